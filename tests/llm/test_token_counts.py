import public_tokenizers
import pytest

from feedpanel.llm.token_counts import load, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return load(PATH)


def expected(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("head", [0, 2000, 1 << 19])
def test_corpus_as_the_library_counts(spark, tokenizer, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, lambda: PATH, head=head).collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == want.keys()
    for k, text in want.items():
        n = expected(tokenizer, text)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(text.encode()), n > 2048)


def test_odd_texts(spark, tokenizer):
    texts = [
        None, "", " \n", "a", "A.", ".", "...", "x.y", "don't, they'll. we've 'S 's.", "<|endoftext|>", "<|ENDOFTEXT|> Word",
        "a<|endoftext|>b, C.", "3.14, 2,718.", "x y z\x1cw", "İSTANBUL ΑΣ. ß", "é, É.", "漢字かな交じり文。", "😀, 😀.", "a\x00b",
        "word," * 5, "Long" * 9000, "many words. " * 4000, "́a b", "end.\n\nNew, line.",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, "a b.", "x"), (0, "a b.", "x"), (None, "a c.", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts(docs, lambda: PATH, head=5).collect())
    want = sorted((i is None, i, expected(tokenizer, t), len((t or "").encode())) for i, t, _ in rows)
    assert got == want
    assert token_counts(docs.limit(0), lambda: PATH).count() == 0


def test_letters_that_compose_before_folding(spark, tokenizer):
    parts = ["H\u0331", "T\u0308", "Y\u030a", "W\u030a", "J\u030c", "A\u030a", "H\u20d0\u0331", "S\u0323\u0307", "K\u212a"]
    texts = [f"{a}{p}{b}" for p in parts for a, b in (("", ""), ("x", "y"), ("X", "Y."), ("Word ", " Word,"), ("\u00c9A", "B"))]
    for neighbour in ("", "<|endoftext|>"):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, neighbour])], "doc_id bigint, text string").coalesce(1)
        got = {r.doc_id: r.n_tokens for r in token_counts(docs, lambda: PATH).collect()}
        assert [got[i] for i in range(len(texts))] == [expected(tokenizer, t) for t in texts]
