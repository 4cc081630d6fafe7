import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedpanel.llm import language
from feedpanel.llm.language import Network, Reader, cut, fit, keep_known, languages, padded


def exact(network):
    """The same network in double precision."""
    for d in (network.ahead, network.behind):
        d.byte, d.state = d.byte.astype(float), d.state.astype(float)
    network.weight, network.bias = network.weight.astype(float), network.bias.astype(float)
    return network


def naive(network, word):
    """Position probabilities of one piece, written out step by step."""
    def states(d, seq):
        h, out, m = np.zeros(d.hidden), [], d.hidden
        for b in seq:
            x, u = d.byte[b], h @ d.state
            z, r = (1 / (1 + np.exp(-(x[i * m : (i + 1) * m] + u[i * m : (i + 1) * m]))) for i in (0, 1))
            new = np.tanh(x[2 * m :] + r * u[2 * m :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    a, b = states(network.ahead, word), states(network.behind, word[::-1])[::-1]
    p = []
    for x, y in zip(a, b, strict=True):
        e = np.exp(np.concatenate([x, y]) @ network.weight + network.bias)
        p.append(e / e.sum())
    return np.array(p)


def test_gradients_by_differences():
    network = exact(Network(["a", "b", "c"], hidden=4, seed=1))
    pieces = [b"abc", b"zbacz", b"c"]
    x, lengths, label = padded(pieces), np.array([3, 5, 1]), np.array([0, 2, 1])
    _, grads = network.gradients(x, lengths, label)
    rng = np.random.default_rng(0)
    for p, g in zip(network.parameters(), grads, strict=True):
        for i in rng.choice(p.size, min(p.size, 40), replace=False) if p.shape[0] != 256 else [ord(c) * p.shape[1] + j for c in "abcz" for j in range(12)]:
            flat, old = p.reshape(-1), p.reshape(-1)[i]
            flat[i] = old + 1e-5
            up = network.gradients(x, lengths, label)[0]
            flat[i] = old - 1e-5
            down = network.gradients(x, lengths, label)[0]
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-7


def test_documents_pool_all_positions(monkeypatch):
    network = exact(Network(["a", "b"], hidden=5, seed=2))
    monkeypatch.setattr(language, "_CHUNK", 3)
    texts = ["one two one", "", "x" * 100 + " yé", "  tab\tone\n", "1 2", None]
    names, scores = Reader(network).languages(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        p = np.concatenate([naive(network, piece) for w in text.encode().split() for piece in cut(w)]).mean(0)
        assert name == network.langs[p.argmax()] and abs(score - p.max()) < 1e-6


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return fit(docs)


def test_held_out_accuracy(docs, network):
    got = languages(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 250 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_from_the_allowed_rows_only(docs):
    """Labels of held-out rows, and the order of the rows, change nothing."""
    other = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang"))).orderBy(F.desc("doc_id"))
    a, b = (fit(d, docs_per_lang=10, words_per_doc=20, epochs=1) for d in (docs, other))
    assert a.langs == b.langs and all((x == y).all() for x, y in zip(a.parameters(), b.parameters(), strict=True))


def test_odd_rows(spark, network):
    rows = [(1, None, "en", 0.5), (2, "", None, 0.5), (None, "the and of that", "en", 0.5), (3, "12 345 !", "en", 0.5), (4, "the " * 50_000, None, 0.5),
            (5, "z" * 100_000, "en", 0.5), (6, "the of", "en", 0.5), (6, "the of", "en", 0.5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in languages(frame, network).collect()}
    assert got == {(1, True, True), (2, True, True), (None, False, False), (3, True, True), (4, False, False), (5, False, False), (6, False, False)}
    left = keep_known(frame, network)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} >= {None, 4, 6}
    assert not {1, 2, 3} & {r.doc_id for r in left.collect()}
    assert languages(frame.limit(0), network).count() == 0


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "the and", None), (1, None, "en")], "doc_id bigint, text string, lang string")
    network = fit(frame)
    assert network.langs == [] and {(r.lang_pred, r.score) for r in languages(frame, network).collect()} == {("und", 0.0)}
    assert fit(frame.limit(0)).langs == []


def test_every_part_of_a_long_word_is_learned_from(spark):
    word = "漢字é" * 200
    parts = language.stretches(word.encode())
    assert b"".join(parts) == word.encode() and max(map(len, parts)) <= language.STRETCH
    assert "".join(p.decode() for p in parts) == word and language.stretches(b"") == [b""]
    # two languages that differ only behind the first 128 bytes of their single word
    rows = [(i, "." * 128 + ("abc" if i % 2 else "xyz") * 300, "l" + str(i % 2)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = languages(frame, fit(frame, epochs=20)).collect()
    assert all(r.lang_pred == "l" + str(r.doc_id % 2) for r in got)


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 20, f"l{i % 300}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(fit(frame, learn=F.lit(True), epochs=1, words_per_doc=2).langs) == 300
