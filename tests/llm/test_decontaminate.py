import hashlib
import random
import re

import pytest

from feedpanel.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - window + 1, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        found.discard("None")
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def test_corpus_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, tests = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    found = contamination(docs, items)
    assert got(found) == brute(rows, tests, 10)
    left = {r.doc_id for r in drop_contaminated(docs, items).collect()}
    assert left == {r.doc_id for r in found.filter("NOT contaminated").collect()}


@pytest.mark.parametrize("pass_words", [1 << 22, 40])
def test_small_vocabulary(spark, pass_words):
    rng = random.Random(pass_words)
    text = lambda n: " ".join(rng.choice("aB c;d é".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    items = [(i % 25, text(rng.randint(0, 9))) for i in range(30)] + [(None, "a a b b c")]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(d, t, window=5, pass_words=pass_words)
    assert got(found) == brute(docs, items, 5)
    for r in found.collect():
        words = {i for s in r.spans for i in range(s.start, s.end)}
        assert len(words) == r.n_hit and r.longest == max((s.end - s.start for s in r.spans), default=0) or len(r.spans)


def test_longest_match_goes_beyond_the_window(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, f"x {passage} y")], "doc_id bigint, text string")
    t = spark.createDataFrame([(7, f"q {passage} z")], "item_id bigint, text string")
    r = contamination(d, t).first()
    assert (r.longest, r.n_hit, [tuple(s) for s in r.spans], r["items"]) == (40, 40, [(1, 41)], ["7"])


def test_long_item(spark):
    item = " ".join(f"w{i}" for i in range(50))
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(41)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("x", item)], "item_id string, text string")
    assert {r.n_hit for r in contamination(d, t).collect()} == {10}


def brute_longest(text, items, window):
    w, best = words_of(text), 0
    for _, item in items:
        q = words_of(item)
        if 0 < len(q) < window:
            best = max(best, len(q) * any(w[i : i + len(q)] == q for i in range(len(w) - len(q) + 1)))
            continue
        row = [0] * (len(q) + 1)
        for x in w:
            row = [0, *(row[j] + 1 if x == q[j] else 0 for j in range(len(q)))]
            best = max(best, max(row) if max(row) >= window else 0)
    return best


@pytest.mark.parametrize("pass_words", [1 << 19, 60])
def test_longest_match_against_brute_force(spark, pass_words):
    rng = random.Random(4)
    text = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90), "ab" if i % 2 else "abcdef")) for i in range(50)] + [(99, "a " * 70)]
    items = [(i, text(rng.randint(0, 70), "ab" if i % 3 else "abcdef")) for i in range(20)] + [(50, "a " * 40), (51, "b " * 33)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: r.longest for r in contamination(d, t, window=5, pass_words=pass_words).collect()}
    assert found == {i: brute_longest(x, items, 5) for i, x in docs}


def test_matches_of_any_length_and_of_repeated_words(spark):
    unlike, alike = " ".join(f"w{i}" for i in range(10_000)), "again " * 10_000
    d = spark.createDataFrame([(1, unlike), (2, alike), (3, "again " * 30_000)], "doc_id bigint, text string")
    t = spark.createDataFrame([(7, f"q {unlike}"), (8, alike)], "item_id bigint, text string")
    assert {r.doc_id: (r.longest, r.n_hit, r.n_items) for r in contamination(d, t).collect()} == {1: (10_000, 10_000, 1), 2: (10_000, 10_000, 1), 3: (10_000, 30_000, 1)}


def test_parts_of_the_benchmark_go_one_after_the_other(spark, monkeypatch):
    from feedpanel.llm import decontaminate

    items = [(i, f"item number {i} has words of its own x{i} y{i} z{i}") for i in range(40)]
    docs = [(i, f"before {items[i][1]} after" if i % 3 else f"clean text {i}") for i in range(40)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    made = decontaminate.passages_of
    monkeypatch.setattr(decontaminate, "passages_of", lambda items, window: made(items, window, pass_words=100))
    assert len(decontaminate.passages_of(t, 10)) > 3
    assert sorted(r.doc_id for r in drop_contaminated(d, t).collect()) == list(range(0, 40, 3))


def test_odd_rows(spark):
    docs = [(1, None, 0), (2, "", 0), (None, "one two", 0), (3, "One-TWO", 0), (3, "One-TWO", 0), (4, "one " * 50_000 + "two", 0), (5, "é" * 100_000, 0)]
    items = [(1, None), (2, ""), (3, "one two"), (4, " ONE, two."), (None, "ééé")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, items int")
    t = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(contamination(d, t)) == brute([r[:2] for r in docs], items, 10)
    left = drop_contaminated(d, t)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert contamination(d.limit(0), t).count() == 0
    assert {r.n_hit for r in contamination(d, t.limit(0)).collect()} == {0}
