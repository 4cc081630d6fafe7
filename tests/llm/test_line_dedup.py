import random

import pytest
from pyspark.sql import functions as F

from brute import words_of
from feedpanel.llm import line_dedup
from feedpanel.llm.line_dedup import _end_keys, _without_each, drop_lines, line_report, within_one_edit


def close(a, b):
    """Levenshtein distance of two word lists is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least):
    places = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if w := tuple(words_of(line)):
                key = (doc is None, doc or 0, i)
                places[w] = min(places.get(w, key), key)
    near = {w for w, p in places.items() if len(w) >= least and any(len(v) >= least and q < p and close(list(v), list(w)) for v, q in places.items())}
    out = []
    for doc, text in rows:
        found = [(i, tuple(words_of(x))) for i, x in enumerate((text or "").split("\n"))]
        found = [(i, w) for i, w in found if w]
        n = [i for i, w in found if w in near]
        e = [i for i, w in found if w not in near and (doc is None, doc or 0, i) > places[w]]
        out.append((str(doc), len(found), len(e), len(n), ",".join(map(str, sorted(n + e)))))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_lines, r.n_exact, r.n_near, r.dropped) for r in frame.collect())


def test_random_lines_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        rows.append((i if i % 9 else None, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(4))))
    seen = [" ".join(f"w{j}" for j in range(n)) for n in (15, 16, 17, 31, 32, 33)]
    for i in range(80, 120):
        w = rng.choice(seen).split()
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["y"]])
        rows.append((i, "first line here\n" + "  ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 4)
    assert got(line_report(docs, min_words=4)) == want and sum(r[3] for r in want) > 50


def test_lines_within_one_edit_share_an_end(spark):
    rng = random.Random(1)
    lines = []
    for n in range(4, 40):
        w = [f"w{rng.randrange(99)}" for _ in range(n)]
        for at in range(n):
            lines += [(w, w[:at] + ["new"] + w[at + 1 :]), (w, w[:at] + ["new"] + w[at:]), (w + ["z"], w)]
    frame = spark.createDataFrame([(i, side, x) for i, p in enumerate(lines) for side, x in enumerate(p)], "i int, side int, words array<string>")
    frame = frame.withColumn("n", F.size("words")).withColumn("string", F.array_join("words", " "))
    assert frame.filter(line_dedup._n_words() != F.col("n")).count() == 0
    keys = frame.select("i", "side", F.array_compact(F.array(*_end_keys(4)))["key"].alias("k"))
    pairs = keys.filter("side = 0").alias("a").join(keys.filter("side = 1").alias("b"), "i")
    assert pairs.filter(~F.arrays_overlap("a.k", "b.k")).count() == 0


def test_variants_and_edits(spark):
    frame = spark.createDataFrame([(["a"],), (list("abc"),), ([str(i) for i in range(300)],)], "w array<string>")
    for r in frame.select("w", _without_each(F.col("w")).alias("v")).collect():
        shorter = spark.createDataFrame([(r.w[:i] + r.w[i + 1 :],) for i in range(len(r.w))], "w array<string>")
        assert r.v == [x.f for x in shorter.select(line_dedup._full(F.col("w")).alias("f")).collect()]
    words = [(["a", "b"], ["a", "b"], True), (["a", "b"], ["b"], True), (["a", "b"], ["b", "a"], False), (["a"], ["b"], True), (["a", "a"], ["a", "a", "a"], True), (["a", "b", "c"], ["x", "a", "b"], False)]
    pairs = spark.createDataFrame(words, "a array<string>, b array<string>, same boolean")
    assert pairs.filter(within_one_edit(F.col("a"), F.col("b")) != F.col("same")).count() == 0


@pytest.mark.parametrize("rows", [1 << 17, 2])
def test_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "MAP_ROWS", rows)
    base = "one two three four five six seven eight nine"
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [
        (1, f"{base}\nkeep me\n\nkeep me", 0), (2, base.replace("five", "5"), 0), (3, f"  \n{base} ten\nown line", 0), (4, None, 0), (5, "", 0), (6, " \n ", 0),
        (7, "keep  me", 0), (8, "fine\n", 0), (8, "fine\n", 0), (None, "fine\nlast", 0), (9, long, 0), (10, long.replace("w17 ", ""), 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line int")
    left = drop_lines(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([
        (1, f"{base}\nkeep me\n"), (3, "  \nown line"), (4, None), (5, ""), (6, " \n "), (8, "fine\n"), (8, "fine\n"), (None, "last"), (9, long)], key=str)
    assert got(line_report(docs)) == brute([r[:2] for r in rows], 8)
    assert line_report(docs.limit(0)).count() == 0 and drop_lines(docs.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    header = "one two three four five six seven eight nine"
    rows = [(None, f"{header}\nown a"), (None, f"{header}\nown b"), (None, f"{header}\nown b"), (1, "short\nx"), (1, "short\ny"),
            (None, f"last\n{header} ten"), (2, "p\nq"), (2, "p\nq")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [x for r in drop_lines(docs).collect() for x in r.text.split("\n")]
    # rows that repeat id and text are one place, so the header stays once or twice
    assert kept.count(header) in (1, 2) and kept.count("short") == 1 and kept.count("p") == kept.count("q") == 2
    assert kept.count(f"{header} ten") == 0 and kept.count("own a") == 1 and kept.count("own b") == 2
    report = [(r.doc_id, r.n_exact, r.n_near) for r in line_report(docs).collect()]
    assert sum(e for d, e, _ in report if d == 1) == 1 and sum(e for d, e, _ in report if d is None) in (1, 2)


def test_any_columns_and_text_ids(spark):
    """Columns named like the operator's own stay as they are; ids may be texts."""
    names = ["_key", "_all", "_node", "_id", "_dropped", "key", "row", "hash", "a.b"]
    rows = [("b", "one line here\nsame line", *range(9)), ("a", "same line\nanother", *range(9, 18)), ("c", "same line", *range(18, 27))]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r["doc_id"]: tuple(r)[1:] for r in drop_lines(frame).collect()}
    assert got == {"a": ("same line\nanother", *range(9, 18)), "b": ("one line here", *range(9))}
    assert {r["doc_id"]: r["dropped"] for r in line_report(frame).collect()} == {"a": "", "b": "1", "c": "0"}
