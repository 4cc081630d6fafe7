import random

from feedpanel.llm import mixing
from feedpanel.llm.mixing import MOST, WEIGHTS, mix, mixed_docs


def brute_targets(sizes):
    """Sharing by weight, the excess of full sources reshared until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(MOST * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: MOST * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = {s for s in open_ if target[s] > MOST * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_and_taken(spark):
    rng = random.Random(2)
    sources = ["b", "a", "é", "Z", None, "tiny", "empty"]
    rows = []
    for i in range(3000):
        s = rng.choices(sources, [900, 300, 200, 100, 50, 2, 0])[0]
        rows.append((i, " ".join(["w"] * rng.randint(0, 40)), s))
    rows += [(9001, None, "empty"), (9002, " ", "empty"), (None, "a b c", "a"), (7000, "x y", "b"), (7000, "x y", "b"), (7000, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= MOST * r.size
    assert set(by) == {(sizes[s], round(float(want[s]), 6)) for s in sizes}
    for (_, target), part in by.items():
        assert abs(sum(r.taken for r in part) - target) <= 80
    assert sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    kept = mixed_docs(docs)
    assert kept.columns == [*docs.columns, "copies"]
    assert sum(r.copies * len(r.text.split()) for r in kept.collect()) == sum(r.taken for r in got)


def test_many_parts_give_the_same_mix(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', cast(id % 17 AS int)) AS text", "cast(id % 3 AS string) AS source")
    one = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(mixing, "_digits", lambda rows: 2)
    assert sorted(map(tuple, mix(docs).collect())) == one


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (1, "", "a", 5)], "doc_id bigint, text string, source string, taken int")
    assert {(r.size, r.target, r.taken) for r in mix(docs).collect()} == {(0, 0.0, 0)}
    assert mix(docs.limit(0)).count() == 0 and mixed_docs(docs).count() == 0


def test_any_columns(spark):
    """Columns named like the operator's own stay as they are."""
    names = ["_words", "copies", "copies_1", "_id", "_size", "key", "row", "words", "from", "a.b"]
    rows = [(str(i), f"{'w ' * (i % 9 + 1)}", "ab"[i % 2], *range(i, i + 10)) for i in range(40)]
    out = mixed_docs(spark.createDataFrame(rows, ["doc_id", "text", "source", *names]))
    assert out.columns == ["doc_id", "text", "source", *names, "copies_2"]
    assert {tuple(r)[:-1] for r in out.collect()} <= set(rows) and out.count() > 10
