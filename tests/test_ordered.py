"""Ordered primitives against plain Python, with one key holding most rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedpanel.operators import ordered
from feedpanel.session import slots


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}"
        out.append((key, rng.randrange(900), i, rng.choice([None, rng.random()])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, t int, id int, x double").repartition(6).cache()


@pytest.fixture(params=["coalesced", "split"])
def splits(request, spark):
    """Small data normally ends up in one split; force several as well."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param == "coalesced")
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def test_hot_key_is_spread(spark, df):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    parts = ordered.split_by_order(df, ["key"], ["t", "id"])
    biggest = parts.groupBy("_part").count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert biggest < 4000 * 0.35


def test_running_sums(df, rows, splits):
    out = ordered.running_sums(df, ["key"], ["t", "id"], {"n": F.lit(1).cast("bigint"), "s": F.col("x")})
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        s = 0.0
        for i, r in enumerate(group):
            s += r[3] or 0.0
            assert got[r[2]]["n"] == i + 1 and got[r[2]]["n_total"] == len(group)
            assert got[r[2]]["s"] == pytest.approx(s)


def test_previous_values(df, rows, splits):
    got = {r["id"]: r["prev_x"] for r in ordered.previous_values(df, ["key"], ["t", "id"], ["x"]).collect()}
    for group in by_key(rows).values():
        before = None
        for r in group:
            assert got[r[2]] == before
            before = r[3]


def test_last_known(df, rows, splits):
    got = {r["id"]: r["seen"] for r in ordered.last_known(df, ["key"], ["t", "id"], "x", "seen").collect()}
    for group in by_key(rows).values():
        seen = None
        for r in group:
            seen = seen if r[3] is None else r[3]
            assert got[r[2]] == seen


def test_ranks_and_quantiles(df, rows, splits):
    t = sorted(r[1] for r in rows)
    ranks = {r["t"]: r for r in ordered.value_ranks(df, [], "t").collect()}
    for v in set(t):
        first, last = t.index(v) + 1, len(t) - t[::-1].index(v)
        assert ranks[v]["avg_rank"] == (first + last) / 2
    x = [r[3] for r in rows if r[3] is not None]
    q = ordered.exact_quantiles(df, [], "x", {"a": 0.25, "b": 0.9, "c": 1.0}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(np.quantile(x, [0.25, 0.9, 1.0]).tolist())


def test_row_numbers(df, rows, splits):
    got = [r["row_number"] for r in ordered.row_numbers(df, ["t", "id"]).orderBy("t", "id").collect()]
    assert got == list(range(1, len(rows) + 1))


def test_column_quantiles(spark, df, rows, splits, monkeypatch):
    x = [r[3] for r in rows if r[3] is not None]
    t = [float(r[1]) for r in rows]
    probs = {"a": 0.0, "b": 0.333, "c": 0.75, "d": 0.999, "e": 1.0}
    wide = df.select("x", F.col("t").cast("double").alias("t"), F.lit(None).cast("double").alias("empty"))
    # a fine sketch, and one too coarse to bracket anything well
    for sketch in (10_000, 3):
        monkeypatch.setattr(ordered, "_SKETCH", sketch)
        got = {r["variable"]: [r[p] for p in probs] for r in ordered.column_quantiles(wide, ["x", "t", "empty"], probs).collect()}
        assert set(got) == {"x", "t", "empty"} and got["empty"] == [None] * len(probs)
        assert got["x"] == pytest.approx(np.quantile(x, list(probs.values())).tolist())
        assert got["t"] == pytest.approx(np.quantile(t, list(probs.values())).tolist())
    tied = df.select(F.when(F.col("key") == "hot", 0.5).otherwise(F.col("x")).alias("x"))
    values = [0.5 if r[0] == "hot" else r[3] for r in rows]
    want = np.quantile([v for v in values if v is not None], 0.6)
    assert ordered.column_quantiles(tied, ["x"], {"q": 0.6}).first()["q"] == pytest.approx(want)


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows(df, rows, splits, n):
    got = {(r["key"], r["id"]): r["rn"] for r in ordered.first_rows(df, ["key"], ["t", "id"], n).collect()}
    want = {(k, r[2]): i + 1 for k, g in by_key(rows).items() for i, r in enumerate(g[:n])}
    assert got == want


def test_one_shuffle_of_the_rows(spark, df):
    """The rows are shuffled by their range when they are stored; afterwards only edges of splits are."""
    def shuffled(out):
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        return sum("Exchange hashpartitioning" in line or "Exchange SinglePartition" in line for line in plan), sum("Exchange range" in line for line in plan)

    sums = ordered.running_sums(df, ["key"], ["t", "id"], {"n": F.lit(1).cast("bigint")})
    last = ordered.previous_values(df, ["key"], ["t", "id"], ["x"])
    known = ordered.last_known(df, ["key"], ["t", "id"], "x", "seen")
    # one of the edges by key, at most two rows per split
    assert [shuffled(out) for out in (sums, last, known)] == [(1, 0)] * 3


def test_slots(spark):
    for n in (1, 8, 211):
        table = spark.createDataFrame([(i, s) for i, s in enumerate(slots(n))], "i int, s int")
        assert table.filter(F.pmod(F.hash("s"), F.lit(n)) != F.col("i")).count() == 0


def test_null_keys_over_many_splits(spark, splits):
    rows = [(None if i % 3 else "a", i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "key string, i int").repartition(7)
    got = {r["i"]: (r["n"], r["n_total"]) for r in ordered.running_sums(frame, ["key"], ["i"], {"n": F.lit(1).cast("bigint")}).collect()}
    assert got == {i: (i // 3 + 1, 1000) if i % 3 == 0 else (i - i // 3, 2000) for i in range(3000)}
    back = {r["i"]: r["prev_i"] for r in ordered.previous_values(frame, ["key"], ["i"], ["i"]).collect()}
    assert back[0] is None and back[1] is None and back[300] == 297 and back[301] == 299 and back[302] == 301
    assert ordered.running_sums(frame.limit(0), [], ["i"], {"n": F.lit(1)}).count() == 0
