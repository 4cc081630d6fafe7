"""Sets of models against one fit at a time and against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedpanel.operators import model_sets, regressions


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 900
    t = pd.DataFrame({c: rng.normal(size=n) for c in "abcd"})
    t["u"] = rng.integers(0, 60, n)
    t["y"] = 2 * t.a - t.b + rng.normal(size=n)
    t["z"] = t.y + t.c + rng.normal(size=n) + 1e6
    t["hit"] = (rng.random(n) < 1 / (1 + np.exp(-t.a + 0.5 * t.d))).astype(float)
    t["same"] = t.a + t.b
    for c, share in (("b", 0.1), ("c", 0.2), ("y", 0.05)):
        t.loc[rng.random(n) < share, c] = np.nan
    return t


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(table.itertuples(index=False))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in table.columns)).withColumn("k", F.col("u") % 3)


MODELS = {"one": ("y", ["a"]), "two": ("y", ["a", "b"]), "turned": ("a", ["y", "c", "d"]), "far": ("z", ["a", "b", "c"]), "dependent": ("y", ["a", "b", "same"])}


def test_sweep():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    m = x.T @ x
    swept = model_sets.sweep(m, [0, 2])
    at, rest = [0, 2], [1, 3]
    inverse = np.linalg.inv(m[np.ix_(at, at)])
    assert np.allclose(swept[np.ix_(at, at)], inverse)
    assert np.allclose(swept[np.ix_(at, rest)], inverse @ m[np.ix_(at, rest)])
    assert np.allclose(swept[np.ix_(rest, rest)], m[np.ix_(rest, rest)] - m[np.ix_(rest, at)] @ inverse @ m[np.ix_(at, rest)])
    assert model_sets.sweep(np.ones((2, 2)), [0, 1]) is None


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ols_set_equals_single_fits(df, keys):
    got = model_sets.ols_set(df, MODELS, keys).toPandas().set_index([*keys, "model", "term"]).sort_index()
    assert got.estimate.isna().groupby("model").all().to_dict() == {m: m == "dependent" for m in MODELS}
    for name, (y, xs) in MODELS.items():
        one = regressions.ols(df, y, xs, keys).toPandas().set_index([*keys, "term"]).sort_index()
        mine = got.xs(name, level="model").sort_index()
        pd.testing.assert_frame_equal(mine[one.columns], one, check_dtype=False, rtol=1e-7, atol=1e-9)


def jobs(context, name, make):
    context.setJobGroup(name, name)
    make()
    count = len(context.statusTracker().getJobIdsForGroup(name))
    context.setLocalProperty("spark.jobGroup.id", None)
    return count


def test_one_reading_for_the_set(spark, df):
    scans = model_sets.ols_set(df, MODELS)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans == 1
    context = spark.sparkContext
    one = jobs(context, "one", lambda: model_sets.cluster_boot_set(df, "u", {"one": MODELS["one"]}, reps=5).collect())
    all_of_them = jobs(context, "all", lambda: model_sets.cluster_boot_set(df, "u", MODELS, reps=5).collect())
    assert one == all_of_them


def weighted(table, y, xs, w):
    t = table[[*xs, y]].assign(w=w).dropna()
    x = np.column_stack([np.ones(len(t)), t[list(xs)]])
    return np.linalg.lstsq(x * np.sqrt(t.w.to_numpy())[:, None], t[y].to_numpy() * np.sqrt(t.w.to_numpy()), rcond=None)[0]


def test_cluster_boot_set(spark, df, table):
    draws = model_sets.cluster_boot_set(df, "u", MODELS, reps=7, seed=5).toPandas()
    units = df.select("u", F.xxhash64("u").alias("unit")).distinct().toPandas()
    drawn = pd.DataFrame(regressions._draws(units["unit"].to_numpy(), 7, 5), index=units["u"].astype(int), columns=range(1, 8))
    for name, (y, xs) in MODELS.items():
        for rep in range(1, 8):
            got = draws[(draws.model == name) & (draws.rep == rep)].set_index("term").loc[["(Intercept)", *xs], "estimate"]
            if name == "dependent":
                assert got.isna().all()
            else:
                assert got.tolist() == pytest.approx(weighted(table, y, xs, table.u.map(drawn[rep]).to_numpy()).tolist(), rel=1e-6)
    alone = model_sets.cluster_boot_set(df, "u", {"two": MODELS["two"]}, reps=7, seed=5).toPandas()
    both = draws[draws.model == "two"].merge(alone, on=["rep", "term"])
    assert np.allclose(both.estimate_x, both.estimate_y)


LOGITS = {"one": ("hit", ["a"]), "two": ("hit", ["a", "d"]), "gaps": ("hit", ["a", "b", "c"]), "apart": ("hit", ["double"])}


def test_logit_set_equals_single_fits(df):
    data = df.withColumn("double", F.col("hit") * 2)
    got = model_sets.logit_set(data, LOGITS).toPandas().set_index(["model", "term"])
    assert got.loc["apart"].estimate.isna().all()
    for name in ("one", "two", "gaps"):
        y, xs = LOGITS[name]
        one = regressions.logit(df, y, xs).toPandas().set_index("term")
        pd.testing.assert_frame_equal(got.loc[name].loc[one.index][one.columns], one, rtol=1e-5, atol=1e-7)


def test_boot_logit_set_equals_single_fits(df):
    data = df.withColumn("double", F.col("hit") * 2)
    draws = model_sets.boot_logit_set(data, "u", LOGITS, reps=6, seed=3).toPandas()
    assert draws.groupby("model").converged.all().to_dict() == {m: m != "apart" for m in LOGITS}
    for name in ("one", "gaps"):
        y, xs = LOGITS[name]
        one = regressions.boot_logit(df, "u", y, xs, reps=6, seed=3).toPandas()
        both = draws[draws.model == name].merge(one, on=["rep", "term"])
        assert len(both) == 6 * (len(xs) + 1) and np.allclose(both.estimate_x, both.estimate_y, atol=1e-7)


def test_no_rows(df):
    none = df.limit(0)
    assert model_sets.ols_set(none, {"one": MODELS["one"]}).filter("estimate IS NOT NULL").count() == 0
    assert model_sets.cluster_boot_set(none, "u", {"one": MODELS["one"]}, reps=3).count() == 0
    assert model_sets.logit_set(none, {"one": LOGITS["one"]}).filter("estimate IS NOT NULL").count() == 0
