"""Statistics against NumPy on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedpanel.functions import tails
from feedpanel.operators import panel, regressions, stats, validation


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 600
    a, b = rng.normal(size=n), rng.normal(size=n)
    user = rng.integers(0, 25, n)
    # a third of all rows belong to one user
    user[: n // 3] = 99
    effect = {u: v for u, v in zip(np.unique(user), rng.normal(scale=1.5, size=26))}
    y = 1 + 2 * a - 0.5 * b + np.array([effect[u] for u in user]) + rng.normal(size=n)
    hit = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + a - 0.7 * b)))).astype(int)
    return pd.DataFrame({"u": user.astype(str), "a": a, "b": b + 0.4 * a, "y": y, "hit": hit, "t": np.round(a, 1)})


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table).repartition(5).cache()


def design(table, xs):
    return np.column_stack([np.ones(len(table)), *[table[x] for x in xs]])


def test_corr_vif_pca(df, table):
    r = {(x["a"], x["b"]): x["r"] for x in stats.corr_matrix(df, ["a", "b", "y"]).collect()}
    want = table[["a", "b", "y"]].corr()
    assert all(v == pytest.approx(want.loc[k]) for k, v in r.items())
    v = {x["variable"]: x["vif"] for x in stats.vif(df, ["a", "b", "y"]).collect()}
    assert list(v.values()) == pytest.approx(np.diag(np.linalg.inv(want)).tolist())
    eig, vec = np.linalg.eigh(want)
    p = stats.pca(df, ["a", "b", "y"]).toPandas()
    top = p[p.component == 1]
    assert top.explained_share.iloc[0] == pytest.approx(eig[-1] / 3)
    assert np.abs(top.loading.to_numpy()) == pytest.approx(np.abs(vec[:, -1]))


def test_spearman(df, table):
    got = stats.spearman_matrix(df.withColumn("b", F.when(F.col("b") > -1, F.col("b"))), ["t", "b", "y"]).collect()
    sub = table.assign(b=table.b.where(table.b > -1))
    for x in got:
        pair = sub[[x["a"], x["b"]]].dropna().rank()
        assert x["rho"] == pytest.approx(pair.corr().iloc[0, 1]) and x["n"] == len(pair)


def test_wilcoxon(df, table):
    row = stats.wilcoxon_ranksum(df.withColumn("g", F.when(F.col("hit") == 1, "one").otherwise("zero")), "t", "g", "one", "zero").first()
    ranks = table.t.rank()
    n1, n2 = int((table.hit == 1).sum()), int((table.hit == 0).sum())
    w = ranks[table.hit == 1].sum() - n1 * (n1 + 1) / 2
    ties = table.t.value_counts()
    sd = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - (ties**3 - ties).sum() / ((n1 + n2) * (n1 + n2 - 1))))
    off = w - n1 * n2 / 2
    z = (off - math.copysign(0.5, off)) / sd
    assert (row["w"], row["z"]) == (pytest.approx(w), pytest.approx(z))
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803)
    assert tails.f_upper(3.0, 2, 20) == pytest.approx(0.0725, abs=2e-4)
    assert tails.f_upper(4.0, 1, 10) == pytest.approx(tails.t_two_sided(2.0, 10))
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_ols(df, table):
    fit = {r["term"]: r for r in regressions.ols(df, "y", ["a", "b"]).collect()}
    x, y = design(table, ["a", "b"]), table.y.to_numpy()
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    sigma2 = rss[0] / (len(y) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sigma2)
    for i, name in enumerate(["(Intercept)", "a", "b"]):
        assert fit[name]["estimate"] == pytest.approx(beta[i])
        assert fit[name]["std_error"] == pytest.approx(se[i])
    per_key = regressions.ols(df, "y", ["a"], ["u"]).filter("term = 'a'").collect()
    assert len(per_key) == table.u.nunique()


def newton(x, y, w):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * mu * (1 - mu))[:, None]), x.T @ (w * (y - mu)))
    return b


def test_logit(df, table):
    fit = {r["term"]: r["estimate"] for r in regressions.logit(df, "hit", ["a", "b"]).collect()}
    want = newton(design(table, ["a", "b"]), table.hit.to_numpy(), np.ones(len(table)))
    assert [fit["(Intercept)"], fit["a"], fit["b"]] == pytest.approx(want.tolist(), abs=1e-6)


def test_boot_logit_solves_every_replicate(spark, df, table):
    draws = regressions.boot_logit(df, "y", "hit", ["a", "b"], reps=8, seed=3).toPandas()
    assert draws.converged.all()
    units = df.select("y", F.xxhash64("y").alias("unit")).toPandas()
    drawn = pd.DataFrame(regressions._draws(units["unit"].to_numpy(), 8, 3), columns=range(1, 9)).assign(y=units["y"])
    weights = drawn.melt("y", var_name="rep", value_name="w")
    for rep, part in weights.groupby("rep"):
        w = table[["y"]].merge(part, on="y")["w"].to_numpy()
        want = newton(design(table, ["a", "b"]), table.hit.to_numpy(), w)
        got = draws[draws.rep == rep].set_index("term").loc[["(Intercept)", "a", "b"], "estimate"]
        assert got.tolist() == pytest.approx(want.tolist(), abs=1e-6)


def test_boot_logit_says_what_did_not_converge(spark):
    apart = spark.createDataFrame([(i, float(i), float(i > 20)) for i in range(40)], "u int, x double, hit double")
    draws = regressions.boot_logit(apart, "u", "hit", ["x"], reps=5).toPandas()
    assert not draws.converged.any() and draws.estimate.isna().all()


def test_large_means_cost_no_digits(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(0, 1, 4000), rng.normal(0, 1, 4000)
    rows = [(i % 7, float(a + 1e6), float(2 * a + b + 1e9), float(2 * a + b)) for i, (a, b) in enumerate(zip(x, e))]
    far = spark.createDataFrame(rows, "g int, x double, y double, small double")
    X = np.column_stack([np.ones(4000), x])
    beta, rss = np.linalg.lstsq(X, 2 * x + e, rcond=None)[:2]
    sigma = math.sqrt(rss[0] / 3998)
    for y in ("y", "small"):
        got = regressions.ols(far, y, ["x"]).toPandas().set_index("term")
        assert got.estimate["x"] == pytest.approx(beta[1], abs=1e-6)
        assert got.sigma["x"] == pytest.approx(sigma, abs=1e-6)
        assert got.std_error["x"] == pytest.approx(sigma * math.sqrt(np.linalg.inv(X.T @ X)[1, 1]), rel=1e-5)
        draws = regressions.cluster_boot_ols(far, "g", y, ["x"], reps=20).toPandas()
        assert draws[draws.term == "x"].estimate.between(1.8, 2.2).all()
        summary, _ = regressions.random_intercept(far, y, ["x"], "g")
        fit = summary.toPandas().set_index("term")
        assert fit.estimate["x"] == pytest.approx(beta[1], abs=5e-3) and fit.within_var["x"] == pytest.approx(sigma**2, rel=1e-2)


def test_short_and_dependent_groups_give_nulls(spark):
    rows = [("short", 1.0, 1.0, 2.0)] + [("same", 1.0, 2.0, float(i)) for i in range(9)] + [("ok", float(i), float(i * i), float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    got = regressions.ols(df, "y", ["a", "b"], ["k"]).toPandas().groupby("k").estimate.apply(lambda e: e.isna().all())
    assert got.to_dict() == {"short": True, "same": True, "ok": False}
    days = df.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("a")))
    assert regressions.var_fit(days, "t", ["a", "y"], 1, keys=["k"]).filter("k = 'short' AND estimate IS NOT NULL").count() == 0
    assert regressions.granger_wald(days, "t", ["a", "y"], 2, keys=["k"]).filter("k <> 'ok' AND f IS NOT NULL").count() == 0
    assert regressions.var_select(days, "t", ["a", "y"], 2, keys=["k"]).filter("k = 'same' AND aic IS NOT NULL").count() == 0


def test_lags_do_not_cross_gaps(spark):
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06"])], "d string, v double")
    df = df.withColumn("d", F.to_date("d"))
    assert [(r.v, r.v_l1) for r in regressions.lag_design(df, [], "d", ["v"], 1).orderBy("d").collect()] == [(1.0, 0.0), (3.0, 2.0)]


def test_poisson_weights(spark):
    w = spark.range(40000).select(regressions.poisson_weight(F.col("id"), F.lit(1), 7).alias("w"))
    row = w.agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("double"))).first()
    assert row[0] == pytest.approx(1, abs=0.03) and row[1] == pytest.approx(1, abs=0.06)
    assert row[2] == pytest.approx(math.exp(-1), abs=0.01)


def test_cluster_boot(df, table):
    draws = regressions.cluster_boot_ols(df, "u", "y", ["a"], reps=12, seed=5).toPandas()
    users = df.select("u").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(12))))
    weights = users.withColumn("w", regressions.poisson_weight(F.col("u"), F.col("rep"), 5)).toPandas()
    for rep, part in weights.groupby("rep"):
        w = table.u.map(part.set_index("u")["w"]).to_numpy()
        x = design(table, ["a"])
        want = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * table.y.to_numpy()))
        got = draws[draws.rep == rep].set_index("term").loc[["(Intercept)", "a"], "estimate"]
        assert got.tolist() == pytest.approx(want.tolist())
    ci = regressions.percentile_ci(df.sparkSession.createDataFrame(draws), ["term"]).toPandas().set_index("term")
    assert ci.loc["a", "lower"] == pytest.approx(np.quantile(draws[draws.term == "a"].estimate, 0.025))


def test_random_intercept(df, table):
    summary, users = regressions.random_intercept(df, "y", ["a"], "u")
    got = summary.toPandas().set_index("term")
    x, y = design(table, ["a"]), table.y.to_numpy()
    z = pd.get_dummies(table.u).to_numpy(dtype=float)

    def criterion(ratio):
        v = np.eye(len(y)) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        xtx = x.T @ vi @ x
        b = np.linalg.solve(xtx, x.T @ vi @ y)
        rss = (y - x @ b) @ vi @ (y - x @ b)
        n, k = x.shape
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xtx)[1] + (n - k) * math.log(rss / (n - k))), b, rss / (n - k)

    ratio = got.loc["a", "between_var"] / got.loc["a", "within_var"]
    here, b, within = criterion(ratio)
    assert here >= max(criterion(ratio * 1.05)[0], criterion(ratio / 1.05)[0])
    assert got["estimate"].tolist() == pytest.approx(b.tolist(), abs=1e-6)
    assert got.loc["a", "within_var"] == pytest.approx(within, rel=1e-6)
    u = ratio * z.T @ np.linalg.inv(np.eye(len(y)) + ratio * z @ z.T) @ (y - x @ b)
    names = pd.get_dummies(table.u).columns
    dev = users.toPandas().set_index("u").loc[names, "deviation"]
    assert dev.tolist() == pytest.approx(u.tolist(), abs=1e-6)


def test_icc(df, table):
    row = stats.icc_anova(df, "y", "u").first()
    g = table.groupby("u").y
    n, k, sizes = len(table), table.u.nunique(), g.size()
    msb = (sizes * (g.mean() - table.y.mean()) ** 2).sum() / (k - 1)
    msw = ((table.y - g.transform("mean")) ** 2).sum() / (n - k)
    n0 = (n - (sizes**2).sum() / n) / (k - 1)
    assert row["icc"] == pytest.approx((msb - msw) / (msb + (n0 - 1) * msw))


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    out = []
    for key in ("k1", "k2"):
        v = np.zeros((200, 2))
        for i in range(1, 200):
            v[i] = [[0.5, 0.3], [0.0, 0.4]] @ v[i - 1] + rng.normal(size=2)
        out.append(pd.DataFrame({"key": key, "day": pd.date_range("2020-01-01", periods=200).date, "p": v[:, 0], "q": v[:, 1]}))
    return pd.concat(out)


def test_var_models(spark, series):
    df = spark.createDataFrame(series)
    fit = regressions.var_fit(df, "day", ["p", "q"], 2, keys=["key"]).toPandas()
    granger = regressions.granger_wald(df, "day", ["p", "q"], 2, keys=["key"]).toPandas()
    select = regressions.var_select(df, "day", ["p", "q"], 4, keys=["key"]).toPandas()
    for key, g in series.groupby("key"):
        v = g[["p", "q"]].to_numpy()
        x = np.column_stack([np.ones(198), v[1:-1], v[:-2]])
        y = v[2:, 0]
        beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
        mine = fit[(fit.key == key) & (fit.equation == "p")].set_index("term")
        assert mine.loc[["(Intercept)", "p_l1", "q_l1", "p_l2", "q_l2"], "estimate"].tolist() == pytest.approx(beta.tolist())
        small = np.linalg.lstsq(x[:, [0, 1, 3]], y, rcond=None)[1]
        f = (small[0] - rss[0]) / 2 / (rss[0] / (198 - 5))
        got = granger[(granger.key == key) & (granger.cause == "q") & (granger.response == "p")].iloc[0]
        assert got["f"] == pytest.approx(f) and got["p_value"] == pytest.approx(tails.f_upper(f, 2, 193))
        x1 = np.column_stack([np.ones(196), v[3:-1]])
        resid = v[4:] - x1 @ np.linalg.lstsq(x1, v[4:], rcond=None)[0]
        aic = np.linalg.slogdet(resid.T @ resid / 196)[1] + 2 * 2 * 3 / 196
        assert select[(select.key == key) & (select.p == 1)].aic.iloc[0] == pytest.approx(aic)


def test_mean_stability(spark):
    values = spark.createDataFrame([(0.0, 3), (1.0, 1)], "value double, weight bigint")
    out = stats.boot_mean_stability(values, [2, 20], reps=2000).toPandas().set_index("n")
    assert out.loc[20, "mean_mean"] == pytest.approx(0.25, abs=0.02)
    assert out.loc[2, "sd_mean"] == pytest.approx(math.sqrt(0.25 * 0.75 / 2), abs=0.02)
    assert out.loc[20, "sd_mean"] < out.loc[2, "sd_mean"]


def test_classifier_metrics(spark):
    rows = [("1", 1, 0.9, 2.0), ("2", 0, 0.8, 1.0), ("3", 1, 0.5, 1.0), ("4", 0, 0.5, 3.0), ("5", 0, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "id string, y int, p double, w double")
    wins = 2 * (1 + 3 + 1) + 1 * (0.5 * 3 + 1)
    assert validation.roc_auc(df).first()["auc"] == pytest.approx(wins / (3 * 5))
    m = validation.precision_recall_f1(df, 0.5).first()
    assert (m["precision"], m["recall"]) == (pytest.approx(3 / 7), 1.0)
    assert validation.precision_recall_f1(df, 2.0).first()["f1"] == 0.0
    assert validation.roc_auc(df.filter("y = 0")).first()["auc"] is None
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in validation.roc_points(df).collect()}
    assert points[0.8] == pytest.approx((0.2, 2 / 3)) and points[0.1] == (1.0, 1.0)


def test_agreement(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)]
    r = validation.agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    po, pe = 0.75, (2 * 1 + 2 * 3) / 16
    assert (r["n"], r["agreement"], r["kappa"]) == (4, 0.75, pytest.approx((po - pe) / (1 - pe)))
    assert r["alpha"] == pytest.approx(1 - 0.25 / (2 * 3 * 5 / (8 * 7)))


def test_stratified_sample(spark):
    pop = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit("de").alias("lang"),
        *[((F.col("id") * m % 1000) / 1000).alias(f"{e}_v2") for e, m in (("anger", 7), ("fear", 11), ("disgust", 13))],
    ).withColumn("stratum", validation.stratum(0.9))
    s = validation.stratified_sample(pop, 10, 25)
    sizes = {r["stratum"]: r["N_stratum"] for r in validation.stratum_sizes(pop).collect()}
    got = s.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    assert {r["stratum"]: r["n"] for r in got} == {k: 25 if k == "low" else 10 for k in sizes}
    assert {r["stratum"]: round(r["w"]) for r in got} == sizes
    assert validation.stratified_sample(pop, 10, 25).exceptAll(s).count() == 0
    sheet = validation.blind(s.withColumn("text_cleaned", F.lit("x")))
    assert sheet.columns == ["id", "lang", "text_cleaned", "anger_manual", "fear_manual", "disgust_manual"]


def test_zscore(df):
    row = panel.zscore(df, ["a", "y"]).agg(F.avg("a"), F.stddev_samp("y")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)


def test_annotations(spark):
    key = spark.createDataFrame([("1", 0.5), ("2", 0.1)], "id string, anger_v2 double")
    coded = spark.createDataFrame([("1", 1, None), ("2", 0, "1"), ("3", 0, None)], "id string, anger_manual int, uncodable string")
    got = validation.annotations_with_key(coded, key).collect()
    assert [r["id"] for r in got] == ["1"]
    assert validation.drop_uncodable(key).count() == 2
