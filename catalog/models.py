"""Correlations, tests, regressions, series models, validation, release."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import POSTS, TEXTS, keyed, query, scored_sql
from catalog.daily import PROPS, make_daily, r, rounded, shares_sql
from catalog.users import (
    FEATURES_SQL, GROUP_FEATURES_SQL, HOURS, WINDOWS_SQL, _BASE, make_features, make_group_features, make_windows,
)
from feedpanel.operators import (
    daily, features, model_sets, panel, regressions, release, scoring, sharers, stats, validation, windows,
)
from feedpanel.plans import flows
from feedpanel.schema import EMOTIONS
from feedpanel.session import materialize

BASELINES = [f"{e}_baseline" for e in EMOTIONS]


# --- correlations ----------------------------------------------------------
def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


_CC = ["prop_news", "prop_misinfo", "prop_anger", "prop_fear"]


@query("corr_matrix_daily", f"{shares_sql()} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM shares" for a, b in _pairs(_CC)))
def corr_matrix_daily(t):
    return rounded(stats.corr_matrix(daily.daily_shares(make_daily(t)), _CC))


@query("corr_matrix_changes", f"{shares_sql()}, d AS (SELECT {', '.join(f'{c} - lag({c}) OVER (ORDER BY day) AS d_{c}' for c in _CC)} FROM shares) " + " UNION ALL ".join(f"SELECT 'd_{a}' AS a, 'd_{b}' AS b, {r(f'corr(d_{a}, d_{b})', 'r')} FROM d" for a, b in _pairs(_CC)))
def corr_matrix_changes(t):
    d = daily.differences(daily.daily_shares(make_daily(t)), _CC)
    return rounded(stats.corr_matrix(d, [f"d_{c}" for c in _CC]))


_SP = ["anger_baseline", "anger_instability", "n_news_shared", "n_tweets"]


def _spear(a, b):
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r('corr(x, y)', 'rho')} FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM features WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("spearman_matrix", f"{FEATURES_SQL} " + " UNION ALL ".join(_spear(a, b) for a, b in _pairs(_SP)))
def spearman_matrix(t):
    return rounded(stats.spearman_matrix(make_features(t), _SP))


_R3 = "b AS (SELECT corr(anger_baseline, fear_baseline) AS r12, corr(anger_baseline, disgust_baseline) AS r13, corr(fear_baseline, disgust_baseline) AS r23 FROM base), d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 ^ 2 - r13 ^ 2 - r23 ^ 2 AS det FROM b)"


@query("vif", f"WITH {scored_sql()}, {_BASE}, {_R3} SELECT 'anger_baseline' AS variable, {r('(1 - r23 ^ 2) / det', 'vif')} FROM d UNION ALL SELECT 'fear_baseline', round((1 - r13 ^ 2) / det, 6) FROM d UNION ALL SELECT 'disgust_baseline', round((1 - r12 ^ 2) / det, 6) FROM d")
def vif(t):
    return rounded(stats.vif(features.user_baseline(t.scored()), BASELINES))


@query("pca_two", f"WITH {scored_sql()}, {_BASE}, c AS (SELECT corr(anger_baseline, fear_baseline) AS r FROM base) SELECT k AS component, round((1 + CASE k WHEN 1 THEN 1 ELSE -1 END * abs(r)) / 2, 6) + 0.0 AS explained_share FROM c, (SELECT unnest([1, 2]) AS k)")
def pca_two(t):
    p = stats.pca(features.user_baseline(t.scored()), ["anger_baseline", "fear_baseline"])
    return rounded(p.select("component", "explained_share").distinct())


@query("pca_features")
def pca_features(t):
    return rounded(stats.pca(make_features(t), [f"{e}_{m}" for e in ("anger", "fear") for m in features.MEASURES]))


@query("describe_features", f"""{FEATURES_SQL}, l AS (SELECT 'anger_baseline' AS variable, anger_baseline AS v FROM features UNION ALL SELECT 'anger_instability', anger_instability FROM features UNION ALL SELECT 'fear_inertia', fear_inertia FROM features)
 SELECT variable, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('min(v)', '"min"')}, {r('max(v)', '"max"')}, count(*) - count(v) AS n_missing, {r('quantile_cont(v, 0.5)', 'median')} FROM l GROUP BY 1""")
def describe_features(t):
    return rounded(daily.describe(make_features(t), ["anger_baseline", "anger_instability", "fear_inertia"]))


# --- tests -----------------------------------------------------------------
# Rank sums, tie counts and z per metric, written with window functions.
_WILCOXON = f"""{GROUP_FEATURES_SQL}, rk AS (SELECT metric, "group", rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY metric, value) AS ties FROM gl),
 sm AS (SELECT metric, count(*) FILTER ("group" = 'Trustworthy') AS n1, count(*) FILTER ("group" = 'Untrustworthy') AS n2, sum(rk) FILTER ("group" = 'Trustworthy') AS r1, sum(CAST(ties AS DOUBLE) ^ 2 - 1) AS tt FROM rk GROUP BY 1),
 w AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS w FROM sm),
 zs AS (SELECT *, (w - n1 * n2 / 2.0 - sign(w - n1 * n2 / 2.0) * 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z FROM w)"""


@query("wilcoxon_groups", f"{_WILCOXON} SELECT metric, n1 AS n_first, n2 AS n_second, {r('w', 'w')}, {r('z', 'z')} FROM zs")
def wilcoxon_groups(t):
    cols = [f"{e}_{m}" for e in EMOTIONS for m in features.MEASURES]
    long = make_group_features(t).unpivot(["group"], cols, "metric", "value")
    out = stats.wilcoxon_ranksum(long, "value", "group", "Trustworthy", "Untrustworthy", ["metric"])
    return rounded(out.select("metric", "n_first", "n_second", "w", "z"))


# Normal quantiles of two-sided p = 0.05, 0.01 and 0.001.
@query("wilcoxon_significance", f"{_WILCOXON} SELECT metric, CASE WHEN abs(z) > 3.290526731 THEN '***' WHEN abs(z) > 2.575829304 THEN '**' WHEN abs(z) > 1.959963985 THEN '*' ELSE 'ns' END AS significance FROM zs")
def wilcoxon_significance(t):
    cols = [f"{e}_{m}" for e in EMOTIONS for m in features.MEASURES]
    long = make_group_features(t).unpivot(["group"], cols, "metric", "value")
    out = stats.wilcoxon_ranksum(long, "value", "group", "Trustworthy", "Untrustworthy", ["metric"])
    return out.select("metric", "significance")


@query("icc_anova", f"""{WINDOWS_SQL}, x AS (SELECT author_id, mean_anger_after AS v FROM win WHERE mean_anger_after IS NOT NULL),
 g AS (SELECT author_id, count(*) AS n, avg(v) AS m FROM x GROUP BY 1), tot AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * m) / sum(n) AS gm FROM g),
 ss AS (SELECT (SELECT sum(n * (m - gm) ^ 2) FROM g, tot) AS ssb, (SELECT sum((v - m) ^ 2) FROM x JOIN g USING (author_id)) AS ssw),
 ms AS (SELECT k, nn, ssb / (k - 1) AS msb, ssw / (nn - k) AS msw, (nn - n2 / CAST(nn AS DOUBLE)) / (k - 1) AS n0 FROM tot, ss)
 SELECT k AS n_groups, CAST(nn AS BIGINT) AS n_rows, {r('msb', 'ms_between')}, {r('msw', 'ms_within')}, {r('(msb - msw) / (msb + (n0 - 1) * msw)', 'icc')} FROM ms""")
def icc_anova(t):
    return rounded(stats.icc_anova(make_windows(t), "mean_anger_after", "author_id"))


@query("boot_mean_stability")
def boot_mean_stability(t):
    values = windows.window_values(t.scored(), make_windows(t), HOURS, "anger", "before")
    return rounded(stats.boot_mean_stability(values, reps=1000))


# --- regressions -----------------------------------------------------------
_U = "(100 - event_score) / 100.0"


@query("ols_after", f"{WINDOWS_SQL}, x AS (SELECT mean_anger_after AS y, {_U} AS u FROM win WHERE mean_anger_after IS NOT NULL) SELECT 'untrustworthy' AS term, count(*) AS n, {r('regr_slope(y, u)', 'estimate')}, {r('regr_r2(y, u)', 'r_squared')}, {r('sqrt((1 - regr_r2(y, u)) * regr_syy(y, u) / (count(*) - 2))', 'sigma')} FROM x UNION ALL SELECT '(Intercept)', count(*), round(regr_intercept(y, u), 6) + 0.0, round(regr_r2(y, u), 6) + 0.0, round(sqrt((1 - regr_r2(y, u)) * regr_syy(y, u) / (count(*) - 2)), 6) FROM x")
def ols_after(t):
    w = windows.with_untrust_degree(make_windows(t))
    return rounded(regressions.ols(w, "mean_anger_after", ["untrustworthy"]).select("term", "n", "estimate", "r_squared", "sigma"))


def _two(y, a, b, name_a, name_b, rel, extra=""):
    """Both slopes of y ~ a + b from correlations."""
    ra, rb, rab = f"corr({y}, {a})", f"corr({y}, {b})", f"corr({a}, {b})"
    one = f"stddev_samp({y}) / stddev_samp({a}) * ({ra} - {rb} * {rab}) / (1 - {rab} ^ 2)"
    two = f"stddev_samp({y}) / stddev_samp({b}) * ({rb} - {ra} * {rab}) / (1 - {rab} ^ 2)"
    grp = f"GROUP BY {extra}" if extra else ""
    pre = f"{extra}, " if extra else ""
    return f"SELECT {pre}'{name_a}' AS term, count(*) AS n, {r(one, 'estimate')} FROM {rel} {grp} UNION ALL SELECT {pre}'{name_b}', count(*), round({two}, 6) + 0.0 FROM {rel} {grp}"


@query("ols_change", f"{WINDOWS_SQL}, x AS (SELECT mean_anger_after AS y, {_U} AS u, mean_anger_before AS b FROM win WHERE mean_anger_after IS NOT NULL AND mean_anger_before IS NOT NULL) " + _two("y", "u", "b", "untrustworthy", "mean_anger_before", "x"))
def ols_change(t):
    w = windows.with_untrust_degree(make_windows(t))
    fit = regressions.ols(w, "mean_anger_after", ["untrustworthy", "mean_anger_before"])
    return rounded(fit.filter("term <> '(Intercept)'").select("term", "n", "estimate"))


@query("random_intercept")
def random_intercept(t):
    w = windows.with_untrust_degree(make_windows(t))
    return rounded(regressions.random_intercept(w, "mean_anger_after", ["untrustworthy"], "author_id")[0])


@query("random_intercept_users")
def random_intercept_users(t):
    w = windows.with_untrust_degree(make_windows(t))
    return rounded(regressions.random_intercept(w, "mean_anger_after", ["untrustworthy"], "author_id")[1])


@query("cluster_boot_ols")
def cluster_boot_ols(t):
    w = windows.with_untrust_degree(make_windows(t))
    draws = regressions.cluster_boot_ols(w, "author_id", "mean_anger_after", ["untrustworthy"], reps=1000)
    return rounded(regressions.percentile_ci(draws, ["term"]).drop("or_lower", "or_upper"))


# Nearly every test user shares news, so the outcome is "more than 10 posts".
def make_model_users(t):
    f = features.user_baseline(t.scored()).dropna(subset=BASELINES)
    f = f.withColumns({"y": (F.col("n_untrustworthy_shared") > 10).cast("int"), "log_n_scored": F.log("n_scored")})
    return panel.zscore(f, [*BASELINES, "log_n_scored"]).select("author_id", "y", *BASELINES, "log_n_scored")


_IRLS = f"""WITH RECURSIVE {scored_sql()}, {_BASE},
m AS (SELECT CAST(n_untrustworthy_shared > 10 AS INTEGER) AS y, (anger_baseline - avg(anger_baseline) OVER ()) / stddev_samp(anger_baseline) OVER () AS x FROM base WHERE anger_baseline IS NOT NULL AND fear_baseline IS NOT NULL AND disgust_baseline IS NOT NULL),
it AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 UNION ALL
 SELECT i + 1, b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 ^ 2), b1 + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 ^ 2) FROM
 (SELECT i, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
  FROM (SELECT it.*, y, x, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, m WHERE i < 15) GROUP BY i, b0, b1))"""


@query("logit_anger", f"{_IRLS} SELECT '(Intercept)' AS term, {r('b0', 'estimate')}, {r('exp(b0)', 'odds_ratio')} FROM it WHERE i = 15 UNION ALL SELECT 'anger_baseline', round(b1, 6) + 0.0, round(exp(b1), 6) FROM it WHERE i = 15")
def logit_anger(t):
    return rounded(regressions.logit(make_model_users(t), "y", ["anger_baseline"]).select("term", "estimate", "odds_ratio"))


@query("logit_activity")
def logit_activity(t):
    return rounded(regressions.logit(make_model_users(t), "y", ["anger_baseline", "fear_baseline", "log_n_scored"]))


@query("boot_logit")
def boot_logit(t):
    draws = regressions.boot_logit(make_model_users(t), "author_id", "y", ["anger_baseline", "fear_baseline"], reps=1000)
    return rounded(regressions.percentile_ci(draws, ["term"]))


# --- sets of models --------------------------------------------------------
def _simpson(f: str, low: str, high: str, steps: int = 1200) -> str:
    """Simpson's rule in SQL for ``f`` of ``s``."""
    h = f"((({high}) - ({low})) / {steps})"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"{h} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * ({f.replace('{s}', f'(({low}) + i * {h})')})))"


def _p_of_t(t: str, dof: str) -> str:
    """Two-sided p: with s = sqrt(dof) * tan(angle) the density is a power of the cosine."""
    start, power = f"atan(abs({t}) / sqrt({dof}))", f"({dof} - 1)"
    whole = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi())"
    return f"2 * {whole} * {_simpson(f'pow(cos({{s}}), {power})', start, f'least(pi() / 2, {start} + 14 / sqrt({dof}))')}"


def _p_of_z(z: str) -> str:
    return f"2 * {_simpson('exp(-0.5 * pow({s}, 2)) / sqrt(2 * pi())', f'abs({z})', f'abs({z}) + 12')}"


def _one_predictor(model: str, y: str, x: str, term: str) -> str:
    """Both coefficients of y ~ x with their errors."""
    fit = f"SELECT regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS b1, regr_intercept({y}, {x}) AS b0, regr_r2({y}, {x}) AS r2, sqrt((1 - regr_r2({y}, {x})) * regr_syy({y}, {x}) / (regr_count({y}, {x}) - 2)) AS s, regr_sxx({y}, {x}) AS sxx, regr_avgx({y}, {x}) AS ax FROM x"
    both = f"SELECT '{term}' AS term, n, b1 AS b, s / sqrt(sxx) AS se, r2, s FROM ({fit}) UNION ALL SELECT '(Intercept)', n, b0, s * sqrt(1.0 / n + ax * ax / sxx), r2, s FROM ({fit})"
    return f"SELECT '{model}' AS model, * FROM ({both})"


def _two_predictors(model: str, y: str, a: str, b: str, names: tuple[str, str]) -> str:
    """Both slopes of y ~ a + b with their errors, from correlations of the complete rows."""
    c = f"SELECT count(*) AS n, corr({y}, {a}) AS ra, corr({y}, {b}) AS rb, corr({a}, {b}) AS rab, stddev_samp({y}) AS sy, stddev_samp({a}) AS sa, stddev_samp({b}) AS sb FROM x WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
    r2 = "(ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab)"
    rows = [
        f"SELECT '{model}' AS model, '{name}' AS term, n, sy / {sd} * ({mine} - {other} * rab) / (1 - rab * rab) AS b, sy / {sd} * sqrt((1 - {r2}) / ((1 - rab * rab) * (n - 3))) AS se, {r2} AS r2, sy * sqrt((1 - {r2}) * (n - 1) / (n - 3)) AS s FROM ({c})"
        for name, mine, other, sd in ((names[0], "ra", "rb", "sa"), (names[1], "rb", "ra", "sb"))
    ]
    return " UNION ALL ".join(rows)


# before: untrustworthy ~ emotion before; after: emotion after ~ untrustworthy; change: both predictors
WINDOW_MODELS = {
    f"{e}_{kind}": spec
    for e in EMOTIONS
    for kind, spec in {
        "before": ("untrustworthy", [f"mean_{e}_before"]),
        "after": (f"mean_{e}_after", ["untrustworthy"]),
        "change": (f"mean_{e}_after", ["untrustworthy", f"mean_{e}_before"]),
    }.items()
}
_WINDOW_FITS = " UNION ALL ".join(
    _two_predictors(m, y, xs[0], xs[1], (xs[0], xs[1])) if len(xs) == 2 else _one_predictor(m, y, xs[0], xs[0])
    for m, (y, xs) in WINDOW_MODELS.items()
)


@query("ols_set", f"{WINDOWS_SQL}, x AS (SELECT *, {_U} AS untrustworthy FROM win), f AS ({_WINDOW_FITS}) SELECT model, term, n, {r('b', 'estimate')}, {r('se', 'std_error')}, {r('b / se', 'statistic', 4)}, {r(_p_of_t('b / se', '(n - CASE WHEN model LIKE ' + chr(39) + '%change' + chr(39) + ' THEN 3 ELSE 2 END)'), 'p_value')}, {r('r2', 'r_squared')}, {r('s', 'sigma')} FROM f")
def ols_set(t):
    w = windows.with_untrust_degree(make_windows(t))
    fits = model_sets.ols_set(w, WINDOW_MODELS)
    # the twin has no constant of the models with two predictors
    fits = fits.filter("term <> '(Intercept)' OR model NOT LIKE '%change'")
    return rounded(fits.withColumn("statistic", F.round("statistic", 4)))


@query("cluster_boot_set")
def cluster_boot_set(t):
    w = windows.with_untrust_degree(make_windows(t))
    draws = model_sets.cluster_boot_set(w, "author_id", WINDOW_MODELS, reps=1000)
    return rounded(regressions.percentile_ci(draws, ["model", "term"]).drop("or_lower", "or_upper"))


USER_MODELS = {f"{e}_baseline": ("y", [f"{e}_baseline"]) for e in EMOTIONS}
_USERS = " UNION ALL ".join(
    f"SELECT '{e}_baseline' AS model, CAST(n_untrustworthy_shared > 10 AS INTEGER) AS y, ({e}_baseline - avg({e}_baseline) OVER ()) / stddev_samp({e}_baseline) OVER () AS x FROM base WHERE {' AND '.join(f'{o}_baseline IS NOT NULL' for o in EMOTIONS)}"
    for e in EMOTIONS
)
_LOGITS = f"""WITH RECURSIVE {scored_sql()}, {_BASE}, m AS ({_USERS}),
it AS (SELECT DISTINCT model, 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM m UNION ALL
 SELECT model, i + 1, b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 ^ 2), b1 + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 ^ 2) FROM
 (SELECT model, i, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
  FROM (SELECT it.*, y, x, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it JOIN m USING (model) WHERE i < 15) GROUP BY model, i, b0, b1)),
fin AS (SELECT model, b0, b1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11, 4 - 2 * sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS aic
 FROM (SELECT it.*, y, x, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it JOIN m USING (model) WHERE i = 15) GROUP BY 1, 2, 3),
co AS (SELECT model, '(Intercept)' AS term, b0 AS b, sqrt(h11 / (h00 * h11 - h01 ^ 2)) AS se, aic FROM fin UNION ALL SELECT model, model, b1, sqrt(h00 / (h00 * h11 - h01 ^ 2)), aic FROM fin)"""


@query("logit_set", f"{_LOGITS} SELECT model, term, {r('b', 'estimate')}, {r('se', 'std_error')}, {r('b / se', 'statistic')}, {r(_p_of_z('b / se'), 'p_value')}, {r('exp(b)', 'odds_ratio')}, {r('aic', 'aic', 4)} FROM co")
def logit_set(t):
    return rounded(model_sets.logit_set(make_model_users(t), USER_MODELS).withColumn("aic", F.round("aic", 4)))


@query("boot_logit_set")
def boot_logit_set(t):
    models = USER_MODELS | {"activity": ("y", [*BASELINES, "log_n_scored"])}
    draws = model_sets.boot_logit_set(make_model_users(t), "author_id", models, reps=1000)
    return rounded(regressions.percentile_ci(draws, ["model", "term"]))


@query("percentile_interval", f"WITH {scored_sql()} SELECT lang, count(anger_v2) AS n_boot, {r('avg(anger_v2)', 'boot_mean')}, {r('stddev_samp(anger_v2)', 'boot_sd')}, {r('quantile_cont(anger_v2, 0.05)', 'lower')}, {r('quantile_cont(anger_v2, 0.95)', 'upper')}, {r('exp(quantile_cont(anger_v2, 0.05))', 'or_lower')}, {r('exp(quantile_cont(anger_v2, 0.95))', 'or_upper')} FROM scored GROUP BY lang")
def percentile_interval(t):
    """The interval of replicates, here of the scores of each language."""
    return rounded(regressions.percentile_ci(t.scored(), ["lang"], "anger_v2", level=0.9))


# every supplier has the same months, so REML has a closed form: variances from the mean squares, the slope from within
_BALANCED = """WITH b AS (SELECT s_suppkey AS g, CAST(m.i AS DOUBLE) AS x, CAST((s_suppkey * 37 + m.i * 11) % 101 AS DOUBLE) + s_suppkey % 13 * 5 + m.i * 0.3 AS y FROM supplier, range(48) m(i)),
gm AS (SELECT g, avg(y) AS my, count(*) AS n FROM b GROUP BY g),
tot AS (SELECT count(*) AS g, max(n) AS n, avg(my) AS my, var_samp(my) AS vm FROM gm),
w AS (SELECT avg(x) AS mx, sum((x - (SELECT avg(x) FROM b)) ^ 2) AS sxx, sum((x - (SELECT avg(x) FROM b)) * (y - my)) AS sxy, sum((y - my) ^ 2) AS syy FROM b JOIN gm USING (g)),
v AS (SELECT *, sxy / sxx AS slope, (syy - sxy * sxy / sxx) / (tot.g * (tot.n - 1) - 1) AS within_var, tot.n * vm AS msb FROM tot, w),
f AS (SELECT *, (msb - within_var) / n AS between_var FROM v)"""


@query("random_intercept_balanced", f"{_BALANCED} SELECT '(Intercept)' AS term, {r('my - slope * mx', 'estimate', 5)}, {r('sqrt(msb / (g * n) + mx * mx * within_var / sxx)', 'std_error', 5)}, g * n AS n_rows, g AS n_groups, {r('between_var', 'between_var', 2)}, {r('within_var', 'within_var', 2)}, {r('between_var / (between_var + within_var)', 'icc', 5)} FROM f UNION ALL SELECT 'x', round(slope, 5) + 0.0, round(sqrt(within_var / sxx), 5), g * n, g, round(between_var, 2), round(within_var, 2), round(between_var / (between_var + within_var), 5) FROM f")
def random_intercept_balanced(t):
    s = t.table("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i"))
    y = ((F.col("s_suppkey") * 37 + F.col("i") * 11) % 101).cast("double") + F.col("s_suppkey") % 13 * 5 + F.col("i") * 0.3
    fit = regressions.random_intercept(s.select(F.col("s_suppkey").alias("g"), F.col("i").cast("double").alias("x"), y.alias("y")), "y", ["x"], "g")[0]
    digits = {"between_var": 2, "within_var": 2}  # the search ends within 1e-7 of the ratio
    return fit.select(*[F.round(c, digits.get(c, 5)).alias(c) if k == "double" else F.col(c) for c, k in fit.dtypes])


def _near_the_fit(draws, fits, keys):
    """Whether the replicates lie around the fit: their mean within a fifth of their spread, the fit inside the interval."""
    ci = regressions.percentile_ci(draws, keys).join(fits.select(*keys, "estimate"), keys)
    centred = F.abs(F.col("boot_mean") - F.col("estimate")) < 0.2 * F.col("boot_sd")
    return rounded(ci.select(*keys, "n_boot", "estimate", centred.alias("centred"), F.col("estimate").between(F.col("lower"), F.col("upper")).alias("inside")))


@query("cluster_boot_close", f"{WINDOWS_SQL}, x AS (SELECT *, {_U} AS untrustworthy FROM win), f AS ({_WINDOW_FITS}) SELECT model, term, CAST(1000 AS BIGINT) AS n_boot, {r('b', 'estimate')}, true AS centred, true AS inside FROM f")
def cluster_boot_close(t):
    w = windows.with_untrust_degree(make_windows(t))
    draws = model_sets.cluster_boot_set(w, "author_id", WINDOW_MODELS, reps=1000)
    return _near_the_fit(draws, model_sets.ols_set(w, WINDOW_MODELS), ["model", "term"]).filter("term <> '(Intercept)' OR model NOT LIKE '%change'")


@query("boot_logit_close", f"{_LOGITS} SELECT model, term, CAST(1000 AS BIGINT) AS n_boot, {r('b', 'estimate')}, true AS centred, true AS inside FROM co")
def boot_logit_close(t):
    users = make_model_users(t)
    draws = model_sets.boot_logit_set(users, "author_id", USER_MODELS, reps=1000)
    return _near_the_fit(draws, model_sets.logit_set(users, USER_MODELS), ["model", "term"])


@query("boot_mean_close", f"{WINDOWS_SQL}, vals AS (SELECT anger_v2 AS value FROM win w JOIN tl p ON p.author_id = w.author_id AND p.t >= w.t - {HOURS * 3600 * 10**6} AND p.t < w.t WHERE anger_v2 IS NOT NULL) SELECT n.n, {r('m', 'pool_mean')}, true AS centred, true AS spread_right FROM (SELECT avg(value) AS m FROM vals), (SELECT CAST(unnest(range(2, 21)) AS INTEGER) AS n) n")
def boot_mean_close(t):
    """Means of n draws lie around the pool's mean, with its spread over the root of n."""
    values = windows.window_values(t.scored(), make_windows(t), HOURS, "anger", "before")
    total = F.sum("weight")
    mean = F.sum(F.col("value") * F.col("weight")) / total
    pool = values.agg(mean.alias("mean"), F.sqrt(F.sum(F.col("value") * F.col("value") * F.col("weight")) / total - mean * mean).alias("sd")).first()
    out = stats.boot_mean_stability(values, reps=1000)
    want = pool["sd"] / F.sqrt("n")
    return rounded(out.select(
        "n", F.lit(pool["mean"]).alias("pool_mean"), (F.abs(F.col("mean_mean") - pool["mean"]) < want / 6).alias("centred"),
        F.abs(F.col("sd_mean") / want - 1).between(0, 0.12).alias("spread_right")))


# --- series models ---------------------------------------------------------
_SERIES = "se AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty, avg(l_discount) AS disc, CAST(count(*) AS DOUBLE) AS n_lines FROM lineitem GROUP BY 1, 2)"


def make_series(t):
    line = t.table("lineitem")
    return line.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).cast("double").alias("n_lines")
    )


@query("lag_design", f"WITH {_SERIES} SELECT flag, day, {r('qty', 'qty')}, {r('lag(qty, 1) OVER w', 'qty_l1')}, {r('lag(qty, 2) OVER w', 'qty_l2')} FROM se WINDOW w AS (PARTITION BY flag ORDER BY day) QUALIFY row_number() OVER w > 2")
def lag_design(t):
    return rounded(regressions.lag_design(make_series(t).select("flag", "day", "qty"), ["flag"], "day", ["qty"], 2, across_gaps=True))


@query("lag_design_days", f"WITH {_SERIES} SELECT flag, day, {r('qty', 'qty')}, {r('lag(qty, 1) OVER w', 'qty_l1')}, {r('lag(qty, 3) OVER w', 'qty_l3')} FROM se WINDOW w AS (PARTITION BY flag ORDER BY day) QUALIFY day - lag(day, 3) OVER w = 3")
def lag_design_days(t):
    """Rows whose three predecessors are the three days before: none behind a gap."""
    return rounded(regressions.lag_design(make_series(t).select("flag", "day", "qty"), ["flag"], "day", ["qty"], 3).drop("qty_l2"))


@query("var_fit_days", f"WITH {_SERIES}, d AS (SELECT flag, qty, lag(qty) OVER w AS q1 FROM se WINDOW w AS (PARTITION BY flag ORDER BY day) QUALIFY day - lag(day) OVER w = 1) SELECT flag, 'qty_l1' AS term, regr_count(qty, q1) AS n, {r('regr_slope(qty, q1)', 'estimate')}, {r('sqrt((1 - regr_r2(qty, q1)) * regr_syy(qty, q1) / (regr_count(qty, q1) - 2) / regr_sxx(qty, q1))', 'std_error')}, {r('regr_r2(qty, q1)', 'r_squared')} FROM d GROUP BY flag")
def var_fit_days(t):
    fit = regressions.var_fit(make_series(t), "day", ["qty"], 1, keys=["flag"])
    return rounded(fit.filter("term = 'qty_l1'").select("flag", "term", "n", "estimate", "std_error", "r_squared"))


@query("var_fit_one_lag", f"WITH {_SERIES}, d AS (SELECT flag, qty, lag(qty) OVER (PARTITION BY flag ORDER BY day) AS q1 FROM se) SELECT flag, 'qty_l1' AS term, regr_count(qty, q1) AS n, {r('regr_slope(qty, q1)', 'estimate')}, {r('regr_r2(qty, q1)', 'r_squared')} FROM d GROUP BY flag")
def var_fit_one_lag(t):
    fit = regressions.var_fit(make_series(t), "day", ["qty"], 1, keys=["flag"], across_gaps=True)
    return rounded(fit.filter("term = 'qty_l1'").select("flag", "term", "n", "estimate", "r_squared"))


@query("var_fit")
def var_fit(t):
    s = daily.interventions(make_series(t), {"step1": "1998-01-01"})
    return rounded(regressions.var_fit(s, "day", ["qty", "disc"], 3, ["step1"], ["flag"], True))


@query("var_select")
def var_select(t):
    return rounded(regressions.var_select(make_series(t), "day", ["qty", "disc"], 7, keys=["flag"], across_gaps=True))


# With one lag the Wald F is the squared t of one coefficient: from the partial
# correlation of the response and the cause given the response's own lag.
@query("granger_wald", f"""WITH {_SERIES}, d AS (SELECT flag, qty, disc, lag(qty) OVER w AS q1, lag(disc) OVER w AS d1 FROM se WINDOW w AS (PARTITION BY flag ORDER BY day)),
 c AS (SELECT flag, regr_count(qty, q1) AS n, corr(q1, d1) AS rx, corr(qty, q1) AS qq, corr(qty, d1) AS qd, corr(disc, q1) AS dq, corr(disc, d1) AS dd FROM d WHERE q1 IS NOT NULL GROUP BY flag),
 p AS (SELECT flag, n, 'disc' AS cause, 'qty' AS response, (qd - qq * rx) / sqrt((1 - qq ^ 2) * (1 - rx ^ 2)) AS pr FROM c UNION ALL SELECT flag, n, 'qty', 'disc', (dq - dd * rx) / sqrt((1 - dd ^ 2) * (1 - rx ^ 2)) FROM c)
 SELECT flag, cause, response, {r('pr ^ 2 * (n - 3) / (1 - pr ^ 2)', 'f')}, 1 AS df1, CAST(n - 3 AS INTEGER) AS df2 FROM p""")
def granger_wald(t):
    return rounded(regressions.granger_wald(make_series(t), "day", ["qty", "disc"], 1, keys=["flag"], across_gaps=True).drop("p_value"))


@query("its_regression", f"WITH {_SERIES}, x AS (SELECT flag, qty AS y, CAST(day >= DATE '1998-01-01' AS INTEGER) AS s, greatest(date_diff('day', DATE '1998-01-01', day) + 1, 0) AS rm FROM se) " + _two("y", "s", "rm", "step1", "ramp", "x", "flag"))
def its_regression(t):
    fit = regressions.its_regression(make_series(t), "qty", {"step1": "1998-01-01"}, "1998-01-01", ["flag"])
    return rounded(fit.filter("term <> '(Intercept)'").select("flag", "term", "n", "estimate"))


@query("peak_rows", f"WITH {_SERIES}, d AS (SELECT flag, day, round(qty - lag(qty) OVER (PARTITION BY flag ORDER BY day), 6) + 0.0 AS change FROM se) SELECT flag, max(abs(change)) AS size FROM d GROUP BY 1")
def peak_rows(t):
    s = regressions.lag_design(make_series(t), ["flag"], "day", ["qty"], 1, across_gaps=True)
    s = s.select("flag", "day", (F.round(F.col("qty") - F.col("qty_l1"), 6) + F.lit(0.0)).alias("change"))
    return regressions.peak_rows(s, ["flag"], "change").select("flag", F.abs("change").alias("size"))


# --- validation ------------------------------------------------------------
def make_coded(t):
    """Labelled documents with a score, sampling weight and a second coder."""
    d = t.table("labels").join(t.table("documents"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + 500.0)
    d = d.select(
        F.col("doc_id").cast("string").alias("id"), "lang", F.col("toxic").alias("y"), p.alias("p"),
        F.when(F.col("doc_id") % 11 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("y2"),
        (F.lit(1.0) + F.col("doc_id") % 3).alias("w"),
    )
    return d


_CODED = """cd AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, toxic AS y, n_chars / (n_chars + CAST(500 AS DOUBLE)) AS p, CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END AS y2, 1.0 + doc_id % 3 AS w FROM labels JOIN documents USING (doc_id))"""


@query("roc_auc", f"WITH {_CODED} SELECT a.lang, {r('sum(a.w * b.w * CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.w * b.w)', 'auc')} FROM cd a JOIN cd b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1")
def roc_auc(t):
    return rounded(validation.roc_auc(make_coded(t), ["lang"]).filter("auc IS NOT NULL"))


@query("roc_points", f"WITH {_CODED}, th AS (SELECT DISTINCT p AS threshold FROM cd) SELECT {r('threshold', 'threshold', 9)}, {r('coalesce(sum(w) FILTER (y = 0 AND p >= threshold), 0) / sum(w) FILTER (y = 0)', 'fpr')}, {r('coalesce(sum(w) FILTER (y = 1 AND p >= threshold), 0) / sum(w) FILTER (y = 1)', 'tpr')} FROM cd, th GROUP BY th.threshold")
def roc_points(t):
    return validation.roc_points(make_coded(t)).select(
        *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("threshold", 9), ("fpr", 6), ("tpr", 6))])


@query("precision_recall_f1", f"WITH {_CODED}, s AS (SELECT lang, sum(w) FILTER (y = 1 AND p >= 0.5) AS tp, sum(w) FILTER (p >= 0.5) AS h, sum(w) FILTER (y = 1) AS tr FROM cd GROUP BY 1) SELECT lang, {r('coalesce(tp / h, 0)', 'precision')}, {r('coalesce(tp / tr, 0)', 'recall')}, {r('coalesce(2 * tp / (coalesce(h, 0) + coalesce(tr, 0)), 0)', 'f1')} FROM s")
def precision_recall_f1(t):
    return rounded(validation.precision_recall_f1(make_coded(t), 0.5, ["lang"]))


@query("coder_agreement", f"""WITH {_CODED}, c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(y = y2 AS INTEGER)) AS po, avg(y) AS a, avg(y2) AS b, sum(y) + sum(y2) AS ones FROM cd)
 SELECT CAST(n AS BIGINT) AS n, {r('po', 'agreement')}, {r('(po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b)))', 'kappa')}, {r('1 - (1 - po) / (2 * ones * (2 * n - ones) / (2 * n * (2 * n - 1)))', 'alpha')} FROM c""")
def coder_agreement(t):
    return rounded(validation.agreement(make_coded(t), "y", "y2"))


def make_population(t):
    done = t.posts().filter(F.col("id").endswith("7")).select("id")
    return flows.validation_population(t.scored(), done)


_STRATA = f"""WITH {scored_sql()}, pop AS (SELECT *, CASE WHEN fear_v2 >= 0.5 THEN 'fear_hi' WHEN disgust_v2 >= 0.5 THEN 'disgust_hi' WHEN anger_v2 >= 0.5 THEN 'anger_hi' ELSE 'low' END AS stratum
 FROM scored WHERE lang IN ('de', 'en') AND anger_v2 IS NOT NULL AND id NOT LIKE '%7')"""


@query("stratum_sizes", f"{_STRATA} SELECT lang, stratum, count(*) AS N_stratum FROM pop GROUP BY 1, 2")
def stratum_sizes(t):
    return validation.stratum_sizes(make_population(t))


@query("stratified_sample_sizes", f"{_STRATA} SELECT lang, stratum, least(count(*), CASE WHEN stratum = 'low' THEN 40 ELSE 20 END) AS n, {r('''CAST(count(*) AS DOUBLE)''', 'weights')} FROM pop GROUP BY 1, 2")
def stratified_sample_sizes(t):
    s = validation.stratified_sample(make_population(t), 20, 40)
    return rounded(s.groupBy("lang", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weights")))


@query("blind_sheet", f"{_STRATA} SELECT id, lang, hashtags AS text_cleaned, {', '.join(f'CAST(NULL AS BIGINT) AS {e}_manual' for e in EMOTIONS)} FROM pop QUALIFY row_number() OVER (PARTITION BY lang, stratum ORDER BY {keyed('id', 636)}, id) <= CASE WHEN stratum = 'low' THEN 40 ELSE 20 END")
def blind_sheet(t):
    s = validation.stratified_sample(make_population(t), 20, 40).withColumn("text_cleaned", F.col("hashtags"))
    return validation.blind(s)


def make_annotated(t):
    """Coded documents shaped like an annotation sheet joined to its key."""
    c = make_coded(t)
    return c.select(
        "id", "lang", F.col("w").alias("weight"),
        *[F.when(F.col("id").cast("bigint") % (5 + i) != 0, F.col("y")).alias(f"{e}_manual") for i, e in enumerate(EMOTIONS)],
        *[(F.col("p") ** (i + 1)).alias(f"{e}_v2") for i, e in enumerate(EMOTIONS)],
    )


@query("evaluate_classifier", f"""WITH {_CODED}, lg AS ({' UNION ALL '.join(f"SELECT lang, '{e}' AS emotion, CASE WHEN CAST(id AS BIGINT) % {5 + i} <> 0 THEN y END AS y, p ^ {i + 1} AS p, w FROM cd" for i, e in enumerate(EMOTIONS))}),
 pl AS (SELECT * FROM lg WHERE y IS NOT NULL UNION ALL SELECT * REPLACE ('de+en' AS lang) FROM lg WHERE y IS NOT NULL),
 ww AS (SELECT lang, emotion, 'w' AS weighting, y, p, CAST(w AS DOUBLE) AS w FROM pl UNION ALL SELECT lang, emotion, 'unw', y, p, 1.0 FROM pl),
 au AS (SELECT a.lang, a.emotion, a.weighting, sum(a.w * b.w * CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.w * b.w) AS auc FROM ww a JOIN ww b ON a.lang = b.lang AND a.emotion = b.emotion AND a.weighting = b.weighting AND a.y = 1 AND b.y = 0 GROUP BY 1, 2, 3),
 pr AS (SELECT lang, emotion, weighting, t AS threshold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, coalesce(sum(w) FILTER (y = 1 AND p >= t), 0) AS tp, coalesce(sum(w) FILTER (p >= t), 0) AS h, coalesce(sum(w) FILTER (y = 1), 0) AS tr FROM ww, (SELECT unnest([0.5, 0.65]) AS t) GROUP BY 1, 2, 3, 4)
 SELECT pr.lang, pr.emotion, pr.weighting, CAST(threshold AS DOUBLE) AS threshold, n, positives, {r('auc', 'auc')}, {r('coalesce(tp / nullif(h, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tr, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(h + tr, 0), 0)', 'f1')}
 FROM pr LEFT JOIN au ON au.lang = pr.lang AND au.emotion = pr.emotion AND au.weighting = pr.weighting""")
def evaluate_classifier(t):
    return rounded(validation.evaluate(make_annotated(t)))


# --- scoring and release ---------------------------------------------------
@query("score_texts")
def score_texts(t):
    texts = materialize(panel.filter_scorable(t.texts()))
    labelled = texts.join(t.table("labels").select(F.col("doc_id").cast("string").alias("id"), "toxic"), "id")
    model = scoring.train_scorer(labelled, "toxic")
    return rounded(scoring.apply_scorer(model, texts, "toxic_p").select("id", "toxic_p"))


_MARKS = ["!", "?", ","]


def _mark_share(batch):
    return [[s.count(m) / max(len(s), 1) for m in _MARKS] for s in batch]


@query("score_texts_batches", f"WITH {TEXTS} SELECT id, " + ", ".join(r(f"(length(text) - length(replace(text, '{m}', ''))) / CAST(greatest(length(text), 1) AS DOUBLE)", n) for m, n in zip(_MARKS, ("shout", "ask", "pause"))) + " FROM texts")
def score_texts_batches(t):
    texts = t.texts().select("id", F.col("text").alias("text_cleaned"))
    return rounded(scoring.score_texts(texts, _mark_share, ["shout", "ask", "pause"]).drop("text_cleaned"))


@query("order_preserving_ids", f"WITH {POSTS} SELECT author_id, row_number() OVER (ORDER BY author_id) AS anon FROM (SELECT DISTINCT author_id FROM posts)")
def order_preserving_ids(t):
    return release.order_preserving_ids(t.posts(), "author_id")


@query("random_ids")
def random_ids(t):
    return release.random_ids(t.posts(), "id")


@query("random_ids_cover", f"WITH {POSTS}, n AS (SELECT count(DISTINCT id) AS n FROM posts) SELECT n AS n_ids, n AS n_numbers, CAST(1 AS BIGINT) AS smallest, n AS largest FROM n")
def random_ids_cover(t):
    return random_ids(t).agg(
        F.count_distinct("id").alias("n_ids"), F.count_distinct("anon").alias("n_numbers"),
        F.min("anon").alias("smallest"), F.max("anon").alias("largest"))


@query("permuted_ids", f"WITH {POSTS} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT id) AS n_numbers, count(DISTINCT id) AS n_pairs, true AS in_range FROM posts")
def permuted_ids(t):
    """Counts that prove the map of post ids to be one to one: no two ids share a number, no id has two."""
    posts = t.posts().select("id", F.col("id").alias("event_id"))
    out = release.permuted_ids(posts, "event_id", release.fresh_key(t.spark))
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_distinct("event_id").alias("n_numbers"),
        F.count_distinct("id", "event_id").alias("n_pairs"), F.bool_and(F.col("event_id").between(0, (1 << 60) - 1)).alias("in_range"))


@query("apply_mapping", f"WITH {POSTS}, m AS (SELECT author_id, row_number() OVER (ORDER BY author_id) AS anon FROM (SELECT DISTINCT author_id FROM posts)) SELECT anon AS author_id, count(*) AS n FROM posts JOIN m USING (author_id) GROUP BY 1")
def apply_mapping(t):
    posts = t.posts().select("author_id", "lang")
    mapped = release.apply_mapping(posts, "author_id", release.order_preserving_ids(posts, "author_id"))
    return mapped.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


@query("release_windows", f"{WINDOWS_SQL}, m AS (SELECT author_id, row_number() OVER (ORDER BY author_id) AS anon FROM authors) SELECT anon AS author_id, count(*) AS n_events, {r('avg(event_score)', 'mean_score')} FROM win JOIN m USING (author_id) GROUP BY 1")
def release_windows(t):
    w = make_windows(t).select("event_id", "author_id", "event_score")
    out = release.release({"windows": w}, {"windows": ["author_id", "event_id"]}, t.authors())["windows"]
    return rounded(out.groupBy("author_id").agg(F.count_distinct("event_id").alias("n_events"), F.avg("event_score").alias("mean_score")))
