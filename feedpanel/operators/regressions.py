"""Regressions. Spark sums cross products per group or replicate; what is solved
afterwards is a matrix with one row and column per coefficient."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions.tails import f_upper, t_two_sided
from feedpanel.operators.ordered import running_sums
from feedpanel.session import materialize


# --- centred cross products --------------------------------------------------
def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key over complete rows: ``n`` rows, ``mean`` of ``cols`` and ``cc``, the
    sums of products of their deviations (upper triangle, row by row). Spark
    merges means and deviations, so large means cost no digits."""
    full = df.dropna(subset=list(cols))
    terms = [F.col(c).cast("double") for c in cols]
    n = F.count(F.lit(1))
    sums = [F.covar_pop(a, b) * n for a, b in combinations_with_replacement(terms, 2)]
    return full.groupBy(*keys).agg(n.alias("n"), F.array(*[F.avg(t) for t in terms]).alias("mean"), F.array(*sums).alias("cc"))


def _shifted(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Complete rows with the columns' means taken off, and those means."""
    full = df.dropna(subset=list(cols))
    means = full.agg(*[F.avg(c).alias(c) for c in cols]).first()
    at = [float(means[c] or 0.0) for c in cols]
    return full.withColumns({c: F.col(c).cast("double") - m for c, m in zip(cols, at, strict=True)}), at


def cross_products(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key the sums of all products of the constant 1 and ``cols`` (upper
    triangle, row by row) over complete rows, as array ``xx``; ``n`` rows."""
    full = df.dropna(subset=list(cols))
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    sums = [F.sum(a * b) for a, b in combinations_with_replacement(terms, 2)]
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"))


def _square(flat: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


# Smallest eigenvalue of the predictors' correlations that counts as full rank.
_RANK = 1e-10


def _inverse(c: np.ndarray) -> np.ndarray | None:
    """Inverse of a matrix of deviation products; None if predictors are constant
    or depend on one another."""
    scale = np.sqrt(np.diag(c))
    if not np.all(scale > 0) or not np.all(np.isfinite(scale)):
        return np.zeros((0, 0)) if len(c) == 0 else None
    values, vectors = np.linalg.eigh(c / np.outer(scale, scale))
    if values[0] < _RANK:
        return None
    return (vectors / values) @ vectors.T / np.outer(scale, scale)


def _least_squares(n: float, mean: np.ndarray, c: np.ndarray, k: int):
    """Coefficients (constant first), their covariances divided by the residual
    variance, residual and total sum of squares, with the last variable regressed
    on the first ``k - 1``; None without full rank or spare rows."""
    inverse = _inverse(c[: k - 1, : k - 1]) if n > k else None
    if inverse is None:
        return None
    x, y = mean[: k - 1], mean[-1]
    slopes = inverse @ c[: k - 1, -1]
    tss = float(c[-1, -1])
    rss = max(tss - float(slopes @ c[: k - 1, -1]), 0.0)
    moved = inverse @ x
    spread = np.block([[np.array([[1 / n + x @ moved]]), -moved[None, :]], [-moved[:, None], inverse]])
    return np.concatenate([[y - slopes @ x], slopes]), spread, rss, tss


def _centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, deviation products) of cross products with the constant first."""
    n, total = m[0, 0], m[0, 1:]
    return n, total / n, m[1:, 1:] - np.outer(total, total) / n


def _or_null(value: float) -> float | None:
    return float(value) if value is not None and math.isfinite(value) else None


def _spark_type(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares with a constant, one fit per key: one row per coefficient.
    Estimates are null where rows do not suffice or predictors are dependent."""
    names = ["(Intercept)", *xs]
    k = len(names)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n, mean = int(row["n"]), np.array(row["mean"])
                fit = _least_squares(n, mean, _square(row["cc"], k), k)
                for i, name in enumerate(names):
                    values = [None] * 6
                    if fit is not None:
                        beta, spread, rss, tss = fit
                        dof = n - k
                        se = math.sqrt(max(rss / dof * spread[i, i], 0.0))
                        t = beta[i] / se if se else math.nan
                        p = t_two_sided(t, dof) if se else math.nan
                        r2 = 1 - rss / tss if tss > 0 else math.nan
                        values = [_or_null(v) for v in (beta[i], se, t, p, r2, math.sqrt(rss / dof))]
                    out.append([row[c] for c in keys] + [name, n] + values)
            cols = [*keys, "term", "n", "estimate", "std_error", "statistic", "p_value", "r_squared", "sigma"]
            yield pd.DataFrame(out, columns=cols)

    schema = _spark_type(df, keys) + (
        "term string, n bigint, estimate double, std_error double, statistic double, p_value double, "
        "r_squared double, sigma double"
    )
    return moments(df, keys, [*xs, y]).mapInPandas(solve, schema)


# --- bootstrap weights -------------------------------------------------------
def _poisson_steps() -> list[float]:
    """P(X <= 0), P(X <= 1), ... of Poisson(1), as long as doubles tell them apart from 1."""
    mass = total = math.exp(-1)
    steps = []
    while total < 1.0 and total + mass / (len(steps) + 1) > total:
        steps.append(total)
        mass /= len(steps)
        total += mass
    return steps


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """How often a unit is drawn in a replicate: Poisson(1) from a hash."""
    u = F.shiftrightunsigned(F.xxhash64(key, replicate, F.lit(seed)), 11) / F.lit(float(2**53))
    steps = _poisson_steps()
    out = F.lit(len(steps))
    for k, upto in reversed(list(enumerate(steps))):
        out = F.when(u < upto, F.lit(k)).otherwise(out)
    return out


def _replicates(df: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """Rows times replicates with the weight of the row's unit; zero weights go."""
    wide = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return wide.withColumn("w", poisson_weight(F.col(key), F.col("rep"), seed)).filter("w > 0")


def percentile_ci(draws: DataFrame, keys: Sequence[str], value: str = "estimate", level: float = 0.95) -> DataFrame:
    """Percentile interval over the replicates of each key, and their odds ratios."""
    tail = (1 - level) / 2
    ci = F.percentile(value, [tail, 1 - tail])
    return draws.groupBy(*keys).agg(
        F.count(value).alias("n_boot"),
        F.avg(value).alias("boot_mean"),
        F.stddev_samp(value).alias("boot_sd"),
        ci[0].alias("lower"),
        ci[1].alias("upper"),
        F.exp(ci[0]).alias("or_lower"),
        F.exp(ci[1]).alias("or_upper"),
    )


# --- logistic regression -----------------------------------------------------
def logit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Binomial GLM with standard errors, p values and odds ratios."""
    full = df.dropna(subset=[y, *xs]).withColumn("_y", F.col(y).cast("double"))
    data = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(full)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol="_y", maxIter=50, tol=1e-10
    )
    model = glm.fit(data)
    s = model.summary
    estimates = [*model.coefficients.toArray(), model.intercept]
    rows = [
        (name, float(b), float(se), float(t), float(p), float(math.exp(b)), float(s.aic))
        for name, b, se, t, p in zip(
            [*xs, "(Intercept)"], estimates, s.coefficientStandardErrors, s.tValues, s.pValues
        )
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, statistic double, p_value double, odds_ratio double, aic double",
    )


def _draws(units: np.ndarray, reps: int | np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights (units, replicates) from a hash of unit, replicate (the
    first ``reps``, or those listed) and seed."""
    numbers = np.arange(1, reps + 1) if np.ndim(reps) == 0 else reps
    x = units.view(np.uint64)[:, None] + numbers.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ np.uint64(seed * 0xD1342543DE82EF95 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(np.array(_poisson_steps()), u, side="right").astype(float)


def boot_logit(
    df: DataFrame, key: str, y: str, xs: Sequence[str], reps: int = 1000, seed: int = 636, max_iter: int = 50
) -> DataFrame:
    """Logit coefficients of ``reps`` bootstrap samples of units.

    All replicates are fitted together by Newton steps. A step reads the rows
    once: each task draws the weights anew from hashes and adds up gradient and
    curvature of every replicate, so nothing of the size rows times replicates is
    kept, and only these sums (replicates times coefficients squared) are solved
    outside Spark. Replicates that do not converge within ``max_iter`` steps
    (separated outcomes, no rows) have null estimates and ``converged`` false.
    """
    spark = df.sparkSession
    names = ["(Intercept)", *xs]
    k = len(names)
    pairs = list(combinations_with_replacement(range(k), 2))
    full = df.dropna(subset=[y, *xs])
    data = materialize(
        full.select(F.xxhash64(key).alias("_unit"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in xs])
    )
    betas, open_ = np.zeros((reps, k)), np.ones(reps, bool)

    def sums_at(at: np.ndarray, which: np.ndarray):
        def run(batches):
            total = np.zeros((len(which), k + len(pairs)))
            for pdf in batches:
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    x = np.column_stack([np.ones(len(part)), part[list(xs)].to_numpy(float)])
                    w = _draws(part["_unit"].to_numpy(np.int64), which + 1, seed)
                    mu = 1 / (1 + np.exp(-np.clip(x @ at.T, -700, 700)))
                    total[:, :k] += (w * (part["_y"].to_numpy()[:, None] - mu)).T @ x
                    curve = w * mu * (1 - mu)
                    for c, (i, j) in enumerate(pairs, k):
                        total[:, c] += (x[:, i] * x[:, j]) @ curve
            yield pd.DataFrame({"rep": which.astype("int32"), "s": list(total)})

        return run

    for _ in range(max_iter):
        which = np.flatnonzero(open_)
        if not len(which):
            break
        parts = data.mapInPandas(sums_at(betas[which], which), "rep int, s array<double>")
        cells = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k + len(pairs))]
        for row in parts.groupBy("rep").agg(*cells).collect():
            flat = np.array(row[1:])
            curve = _square(flat[k:], k)
            if not np.all(np.isfinite(flat)) or np.linalg.cond(curve) > 1e14:
                continue
            step = np.linalg.solve(curve, flat[:k])
            betas[row["rep"]] += np.clip(step, -5, 5)
            open_[row["rep"]] = np.abs(step).max() >= 1e-8
    rows = [(r + 1, n, None if open_[r] else float(betas[r, i]), not open_[r]) for r in range(reps) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "rep int, term string, estimate double, converged boolean")


# --- clustered bootstrap of least squares ------------------------------------
def cluster_boot_ols(
    df: DataFrame, cluster: str, y: str, xs: Sequence[str], reps: int = 1000, seed: int = 636
) -> DataFrame:
    """OLS coefficients with clusters resampled: cross products are summed once
    per cluster, a replicate is their weighted sum."""
    names = ["(Intercept)", *xs]
    k, size = len(names), len(names) + 1
    cells = size * (size + 1) // 2
    near, at = _shifted(df, [*xs, y])
    per_cluster = materialize(cross_products(near, [cluster], [*xs, y]))
    drawn = _replicates(per_cluster, cluster, reps, seed)
    sums = drawn.groupBy("rep").agg(
        F.array(*[F.sum(F.col("xx")[i] * F.col("w")) for i in range(cells)]).alias("xx")
    )

    def solve(batches):
        for pdf in batches:
            out = []
            for rep, flat in zip(pdf["rep"], pdf["xx"]):
                n, mean, c = _centred(_square(flat, size))
                fit = _least_squares(n, mean + np.array(at), c, k)
                beta = [None] * k if fit is None else [float(b) for b in fit[0]]
                out += [(int(rep), name, b) for name, b in zip(names, beta)]
            yield pd.DataFrame(out, columns=["rep", "term", "estimate"])

    return sums.mapInPandas(solve, "rep int, term string, estimate double")


# --- random intercept --------------------------------------------------------
def random_intercept(df: DataFrame, y: str, xs: Sequence[str], group: str) -> tuple[DataFrame, DataFrame]:
    """Linear model with a random intercept per group by REML.

    Groups are reduced to counts, sums and cross products. The likelihood depends
    on one ratio of variances; each search round evaluates a grid of ratios in
    one aggregation over the groups. Returns (summary, intercepts per group).
    """
    spark = df.sparkSession
    names = ["(Intercept)", *xs]
    k = len(names)
    size = k + 1
    near, means = _shifted(df, [*xs, y])
    groups = materialize(cross_products(near, [group], [*xs, y]))
    cells = size * (size + 1) // 2
    total = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), *[F.sum(F.col("xx")[i]).alias(f"t{i}") for i in range(cells)]
    ).first()
    n, g = int(total["n"]), int(total["g"])
    m = _square([total[f"t{i}"] for i in range(cells)], size)

    def shrunk(ratios: np.ndarray) -> dict[float, tuple[np.ndarray, float]]:
        """Per ratio the cross products under the model and the log determinant."""
        grid = groups.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
        c = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
        # the first row of a group's cross products holds its sums
        s = [F.col("xx")[i] for i in range(size)]
        rows = grid.groupBy("ratio").agg(
            F.sum(F.log1p(F.col("n") * F.col("ratio"))).alias("logdet"),
            F.array(*[F.sum(c * a * b) for a, b in combinations_with_replacement(s, 2)]).alias("cut"),
        ).collect()
        return {r["ratio"]: (m - _square(r["cut"], size), r["logdet"]) for r in rows}

    def solved(adjusted: np.ndarray):
        inverse = _inverse(adjusted[:k, :k])
        if inverse is None or n <= k:
            raise ValueError("the predictors are constant or depend on one another, or the rows do not suffice")
        beta = inverse @ adjusted[:k, -1]
        return beta, inverse, max(float(adjusted[-1, -1] - beta @ adjusted[:k, -1]), 0.0)

    floor = max(m[-1, -1], 1e-300) * 1e-15  # a perfect fit has no likelihood to compare

    def reml(adjusted: np.ndarray, logdet: float) -> float:
        rss = max(solved(adjusted)[2], floor)
        return -0.5 * (logdet + np.linalg.slogdet(adjusted[:k, :k])[1] + (n - k) * math.log(rss / (n - k)))

    low, high, best = -14.0, 6.0, 0.0
    for _ in range(7):
        at = np.exp(np.linspace(low, high, 33))
        fits = shrunk(at)
        best = max(fits, key=lambda r: reml(*fits[r]))
        width = (high - low) / 32
        low, high = math.log(best) - width, math.log(best) + width
    adjusted, logdet = fits[best]
    beta, inverse, rss = solved(adjusted)
    within = rss / (n - k)
    between = best * within
    # back from the shifted columns: only the constant moves
    back = np.eye(k)
    back[0, 1:] = -np.array(means[:-1])
    inverse = back @ inverse @ back.T
    constant = means[-1] + float(back[0] @ beta)
    icc = between / (between + within) if between + within > 0 else None
    rows = [
        (name, float(b), float(math.sqrt(within * inverse[i, i])), n, g, between, within, icc)
        for i, (name, b) in enumerate(zip(names, [constant, *beta[1:]]))
    ]
    summary = spark.createDataFrame(
        rows,
        "term string, estimate double, std_error double, n_rows bigint, n_groups bigint, "
        "between_var double, within_var double, icc double",
    )
    left = F.col("xx")[k] - sum(F.col("xx")[i] * float(beta[i]) for i in range(k))
    effect = left * best / (1 + F.col("n") * best)
    intercepts = groups.select(group, "n", effect.alias("deviation"), (effect + constant).alias("intercept"))
    return summary, intercepts


# --- series ------------------------------------------------------------------
def lag_design(
    series: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], p: int, across_gaps: bool = False
) -> DataFrame:
    """Adds ``<col>_l1`` .. ``<col>_lp``; rows without all lags are dropped, also
    those behind a gap: the p rows before must be the p days (or whole numbers)
    before, unless ``across_gaps`` takes rows as they follow. A series has one row
    per key and day.

    Rows are numbered in range splits, and every row sends its values to the p
    places behind its own, so one long series is spread over tasks."""
    kind = dict(series.dtypes)[order]
    numbered = running_sums(series, keys, [order], {"_no": F.lit(1).cast("bigint")})
    own, past = F.struct(*series.columns), F.struct(order, *cols)

    def sent(i: int) -> Column:
        row, before = (own, F.lit(None)) if i == 0 else (F.lit(None), past)
        return F.struct((F.col("_no") + i).alias("_at"), F.lit(i).alias("_back"), row.alias("_own"), before.alias("_past"))

    parts = [numbered.select(*keys, sent(i).alias("_s")).select(*keys, "_s.*") for i in range(p + 1)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    met = rows.groupBy(*keys, "_at").agg(
        F.first("_own", ignorenulls=True).alias("_own"),
        *[F.first(F.when(F.col("_back") == i, F.col("_past")), ignorenulls=True).alias(f"_l{i}") for i in range(1, p + 1)],
    )
    first = F.col(f"_l{p}")[order]
    apart = F.datediff(F.col("_own")[order], first) if kind in ("date", "timestamp", "timestamp_ntz") else F.col("_own")[order] - first
    whole = F.col("_own").isNotNull() & F.col(f"_l{p}").isNotNull()
    lags = [F.col(f"_l{i}")[c].alias(f"{c}_l{i}") for i in range(1, p + 1) for c in cols]
    return met.filter(whole if across_gaps else whole & (apart == p)).select("_own.*", *lags)


def _var_blocks(endo: Sequence[str], exog: Sequence[str], p: int) -> list[str]:
    return [f"{c}_l{i}" for i in range(1, p + 1) for c in endo] + list(exog)


def _var_products(series, keys, order, endo, exog, p, across_gaps):
    design = lag_design(series, keys, order, endo, p, across_gaps)
    return moments(design, keys, [*_var_blocks(endo, exog, p), *endo])


def var_fit(
    series: DataFrame, order: str, endo: Sequence[str], p: int, exog: Sequence[str] = (), keys: Sequence[str] = (),
    across_gaps: bool = False,
) -> DataFrame:
    """Vector autoregression per key, one equation per variable: coefficients with
    standard errors, R2, residual standard error and F."""
    names = ["(Intercept)", *_var_blocks(endo, exog, p)]
    k, size = len(names), len(names) - 1 + len(endo)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                c, mean, n = _square(row["cc"], size), np.array(row["mean"]), int(row["n"])
                for e, target in enumerate(endo):
                    pick = [*range(k - 1), k - 1 + e]
                    fit = _least_squares(n, mean[pick], c[np.ix_(pick, pick)], k)
                    for i, name in enumerate(names):
                        values = [None] * 7
                        if fit is not None:
                            beta, spread, rss, tss = fit
                            dof = n - k
                            sigma = math.sqrt(rss / dof)
                            r2 = 1 - rss / tss if tss > 0 else math.nan
                            f = (tss - rss) / (k - 1) / (rss / dof) if rss > 0 else math.nan
                            tail = f_upper(f, k - 1, dof) if math.isfinite(f) else math.nan
                            values = [beta[i], sigma * math.sqrt(spread[i, i]), r2, 1 - (1 - r2) * (n - 1) / dof, sigma, f, tail]
                        out.append([row[key] for key in keys] + [target, name, n] + [_or_null(v) for v in values])
            cols = [*keys, "equation", "term", "n", "estimate", "std_error", "r_squared", "adj_r_squared", "sigma",
                    "f_statistic", "f_p_value"]
            yield pd.DataFrame(out, columns=cols)

    schema = _spark_type(series, keys) + (
        "equation string, term string, n bigint, estimate double, std_error double, r_squared double, "
        "adj_r_squared double, sigma double, f_statistic double, f_p_value double"
    )
    return _var_products(series, keys, order, endo, exog, p, across_gaps).mapInPandas(solve, schema)


def var_select(
    series: DataFrame, order: str, endo: Sequence[str], max_p: int, exog: Sequence[str] = (), keys: Sequence[str] = (),
    across_gaps: bool = False,
) -> DataFrame:
    """AIC, HQ and SC for every lag order up to ``max_p`` on the common sample.
    One set of cross products holds all the smaller models."""
    names = ["(Intercept)", *_var_blocks(endo, exog, max_p)]
    size, eq = len(names) - 1 + len(endo), len(endo)
    own = len(names) - 1 - len(exog)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                c, n = _square(row["cc"], size), int(row["n"])
                ys = list(range(len(names) - 1, size))
                for p in range(1, max_p + 1):
                    used = [*range(p * eq), *range(own, len(names) - 1)]
                    count = eq * (len(used) + 1)
                    inverse = _inverse(c[np.ix_(used, used)]) if n > len(used) + 1 else None
                    base = math.nan
                    if inverse is not None:
                        xy = c[np.ix_(used, ys)]
                        sign, base = np.linalg.slogdet((c[np.ix_(ys, ys)] - xy.T @ inverse @ xy) / n)
                        base = base if sign > 0 else math.nan
                    values = [base + 2 * count / n, base + 2 * math.log(math.log(max(n, 3))) * count / n, base + math.log(n) * count / n]
                    out.append([row[key] for key in keys] + [p, n] + [_or_null(v) for v in values])
            yield pd.DataFrame(out, columns=[*keys, "p", "n", "aic", "hq", "sc"])

    schema = _spark_type(series, keys) + "p int, n bigint, aic double, hq double, sc double"
    return _var_products(series, keys, order, endo, exog, max_p, across_gaps).mapInPandas(solve, schema)


def granger_wald(
    series: DataFrame, order: str, endo: Sequence[str], p: int, exog: Sequence[str] = (), keys: Sequence[str] = (),
    across_gaps: bool = False,
) -> DataFrame:
    """Wald F of all lags of one variable in the equation of another, all pairs."""
    names = ["(Intercept)", *_var_blocks(endo, exog, p)]
    k, size = len(names), len(names) - 1 + len(endo)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                c, mean, n = _square(row["cc"], size), np.array(row["mean"]), int(row["n"])
                for e, response in enumerate(endo):
                    pick = [*range(k - 1), k - 1 + e]
                    fit = _least_squares(n, mean[pick], c[np.ix_(pick, pick)], k)
                    for cause in endo:
                        if cause == response:
                            continue
                        at, wald, tail = [names.index(f"{cause}_l{i}") for i in range(1, p + 1)], None, None
                        if fit is not None and fit[2] > 0:
                            beta, spread, rss, _ = fit
                            cov = spread[np.ix_(at, at)] * rss / (n - k)
                            wald = float(beta[at] @ np.linalg.solve(cov, beta[at])) / p
                            tail = f_upper(wald, p, n - k)
                        out.append([row[key] for key in keys] + [cause, response, wald, p, n - k, tail])
            yield pd.DataFrame(out, columns=[*keys, "cause", "response", "f", "df1", "df2", "p_value"])

    schema = _spark_type(series, keys) + "cause string, response string, f double, df1 int, df2 int, p_value double"
    return _var_products(series, keys, order, endo, exog, p, across_gaps).mapInPandas(solve, schema)


def its_regression(
    daily: DataFrame, y: str, steps: dict[str, str], ramp_from: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Interrupted series: least squares on step and ramp columns per key."""
    from feedpanel.operators.daily import interventions

    xs = [*steps, *(["ramp"] if ramp_from else [])]
    return ols(interventions(daily, steps, ramp_from), y, xs, keys)


def peak_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The row with the largest absolute value per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.abs(value), *rest)).alias("b"))
    return best.select(*keys, "b.*")
