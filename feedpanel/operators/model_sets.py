"""Sets of regressions fitted from one reading of the rows.

A set is a dictionary from a model's name to (outcome, predictors). All models of a
set share one table of sums over the union of their columns: per pattern of missing
values, so that every model still uses exactly the rows that are complete for it.
A model is then a sub-matrix, solved by sweeping its predictors out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions.tails import normal_two_sided, t_two_sided
from feedpanel.operators.regressions import _RANK, _draws, _or_null, _spark_type, _square
from feedpanel.session import materialize

Models = dict[str, tuple[str, Sequence[str]]]


def _columns(models: Models) -> list[str]:
    return list(dict.fromkeys(c for y, xs in models.values() for c in (*xs, y)))


def _present(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The columns as doubles, NaN counting as missing."""
    return {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}


def _pattern(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).isNotNull() for c in cols])


# --- sweep ---------------------------------------------------------------------
def sweep(matrix: np.ndarray, pivots: Sequence[int]) -> np.ndarray | None:
    """A symmetric matrix with the pivots swept out: their block turns into its
    inverse, their columns into coefficients, the rest into what they leave
    unexplained. None if a pivot is explained by those before it."""
    a = matrix.copy()
    for p in pivots:
        d = a[p, p]
        if not d > _RANK:
            return None
        row, column = a[p] / d, a[:, p].copy()
        a -= np.outer(column, row)
        a[p], a[:, p] = row, -column / d
        a[p, p] = 1 / d
    return a


def _fit(n: float, mean: np.ndarray, c: np.ndarray):
    """(coefficients with the constant first, their covariances over the residual
    variance, residual and total sum of squares) of the last variable on the
    others, from means and products of deviations; None if it cannot be told."""
    k = len(mean)
    scale = np.sqrt(np.maximum(np.diag(c), 0))
    if n <= k or not np.all(np.isfinite(scale)) or not np.all(scale[:-1] > 0):
        return None
    unit = np.append(scale[:-1], scale[-1] or 1.0)
    swept = sweep(c / np.outer(unit, unit), range(k - 1))
    if swept is None:
        return None
    slopes = swept[:-1, -1] * unit[-1] / unit[:-1]
    inverse = swept[:-1, :-1] / np.outer(unit[:-1], unit[:-1])
    moved = inverse @ mean[:-1]
    spread = np.block([[np.array([[1 / n + mean[:-1] @ moved]]), -moved[None, :]], [-moved[:, None], inverse]])
    rss = max(float(swept[-1, -1]) * unit[-1] ** 2, 0.0)
    return np.concatenate([[mean[-1] - slopes @ mean[:-1]], slopes]), spread, rss, float(c[-1, -1])


# --- least squares ---------------------------------------------------------------
def ols_set(df: DataFrame, models: Models, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares with a constant for every model and key: one row per model and
    coefficient, as ``regressions.ols`` gives them one model at a time.

    Rows are summed once, per key and pattern of missing values (means and products
    of deviations, which Spark merges); a key has as many rows then as it has
    patterns."""
    cols = _columns(models)
    place = {c: i for i, c in enumerate(cols)}
    clean = df.select(*keys, *[e.alias(c) for c, e in _present(df, cols).items()])
    n = F.count(F.lit(1))
    products = [F.covar_pop(a, b) * n for a, b in combinations_with_replacement(cols, 2)]
    sums = clean.groupBy(*keys, _pattern(cols).alias("there")).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(*products).alias("cc")
    )
    per_key = sums.groupBy(*keys).agg(F.collect_list(F.struct("there", "n", "mean", "cc")).alias("parts"))

    def merged(parts, picked):
        """Rows, means and products of deviations over all patterns that hold the columns."""
        total, mean, c = 0.0, np.zeros(len(picked)), np.zeros((len(picked), len(picked)))
        for there, count, means, products in parts:
            if not all(there[i] for i in picked):
                continue
            apart, both = means[picked] - mean, total + count
            c = c + products[np.ix_(picked, picked)] + np.outer(apart, apart) * (total * count / both)
            mean, total = mean + apart * (count / both), both
        return total, mean, c

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                parts = [(p["there"], p["n"], np.array(p["mean"], float), _square(np.array(p["cc"], float), len(cols))) for p in row["parts"]]
                for model, (y, xs) in models.items():
                    count, mean, c = merged(parts, [place[x] for x in xs] + [place[y]])
                    fit, k = _fit(count, mean, c), len(xs) + 1
                    for i, term in enumerate(["(Intercept)", *xs]):
                        values = [None] * 6
                        if fit is not None:
                            beta, spread, rss, tss = fit
                            se = math.sqrt(max(rss / (count - k) * spread[i, i], 0.0))
                            t = beta[i] / se if se else math.nan
                            p = t_two_sided(t, count - k) if se else math.nan
                            r2 = 1 - rss / tss if tss > 0 else math.nan
                            values = [_or_null(v) for v in (beta[i], se, t, p, r2, math.sqrt(rss / (count - k)))]
                        out.append([row[key] for key in keys] + [model, term, int(count), *values])
            names = ["model", "term", "n", "estimate", "std_error", "statistic", "p_value", "r_squared", "sigma"]
            yield pd.DataFrame(out, columns=[*keys, *names])

    schema = _spark_type(df, keys) + (
        "model string, term string, n bigint, estimate double, std_error double, statistic double, p_value double, "
        "r_squared double, sigma double"
    )
    return per_key.mapInPandas(solve, schema)


def cluster_boot_set(df: DataFrame, cluster: str, models: Models, reps: int = 1000, seed: int = 636) -> DataFrame:
    """Least squares coefficients of every model with clusters resampled, the same
    draws for all models: (model, rep, term, estimate).

    Cross products are summed once per cluster and pattern of missing values. A task
    draws the weights of its clusters from hashes and multiplies them with those
    sums, for all replicates at once; what it sends on has a row per replicate."""
    cols = _columns(models)
    size = len(cols) + 1
    place = {c: i + 1 for i, c in enumerate(cols)}
    clean = df.select(F.xxhash64(cluster).alias("unit"), *[e.alias(c) for c, e in _present(df, cols).items()])
    means = clean.agg(*[F.avg(c).alias(c) for c in cols]).first()
    at = np.array([0.0, *[means[c] or 0.0 for c in cols]])
    terms = [F.lit(1.0), *[F.coalesce(F.col(c) - means[c], F.lit(0.0)) if means[c] is not None else F.lit(0.0) for c in cols]]
    products = [F.sum(a * b) for a, b in combinations_with_replacement(terms, 2)]
    per_cluster = materialize(clean.groupBy("unit", _pattern(cols).alias("there")).agg(F.array(*products).alias("xx")))

    def weigh(batches):
        totals: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            there = [tuple(t) for t in pdf["there"]]
            for pattern in set(there):
                mine = pdf[[t == pattern for t in there]]
                for lo in range(0, len(mine), 4096):
                    part = mine.iloc[lo : lo + 4096]
                    drawn = _draws(part["unit"].to_numpy(np.int64), reps, seed).T @ np.stack(part["xx"])
                    totals[pattern] = totals.get(pattern, 0.0) + drawn
        for pattern, total in totals.items():
            yield pd.DataFrame({"rep": np.arange(1, reps + 1, dtype="int32"), "there": [list(pattern)] * reps, "xx": list(total)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, out = int(pdf["rep"].iloc[0]), []
        parts: dict[tuple, np.ndarray] = {}
        for there, xx in zip(pdf["there"], pdf["xx"], strict=True):
            parts[tuple(there)] = parts.get(tuple(there), 0.0) + xx
        for model, (y, xs) in models.items():
            picked = [0, *[place[x] for x in xs], place[y]]
            flat = sum(xx for there, xx in parts.items() if all(there[i - 1] for i in picked[1:]))
            fit = None
            if np.ndim(flat):
                m = _square(flat, size)[np.ix_(picked, picked)]
                n, total = m[0, 0], m[0, 1:]
                fit = _fit(n, total / n + at[picked[1:]], m[1:, 1:] - np.outer(total, total) / n) if n > 0 else None
            out += [(model, rep, term, None if fit is None else float(fit[0][i])) for i, term in enumerate(["(Intercept)", *xs])]
        return pd.DataFrame(out, columns=["model", "rep", "term", "estimate"])

    drawn = per_cluster.mapInPandas(weigh, "rep int, there array<boolean>, xx array<double>")
    return drawn.groupBy("rep").applyInPandas(solve, "model string, rep int, term string, estimate double")


# --- logistic regression -----------------------------------------------------------
class _Newton:
    """Newton steps of many logistic models and replicates, one reading of the rows each."""

    def __init__(self, df: DataFrame, key: str | None, models: Models, reps: int | None, seed: int):
        self.models, self.cols, self.reps, self.seed = list(models.items()), _columns(models), reps, seed
        unit = F.lit(0).cast("bigint") if key is None else F.xxhash64(key)
        self.data = materialize(df.select(unit.alias("_unit"), *[e.alias(c) for c, e in _present(df, self.cols).items()]))
        self.beta = [np.zeros((reps or 1, len(xs) + 1)) for _, (_, xs) in self.models]
        self.open = [np.ones(reps or 1, bool) for _ in self.models]
        self.curve = [[None] * (reps or 1) for _ in self.models]
        self.likelihood = np.zeros((len(self.models), reps or 1))

    def sums(self):
        """Gradient, curvature and likelihood of every open replicate of every model."""
        models, cols, reps, seed = self.models, self.cols, self.reps, self.seed
        which = [np.flatnonzero(o) for o in self.open]
        at = [b[w] for b, w in zip(self.beta, which, strict=True)]
        drawn = np.unique(np.concatenate(which))

        def run(batches):
            total = [np.zeros((len(w), 1 + b.shape[1] + b.shape[1] * (b.shape[1] + 1) // 2)) for w, b in zip(which, at, strict=True)]
            for pdf in batches:
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    units = part["_unit"].to_numpy(np.int64)
                    weights = np.ones((len(part), 1)) if reps is None else _draws(units, drawn + 1, seed)
                    table = part[cols].to_numpy(float)
                    there = ~np.isnan(table)
                    for m, (_, (y, xs)) in enumerate(models):
                        if not len(which[m]):
                            continue
                        picked = [cols.index(c) for c in (*xs, y)]
                        rows = there[:, picked].all(1)
                        x = np.column_stack([np.ones(rows.sum()), table[rows][:, picked[:-1]]])
                        hit = table[rows][:, picked[-1:]]
                        w = weights[rows][:, np.searchsorted(drawn, which[m])]
                        eta = np.clip(x @ at[m].T, -700, 700)
                        mu = 1 / (1 + np.exp(-eta))
                        total[m][:, 0] += (w * (hit * eta - np.logaddexp(0, eta))).sum(0)
                        k = x.shape[1]
                        total[m][:, 1 : k + 1] += (w * (hit - mu)).T @ x
                        bend = w * mu * (1 - mu)
                        for c, (i, j) in enumerate(combinations_with_replacement(range(k), 2), k + 1):
                            total[m][:, c] += (x[:, i] * x[:, j]) @ bend
            for m, w in enumerate(which):
                if len(w):
                    yield pd.DataFrame({"model": np.full(len(w), m, "int32"), "rep": w.astype("int32"), "s": list(total[m])})

        widest = max(1 + b.shape[1] + b.shape[1] * (b.shape[1] + 1) // 2 for b in at)
        parts = self.data.mapInPandas(run, "model int, rep int, s array<double>")
        cells = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(widest)]
        return parts.groupBy("model", "rep").agg(*cells).collect()

    def run(self, max_iter: int) -> None:
        for _ in range(max_iter):
            if not any(o.any() for o in self.open):
                break
            for row in self.sums():
                m, r = row["model"], row["rep"]
                k = self.beta[m].shape[1]
                flat = np.array(row[2 : 3 + k + k * (k + 1) // 2], float)
                curve = _square(flat[k + 1 :], k) if np.all(np.isfinite(flat)) else np.zeros((k, k))
                if np.linalg.cond(curve) > 1e14:
                    continue
                step = np.linalg.solve(curve, flat[1 : k + 1])
                self.beta[m][r] += np.clip(step, -5, 5)
                self.curve[m][r], self.likelihood[m, r] = curve, flat[0]
                self.open[m][r] = np.abs(step).max() >= 1e-8


def logit_set(df: DataFrame, models: Models, max_iter: int = 50) -> DataFrame:
    """Binomial models with a constant: estimates, standard errors, z, p values, odds
    ratios and AIC. All models take a Newton step in the same reading of the rows;
    one that does not converge has nulls."""
    fits = _Newton(df, None, models, None, 0)
    fits.run(max_iter)
    rows = []
    for m, (name, (_, xs)) in enumerate(models.items()):
        beta, curve, done = fits.beta[m][0], fits.curve[m][0], not fits.open[m][0]
        se = np.sqrt(np.diag(np.linalg.inv(curve))) if done else np.zeros(len(beta))
        aic = 2 * len(beta) - 2 * float(fits.likelihood[m, 0])
        for i, term in enumerate(["(Intercept)", *xs]):
            b, z = float(beta[i]), float(beta[i] / se[i]) if done else None
            rows.append((name, term, b, float(se[i]), z, normal_two_sided(z), math.exp(b), aic) if done else (name, term, *[None] * 6))
    return df.sparkSession.createDataFrame(
        rows,
        "model string, term string, estimate double, std_error double, statistic double, p_value double, odds_ratio double, aic double",
    )


def boot_logit_set(df: DataFrame, key: str, models: Models, reps: int = 1000, seed: int = 636, max_iter: int = 50) -> DataFrame:
    """Binomial coefficients of every model in ``reps`` bootstrap samples of units,
    the same samples for all models: (model, rep, term, estimate, converged).

    A step reads the rows once for all models and replicates that are still open;
    a block of rows draws its weights once for all of them."""
    fits = _Newton(df, key, models, reps, seed)
    fits.run(max_iter)
    rows = [
        (name, r + 1, term, None if fits.open[m][r] else float(fits.beta[m][r, i]), bool(not fits.open[m][r]))
        for m, (name, (_, xs)) in enumerate(models.items())
        for r in range(reps)
        for i, term in enumerate(["(Intercept)", *xs])
    ]
    return df.sparkSession.createDataFrame(rows, "model string, rep int, term string, estimate double, converged boolean")
