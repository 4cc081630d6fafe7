"""Whitening of embeddings by an eigendecomposition that grows one vector at a time.

Every task keeps the spectrum of the vectors it has seen: their number, mean, and the eigenvalues and eigenvectors of their
scatter. A further vector is a centred rank-one update: in the basis of the eigenvectors the scatter becomes a diagonal
plus ``rho * z z'``, whose eigenvalues are the roots of the secular equation ``1 + rho * sum(z**2 / (d - x)) = 0``. Where z
is zero, or eigenvalues are equal, nothing needs solving (deflation). Spectra of tasks are combined in the same way: each
eigenvector of one is a rank-one update of the other, and so is the difference of their means. At last the basis is
refined: all tasks project their vectors on it, and the small matrix of their products is solved once more (Rayleigh-Ritz).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.session import materialize

#: Steps per unit of an entry; spectra combined by one task; components returned.
SCALE = 256
FAN_IN = 16
COMPONENTS = 4
_EPS = np.finfo(float).eps
_BLOCK = 4096


# --- one update ---------------------------------------------------------------------
def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + rho z z'`` as (nearest pole, distance from it); d ascending and apart, z nonzero, rho > 0.

    Root i lies between d[i] and d[i + 1] (the last one within rho * z'z). It is measured from the nearer end, so that its
    distances from both poles keep their digits. Newton steps on a pair of hyperbolas that take over the function and its
    slope on either side converge in a few rounds for all roots at once; a step that leaves its bracket is halved.
    """
    n = len(d)
    weight = rho * z * z
    width = np.append(np.diff(d), weight.sum())
    middle = d + width / 2
    value = 1 + (weight / (d - middle[:, None])).sum(1)
    near_right = value < 0
    near_right[-1] = False
    pole = np.arange(n) + near_right
    gap = d - d[pole][:, None]  # poles seen from each root's own pole
    low = np.where(near_right, -width / 2, np.where(value >= 0, 0.0, width / 2))
    high = np.where(near_right, 0.0, np.where(value >= 0, width / 2, width))
    left, right = gap[np.arange(n), np.arange(n)], np.append(gap[np.arange(n - 1), np.arange(1, n)], np.inf)
    last, to_end = np.isinf(right), np.where(np.isinf(right), 0.0, right)
    below = np.tri(n) * weight
    above = weight - below
    x = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(60):
            inverse = 1 / (gap - x[:, None])
            psi, phi = np.einsum("ij,ij->i", below, inverse), np.einsum("ij,ij->i", above, inverse)
            f = 1 + psi + phi
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            # f within its rounding, or no number left between the ends of the bracket
            done = (np.abs(f) <= 8 * n * _EPS * (1 - psi + phi)) | (high - low <= 4 * _EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            inverse *= inverse
            slope_left, slope_right = np.einsum("ij,ij->i", below, inverse), np.einsum("ij,ij->i", above, inverse)
            to_left, to_right = left - x, np.where(last, 0.0, to_end - x)
            a, b = slope_left * to_left**2, slope_right * to_right**2
            c = 1 + (psi - slope_left * to_left) + (phi - slope_right * to_right)
            # c + a / (left - y) + b / (right - y) = 0 for y between the poles
            p = c * (left + to_end) + a + b
            q = c * left * to_end + a * to_end + b * left
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            y = np.where(last, left + a / c, np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c)))
            x = np.where(done, x, np.where((y > low) & (y < high), y, (low + high) / 2))
    return pole, x


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``u diag(d) u' + rho v v'``."""
    z = v @ u
    size = float(z @ z)
    if not rho * size > 0:
        return d, u
    tiny = 8 * _EPS * max(float(d[-1]), rho * size)
    live = rho * np.sqrt(size) * np.abs(z) > tiny
    # equal eigenvalues: a rotation moves the vector into one of their directions
    order = np.flatnonzero(live)
    close = np.flatnonzero(np.diff(d[order]) <= tiny)
    if len(close):
        d, u, z = d.copy(), u.copy(), z.copy()
        for k in close:
            i, j = order[k], order[k + 1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
            z[i], z[j] = 0.0, r
            live[i] = False
    at = np.flatnonzero(live)
    pole, offset = secular_roots(d[at], z[at], rho)
    value = d[at][pole] + offset
    apart = (d[at] - d[at][pole][:, None]) - offset[:, None]  # d_j - root_i
    # the vector of which the computed roots are exact, so that eigenvectors are orthogonal
    poles = d[at] - d[at][:, None]  # d_j - d_i
    np.fill_diagonal(poles, 1.0)
    ratio = -apart / np.where(poles.T == 0, 1.0, poles.T)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0)) / rho) * np.sign(z[at])
    vectors = exact / apart
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    d, u = d.copy(), u.copy()
    d[at], u[:, at] = value, u[:, at] @ vectors.T
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Number, mean, and eigenvalues and eigenvectors of the scatter of vectors."""

    def __init__(self, size: int):
        self.n, self.mean, self.d, self.u = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, vector: np.ndarray) -> None:
        v = vector - self.mean
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, v, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + v / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.d, self.u = other.n, other.mean, other.d, other.u
            return
        for value, vector in zip(other.d, other.u.T, strict=True):
            self.d, self.u = rank_one(self.d, self.u, vector, float(value))
        apart, n = other.mean - self.mean, self.n + other.n
        self.d, self.u = rank_one(self.d, self.u, apart, self.n * other.n / n)
        self.mean, self.n = self.mean + apart * (other.n / n), n

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.d, self.u.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, size: int) -> Spectrum:
        out, values = cls(size), np.frombuffer(data)
        out.n, out.mean, out.d, out.u = int(values[0]), values[1 : size + 1], values[size + 1 : 2 * size + 1], values[2 * size + 1 :].reshape(size, size)
        return out


# --- tables -------------------------------------------------------------------------
def whole_steps(vector: Column) -> Column:
    """Entries as whole steps of 1/SCALE; null where the vector is null or an entry is null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    steps = F.transform(entries, lambda c: F.floor(c * SCALE))
    return F.when(~F.coalesce(bad, F.lit(False)) & vector.isNotNull(), steps)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def spectra(vectors: DataFrame, size: int) -> DataFrame:
    """``(part, spectrum)``: the spectrum of each task's vectors ``x``."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(size)
        for batch in batches:
            for vector in _matrix(batch.column(0), size).astype(float):
                spectrum.add(vector)
        if spectrum.n:
            yield pa.RecordBatch.from_pydict({"spectrum": [spectrum.packed()]})

    made = vectors.select("x").mapInArrow(grown, "spectrum binary")
    return made.select(F.spark_partition_id().cast("bigint").alias("part"), "spectrum")


def combined(table: DataFrame, size: int) -> Spectrum:
    """One spectrum of all tasks, in rounds that combine FAN_IN each; only the last one reaches the driver."""

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        total = Spectrum(size)
        for data in frame.sort_values("part")["spectrum"]:
            total.merge(Spectrum.unpacked(data, size))
        return pd.DataFrame({"part": [frame["part"].iloc[0] // FAN_IN], "spectrum": [total.packed()]})

    table = materialize(table)
    while (table.agg(F.max("part")).first()[0] or 0) > 0:
        table = materialize(table.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, "part bigint, spectrum binary"))
    last = table.first()
    return Spectrum.unpacked(last.spectrum, size) if last else Spectrum(size)


def _products(vectors: DataFrame, size: int, projection: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Mean product of the projections of the centred vectors; every task returns one matrix, summed entry by entry."""
    width = projection.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for lo in range(0, len(x), _BLOCK):
                y = _centred(x[lo : lo + _BLOCK], n, sums) @ projection
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": total.ravel()})

    sent = vectors.select("x").mapInArrow(summed, "i bigint, j bigint, v double")
    out = np.zeros((width, width))
    for r in sent.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return (out + out.T) / 2 / max(n, 1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: whole numbers are subtracted, so nothing but one division is rounded."""
    return (n * x - sums) / n


class Whitening:
    """Fit list's ``n`` and ``sums``, the leading eigenvectors by columns, their eigenvalues, and the trace."""

    def __init__(self, n: int, sums: np.ndarray, vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace

    @property
    def projection(self) -> np.ndarray:
        """Components without variance project to nothing."""
        positive = self.values > 0
        return np.where(positive, self.vectors / np.sqrt(np.where(positive, self.values, 1.0)), 0.0)


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the vectors ``x`` (arrays of whole numbers, each once, of at most ``size`` entries).

    The driver holds matrices of ``size`` x ``size`` numbers only.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), size).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size), "v": total})

    n, sums = vectors.count(), np.zeros(size, np.int64)
    for r in vectors.select("x").mapInArrow(summed, "i bigint, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    spectrum = combined(spectra(vectors, size), size)
    basis = np.linalg.qr(spectrum.u[:, ::-1])[0]
    values, turn = np.linalg.eigh(_products(vectors, size, basis, n, sums))
    values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
    found = basis @ turn[:, :components]
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    leading = np.where(values <= values[:1].sum() * size * _EPS, 0.0, values)[:components]
    return Whitening(n, sums, found, leading, float(values.sum()))


def whitened_rows(rows: DataFrame, size: int, by: Whitening, identity_error: float) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of rows ``(vec_id, x)``."""
    width = by.vectors.shape[1]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = by.values <= 0
        share = by.values / by.trace if by.trace > 0 else np.zeros(width)
        for batch in batches:
            x = _matrix(batch.column(1), size)
            y = _centred(x, by.n, by.sums) @ by.projection
            apart = by.n * x - by.sums
            count = len(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(np.repeat(np.arange(count), width)),
                    "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * width, by.n, np.int64)),
                    "deviation": pa.array(np.repeat((apart * apart).sum(1), width)),
                    "whitened": pa.array(y.ravel(), mask=np.tile(none, count)),
                    "explained": pa.array(np.tile(share, count)),
                    "identity_error": pa.array(np.full(count * width, identity_error)),
                }
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(projected, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The leading whitened components of every vector of ``table``.

    Entries become whole steps of 1/256; the fit takes each distinct vector once. Vectors that are null or hold a null or
    an entry that is not finite are dropped; shorter vectors count as filled up with zeros. Rows that repeat have rows
    each. There are as many components as the longest vector has entries, if those are fewer; a component without variance
    has a null ``whitened``. ``identity_error`` is measured on the fit list over the components with variance. ``deviation``
    needs ``n`` times the sums of squares to fit 64 bits. Other columns are ignored; an empty table gives an empty result.
    """
    rows = table.select(F.col(id_col).alias("vec_id"), whole_steps(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    fit_list = materialize(rows.select("x").distinct())
    size = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    if not size:
        return whitened_rows(rows.limit(0), 0, Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0), 0.0).withColumnRenamed("vec_id", id_col)
    by = fit(fit_list, size, components)
    kept = by.values > 0
    error = np.abs(_products(fit_list, size, by.projection[:, kept], by.n, by.sums) - np.eye(kept.sum())).max(initial=0.0) if kept.any() else 0.0
    return whitened_rows(rows, size, by, float(error)).withColumnRenamed("vec_id", id_col)
