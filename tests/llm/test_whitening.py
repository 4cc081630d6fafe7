import math

import numpy as np
import pytest

from feedpanel.llm.whitening import Spectrum, combined, rank_one, secular_roots, spectra, whiten


def scatter(d, u):
    return u @ np.diag(d) @ u.T


@pytest.mark.parametrize("kind", ["random", "zeros", "equal", "close", "sparse", "scales", "same"])
def test_rank_one_update(kind):
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 33, 64):
        d = np.sort(rng.random(size))
        v, rho = rng.normal(size=size), 0.7
        u = np.linalg.qr(rng.normal(size=(size, size)))[0]
        if kind == "zeros":
            d[: size // 2] = 0
        elif kind == "equal":
            d[:] = 1.0
        elif kind == "close":
            d = 1 + np.sort(rng.random(size)) * 1e-13
        elif kind == "sparse":
            v = u[:, 0] + (u[:, -1] if size > 1 else 0)
        elif kind == "scales":
            d, v = np.sort(10.0 ** rng.uniform(-12, 6, size)), v * 10.0 ** rng.uniform(-8, 3, size)
        elif kind == "same":
            v, rho = u[:, -1] * 3, 2.0
        want = np.linalg.eigvalsh(scatter(d, u) + rho * np.outer(v, v))
        value, vectors = rank_one(d, u, v, rho)
        top = want[-1]
        assert np.allclose(value, want, rtol=0, atol=1e-13 * size * top)
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)
        assert np.allclose(scatter(value, vectors), scatter(d, u) + rho * np.outer(v, v), rtol=0, atol=1e-13 * size * top)


def test_secular_roots_lie_between_poles():
    rng = np.random.default_rng(1)
    d = np.sort(rng.random(40) * 10.0 ** rng.integers(-3, 3, 40))
    z = rng.normal(size=40) * 10.0 ** rng.integers(-6, 1, 40)
    pole, offset = secular_roots(d, z, 1.5)
    value = d[pole] + offset
    assert (value >= d).all() and (value[:-1] <= d[1:]).all()
    apart = d - d[pole][:, None] - offset[:, None]
    f, size = 1 + (1.5 * z * z / apart).sum(1), 1 + np.abs(1.5 * z * z / apart).sum(1)
    assert (np.abs(f) < 1e-12 * size).all()


def test_spectra_combine(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (300, 6)) * np.array([1, 2, 3, 4, 5, 6]) + 1000
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(40)
    total = combined(spectra(frame, 6), 6)
    assert total.n == 300 and np.allclose(total.mean, x.mean(0))
    assert np.allclose(scatter(total.d, total.u), np.cov(x.T, bias=True) * 300, rtol=1e-10)
    alone = Spectrum(6)
    for v in x.astype(float):
        alone.add(v)
    assert np.allclose(alone.d, total.d, rtol=1e-10)


def brute(rows, components=4):
    steps = []
    for i, vector in rows:
        if vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        steps.append((i, [math.floor(256 * float(np.float32(c))) for c in vector]))
    size = max(len(x) for _, x in steps)
    steps = [(i, x + [0] * (size - len(x))) for i, x in steps]
    fit = np.array(sorted({tuple(x) for _, x in steps}))
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values < 1e-12 * max(values[0], 0), 0, values)
    out = []
    for i, x in steps:
        y = (n * np.array(x) - sums) / n @ vectors
        deviation = int(((n * np.array(x, object) - sums.astype(object)) ** 2).sum())
        for c in range(min(components, size)):
            white = None if values[c] <= 0 else y[c] / math.sqrt(values[c])
            out.append((str(i), c + 1, n, deviation, white, values[c] / values.sum() if values.sum() > 0 else 0.0))
    return out


def compare(found, want):
    found = [(str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained) for r in found]
    signs = {}
    for c in {w[1] for w in want}:
        a = max((w for w in want if w[1] == c and w[4] is not None), key=lambda w: abs(w[4]), default=None)
        if a:
            signs[c] = next(math.copysign(1, f[4] * a[4]) for f in found if f[:2] == a[:2] and f[3] == a[3])
    key = lambda r: (r[0], r[1], r[3])
    want = sorted(((*w[:4], None if w[4] is None else w[4] * signs[w[1]], w[5]) for w in want), key=key)
    for f, w in zip(sorted(found, key=key), want, strict=True):
        assert f[:4] == w[:4] and (f[4] is None) == (w[4] is None) and abs(f[5] - w[5]) < 1e-10
        assert f[4] is None or abs(f[4] - w[4]) < 1e-9


def test_corpus(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = whiten(table).collect()
    compare(found, brute([(r.vec_id, r.embedding) for r in table.collect()]))
    assert {r.identity_error < 1e-9 for r in found} == {True}


@pytest.mark.filterwarnings("ignore")
def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0]), (2, [1.0, -0.5, 0.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (6, [None, 1.0, 1.0]), (None, [-0.1, 0.7, 3.0]), (7, [0.3, 0.9]), (8, [2.0, 2.0, -7.5])]
    schema = "vec_id bigint, embedding array<float>, x int, part int, n int"
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    compare(whiten(frame).collect(), brute(rows))
    flat = spark.createDataFrame([(1, [1.0, 1.0], 1, 1, 1), (2, [2.0, 1.0], 1, 1, 1), (3, [2.0, 1.0], 1, 1, 1)], schema)
    compare(whiten(flat).collect(), brute([(1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0])]))
    one = whiten(flat.filter("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 2
    assert whiten(frame.limit(0)).count() == 0
    assert whiten(frame.filter("vec_id = 3")).count() == 0
