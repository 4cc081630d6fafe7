"""Emotion dynamics, event windows and variance shares against plain Python."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedpanel.functions import exact
from feedpanel.operators import features, panel, sharers, stats, windows
from feedpanel.schema import EMOTIONS, check_language_set

START = datetime(2020, 12, 20)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(1500):
        author = "1" if rng.random() < 0.6 else str(rng.randrange(2, 9))
        # coarse times give equal instants, whole hours and gaps below an hour
        at = START + timedelta(minutes=20 * rng.randrange(3 * 24 * 30))
        scores = [rng.choice([0.0, 0.25, rng.random()]) for _ in EMOTIONS]
        if rng.random() < 0.2:
            scores = [None, None, None]
        rated = rng.random() < 0.3
        out.append((str(i), author, at, rng.choice(["de", "en", "fr", None]), *scores,
                    "x.org" if rated else None, rng.choice([20.0, 59.5, 60.0, 100.0]) if rated else None,
                    rng.choice(["Left", "Neutral"]) if rated else None))
    return out


@pytest.fixture(scope="module")
def posts(spark, rows):
    schema = ("id string, author_id string, created_at timestamp, lang string, anger_v2 double, fear_v2 double, "
              "disgust_v2 double, ng_domain string, Score double, Orientation string")
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def weekly_groups(rows):
    groups = defaultdict(list)
    for r in sorted((r for r in rows if r[4] is not None), key=lambda r: (r[2], r[0])):
        iso = r[2].isocalendar()
        groups[r[1], f"{iso[0]}-{iso[1]:02d}"].append(r)
    return groups


def inertia(values, times):
    xs, ys, hs = [], [], []
    for (a, s), (b, t) in zip(zip(values, times), zip(values[1:], times[1:])):
        h = int((t - s).total_seconds() // 3600)
        if h > 0 and a != 0 and b != 0:
            xs.append(a), ys.append(b), hs.append(h)
    if len(xs) < 2 or np.std(xs) == 0 or np.std(ys) == 0:
        return None
    x = -np.array(hs, dtype=float)
    y = np.log(np.abs(np.array(ys) / np.array(xs)))
    return math.exp(-abs((x * y).sum() / (x * x).sum()))


def test_dynamics(posts, rows):
    got = {r["author_id"]: r for r in features.user_features(posts).collect()}
    mssd, phi = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
    for (author, _), group in weekly_groups(rows).items():
        if len(group) < 10:
            continue
        times = [r[2] for r in group]
        for k, e in enumerate(EMOTIONS):
            v = [r[4 + k] for r in group]
            sq = [(b - a) ** 2 for a, b, s, t in zip(v, v[1:], times, times[1:]) if t > s]
            if sq:
                mssd[author][e].append(np.mean(sq))
            p = inertia(v, times)
            if p is not None:
                phi[author][e].append(p)
    assert set(got) == {r[1] for r in rows}
    for author, row in got.items():
        for e in EMOTIONS:
            for name, table in (("instability", mssd), ("inertia", phi)):
                want = table[author].get(e)
                value = row[f"{e}_{name}"]
                assert value == (pytest.approx(np.mean(want)) if want else None)
                assert name != "inertia" or value is None or 0 < value <= 1
    assert got["1"]["n_tweets"] == sum(r[1] == "1" for r in rows)
    assert sum(r["n_news_shared"] for r in got.values()) == sum(r[7] is not None for r in rows)


def test_weekly_variant_agrees(posts):
    wide = features.window_features(posts).join(features.user_features(posts), "author_id")
    for e in EMOTIONS:
        for m in ("instability", "inertia"):
            a, b = F.col(f"{e}_{m}_week"), F.col(f"{e}_{m}")
            assert wide.filter(~a.eqNullSafe(b) & (F.abs(a - b) > 1e-12)).count() == 0


def test_variance_shares_add_up(posts):
    shares = features.variance_decomposition(posts)
    assert [r["s"] for r in shares.groupBy("emotion").agg(F.sum("pct_of_total").alias("s")).collect()] == [pytest.approx(100)] * 3
    within = shares.groupBy("emotion").agg(F.sum("pct_of_within_user").alias("s")).collect()
    assert [r["s"] for r in within] == [pytest.approx(100)] * 3
    assert shares.count() == 15


@pytest.mark.parametrize("hours", [1, 24])
def test_event_windows(posts, rows, hours):
    span = timedelta(hours=hours)
    got = {r["event_id"]: r for r in windows.event_windows(posts, hours, 3).collect()}
    seen = 0
    for ev in rows:
        if ev[8] is None:
            continue
        mine = [r for r in rows if r[1] == ev[1]]
        sides = {
            "before": [r for r in mine if ev[2] - span <= r[2] < ev[2]],
            "after": [r for r in mine if ev[2] < r[2] <= ev[2] + span],
        }
        scored = {s: [r for r in g if r[4] is not None] for s, g in sides.items()}
        if not (scored["before"] and scored["after"]):
            assert ev[0] not in got
            continue
        seen += 1
        row = got[ev[0]]
        for s, g in sides.items():
            assert row[f"n_tweets_{s}"] == len(g) and row[f"n_fear_{s}"] == len(scored[s])
            mean = np.mean([r[5] for r in scored[s]]) if len(scored[s]) >= 3 else None
            assert row[f"mean_fear_{s}"] == (pytest.approx(mean) if mean is not None else None)
    assert seen == len(got) > 0


def test_pooled_window_values(posts, rows):
    kept = windows.event_windows(posts, 24, 3)
    pool = defaultdict(int)
    for ev in kept.collect():
        for r in rows:
            if r[1] == ev["author_id"] and r[4] is not None and ev["event_timestamp"] - timedelta(hours=24) <= r[2] < ev["event_timestamp"]:
                pool[r[4]] += 1
    got = {r["value"]: r["weight"] for r in windows.window_values(posts, kept, 24, "anger", "before").collect()}
    assert got == dict(pool)


def test_languages(posts, rows):
    masked = panel.mask_language(posts, "de_en")
    assert masked.count() == len(rows)
    assert masked.filter("anger_v2 IS NOT NULL").count() == sum(r[3] in ("de", "en") and r[4] is not None for r in rows)
    with pytest.raises(ValueError):
        check_language_set("xx")


def test_supersharers(spark):
    counts = [("3", 50), ("10", 30), ("2", 30), ("7", 10), ("9", 0)]
    totals = spark.createDataFrame(counts, "author_id string, c bigint")
    conc = sharers.concentration(totals, "c")
    got = [(r["author_id"], r["user_rank"], r["cumsum_count"]) for r in conc.orderBy("user_rank").collect()]
    # ties by numeric id: 2 comes before 10
    assert got == [("3", 1, 50), ("2", 2, 80), ("10", 3, 110), ("7", 4, 120), ("9", 5, 120)]
    top = {r["author_id"] for r in sharers.supersharers(conc, 0.8).collect()}
    assert top == {"3", "2", "10"}
    assert sharers.concentration(totals, "c", drop_zero=True).count() == 4


def test_ntiles(spark):
    df = spark.range(23).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7 % 23).alias("v"))
    got = windows.ntiles(df, "v", "k").groupBy("decile").count().orderBy("decile").collect()
    assert [r["count"] for r in got] == [3, 3, 3] + [2] * 7


def test_activity_filter(spark):
    times = [("a", START)] * 3 + [("b", START)] * 2 + [("b", START + timedelta(days=1))] * 4
    posts = spark.createDataFrame(times, "author_id string, created_at timestamp")
    assert {r[0] for r in panel.activity_filter(posts, 4).collect()} == {"a"}
    assert {r[0] for r in panel.activity_filter(posts, 4, literal=True).collect()} == {"a", "b"}


def test_period_is_half_open(spark):
    times = ["2018-12-31 23:59:59.999", "2019-01-01 00:00:00", "2023-03-31 23:59:59.999", "2023-04-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("created_at"))
    assert panel.in_period(df).count() == 2


def test_exact_sums(spark):
    rng = random.Random(5)
    values = [rng.choice([1e6, -1.0, 1e-5, 3.0]) * rng.random() for _ in range(5000)] + [0.0, 1e6, -1e6]
    unit = exact.unit_of(max(map(abs, values)))
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "x double, g int").repartition(5)
    sums = df.groupBy("g").agg(*[F.sum(k).alias(f"k{i}") for i, k in enumerate(exact.cuts(F.col("x"), unit))])
    total = exact.put_together([F.col(f"k{i}") for i in range(exact.CUTS)], unit)
    got = {r["g"]: r["s"] for r in sums.select("g", total.alias("s")).collect()}
    assert got == {g: math.fsum(v for i, v in enumerate(values) if i % 7 == g) for g in range(7)}
    assert exact.unit_of(None) == exact.unit_of(0.0) == 1.0


def test_windows_of_a_busy_author_lose_no_digits(spark):
    """Small scores behind large ones: differences of plain running sums would miss their last digits."""
    rows = [(str(i), "a", datetime(2024, 1, 1) + timedelta(minutes=i), 1e9 / 3 if i < 3000 else 1e-3 / 3, 80.0 if i > 3900 else None) for i in range(4000)]
    posts = spark.createDataFrame(rows, "id string, author_id string, created_at timestamp, anger_v2 double, Score double")
    events = windows.news_events(posts)
    got = {int(r["event_id"]): r["s_anger_before"] for r in windows.window_totals(posts, events, 1, ["anger"]).collect()}
    assert got == {i: math.fsum([1e-3 / 3] * 60) for i in range(3901, 4000)}


def test_large_values_cost_no_digits(spark):
    rng = random.Random(6)
    days = [datetime(2021, 1, 1) + timedelta(hours=7 * i) for i in range(600)]
    rows = [(f"u{rng.randrange(9)}", d, rng.gauss(rng.randrange(3), 1)) for d in days]

    def table(shift):
        return spark.createDataFrame([(u, d, x + shift) for u, d, x in rows], "author_id string, created_at timestamp, anger_v2 double")

    near, far = ({r["component"]: r["pct_of_total"] for r in features.variance_decomposition(table(s), ["anger"]).collect()} for s in (0.0, 1e9))
    assert far == {k: pytest.approx(v, abs=1e-4) for k, v in near.items()} and sum(near.values()) == pytest.approx(100)
    near, far = (stats.icc_anova(table(s), "anger_v2", "author_id").first() for s in (0.0, 1e9))
    assert far["icc"] == pytest.approx(near["icc"], abs=1e-6) and far["ms_between"] == pytest.approx(near["ms_between"], rel=1e-6)
