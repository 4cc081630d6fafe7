"""Ratings of posts, literal and corrected, and domain reports."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.operators import daily, domains, ratings
from feedpanel.session import bucketed, work_tables

D = date


@pytest.fixture(scope="module")
def rated(spark):
    raw = [
        ("a.com", "AT", D(2021, 1, 1), 80.0, "Slightly Left"),
        ("a.com", "AT", D(2021, 1, 15), 70.0, None),
        ("a.com", "AT", D(2021, 2, 1), 50.0, "Far Left"),
        ("a.com", "AT", D(2020, 2, 1), 1.0, None),
        ("b.com", "DE", D(2021, 1, 1), 30.0, "Right"),
        ("b.com", "DE", D(2021, 3, 1), 30.0, "Right"),
    ]
    df = spark.createDataFrame(raw, "Domain string, Country string, file_date date, Score double, Orientation string")
    return ratings.build_ratings(df)


def test_build_ratings(rated):
    got = {(r["Domain"], r["file_month"]): (r["Score"], r["Orientation"]) for r in rated.collect()}
    assert got["a.com", D(2021, 1, 1)] == (70.0, "Neutral")
    assert got["a.com", D(2021, 2, 1)] == (50.0, "Left")
    assert ratings.country_domains(rated).count() == 1


@pytest.fixture(scope="module")
def posts(spark):
    t = datetime
    rows = [
        ("1", "u", t(2021, 1, 5), "ua ub"),
        ("2", "u", t(2021, 2, 5), "ux ua"),
        ("3", "u", t(2020, 5, 5), "ua"),
        ("4", "u", t(2020, 5, 5), "ua ub"),
        ("5", "u", t(2021, 2, 5), "ub"),
        ("6", "u", t(2021, 2, 5), None),
        ("1", "u", t(2021, 1, 5), "ua ub"),
    ]
    return spark.createDataFrame(rows, "id string, author_id string, created_at timestamp, expanded_urls string")


@pytest.fixture(scope="module")
def matched(spark):
    return spark.createDataFrame([("ua", "a.com"), ("ub", "b.com")], "url string, ng_domain string")


def rows_of(df):
    return {r["id"]: (r["ng_domain"], r["Score"], r["Orientation"]) for r in df.collect()}


def test_corrected_scores(posts, matched, rated):
    got = rows_of(ratings.rate_posts(posts, matched, rated))
    assert got["1"] == ("a.com, b.com", 50.0, "Neutral, Right")
    # the first link is not rated: the score of the second one counts
    assert got["2"] == ("a.com", 50.0, "Left")
    # before the first rated month: mean over the domain's months
    assert got["3"] == ("a.com", 60.0, "Left, Neutral")
    assert got["4"] == ("a.com, b.com", pytest.approx((70 + 50 + 30 + 30) / 4), "Left, Neutral, Right")
    # no rating in that month: the matched domain stays, no score
    assert got["5"] == ("b.com", None, None)
    assert got["6"] == (None, None, None)
    assert len(got) == 6


def test_literal_scores(posts, matched, rated):
    got = rows_of(ratings.rate_posts(posts, matched, rated, literal=True))
    assert got["2"] == (None, None, None)
    assert got["3"][:2] == ("a.com, a.com", 60.0)
    assert got["4"][1] == pytest.approx(45.0)
    assert sorted(got["3"][2].split(", ")) == ["Left", "Neutral"]


def test_literal_ratings_keep_one_row_per_link(spark, posts, matched, rated):
    links = ratings.attach_domains(posts, matched)
    rows = ratings.attach_rating(links, rated, literal=True)
    # a link before the first month is not repeated for every month of its domain
    assert rows.count() == links.count() == 9
    got = {(r["id"], r["ng_domain"]): (r["n_ratings"], [(x["label"], x["n"]) for x in r["_labels"]]) for r in rows.filter("_labels IS NOT NULL").collect()}
    assert got["4", "a.com"] == (2, [("Left", 1), ("Neutral", 1)]) and got["4", "b.com"] == (2, [("Right", 2)])
    merged = rows_of(ratings.merge_multilink(rows, literal=True))
    assert merged["4"] == ("a.com, a.com, b.com, b.com", pytest.approx(45.0), "Left, Neutral, Right, Right")


def test_literal_ratings_without_score_or_label(spark):
    day = datetime(2020, 5, 5)
    posts = spark.createDataFrame([("1", "u", day, "ua"), ("2", "u", day, "ub"), ("3", "u", day, "uc ua"), ("4", "u", day, "ub uc")], "id string, author_id string, created_at timestamp, expanded_urls string")
    matched = spark.createDataFrame([(f"u{x}", x) for x in "abc"], "url string, ng_domain string")
    raw = [("a", D(2021, 1, 1), None, "Right"), ("a", D(2021, 2, 1), 50.0, None), ("b", D(2021, 1, 1), 30.0, "Left"), ("b", D(2021, 2, 1), None, "Left"), ("c", D(2021, 1, 1), 20.0, "Right"), ("c", D(2021, 2, 1), 10.0, None)]
    rated = spark.createDataFrame(raw, "Domain string, file_month date, Score double, Orientation string")
    got = rows_of(ratings.rate_posts(posts, matched, rated, literal=True))
    # one scored row: the first row of the first link decides, no label before any label, no score before any score
    assert got["1"] == ("a", 50.0, None)
    assert got["2"] == ("b", None, "Left")
    assert got["3"] == ("c, c, a", pytest.approx(80 / 3), "Right")
    assert got["4"] == ("b, c, c", 20.0, "Left, Right")


def test_band_gaps(spark):
    scores = spark.createDataFrame([(x,) for x in (39.0, 39.5, 59.5, 60.0, 74.5, 99.5, 100.0)], "Score double")
    got = [r[0] for r in scores.select(S.score_band(F.col("Score"))).collect()]
    assert got == ["max_caution", None, None, "exceptions", None, None, "high_credibility"]
    below = scores.agg(F.count_if(F.col("Score") < 60)).first()[0]
    in_bands = sum(b in ("max_caution", "caution") for b in got)
    assert below == in_bands + 2


def test_criterion(spark):
    raw = spark.createDataFrame(
        [("a", "AT", D(2021, 1, 1), 50.0, "yes", None), ("a", "AT", D(2021, 2, 1), 50.0, None, "No"), ("b", "AT", D(2021, 1, 1), 40.0, None, None)],
        "Domain string, Country string, file_date date, Score double, c1 string, c2 string",
    )
    r = ratings.ratings_with_criterion(raw, ["c1", "c2"])
    assert ratings.criterion_coverage(r).first()["share_missing_criterion"] == pytest.approx(1 / 3)
    by = {x["Domain"]: x["passes"] for x in ratings.rating_by_domain(r).collect()}
    assert by == {"a": False, "b": None}
    links = spark.createDataFrame(
        [("1", "a", D(2020, 1, 1), 50.0), ("1", "a", D(2020, 1, 1), 50.0), ("2", "a", D(2021, 1, 1), 50.0), ("2", "b", D(2021, 1, 1), 45.0)],
        "id string, ng_domain string, month date, Score double",
    )
    full = ratings.attach_criterion(links, r)
    assert full.count() == 3
    shares = {(x["level"], x["name"]): (x["n"], x["share_failing"]) for x in ratings.share_failing(full).collect()}
    assert shares["link", "all"] == (2, 0.5)
    assert shares["post", "all"] == (2, 0.5)
    assert shares["domain", "all"] == (1, 1.0)
    assert shares["year", "2020"] == (1, 1.0)


def test_domain_classes(spark):
    uses = spark.createDataFrame(
        [(D(2022, 6, d), "a", s, 1) for d, s in ((1, 70.0), (2, 50.0), (3, 40.0), (4, 80.0))] + [(D(2022, 6, 1), "b", 20.0, 5)],
        "day date, ng_domain string, Score double, n_used bigint",
    )
    got = {(r["ng_domain"], r["day"].day): r["classification"] for r in domains.classify_domains(uses).collect()}
    assert got == {("a", 1): "Other", ("a", 2): "downrated", ("a", 3): "stable", ("a", 4): "Other", ("b", 1): "first"}
    ba = domains.before_after(uses, "2022-06-03").collect()
    assert {(r["ng_domain"], r["Score"], r["before"], r["after"], r["pct_change"]) for r in ba} == {
        ("a", 50.0, 1, 0, -100.0), ("a", 40.0, 0, 1, None), ("b", 20.0, 5, 0, -100.0)}


def test_series_helpers(spark):
    d = spark.createDataFrame([(D(2021, 1, 1), 4), (D(2021, 1, 4), 8)], "day date, n bigint")
    full = daily.fill_days(d, ["n"])
    assert [r["n"] for r in full.orderBy("day").collect()] == [4, 0, 0, 8]
    assert [r["n"] for r in daily.rolling_means(full, ["n"], 2).orderBy("day").collect()] == [2.0, 0.0, 4.0]
    assert daily.trim_ends(full).count() == 2
    steps = daily.interventions(full, {"s": "2021-01-03"}, "2021-01-03").orderBy("day").collect()
    assert [(r["s"], r["ramp"]) for r in steps] == [(0, 0), (0, 0), (1, 1), (1, 2)]


def test_iso_week(spark):
    df = spark.createDataFrame([(D(2021, 1, 3),), (D(2021, 1, 4),)], "d date")
    assert [r[0] for r in df.select(S.iso_week(F.col("d"))).collect()] == ["2020-53", "2021-01"]
    assert [r[0] for r in df.select(S.week_start(F.col("d"), "sunday")).collect()] == [D(2021, 1, 3), D(2021, 1, 3)]


def test_share_failing_stores_the_links_once(spark):
    rows = [(i, f"d{i % 7}", date(2021 + i % 2, 1 + i % 12, 1), float(i % 90), [None, True, False][i % 3]) for i in range(300)]
    rows += [(i, "hot", date(2021, 1, 1), 5.0, False) for i in range(200)]
    links = spark.createDataFrame(rows, "id int, ng_domain string, month date, ng_score double, passes boolean")
    got = {(r["level"], r["name"]): (r["n"], r["share_failing"]) for r in ratings.share_failing(links).collect()}
    low = [r for r in rows if r[3] < 60 and r[4] is not None]
    domains = {d: [not r[4] for r in low if r[1] == d] for d in {r[1] for r in low}}
    posts = {i: any(r[4] is False for r in rows if r[0] == i) for i in {r[0] for r in rows if r[4] is not None}}
    want = {("link", "all"): (len(low), sum(not r[4] for r in low) / len(low)),
            ("post", "all"): (len(posts), sum(posts.values()) / len(posts)),
            ("domain", "all"): (len(domains), sum(sum(f) / len(f) >= 0.5 for f in domains.values()) / len(domains))}
    for y in (2021, 2022):
        mine = [not r[4] for r in low if r[2].year == y]
        want[("year", str(y))] = (len(mine), sum(mine) / len(mine))
    assert got == {k: (n, pytest.approx(s)) for k, (n, s) in want.items()}
    none = ratings.share_failing(links.limit(0)).filter("level <> 'year'").collect()
    assert {(r["level"], r["n"], r["share_failing"]) for r in none} == {("link", 0, None), ("post", 0, None), ("domain", 0, None)}


def test_buckets_are_grouped_without_a_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 300).alias("k"), "id")
    with work_tables(spark):
        stored = bucketed(df, ["k"])
        plan = stored.groupBy("k").agg(F.sum("id"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and stored.count() == 1000
        name = stored.inputFiles()[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("feedpanel_") and t.name in name]
