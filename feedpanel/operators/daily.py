"""Daily series: panel counts, thresholds, hashtags, shares and weekly rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.functions.text import split_list
from feedpanel.operators.ordered import column_quantiles, exact_quantiles, first_rows
from feedpanel.operators.panel import add_day
from feedpanel.schema import EMOTIONS

BANDS = ["max_caution", "caution", "exceptions", "generally_credible", "high_credibility"]


def score_quantiles(
    posts: DataFrame, probs: dict[str, float], emotions: Sequence[str] = EMOTIONS, stored: bool = False
) -> DataFrame:
    """Exact quantiles over all scored posts, one row per emotion; ``stored`` posts
    are read as they are, others written once."""
    wide = posts.select(*[F.col(f"{e}_v2").alias(e) for e in emotions])
    return column_quantiles(wide, list(emotions), probs, stored).withColumnRenamed("variable", "emotion")


def third_quartiles(posts: DataFrame, emotions: Sequence[str] = EMOTIONS, stored: bool = False) -> dict[str, float]:
    """The q3 cutoffs as constants (one row per emotion reaches the driver)."""
    rows = score_quantiles(posts, {"q3": 0.75}, emotions, stored).collect()
    return {r["emotion"]: r["q3"] for r in rows}


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def daily_panel(
    posts: DataFrame, q3: dict[str, float], emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """All daily counts and means. Distinct authors are counted next to the other
    measures, not with them: (day, author) groups would carry every buffer."""
    band = S.score_band(F.col("Score"))
    label = F.col("Orientation")

    def reached(cutoffs: dict[str, float], suffix: str) -> list[Column]:
        return [
            # without a cutoff (no scored post) nothing reaches it
            F.count_if(F.col(f"{e}_v2") >= F.lit(cutoffs.get(e)).cast("double")).alias(f"count_{e}_{suffix}")
            for e in emotions
        ]

    by_day = add_day(posts)
    active = by_day.select("day", "author_id").distinct().groupBy("day")
    n_authors = active.agg(F.count("author_id").alias("n_authors"))
    return (
        by_day.groupBy("day")
        .agg(
            F.count(F.lit(1)).alias("tweet_count"),
            F.count(f"{emotions[0]}_v2").alias("n_scored"),
            F.count("ng_domain").alias("count_ng_domains"),
            F.count("Score").alias("count_ng_scored"),
            *[_count(band == b, f"count_{b}") for b in BANDS],
            F.avg("Score").alias("mean_score"),
            *[_count(label == o, f"count_{o.lower()}") for o in ("Right", "Neutral", "Left")],
            *reached(dict.fromkeys(emotions, 0.5), "05"),
            *reached(dict.fromkeys(emotions, 0.65), "065"),
            *reached(q3, "q3"),
            *[F.avg(f"{e}_v2").alias(f"mean_{e}") for e in emotions],
        )
        .join(n_authors, "day")
    )


def daily_thresholds(posts: DataFrame, cutoffs: Sequence[int] = (40, 50, 60, 70)) -> DataFrame:
    return (
        add_day(posts)
        .groupBy("day")
        .agg(
            F.count(F.lit(1)).alias("tweet_count"),
            F.count("Score").alias("n_rated"),
            *[_count(F.col("Score") < t, f"N_{t}") for t in cutoffs],
        )
    )


def daily_hashtags(posts: DataFrame, sep: str = " ") -> DataFrame:
    """Uses of each hashtag per day (the day's list as a table, never one cell),
    with the day's total."""
    counts = (
        add_day(posts)
        .select("day", F.explode(split_list(F.col("hashtags"), sep)).alias("hashtag"))
        .groupBy("day", "hashtag")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    totals = counts.groupBy("day").agg(F.sum("uses").alias("hashtag_count"))
    return counts.join(totals, "day")


def top_hashtags(hashtags: DataFrame, k: int = 3) -> DataFrame:
    """The k most used hashtags per day in columns top_1..top_k, null-padded;
    ties go to the alphabetically first."""
    top = first_rows(hashtags.withColumn("_down", -F.col("uses")), ["day"], ["_down", "hashtag"], k)
    return top.groupBy("day").agg(
        *[F.max(F.when(F.col("rn") == i, F.col("hashtag"))).alias(f"top_{i}") for i in range(1, k + 1)]
    )


def panel_totals(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("n_tweets"),
        F.count("Score").alias("n_rated_tweets"),
        _count(F.col("Score") < 60, "n_untrustworthy_tweets"),
    )


def daily_shares(
    daily: DataFrame,
    thr: str = "065",
    denom: str = "n_scored",
    trust_denom: str = "tweet_count",
    emotions: Sequence[str] = EMOTIONS,
    cutoff: int | None = None,
) -> DataFrame:
    """Shares in percent. ``denom`` divides emotion counts, ``trust_denom`` the
    untrustworthy count; ``cutoff`` uses N_<cutoff> over n_rated instead."""

    def pct(part: Column, whole: str) -> Column:
        return S.share(part, F.col(whole), 100.0)

    low = F.col("count_caution") + F.col("count_max_caution")
    trust = pct(low, trust_denom) if cutoff is None else pct(F.col(f"N_{cutoff}"), "n_rated")
    right, left = F.col("count_right"), F.col("count_left")
    return daily.withColumns(
        {
            "prop_news": pct(F.col("count_ng_domains"), "tweet_count"),
            "prop_misinfo": trust,
            "prop_right": pct(right, "tweet_count"),
            "prop_left": pct(left, "tweet_count"),
            "prop_bias": pct(right + left, "tweet_count"),
        }
        | {f"prop_{e}": pct(F.col(f"count_{e}_{thr}"), denom) for e in emotions}
    )


def fill_days(daily: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """Adds days without posts; the named counts become 0 there, the rest null."""
    ends = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = ends.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(daily, "day", "left").fillna(0, subset=list(counts))


def interventions(daily: DataFrame, steps: dict[str, str], ramp_from: str | None = None) -> DataFrame:
    """0/1 step columns from the given days and a ramp counting days from one."""
    out = daily.withColumns(
        {name: (F.col("day") >= F.lit(d).cast("date")).cast("int") for name, d in steps.items()}
    )
    if ramp_from is None:
        return out
    since = F.datediff("day", F.lit(ramp_from).cast("date")) + 1
    return out.withColumn("ramp", F.greatest(since, F.lit(0)))


def _by_day() -> Window:
    # One row per calendar day: the series is bounded by the length of the period.
    return Window.partitionBy(F.lit(0)).orderBy("day")


def rolling_means(daily: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Trailing mean over k days; the incomplete head is dropped."""
    frame = _by_day().rowsBetween(-(k - 1), 0)
    out = daily.withColumns({c: F.avg(c).over(frame) for c in cols})
    return out.withColumn("_n", F.row_number().over(_by_day())).filter(F.col("_n") >= k).drop("_n")


def differences(daily: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First differences of the series, the first day dropped."""
    out = daily.withColumns(
        {f"d_{c}": F.col(c) - F.lag(c).over(_by_day()) for c in cols}
        | {"_n": F.row_number().over(_by_day())}
    )
    return out.filter(F.col("_n") > 1).drop("_n")


def trim_ends(series: DataFrame, order: str = "day") -> DataFrame:
    """Drops the first and the last row of the series."""
    first = series.agg(F.min(order)).scalar()
    last = series.agg(F.max(order)).scalar()
    return series.filter((F.col(order) > first) & (F.col(order) < last))


def observation_days(outliers: DataFrame, start: Column, index: str = "ind") -> DataFrame:
    """Calendar day of the index-th observation (1-based) of a gapless series."""
    return outliers.withColumn("day", F.date_add(start, F.col(index) - 1))


def weekly_rollup(
    daily: DataFrame, sums: Sequence[str], means: Sequence[str] = (), first: str = "sunday"
) -> DataFrame:
    return (
        daily.groupBy(S.week_start(F.col("day"), first).alias("week"))
        .agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])
    )


def with_trust_counts(daily: DataFrame) -> DataFrame:
    return daily.withColumns(
        {
            "count_trustworthy": F.col("count_exceptions")
            + F.col("count_generally_credible")
            + F.col("count_high_credibility"),
            "count_untrustworthy": F.col("count_max_caution") + F.col("count_caution"),
        }
    )


def weekly_shares(weekly: DataFrame) -> DataFrame:
    """Trustworthy and untrustworthy share of news per week, long form."""
    news = F.col("count_ng_domains")
    wide = weekly.select(
        "week",
        S.share(F.col("count_trustworthy"), news, 100.0).alias("trustworthy"),
        S.share(F.col("count_untrustworthy"), news, 100.0).alias("untrustworthy"),
    )
    return wide.unpivot(["week"], ["trustworthy", "untrustworthy"], "type", "proportion")


def weekly_threshold_shares(daily: DataFrame, cutoffs: Sequence[int] = (40, 50, 60)) -> DataFrame:
    """Weekly share of posts below (N) and at or above (T) each cutoff, from
    Monday to Sunday, without the first and the last week."""
    below = [f"N_{k}" for k in cutoffs]
    above = [f"T_{k}" for k in cutoffs]
    full = daily.withColumns({t: F.col("n_rated") - F.col(n) for t, n in zip(above, below)})
    weekly = trim_ends(weekly_rollup(full, ["tweet_count", *below, *above], first="monday"), "week")
    long = weekly.unpivot(["week", "tweet_count"], [*below, *above], "series", "count")
    return long.select(
        "week",
        F.when(F.col("series").startswith("N"), "Untrustworthy").otherwise("Trustworthy").alias("type"),
        F.substring("series", 3, 9).cast("int").alias("cutoff"),
        "count",
        S.share(F.col("count"), F.col("tweet_count"), 100.0).alias("share"),
    )


def pooled_shares(daily: DataFrame) -> DataFrame:
    """Ratio of sums, and mean, sd and maximum of the daily ratios."""
    low = F.col("count_caution") + F.col("count_max_caution")
    out = []
    for name, whole in (("of_tweets", "tweet_count"), ("of_news", "count_ng_domains")):
        ratio = S.share(low, F.col(whole), 100.0)
        out += [
            S.share(F.sum(low), F.sum(whole), 100.0).alias(f"pooled_{name}"),
            F.avg(ratio).alias(f"{name}_mean"),
            F.stddev_samp(ratio).alias(f"{name}_sd"),
            F.max(ratio).alias(f"{name}_max"),
        ]
    return daily.agg(*out)


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, median, min, max and missing count, one row per column."""
    long = df.unpivot(list(keys), list(cols), "variable", "value")
    by = [*keys, "variable"]
    base = long.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    return base.join(exact_quantiles(long, by, "value", {"median": 0.5}), by, "left")


def emotion_stats(posts: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """Count, mean, median, upper quantiles and shares at the cutoffs per emotion."""
    long = posts.select(*[F.col(f"{e}_v2").alias(e) for e in emotions])
    long = long.unpivot([], list(emotions), "emotion", "score")
    base = long.groupBy("emotion").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.avg((F.col("score") >= 0.5).cast("double")).alias("share_ge_05"),
        F.avg((F.col("score") >= 0.65).cast("double")).alias("share_ge_065"),
    )
    cuts = score_quantiles(posts, {"median": 0.5, "q3": 0.75, "q90": 0.9}, emotions)
    return base.join(cuts, "emotion", "left")


def log_histogram(
    posts: DataFrame, bins: int = 80, low: float = -5.0, emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    long = posts.select(*[F.col(f"{e}_v2").alias(e) for e in emotions])
    long = long.unpivot([], list(emotions), "emotion", "score").filter("score IS NOT NULL")
    counts = long.groupBy("emotion", S.clipped_log_bin(F.col("score"), bins, low).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = F.sum("n").over(Window.partitionBy("emotion"))
    return counts.withColumn("pct", F.col("n") / whole * 100)


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """Equal-width bins between minimum and maximum, optionally of log10(x + 1)."""
    x = F.log10(F.col(col) + 1) if log else F.col(col).cast("double")
    values = df.select(x.alias("x")).filter("x IS NOT NULL")
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return values.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = hi - lo if hi > lo else 1.0
    return values.groupBy(S.linear_bin(F.col("x"), lo, lo + width, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
