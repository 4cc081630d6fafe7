"""Per-user emotion dynamics, author-day panel and user statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.operators.ordered import previous_values
from feedpanel.operators.panel import add_day, all_scored, flag_posts
from feedpanel.schema import EMOTIONS

# Fewest scored posts a period needs to count.
MIN_POSTS = {"day": 5, "week": 10, "month": 10}

MEASURES = ["baseline", "variability", "instability", "inertia"]


def period_of(day: Column, unit: str) -> Column:
    if unit == "day":
        return day.cast("string")
    if unit == "week":
        return S.iso_week(day)
    if unit == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError("unit must be day, week or month")


def user_baseline(posts: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """Mean, sample sd, activity and news counts per author in one aggregation."""
    news = F.col("is_news")
    return (
        flag_posts(posts)
        .groupBy("author_id")
        .agg(
            *[F.avg(f"{e}_v2").alias(f"{e}_baseline") for e in emotions],
            *[F.stddev_samp(f"{e}_v2").alias(f"{e}_variability") for e in emotions],
            F.sum("is_news").alias("n_news_shared"),
            F.sum(news * F.col("is_untrustworthy")).alias("n_untrustworthy_shared"),
            F.sum(news * F.col("is_biased")).alias("n_biased_shared"),
            F.count(F.lit(1)).alias("n_tweets"),
            F.count(f"{emotions[0]}_v2").alias("n_scored"),
        )
    )


def with_previous(posts: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """Scored posts with the scores and time of the author's post before. Periods
    are stretches of time, so one pass serves day, week and month. Copies of a
    post become one row with ``copies``: posts at one instant form no pair, and
    the posts around them see the same neighbours."""
    cols = [f"{e}_v2" for e in emotions]
    slim = all_scored(posts, emotions).groupBy("author_id", "id", "created_at", *cols).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return previous_values(slim, ["author_id"], ["created_at", "id", *cols], ["created_at", *cols])


def period_dynamics(
    pairs: DataFrame, unit: str, min_posts: int, emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Per (author, period): mean squared successive difference and hourly decay
    factor. ``pairs`` comes from :func:`with_previous`."""
    now, then = F.col("created_at"), F.col("prev_created_at")
    period = period_of(F.to_date(now), unit)
    same = period == period_of(F.to_date(then), unit)
    seconds = F.when(same, S.whole_seconds(now, then))
    rows = pairs.withColumns({"period": period, "_s": seconds, "_h": F.floor(seconds / 3600)})

    aggs = [F.sum("copies").alias("n_posts")]
    for e in emotions:
        x1, x0 = F.col(f"{e}_v2"), F.col(f"prev_{e}_v2")
        usable = (F.col("_h") > 0) & (x0 != 0) & (x1 != 0)
        x = -F.col("_h").cast("double")
        y = F.log(F.abs(x1 / F.nullif(x0, F.lit(0.0))))

        def used(col: Column) -> Column:
            return F.when(usable, col)

        aggs += [
            F.avg(F.when(F.col("_s") > 0, (x1 - x0) * (x1 - x0))).alias(f"{e}_mssd"),
            F.count(used(x)).alias(f"{e}_pairs"),
            (F.min(used(x0)) != F.max(used(x0))).alias(f"{e}_var0"),
            (F.min(used(x1)) != F.max(used(x1))).alias(f"{e}_var1"),
            F.sum(used(x * y)).alias(f"{e}_xy"),
            F.sum(used(x * x)).alias(f"{e}_xx"),
        ]
    by_period = rows.groupBy("author_id", "period").agg(*aggs)
    phis = [
        F.when(
            (F.col(f"{e}_pairs") >= 2) & F.col(f"{e}_var0") & F.col(f"{e}_var1"),
            F.exp(-F.abs(F.col(f"{e}_xy") / F.col(f"{e}_xx"))),
        ).alias(f"{e}_phi")
        for e in emotions
    ]
    return by_period.filter(F.col("n_posts") >= min_posts).select(
        "author_id", "period", "n_posts", *[f"{e}_mssd" for e in emotions], *phis
    )


def _over_periods(periods: DataFrame, emotions: Sequence[str], suffix: str = "") -> DataFrame:
    return periods.groupBy("author_id").agg(
        *[F.avg(f"{e}_mssd").alias(f"{e}_instability{suffix}") for e in emotions],
        *[F.avg(f"{e}_phi").alias(f"{e}_inertia{suffix}") for e in emotions],
    )


def user_features(
    posts: DataFrame, min_posts: int = MIN_POSTS["week"], emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Baseline, variability, weekly instability and inertia, activity and news
    counts per author; dynamics are null without a qualified week."""
    weekly = period_dynamics(with_previous(posts, emotions), "week", min_posts, emotions)
    return user_baseline(posts, emotions).join(_over_periods(weekly, emotions), "author_id", "left")


def window_features(
    posts: DataFrame,
    min_posts: dict[str, int] | None = None,
    emotions: Sequence[str] = EMOTIONS,
) -> DataFrame:
    """Instability and inertia from daily, weekly and monthly periods side by side."""
    pairs = with_previous(posts, emotions)
    out = None
    for unit, k in (min_posts or MIN_POSTS).items():
        one = _over_periods(period_dynamics(pairs, unit, k, emotions), emotions, f"_{unit}")
        out = one if out is None else out.join(one, "author_id", "full_outer")
    return out


def window_coverage(features: DataFrame, units: Sequence[str] = tuple(MIN_POSTS)) -> DataFrame:
    """Users with a value per period length."""
    counts = features.agg(
        *[F.count(f"anger_instability_{u}").alias(f"instability_{u}") for u in units],
        *[F.count(f"anger_inertia_{u}").alias(f"inertia_{u}") for u in units],
    )
    return counts.unpivot([], counts.columns, "feature", "n_users")


def window_agreement(features: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """Correlations of each feature between period lengths over users with all three."""
    aggs, names = [], []
    for m in ("instability", "inertia"):
        for e in emotions:
            day, week, month = (F.col(f"{e}_{m}_{u}") for u in ("day", "week", "month"))
            whole = day.isNotNull() & week.isNotNull() & month.isNotNull()
            stats = {
                "n": F.count_if(whole).cast("double"),
                "day_week": F.corr(F.when(whole, day), F.when(whole, week)),
                "week_month": F.corr(F.when(whole, week), F.when(whole, month)),
                "day_month": F.corr(F.when(whole, day), F.when(whole, month)),
            }
            names.append(f"{e}_{m}")
            aggs.append(
                F.struct(F.lit(f"{e}_{m}").alias("feature"), *[c.alias(k) for k, c in stats.items()]).alias(names[-1])
            )
    return features.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def author_day(posts: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Counts and shares per author and day; emotion shares are null on days
    without scored posts."""
    counts = (
        add_day(flag_posts(posts))
        .groupBy("author_id", "day")
        .agg(
            F.count(F.lit(1)).alias("n_tweets"),
            F.count("anger_v2").alias("n_scored"),
            F.sum("is_news").alias("n_news"),
            F.sum("is_untrustworthy").alias("n_untrustworthy"),
            F.sum("is_trustworthy").alias("n_trustworthy"),
            *[F.count_if(F.col(f"{e}_v2") >= threshold).alias(f"n_{e}") for e in EMOTIONS],
            F.sum("is_biased").alias("n_biased"),
        )
    )
    whole = ["news", "untrustworthy", "trustworthy", "biased"]
    return counts.withColumns(
        {f"prop_{c}": F.col(f"n_{c}") / F.col("n_tweets") for c in whole}
        | {f"prop_{e}": S.share(F.col(f"n_{e}"), F.col("n_scored")) for e in EMOTIONS}
    )


def user_statistics(posts: DataFrame, users: DataFrame) -> DataFrame:
    """First and last post, totals, means and account fields per author. Days are
    aggregated first, so posts per active day cost no second scan."""
    days = (
        add_day(posts)
        .groupBy("author_id", "day")
        .agg(
            F.min("created_at").alias("first"),
            F.max("created_at").alias("last"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(f"s_{c}") for c in ("Score", "anger_v2", "fear_v2")],
            *[F.count(c).alias(f"n_{c}") for c in ("Score", "anger_v2", "fear_v2")],
        )
    )

    def mean(c: str) -> Column:
        return S.share(F.sum(f"s_{c}"), F.sum(f"n_{c}"))

    per_user = days.groupBy("author_id").agg(
        F.min("first").alias("first_tweet_date"),
        F.max("last").alias("last_tweet_date"),
        F.sum("n").alias("total_tweets"),
        mean("Score").alias("avg_trustworthiness"),
        mean("anger_v2").alias("avg_anger"),
        mean("fear_v2").alias("avg_fear"),
        F.avg("n").alias("avg_tweets_per_day"),
    )
    account = users.select(
        "author_id", "account_created", "followers_count", "following_count", "tweet_count"
    )
    return per_user.join(account, "author_id", "left")


def user_statistics_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.avg("total_tweets").alias("avg_tweets_per_user"),
        F.avg("avg_tweets_per_day").alias("avg_tweets_per_day"),
        F.avg("avg_trustworthiness").alias("mean_trustworthiness"),
        F.avg("avg_anger").alias("mean_baseline_anger"),
        F.avg("avg_fear").alias("mean_baseline_fear"),
        F.count(F.lit(1)).alias("n_users"),
    )


# Nested levels from coarse to fine, with the name of the variance between them.
_LEVELS = ["author_id", "iso_year", "week", "day"]
_COMPONENTS = [
    "between users",
    "between years (within users)",
    "between weeks (within years)",
    "between days (within weeks)",
    "within days",
]


def variance_decomposition(posts: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """Nested sums of squares user > ISO year > ISO week > day > post in percent.

    Counts, sums and the squares inside a day are taken once per day and rolled up;
    the squares between two levels are the difference of sum(n * (mean - centre)^2)
    at both, with the emotion's mean as centre, so large values cost no digits.
    """
    day = F.to_date("created_at")
    long = posts.select(
        "author_id",
        S.iso_year(day).alias("iso_year"),
        S.iso_week(day).alias("week"),
        day.alias("day"),
        *[F.col(f"{e}_v2").alias(e) for e in emotions],
    ).unpivot(_LEVELS, list(emotions), "emotion", "x")
    n = F.count(F.lit(1))
    base = long.filter("x IS NOT NULL").groupBy("emotion", *_LEVELS).agg(
        n.alias("n"), F.sum("x").alias("s"), (F.var_pop("x") * n).alias("inside")
    )
    # grouping sets (emotion), (emotion, author), ... (emotion, author, year, week, day)
    sets = [["emotion", *_LEVELS[:k]] for k in range(len(_LEVELS) + 1)]
    rolled = base.groupingSets(sets, "emotion", *_LEVELS).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"), F.sum("inside").alias("inside")
    )
    # grouping_id has a bit set for every column that is rolled away: 15, 7, 3, 1, 0
    centre = rolled.filter("level = 15").select("emotion", F.col("m").alias("centre"))
    off = F.col("m") - F.col("centre")
    per_level = rolled.join(centre, "emotion").groupBy("emotion", "level").agg(
        F.sum(F.col("n") * off * off).alias("q"), F.sum("inside").alias("inside")
    )
    q = [F.max(F.when(F.col("level") == 2 ** (4 - k) - 1, F.col("q"))) for k in range(5)]
    inside = F.max(F.when(F.col("level") == 15, F.col("inside")))
    parts = [q[k + 1] - q[k] for k in range(4)] + [inside]
    total = q[4] - q[0] + inside
    within = q[4] - q[1] + inside
    rows = [
        F.struct(
            F.lit(name).alias("component"),
            (part / total * 100).alias("pct_of_total"),
            (F.lit(None).cast("double") if i == 0 else part / within * 100).alias("pct_of_within_user"),
        )
        for i, (name, part) in enumerate(zip(_COMPONENTS, parts))
    ]
    return per_level.groupBy("emotion").agg(F.array(*rows).alias("r")).select("emotion", F.inline("r"))
