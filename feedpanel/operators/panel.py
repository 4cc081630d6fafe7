"""Panel membership, period, language and post-level flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.functions.text import clean_text, with_costly
from feedpanel.schema import EMOTIONS, check_language_set

# Observation period, end excluded.
PERIOD = ("2019-01-01", "2023-04-01")

# Language codes that stand for "no language".
NON_LANG = ["und", "zxx", "qme", "qht", "qam", "qct", "art"]


def add_day(posts: DataFrame) -> DataFrame:
    return posts.withColumn("day", F.to_date("created_at"))


def in_period(posts: DataFrame, start: str = PERIOD[0], end: str = PERIOD[1]) -> DataFrame:
    """Half-open period on the time column itself, so the scan can skip files."""
    when = F.col("created_at")
    return posts.filter(
        (when >= F.lit(start).cast("timestamp")) & (when < F.lit(end).cast("timestamp"))
    )


def keep_authors(posts: DataFrame, authors: DataFrame, on: str = "author_id") -> DataFrame:
    return posts.join(authors.select(on), on, "left_semi")


def restrict_panel(
    posts: DataFrame, authors: DataFrame, start: str = PERIOD[0], end: str = PERIOD[1]
) -> DataFrame:
    return keep_authors(in_period(posts, start, end), authors)


def attach_scores(posts: DataFrame, scores: DataFrame, how: str = "left") -> DataFrame:
    """Scores by post id; ``left`` keeps every post, ``inner`` the scored ones."""
    return posts.join(scores, "id", how)


def _score_columns(emotions: Sequence[str]) -> list[str]:
    return [f"{e}_v2" for e in emotions]


def mask_language(
    posts: DataFrame, langs: str = "de_en", emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Scores of other or unknown languages become null; the post stays."""
    wanted = check_language_set(langs)
    if wanted is None:
        return posts
    return posts.withColumns(
        {c: F.when(F.col("lang").isin(wanted), F.col(c)) for c in _score_columns(emotions)}
    )


def drop_languages(posts: DataFrame, langs: str = "de_en") -> DataFrame:
    wanted = check_language_set(langs)
    return posts if wanted is None else posts.filter(F.col("lang").isin(wanted))


def all_scored(posts: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    return posts.dropna(how="any", subset=_score_columns(emotions))


def flag_posts(posts: DataFrame) -> DataFrame:
    def flag(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    return posts.withColumns(
        {
            "is_news": flag(F.col("ng_domain").isNotNull()),
            "is_untrustworthy": flag(F.col("Score") < 60),
            "is_trustworthy": flag(F.col("Score") >= 60),
            "is_biased": flag(F.col("Orientation").isin(S.PARTISAN)),
        }
    )


def filter_scorable(posts: DataFrame) -> DataFrame:
    """(id, text_cleaned) of posts with something left to score, reposts excluded."""
    kept = posts.filter(~F.col("text").startswith("RT"))
    cleaned = with_costly(kept, "text_cleaned", clean_text(F.col("text")))
    return cleaned.select("id", "text_cleaned").filter(F.col("text_cleaned") != "")


def filter_followers(users: DataFrame, low: float = 50, high: float = 100_000) -> DataFrame:
    n = F.col("followers_count")
    return users.filter((n > low) & (n < high))


def posts_per_author_day(posts: DataFrame) -> DataFrame:
    return add_day(posts).groupBy("author_id", "day").agg(F.count(F.lit(1)).alias("tweet_count"))


def activity_filter(posts: DataFrame, max_per_day: int = 20, literal: bool = False) -> DataFrame:
    """Authors below ``max_per_day`` posts on every day; ``literal`` keeps authors
    that stay below it on at least one day."""
    pick = F.min if literal else F.max
    return (
        posts_per_author_day(posts)
        .groupBy("author_id")
        .agg(pick("tweet_count").alias("_n"))
        .filter(F.col("_n") < max_per_day)
        .select("author_id")
    )


def latest_users(users: DataFrame) -> DataFrame:
    """One row per author: the last file wins, ties by the remaining columns."""
    rest = [F.desc(c) for c in users.columns if c not in ("author_id", "file")]
    w = Window.partitionBy("author_id").orderBy(F.desc("file"), *rest)
    return users.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def analysis_sample(
    posts: DataFrame, users: DataFrame, max_per_day: int = 20, literal: bool = False
) -> DataFrame:
    """Users that pass the activity and the follower filter."""
    active = activity_filter(posts, max_per_day, literal)
    return filter_followers(keep_authors(latest_users(users), active))


def sample_authors(authors: DataFrame, n: int, seed: int = 63) -> DataFrame:
    """Test mode: n authors in a reproducible pseudo-random order."""
    order = S.keyed_order(F.col("author_id"), seed)
    return authors.select("author_id").distinct().orderBy(order, "author_id").limit(n)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order. The rank filter is applied before
    the shuffle as well, so copies of a key collapse on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def language_shares(posts: DataFrame, digits: int = 2) -> DataFrame:
    """Posts per language with their share of all posts in percent."""
    counts = (
        posts.groupBy(F.coalesce("lang", F.lit("missing")).alias("lang"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct_all", F.round(F.col("n") / whole * 100, digits))


def detected_language_shares(posts: DataFrame) -> DataFrame:
    """One row: posts with a language, their share, German and English among them."""
    lang = F.coalesce("lang", F.lit("missing"))
    detected = ~lang.isin([*NON_LANG, "missing"])
    n = F.count_if(detected)
    return posts.agg(
        n.alias("n_detected"),
        (n / F.count(F.lit(1)) * 100).alias("pct_detected"),
        (F.count_if(lang == "de") / n * 100).alias("pct_de"),
        (F.count_if(lang == "en") / n * 100).alias("pct_en"),
    )


def language_shares_by_type(posts: DataFrame, digits: int = 2) -> DataFrame:
    counts = (
        posts.groupBy(
            F.coalesce("tweet_type", F.lit("original")).alias("tweet_type"),
            F.coalesce("lang", F.lit("missing")).alias("lang"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy("tweet_type"))
    return counts.withColumn("pct_within_type", F.round(F.col("n") / whole * 100, digits))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def finite_only(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col)
    return df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardizes columns with the sample standard deviation. The two moments
    per column are one row, brought back as constants."""
    moments = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in cols],
    ).first()
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(moments[f"m_{c}"])) / F.nullif(F.lit(moments[f"s_{c}"]), F.lit(0.0))
            for c in cols
        }
    )


def emotion_long(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str = "value"
) -> DataFrame:
    """Wide emotion columns to one row per (ids, column)."""
    return df.unpivot(list(ids), list(cols), name, value)
