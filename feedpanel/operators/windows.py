"""Posts in the hours before and after each news-sharing post.

Window totals are differences of running totals: every event places a mark at
both ends of its two windows, marks and posts are sorted together, and the
running totals at the marks give counts and sums. The cost is one sort whatever
the length of the window or the number of posts of one author. Scores are added up
as whole numbers, so a difference of large totals loses no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions import exact
from feedpanel.functions import scores as S
from feedpanel.operators.ordered import first_rows, row_numbers, running_sums
from feedpanel.operators.panel import keep_one
from feedpanel.schema import EMOTIONS

_HOUR = 3600 * 1_000_000
# Position of a mark relative to posts at the same instant.
_AHEAD, _POST, _BEHIND = 0, 1, 2


def _marks(t: Column, span: int) -> Column:
    """Ends of [t - span, t) and (t, t + span] with the sign of their total."""

    def mark(at: Column, place: int, side: str, sign: int) -> Column:
        return F.struct(
            at.alias("t"), F.lit(place).alias("place"), F.lit(side).alias("side"), F.lit(sign).alias("sign")
        )

    return F.explode(
        F.array(
            mark(t - span, _AHEAD, "before", -1),
            mark(t, _AHEAD, "before", 1),
            mark(t, _BEHIND, "after", -1),
            mark(t + span, _BEHIND, "after", 1),
        )
    )


def news_events(posts: DataFrame) -> DataFrame:
    """Rated posts, one row per id (the first one wins)."""
    return keep_one(posts.filter("Score IS NOT NULL"), ["id"], [F.col("author_id"), F.col("created_at")])


def window_totals(
    posts: DataFrame, events: DataFrame, hours: float, emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Per event: posts, scored posts and score sums on both sides."""
    span = int(hours * _HOUR)
    largest = posts.agg(*[F.max(F.abs(f"{e}_v2")).alias(e) for e in emotions]).first()
    units = {e: exact.unit_of(largest[e]) for e in emotions}
    # posts of one instant are summed first: copies and bursts become one row
    facts = posts.groupBy("author_id", F.unix_micros("created_at").alias("t")).agg(
        F.count(F.lit(1)).alias("n_tweets"),
        *[F.count(f"{e}_v2").alias(f"n_{e}") for e in emotions],
        *[F.sum(k).alias(f"s{i}_{e}") for e in emotions for i, k in enumerate(exact.cuts(F.col(f"{e}_v2"), units[e]))],
    ).withColumn("place", F.lit(_POST))
    event = [
        F.col("id").alias("event_id"),
        F.col("created_at").alias("event_timestamp"),
        F.col("Score").alias("event_score"),
        *[F.col(f"{e}_v2").alias(f"event_{e}") for e in emotions],
    ]
    marks = events.select("author_id", *event, _marks(F.unix_micros("created_at"), span).alias("m"))
    rows = facts.unionByName(marks.select("*", "m.*").drop("m"), allowMissingColumns=True)
    names = ["n_tweets", *[f"n_{e}" for e in emotions], *[f"s{i}_{e}" for e in emotions for i in range(exact.CUTS)]]
    totals = running_sums(
        rows.withColumnsRenamed({c: f"_{c}" for c in names}),
        ["author_id"],
        ["t", "place", "event_id"],
        {c: F.col(f"_{c}") for c in names},
    ).filter(F.col("place") != _POST)
    own = ["event_id", "author_id", "event_timestamp", "event_score", *[f"event_{e}" for e in emotions]]
    found = totals.groupBy(*own).agg(
        *[
            F.sum(F.when(F.col("side") == side, F.col("sign") * F.col(name))).alias(f"{name}_{side}")
            for side in ("before", "after")
            for name in names
        ],
    )
    sides = [(e, side) for side in ("before", "after") for e in emotions]
    cut = {(e, side): [f"s{i}_{e}_{side}" for i in range(exact.CUTS)] for e, side in sides}
    sums = {f"s_{e}_{side}": exact.put_together([F.col(c) for c in cut[e, side]], units[e]) for e, side in sides}
    return found.withColumns(sums).drop(*[c for cs in cut.values() for c in cs])


def event_windows(
    posts: DataFrame, hours: float, min_mean: int = 10, emotions: Sequence[str] = EMOTIONS
) -> DataFrame:
    """Counts and means around each event; events need every emotion on both
    sides, and a mean needs ``min_mean`` scored posts."""
    totals = window_totals(posts, news_events(posts), hours, emotions)
    sides = [(e, side) for side in ("before", "after") for e in emotions]
    kept = totals
    for e, side in sides:
        kept = kept.filter(F.col(f"n_{e}_{side}") > 0)
    means = [
        F.when(F.col(f"n_{e}_{side}") >= min_mean, F.col(f"s_{e}_{side}") / F.col(f"n_{e}_{side}")).alias(
            f"mean_{e}_{side}"
        )
        for e, side in sides
    ]
    return kept.select(
        "event_id",
        "author_id",
        "event_timestamp",
        "event_score",
        "n_tweets_before",
        "n_tweets_after",
        *[f"n_{e}_{side}" for e, side in sides],
        *means,
        *[f"event_{e}" for e in emotions],
    )


def window_values(
    posts: DataFrame, windows: DataFrame, hours: float, emotion: str, side: str
) -> DataFrame:
    """The scores inside all windows of one side as (value, weight).

    A score belongs to as many lists as events see its post, so the pooled lists
    are a weight per value: events in (t, t + span] for the side before, in
    [t - span, t) for the side after. No list is ever built.
    """
    span = int(hours * _HOUR)
    seen_from = "after" if side == "before" else "before"
    facts = windows.groupBy("author_id", F.unix_micros("event_timestamp").alias("t")).agg(
        F.count(F.lit(1)).alias("events")
    ).withColumn("place", F.lit(_POST))
    marks = (
        posts.filter(F.col(f"{emotion}_v2").isNotNull())
        .groupBy("author_id", "created_at", F.col(f"{emotion}_v2").alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("author_id", "value", "copies", _marks(F.unix_micros("created_at"), span).alias("m"))
        .select("author_id", "value", "copies", "m.*")
        .filter(F.col("side") == seen_from)
    )
    rows = facts.unionByName(marks, allowMissingColumns=True)
    totals = running_sums(rows, ["author_id"], ["t", "place", "value"], {"n": F.col("events")})
    return (
        totals.filter(F.col("place") != _POST)
        .groupBy("value")
        .agg(F.sum(F.col("sign") * F.col("n") * F.col("copies")).alias("weight"))
        .filter("weight > 0")
    )


def windows_long(windows: DataFrame, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """One row per (event, emotion, side) with a mean."""
    cols = [f"mean_{e}_{side}" for e in emotions for side in ("before", "after")]
    long = windows.unpivot(["author_id", "event_id"], cols, "name", "value").filter("value IS NOT NULL")
    parts = F.split("name", "_")
    return long.select(
        "author_id", "event_id", parts[1].alias("emotion"), parts[2].alias("window"), "value"
    )


def window_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("author_id", "window").agg(
        F.count_distinct("event_id").alias("n_events"), F.count(F.lit(1)).alias("n_tweets")
    )


def ntiles(df: DataFrame, value: str, key: str, k: int = 10, name: str = "decile") -> DataFrame:
    """Like ``ntile(k)`` over the whole table, ordered by (value, key)."""
    out = row_numbers(df, [value, key], "_rn")
    size, big = F.floor(F.col("_rn_total") / k), F.col("_rn_total") % k
    pos = F.col("_rn") - 1
    in_big = pos < big * (size + 1)
    tile = F.when(in_big, F.floor(pos / (size + 1))).otherwise(
        big + F.floor((pos - big * (size + 1)) / F.nullif(size, F.lit(0)))
    )
    return out.withColumn(name, (tile + 1).cast("int")).drop("_rn", "_rn_total")


def sample_per_tile(df: DataFrame, tile: str, key: str, n: int, seed: int = 636) -> DataFrame:
    """n rows per tile in a reproducible pseudo-random order."""
    keyed = df.withColumn("_order", S.keyed_order(F.col(key), seed))
    return first_rows(keyed, [tile], ["_order", key], n).drop("_order", "rn")


def with_untrust_degree(windows: DataFrame) -> DataFrame:
    return windows.withColumn("untrustworthy", S.untrust_degree(F.col("event_score")))


