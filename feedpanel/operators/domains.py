"""Uses of rated domains over time. After the first aggregation there is one row
per domain and day, so later windows are bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.operators.panel import add_day


def domains_per_day(posts: DataFrame) -> DataFrame:
    """Uses of a domain per day; the score is that of the first post by id."""
    uses = add_day(posts.filter("ng_domain IS NOT NULL AND Score IS NOT NULL")).select(
        "id", "day", "Score", F.explode(F.split("ng_domain", ", ")).alias("ng_domain")
    )
    return uses.groupBy("day", "ng_domain").agg(
        F.min_by("Score", "id").alias("Score"), F.count(F.lit(1)).alias("n_used")
    )


def before_after(uses: DataFrame, cutoff: str) -> DataFrame:
    """Uses of untrustworthy domains before and from a day on, with the change."""
    early = F.col("day") < F.lit(cutoff).cast("date")
    sums = (
        uses.filter("Score < 60")
        .groupBy("ng_domain", "Score")
        .agg(
            F.sum(F.when(early, F.col("n_used")).otherwise(0)).alias("before"),
            F.sum(F.when(~early, F.col("n_used")).otherwise(0)).alias("after"),
        )
    )
    change = F.col("after") - F.col("before")
    return sums.withColumns(
        {"change": change, "pct_change": F.when(F.col("before") > 0, change / F.col("before") * 100)}
    )


def classify_domains(uses: DataFrame) -> DataFrame:
    """first / downrated / stable / Other by the score of the domain's day before."""
    w = Window.partitionBy("ng_domain").orderBy("day")
    out = uses.withColumns(
        {"prev_score": F.lag("Score").over(w), "first_appearance": F.row_number().over(w) == 1}
    )
    low, prev = F.col("Score") < 60, F.col("prev_score")
    return out.withColumn(
        "classification",
        F.when(F.col("first_appearance") & low, "first")
        .when((prev >= 60) & low, "downrated")
        .when((prev < 60) & low, "stable")
        .otherwise("Other"),
    )


def classified_daily(classified: DataFrame) -> DataFrame:
    named = classified.filter((F.col("Score") < 60) & (F.col("classification") != "Other"))
    return named.groupBy("day", "classification").agg(F.sum("n_used").alias("n_domains"))


def daily_untrustworthy(daily_classes: DataFrame) -> DataFrame:
    return daily_classes.groupBy("day").agg(F.sum("n_domains").alias("total_untrustworthy"))


def mark_spikes(totals: DataFrame, q: float = 0.9) -> DataFrame:
    """Days above the quantile of the daily totals (one value per calendar day)."""
    cut = totals.agg(F.percentile("total_untrustworthy", q)).scalar()
    return totals.withColumn("is_spike", F.col("total_untrustworthy") > cut)


def spike_comparison(uses: DataFrame, days: DataFrame) -> DataFrame:
    """Uses of untrustworthy domains on spike days against normal days."""
    low = uses.filter("Score < 60").join(days.select("day", "is_spike"), "day")
    spike = (
        low.filter("is_spike")
        .groupBy("ng_domain", "Score")
        .agg(
            F.sum("n_used").alias("total_uses"),
            F.count_distinct("day").alias("n_spike_days"),
            F.avg("n_used").alias("avg_uses_per_spike_day"),
        )
    )
    normal = low.filter("NOT is_spike").groupBy("ng_domain").agg(F.avg("n_used").alias("avg_uses_normal"))
    busy, usual = F.col("avg_uses_per_spike_day"), F.col("avg_uses_normal")
    return spike.join(normal, "ng_domain", "left").withColumns(
        {
            "spike_increase": busy - F.coalesce(usual, F.lit(0.0)),
            "spike_ratio": busy / F.coalesce(usual, F.lit(0.1)),
        }
    )


def hashtags_on_days(days: DataFrame, top: DataFrame) -> DataFrame:
    """Top hashtags next to the given days."""
    return days.join(top, "day", "left")
