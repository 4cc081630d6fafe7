"""Concentration of sharing, supersharer groups and account cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.operators.ordered import running_sums

OUTCOMES = {
    "shares_news": "n_news_shared",
    "shares_untrustworthy": "n_untrustworthy_shared",
    "shares_biased": "n_biased_shared",
}


def user_totals(author_days: DataFrame) -> DataFrame:
    return author_days.groupBy("author_id").agg(
        F.sum("n_untrustworthy").alias("total_misinfo_count"),
        F.sum("n_trustworthy").alias("total_trustworthy_count"),
        F.sum("n_news").alias("total_news_count"),
        F.sum("n_biased").alias("total_biased_count"),
    )


def concentration(totals: DataFrame, col: str, drop_zero: bool = False) -> DataFrame:
    """Cumulative count and share from the heaviest user down, rank and
    percentile of users; ties go to the smaller numeric id."""
    users = totals.filter(F.col(col) > 0) if drop_zero else totals
    users = users.select("author_id", F.col(col).alias("count")).withColumns(
        {"_down": -F.col("count"), "_num": F.col("author_id").try_cast("decimal(20,0)")}
    )
    out = running_sums(
        users,
        [],
        ["_down", "_num", "author_id"],
        {"cumsum_count": F.col("count"), "user_rank": F.lit(1).cast("bigint")},
    )
    return out.select(
        "author_id",
        "count",
        "cumsum_count",
        F.col("cumsum_count_total").alias("total_count"),
        S.share(F.col("cumsum_count"), F.col("cumsum_count_total")).alias("cumsum_prop"),
        "user_rank",
        (F.col("user_rank") / F.col("user_rank_total") * 100).alias("percentile"),
    )


def supersharers(concentrated: DataFrame, share: float = 0.8) -> DataFrame:
    """Smallest set of top users that reaches the share of the total."""
    before = S.share(F.col("cumsum_count") - F.col("count"), F.col("total_count"))
    return concentrated.filter(F.coalesce(before, F.lit(0.0)) < share)


def supersharer_groups(totals: DataFrame, share: float = 0.8) -> DataFrame:
    """Supersharers of untrustworthy and of trustworthy news, one below the other."""
    out = None
    for group, col, drop_zero in (
        ("Untrustworthy", "total_misinfo_count", False),
        ("Trustworthy", "total_trustworthy_count", True),
    ):
        one = supersharers(concentration(totals, col, drop_zero), share)
        one = one.select("author_id", F.lit(group).alias("group"))
        out = one if out is None else out.unionByName(one)
    return out


def group_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mean, sd and count of finite values per group and column."""
    x = F.col("value")
    long = df.unpivot([group], list(cols), "metric", "value").filter(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return long.groupBy(group, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value")
    )


def group_means_wide(df: DataFrame, group: str, cols: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """The group means with one column per group."""
    return group_means(df, group, cols).groupBy("metric").pivot(group, list(levels)).agg(F.first("mean_value"))


def feature_coverage(groups: DataFrame, features: DataFrame) -> DataFrame:
    """Supersharers per group, and how many of them have features."""
    has = features.select("author_id", F.lit(1).alias("_has")).distinct()
    n = F.count(F.lit(1))
    return groups.join(has, "author_id", "left").groupBy("group").agg(
        n.alias("n_all"),
        F.count("_has").alias("n_with_features"),
        F.round(F.count("_has") * 100.0 / n, 1).alias("pct_with_features"),
    )


def binarize_outcomes(features: DataFrame) -> DataFrame:
    return features.withColumns({k: (F.col(v) > 0).cast("int") for k, v in OUTCOMES.items()})


def outcome_table(features: DataFrame) -> DataFrame:
    """Users who share each kind of news, count and percent."""
    rows = [
        F.struct(
            F.lit(k).alias("outcome"),
            F.sum(k).alias("n_users"),
            F.round(F.sum(k) / F.count(F.lit(1)) * 100, 1).alias("pct_users"),
        )
        for k in OUTCOMES
    ]
    return binarize_outcomes(features).agg(F.array(*rows).alias("r")).select(F.inline("r"))


# First day of a "new" account, start of the join counts, and the
# day account age is measured at.
NEW_SINCE, JOINS_SINCE, AGE_AT = "2022-01-01", "2019-01-01", "2022-07-01"


def cohort_type(created: Column, since: str = NEW_SINCE) -> Column:
    """Accounts without a creation date count as old."""
    return F.when(created >= F.lit(since).cast("date"), "new").otherwise("old")


def account_age_years(created: Column, at: str = AGE_AT) -> Column:
    return F.datediff(F.lit(at).cast("date"), created) / 365


def join_months(users: DataFrame, since: str = JOINS_SINCE) -> DataFrame:
    month = S.month_start(F.col("account_created"))
    return (
        users.groupBy(month.alias("join_month"))
        .agg(F.count(F.lit(1)).alias("n_new_users"))
        .filter(F.col("join_month") >= F.lit(since).cast("date"))
    )


def active_account_ages(author_days: DataFrame, users: DataFrame, active_from: str, at: str = AGE_AT) -> DataFrame:
    """Age of the accounts that post from a day on; negative and unknown ages dropped."""
    active = author_days.filter(F.col("day") >= F.lit(active_from).cast("date")).select("author_id").distinct()
    age = account_age_years(F.col("account_created"), at)
    return (
        active.join(users.select("author_id", "account_created"), "author_id", "left")
        .select("author_id", age.alias("account_age"))
        .filter(F.col("account_age") >= 0)
    )


def activity_by_cohort(author_days: DataFrame, users: DataFrame, since: str = NEW_SINCE) -> DataFrame:
    """Mean posts and untrustworthy share per author-day, by day and cohort."""
    kinds = users.select("author_id", cohort_type(F.col("account_created"), since).alias("user_type"))
    return (
        author_days.join(kinds, "author_id", "left")
        .groupBy("day", "user_type")
        .agg(F.avg("n_tweets").alias("avg_tweets"), F.avg("prop_untrustworthy").alias("avg_untrustworthy"))
    )
