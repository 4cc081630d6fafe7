"""Source ratings per domain and month, and their way to the posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.functions.text import recode_yes_no, split_list
from feedpanel.operators.panel import add_day, keep_one
from feedpanel.session import bucketed, materialize

# First month with stable ratings. Posts before the first rated
# month take the rating of the domain over all months.
STABLE_SINCE = "2021-01-01"
_ANY_MONTH = "0001-01-01"


def build_ratings(raw: DataFrame) -> DataFrame:
    """One rating per domain and month: the lowest score, then the first label
    (no label last); labels are shortened after the choice."""
    monthly = raw.withColumn("file_month", S.month_start(F.col("file_date")))
    order = [F.col("Score").asc_nulls_last(), F.col("Orientation").asc_nulls_last()]
    one = keep_one(monthly, ["Domain", "file_month"], order)
    return one.withColumn("Orientation", S.recode_orientation(F.col("Orientation")))


def country_domains(ratings: DataFrame, country: str = "AT") -> DataFrame:
    """First rated month of each domain of one country."""
    return keep_one(ratings.filter(F.col("Country") == country), ["Domain"], [F.col("file_month")])


def stable_ratings(ratings: DataFrame, since: str = STABLE_SINCE) -> DataFrame:
    return ratings.filter(F.col("file_month") >= F.lit(since).cast("date"))


def attach_domains(posts: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per post and link with the rated domain behind the link. Copies of
    a post are dropped first, so a post's links come from one row."""
    once = keep_one(posts, ["id", "author_id"], [F.col("created_at"), F.col("expanded_urls")])
    links = once.select(
        *[c for c in once.columns if c != "expanded_urls"],
        F.posexplode_outer(split_list(F.col("expanded_urls"))).alias("position", "url"),
    )
    # posts without links have keys of their own, which match nothing, instead of one null key
    known = matched.select(F.col("url").alias("_url"), "ng_domain").distinct()
    key = F.coalesce("url", F.concat(F.lit(" "), F.col("id").cast("string")))
    return links.join(known, key == F.col("_url"), "left").select("url", *[c for c in links.columns if c != "url"], "ng_domain")


def attach_rating(
    links: DataFrame, ratings: DataFrame, since: str = STABLE_SINCE, literal: bool = False
) -> DataFrame:
    """Score, orientation and ``n_ratings`` (rating rows behind the score).

    From the first stable month on a link takes its month's rating; before it
    the domain's mean over all months. Both cases are one join: the rating table
    holds an extra row per domain for "any month". ``literal`` counts every rating
    row there on its own: a link stays one row, with the mean of its rows, how often
    each label comes in them (``_labels``), and the label and score of the first one
    (``Orientation``, ``_first_score``); ``merge_multilink`` lists them again.
    """
    stable = stable_ratings(ratings, since).select("Domain", "file_month", "Score", "Orientation")
    by_month = stable.withColumn("n_ratings", F.lit(1).cast("bigint"))
    any_month = F.lit(_ANY_MONTH).cast("date")
    if literal:
        every = stable.unionByName(stable.withColumn("file_month", any_month))
        by_month, overall = _counted_ratings(every), None
    else:
        overall = stable.groupBy("Domain").agg(
            any_month.alias("file_month"),
            F.avg("Score").alias("Score"),
            # different labels over the months are listed once each
            F.array_join(F.sort_array(F.collect_set("Orientation")), ", ").alias("Orientation"),
            F.count(F.lit(1)).alias("n_ratings"),
        )
    dim = (by_month if literal else by_month.unionByName(overall)).withColumnRenamed("Domain", "ng_domain")
    first = stable.agg(F.min("file_month")).scalar()
    month = S.month_start(F.to_date("created_at"))
    keyed = links.withColumns(
        {"month": month, "file_month": F.when(month >= first, month).otherwise(any_month)}
    )
    # links without a rated domain likewise spread over keys that match nothing
    key = F.coalesce("ng_domain", F.concat(F.lit(" "), F.col("id").cast("string")))
    dim = dim.withColumnsRenamed({"ng_domain": "_domain", "file_month": "_month"})
    joined = keyed.join(dim, (key == F.col("_domain")) & (F.col("file_month") == F.col("_month")), "left")
    return joined.select("ng_domain", *[c for c in keyed.columns if c not in ("ng_domain", "file_month")], *[c for c in dim.columns if c not in ("_domain", "_month")])


def _counted_ratings(ratings: DataFrame) -> DataFrame:
    """The rating rows of a domain and month in one: their mean score, how many have one,
    the first label and score, and the labels of scored rows with their number."""
    label = F.when(F.col("Score").isNotNull(), F.col("Orientation"))
    first = F.min(F.struct("Orientation", "Score"))
    rows = ratings.groupBy("Domain", "file_month").agg(
        F.avg("Score").alias("Score"),
        F.count("Score").alias("n_ratings"),
        first.alias("_one"),
        F.sort_array(F.collect_list(label)).alias("_all"),
    )
    times = F.transform(F.array_distinct("_all"), lambda x: F.struct(x.alias("label"), F.size(F.filter("_all", lambda y: y == x)).alias("n")))
    return rows.select(
        "Domain", "file_month", "Score", F.col("_one.Orientation").alias("Orientation"), "n_ratings",
        F.col("_one.Score").alias("_first_score"), times.alias("_labels"),
    )


def merge_multilink(links: DataFrame, literal: bool = False) -> DataFrame:
    """One row per post with all its columns. The score is the mean over the rating rows of its links;
    ``ng_domain`` lists the rated domains in link order, ``Orientation`` the
    different labels. Without a rated link the first matched domain stays.

    ``literal`` (links from ``attach_rating`` with it): with fewer than two rating
    rows the first link alone decides, and names and labels are listed once per row.
    """
    rated = F.col("Score").isNotNull()
    where = F.struct("position", "ng_domain", "Orientation", "Score")
    told = F.struct("position", "ng_domain", "n_ratings", "_labels") if literal else where
    first = F.struct("position", "ng_domain", "Orientation", F.col("_first_score").alias("Score")) if literal else where
    made = (
        "id", "author_id", "created_at", "position", "url", "ng_domain", "month", "Score", "Orientation", "n_ratings", "_first_score", "_labels"
    )
    others = [c for c in links.columns if c not in made]
    # the links of a post come from many tasks, so they are brought together before anything is collected
    rows = links.repartition("id", "author_id").groupBy("id", "author_id").agg(
        *[F.first(c).alias(c) for c in others],
        F.min("created_at").alias("created_at"),
        F.sum(F.when(rated, F.col("n_ratings"))).alias("n_ratings"),
        F.sum(F.when(rated, F.col("Score") * F.col("n_ratings"))).alias("_sum"),
        F.sort_array(F.collect_list(F.when(rated, told))).alias("_rated"),
        F.min(first if literal else F.when(F.col("ng_domain").isNotNull(), where)).alias("_one"),
    )
    mean = F.col("_sum") / F.col("n_ratings")
    if literal:
        names = F.flatten(F.transform("_rated", lambda x: F.array_repeat(x["ng_domain"], x["n_ratings"].cast("int"))))
        labels = F.flatten(F.transform("_rated", lambda x: F.flatten(F.transform(x["_labels"], lambda y: F.array_repeat(y["label"], y["n"])))))
        several = F.coalesce(F.col("n_ratings"), F.lit(0)) >= 2
        score = F.when(several, mean).otherwise(F.col("_one.Score"))
        domain = F.when(several, F.array_join(names, ", ")).otherwise(F.col("_one.ng_domain"))
        label = F.when(several, F.array_join(labels, ", ")).otherwise(F.col("_one.Orientation"))
    else:
        has = F.size("_rated") > 0
        names = F.array_join(F.transform("_rated", lambda x: x["ng_domain"]), ", ")
        labels = F.transform("_rated", lambda x: x["Orientation"])
        score = mean
        domain = F.when(has, names).otherwise(F.col("_one.ng_domain"))
        label = F.when(has, F.array_join(F.sort_array(F.array_distinct(labels)), ", "))
    return rows.select(
        "id", "author_id", "created_at", domain.alias("ng_domain"), score.alias("Score"), label.alias("Orientation"),
        *others,
    )


def rate_posts(
    posts: DataFrame, matched: DataFrame, ratings: DataFrame, since: str = STABLE_SINCE, literal: bool = False
) -> DataFrame:
    links = attach_rating(attach_domains(posts, matched), ratings, since, literal)
    return merge_multilink(links, literal)


# --- criterion ---------------------------------------------------------------
def ratings_with_criterion(raw: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """One rating per domain and month (lowest score) with the criterion as a
    boolean; renamed criterion columns are merged."""
    out = raw.select(
        "Domain",
        "Country",
        "Score",
        S.month_start(F.col("file_date")).alias("file_month"),
        recode_yes_no(F.coalesce(*[F.col(c).cast("string") for c in criteria])).alias("passes"),
    )
    order = [F.col("Score").asc_nulls_last(), F.col("passes").asc_nulls_last()]
    return keep_one(out, ["Domain", "file_month"], order)


def criterion_coverage(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).alias("n_domain_months"),
        F.avg(F.col("passes").isNull().cast("double")).alias("share_missing_criterion"),
    )


def rating_by_domain(stable: DataFrame) -> DataFrame:
    """Mean score and criterion per domain; failing in half the months fails."""
    fail_rate = F.avg(F.when(F.col("passes").isNotNull(), (~F.col("passes")).cast("double")))
    return stable.groupBy("Domain").agg(
        F.avg("Score").alias("ng_score"),
        fail_rate.alias("fail_rate"),
        F.when(fail_rate >= 0.5, False).when(fail_rate < 0.5, True).alias("passes"),
    )


def untrustworthy_links(posts: DataFrame) -> DataFrame:
    """Post x domain rows of posts scored below 60."""
    low = add_day(posts.filter(F.col("Score") < 60))
    return low.select(
        "id",
        "author_id",
        "day",
        S.month_start(F.col("day")).alias("month"),
        F.explode(F.split("ng_domain", ", ")).alias("ng_domain"),
        "Score",
    ).withColumn("ng_domain", F.trim("ng_domain"))


def attach_criterion(links: DataFrame, ratings: DataFrame, since: str = STABLE_SINCE) -> DataFrame:
    """Distinct (id, domain) links with score and criterion of their month, or of
    the domain before the first stable month."""
    stable = stable_ratings(ratings, since)
    any_month = F.lit(_ANY_MONTH).cast("date")
    by_month = stable.select("Domain", "file_month", F.col("Score").alias("ng_score"), "passes")
    overall = rating_by_domain(stable).select("Domain", any_month.alias("file_month"), "ng_score", "passes")
    dim = by_month.unionByName(overall).withColumnRenamed("Domain", "ng_domain")
    first = stable.agg(F.min("file_month")).scalar()
    once = keep_one(links, ["id", "ng_domain"], [F.col("month"), F.col("Score")])
    keyed = once.withColumn("file_month", F.when(F.col("month") >= first, F.col("month")).otherwise(any_month))
    return keyed.join(dim, ["ng_domain", "file_month"], "left").drop("file_month")


def rating_coverage(links: DataFrame) -> DataFrame:
    return links.agg(
        F.count(F.lit(1)).alias("n_links"),
        F.avg(F.col("ng_score").isNull().cast("double")).alias("share_no_rating"),
        F.avg(F.col("passes").isNull().cast("double")).alias("share_no_criterion"),
    )


def share_failing(links: DataFrame) -> DataFrame:
    """Share failing the criterion by link, post, domain and year.

    The links are stored once, in buckets of their post, so posts are grouped
    without a shuffle; links, domains and years are sums over one table with a row
    per domain and year."""
    slim = bucketed(links.select("id", "ng_domain", F.year("month").alias("year"), "ng_score", "passes"), ["id"])
    fails = (~F.col("passes")).cast("double")
    n, failing = F.count(F.lit(1)).alias("n"), F.sum(fails).alias("failing")
    low = slim.filter((F.col("ng_score") < 60) & F.col("passes").isNotNull())
    cells = materialize(low.groupBy("ng_domain", "year").agg(n, failing))
    total, part = F.sum("n"), F.sum("failing")

    def level(table, level, name):
        return table.select(F.lit(level).alias("level"), name.alias("name"), "n", "share_failing")

    every = F.lit("all")
    by_link = cells.agg(F.coalesce(total, F.lit(0)).alias("n"), (part / total).alias("share_failing"))
    by_year = cells.groupBy("year").agg(total.alias("n"), (part / total).alias("share_failing"))
    mostly = (F.col("share") >= 0.5).cast("double")
    by_domain = cells.groupBy("ng_domain").agg((part / total).alias("share")).agg(n, F.avg(mostly).alias("share_failing"))
    any_fail = slim.groupBy("id").agg(F.bool_or(~F.col("passes")).alias("any_fail")).filter("any_fail IS NOT NULL")
    by_post = any_fail.agg(n, F.avg(F.col("any_fail").cast("double")).alias("share_failing"))
    return (
        level(by_link, "link", every)
        .unionByName(level(by_post, "post", every))
        .unionByName(level(by_domain, "domain", every))
        .unionByName(level(by_year, "year", F.col("year").cast("string")))
    )


def domain_month_stats(ratings: DataFrame) -> DataFrame:
    low = F.count_distinct(F.when(F.col("Score") < 60, F.col("Domain")))
    every = F.count_distinct("Domain")
    return ratings.groupBy("file_month").agg(
        F.avg("Score").alias("mean_score"),
        low.alias("n_untrustworthy"),
        every.alias("n_sources"),
        (low / every * 100).alias("fraction_untrustworthy"),
    )
