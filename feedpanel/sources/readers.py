"""Readers for nested post exports and CSV panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedpanel.functions.text import empty_to_null
from feedpanel.operators.panel import keep_one
from feedpanel.schema import POST_COLUMNS, USER_COLUMNS, schema_for

# A page of the export: posts in ``data``, their authors in ``includes.users``.
_METRICS = "STRUCT<retweet_count: BIGINT, reply_count: BIGINT, quote_count: BIGINT, like_count: BIGINT, impression_count: BIGINT>"
PAGE_SCHEMA = f"""
data ARRAY<STRUCT<
  id: STRING, conversation_id: STRING, text: STRING, lang: STRING, created_at: STRING, author_id: STRING,
  in_reply_to_user_id: STRING, public_metrics: {_METRICS},
  entities: STRUCT<urls: ARRAY<STRUCT<url: STRING, expanded_url: STRING>>, hashtags: ARRAY<STRUCT<tag: STRING>>,
                   mentions: ARRAY<STRUCT<username: STRING>>>,
  referenced_tweets: ARRAY<STRUCT<type: STRING, id: STRING>>>>,
includes STRUCT<users: ARRAY<STRUCT<
  id: STRING, username: STRING, name: STRING, verified: BOOLEAN, created_at: STRING, description: STRING,
  location: STRING,
  public_metrics: STRUCT<followers_count: BIGINT, following_count: BIGINT, tweet_count: BIGINT>,
  entities: STRUCT<url: STRUCT<urls: ARRAY<STRUCT<expanded_url: STRING>>>>>>>
"""

# Fields of the reduced export, nested ones as JSON.
REDUCED_COLUMNS = [
    "author_id", "conversation_id", "created_at", "id", "in_reply_to_user_id",
    "referenced_tweets", "lang", "public_metrics", "text",
]


def _pages(spark: SparkSession, path: str, multi_line: bool | None) -> DataFrame:
    if multi_line is None:
        # a page that fits its line can be read alone, so files are read in splits
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1)
        multi_line = first.filter(F.get_json_object("value", "$").isNotNull()).isEmpty()
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", multi_line).json(path)


def _joined(items: Column) -> Column:
    """Elements joined by spaces; missing lists give an empty string."""
    return F.coalesce(F.array_join(items, " "), F.lit(""))


def _one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def _file_stem() -> Column:
    return F.substring_index(F.col("_metadata.file_name"), ".", 1)


def read_posts_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The 19 post columns, one row per post of every page. Files with one page per
    line are read in splits; pages over several lines make a file one task. Which of
    them it is shows the first line, unless ``multi_line`` says so."""
    p = _pages(spark, path, multi_line).select(F.explode("data").alias("p")).select("p.*")
    refs = F.col("referenced_tweets")

    def ref_ids(kind: str) -> Column:
        return _joined(F.transform(F.filter(refs, lambda r: r["type"] == kind), lambda r: r["id"]))

    made = {
        "text": _one_line(F.col("text")),
        **{c: F.col(f"public_metrics.{c}").cast("double") for c in
           ("retweet_count", "reply_count", "quote_count", "like_count", "impression_count")},
        "urls": _joined(F.col("entities.urls.url")),
        "expanded_urls": _joined(F.col("entities.urls.expanded_url")),
        "hashtags": _joined(F.col("entities.hashtags.tag")),
        "mentions": _joined(F.col("entities.mentions.username")),
        "tweet_type": _joined(F.col("referenced_tweets.type")),
        "retweeted_id": ref_ids("retweeted"),
        "quoted_id": ref_ids("quoted"),
        "in_reply_to_user_id": F.coalesce("in_reply_to_user_id", F.lit("")),
    }
    return p.select(*[made.get(c, F.col(c)).alias(c) for c in POST_COLUMNS])


def read_posts_json_reduced(spark: SparkSession, path: str) -> DataFrame:
    """The reduced field list from files with one page per line."""
    p = _pages(spark, path, False).select(F.explode("data").alias("p")).select("p.*")
    nested = {c: F.to_json(c) for c in ("referenced_tweets", "public_metrics")}
    return p.select(*[nested.get(c, F.col(c)).alias(c) for c in REDUCED_COLUMNS])


def read_users_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The 11 user columns; missing counts are 0, missing text is empty."""
    u = _pages(spark, path, multi_line).select(F.explode("includes.users").alias("u")).select("u.*")
    made = {
        "author_id": F.col("id"),
        **{c: F.coalesce(F.col(f"public_metrics.{c}"), F.lit(0)).cast("double") for c in
           ("followers_count", "following_count", "tweet_count")},
        "description": F.coalesce(_one_line(F.col("description")), F.lit("")),
        "location": F.coalesce("location", F.lit("")),
        "verified": F.col("verified").cast("string"),
        "expanded_urls": _joined(F.col("entities.url.urls.expanded_url")),
    }
    return u.select(*[made.get(c, F.col(c)).alias(c) for c in USER_COLUMNS])


def read_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header alone."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_panel_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    overrides: dict[str, str] | None = None,
    sep: str = ",",
    with_file: bool = False,
    with_place: bool = False,
) -> DataFrame:
    """CSV or CSV.gz files as one table with fixed types and empty strings as
    null; ``columns`` selects, ``overrides`` changes types, ``with_file`` adds the
    file name up to its first dot, ``with_place`` the order of rows inside a file
    (``_block``, ``_row``)."""
    paths = [path] if isinstance(path, str) else list(path)
    header = read_columns(spark, paths[0], sep)
    schema = schema_for(header)
    for name, kind in (overrides or {}).items():
        if name in header:
            schema[name].dataType = T._parse_datatype_string(kind)
    raw = (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
        .option("escape", '"').option("multiLine", False)
        .option("enforceSchema", False)  # a file with another header fails instead of being read by place
        .csv(paths)
    )
    wanted = [c for c in (columns or header) if c in header and not (with_file and c == "file")]
    types = dict(raw.dtypes)
    out = [empty_to_null(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in wanted]
    if with_file:
        out.append(_file_stem().alias("file"))
    if with_place:
        out.append(F.col("_metadata.file_block_start").alias("_block"))
        out.append(F.monotonically_increasing_id().alias("_row"))
    return raw.select(*out)


def read_users_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """User files as one table: counts that do not parse are null, and each file
    keeps the last row of an author."""
    text = {c: "string" for c in ("followers_count", "following_count", "tweet_count")}
    raw = read_panel_csv(spark, path, overrides=text, with_file=True, with_place=True)
    counts = {c: F.col(c).try_cast("double") for c in text if c in raw.columns}
    last = keep_one(raw.withColumns(counts), ["file", "author_id"], [F.desc("_block"), F.desc("_row")])
    return last.drop("_block", "_row")


def read_batches(spark: SparkSession, folder: str, pattern: str = "*.csv*") -> DataFrame:
    """Per-batch result files of one folder as one table."""
    return read_panel_csv(spark, f"{folder.rstrip('/')}/{pattern}")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation sheet; the delimiter is the one found in its header."""
    header = spark.read.text(path).limit(1).first()[0]
    sep = ";" if ";" in header else ","
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
