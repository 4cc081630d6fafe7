"""Readers and writers: the panel is written as exports and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import POSTS, TEXTS, keyed, query
from feedpanel.functions import scores
from feedpanel.operators import panel
from feedpanel.session import work_folder
from feedpanel.sources import readers, writers


def fresh(t) -> str:
    return f"{work_folder(t.spark)}/feedpanel-{uuid.uuid4().hex}"


def _pages(t) -> str:
    """The events as nested export pages, one post and its author per line."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    e = t.table("events").withColumn("k", k)
    uid, url = F.col("user_id").cast("string"), F.concat(F.lit("https://x.org/"), F.col("k"))
    refs = F.filter(
        F.array(
            F.struct(F.lit("retweeted").alias("type"), (F.col("event_id") + 1).cast("string").alias("id"), (F.col("k") % 2 == 0).alias("on")),
            F.struct(F.lit("quoted").alias("type"), (F.col("event_id") + 2).cast("string").alias("id"), (F.col("k") % 3 == 0).alias("on")),
        ),
        lambda r: r["on"],
    )
    post = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.col("event_type"), F.lit("\n\""), F.col("k"), F.lit("\",\r"), F.lit("end")).alias("text"),
        F.when(F.col("k") % 4 != 0, "de").alias("lang"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        uid.alias("author_id"),
        F.struct(
            F.col("k").alias("like_count"), F.when(F.col("k") > 9, F.col("k")).alias("reply_count"), (F.col("k") + 1).alias("retweet_count"),
            F.when(F.col("k") % 2 == 0, F.col("k") * 2).alias("quote_count"), (F.col("k") * 100).alias("impression_count"),
        ).alias("public_metrics"),
        F.when(F.col("k") > 4, F.struct(
            F.array_repeat(F.struct(F.concat(F.lit("https://t.co/"), F.col("k")).alias("url"), url.alias("expanded_url")), F.col("k") % 3).alias("urls"),
            F.array(F.struct(F.concat(F.lit("h"), F.col("k")).alias("tag")), F.struct(F.lit("z").alias("tag"))).alias("hashtags"),
            F.when(F.col("k") > 60, F.array(F.struct(F.concat(F.lit("u"), uid).alias("username")))).alias("mentions"),
        )).alias("entities"),
        F.col("event_id").cast("string").alias("conversation_id"),
        F.when(F.col("k") > 50, refs).alias("referenced_tweets"),
        F.when(F.col("k") % 7 == 0, uid).alias("in_reply_to_user_id"),
    )
    user = F.struct(
        uid.alias("id"), F.concat(F.lit("u"), uid).alias("username"), F.concat(F.lit("N "), uid).alias("name"),
        F.when(F.col("user_id") % 3 != 0, F.lit("a\nb")).alias("description"), (F.col("user_id") % 5 == 0).alias("verified"),
        F.when(F.col("user_id") % 2 == 0, "Graz").alias("location"), F.lit("2020-01-01T00:00:00.000Z").alias("created_at"),
        F.struct((F.col("user_id") * 7).alias("followers_count"), (F.col("user_id") + 1).alias("following_count")).alias("public_metrics"),
        F.when(F.col("user_id") % 4 == 0, F.struct(F.struct(F.array(F.struct(F.concat(F.lit("https://me/"), uid).alias("expanded_url"))).alias("urls")).alias("url"))).alias("entities"),
    )
    path = fresh(t)
    e.select(F.to_json(F.struct(F.array(post).alias("data"), F.struct(F.array(user).alias("users")).alias("includes")))).write.text(path)
    return path


_K = "WITH k AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"


@query("read_posts_json", f"""{_K} SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS conversation_id, event_type || ' "' || k || '", end' AS text, CASE WHEN k % 4 <> 0 THEN 'de' END AS lang,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, CAST(user_id AS VARCHAR) AS author_id, CAST(k + 1 AS DOUBLE) AS retweet_count, CASE WHEN k > 9 THEN CAST(k AS DOUBLE) END AS reply_count,
 CASE WHEN k % 2 = 0 THEN CAST(k * 2 AS DOUBLE) END AS quote_count, CAST(k AS DOUBLE) AS like_count, CAST(k * 100 AS DOUBLE) AS impression_count,
 CASE WHEN k > 4 THEN trim(repeat('https://t.co/' || k || ' ', k % 3)) ELSE '' END AS urls, CASE WHEN k > 4 THEN trim(repeat('https://x.org/' || k || ' ', k % 3)) ELSE '' END AS expanded_urls,
 CASE WHEN k > 4 THEN 'h' || k || ' z' ELSE '' END AS hashtags, CASE WHEN k > 60 THEN 'u' || user_id ELSE '' END AS mentions,
 CASE WHEN k > 50 THEN concat_ws(' ', CASE WHEN k % 2 = 0 THEN 'retweeted' END, CASE WHEN k % 3 = 0 THEN 'quoted' END) ELSE '' END AS tweet_type,
 CASE WHEN k > 50 AND k % 2 = 0 THEN CAST(event_id + 1 AS VARCHAR) ELSE '' END AS retweeted_id, CASE WHEN k > 50 AND k % 3 = 0 THEN CAST(event_id + 2 AS VARCHAR) ELSE '' END AS quoted_id,
 CASE WHEN k % 7 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS in_reply_to_user_id FROM k""")
def read_posts_json(t):
    return readers.read_posts_json(t.spark, _pages(t))


_METRICS = "'{\"retweet_count\":' || (k + 1) || CASE WHEN k > 9 THEN ',\"reply_count\":' || k ELSE '' END || CASE WHEN k % 2 = 0 THEN ',\"quote_count\":' || (k * 2) ELSE '' END || ',\"like_count\":' || k || ',\"impression_count\":' || (k * 100) || '}'"
_REFS = "'[' || concat_ws(',', CASE WHEN k % 2 = 0 THEN '{\"type\":\"retweeted\",\"id\":\"' || (event_id + 1) || '\"}' END, CASE WHEN k % 3 = 0 THEN '{\"type\":\"quoted\",\"id\":\"' || (event_id + 2) || '\"}' END) || ']'"


@query("read_posts_json_reduced", f"""{_K} SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS author_id, CAST(event_id AS VARCHAR) AS conversation_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at,
 CASE WHEN k % 7 = 0 THEN CAST(user_id AS VARCHAR) END AS in_reply_to_user_id, CASE WHEN k % 4 <> 0 THEN 'de' END AS lang, event_type || chr(10) || '"' || k || '",' || chr(13) || 'end' AS text,
 CASE WHEN k > 50 THEN {_REFS} END AS referenced_tweets, {_METRICS} AS public_metrics FROM k""")
def read_posts_json_reduced(t):
    return readers.read_posts_json_reduced(t.spark, _pages(t))


@query("read_users_json", """SELECT CAST(user_id AS VARCHAR) AS author_id, 'u' || user_id AS username, 'N ' || user_id AS name, CASE WHEN user_id % 5 = 0 THEN 'true' ELSE 'false' END AS verified,
 CAST(user_id * 7 AS DOUBLE) AS followers_count, CAST(user_id + 1 AS DOUBLE) AS following_count, CAST(0 AS DOUBLE) AS tweet_count, '2020-01-01T00:00:00.000Z' AS created_at,
 CASE WHEN user_id % 3 <> 0 THEN 'a b' ELSE '' END AS description, CASE WHEN user_id % 2 = 0 THEN 'Graz' ELSE '' END AS location, CASE WHEN user_id % 4 = 0 THEN 'https://me/' || user_id ELSE '' END AS expanded_urls FROM events""")
def read_users_json(t):
    return readers.read_users_json(t.spark, _pages(t))


_TYPED = ["id", "author_id", "created_at", "lang", "Score", "hashtags", "in_reply_to_user_id", "tweet_type", "like_count"]


@query("panel_types", f"WITH {POSTS}, p AS (SELECT *, CAST(length(id) AS DOUBLE) AS like_count FROM posts) " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, '{'double' if c == 'like_count' else 'string'}' AS type, count({c}) AS n FROM p" for i, c in enumerate(_TYPED)))
def panel_types(t):
    """Header and types of a written panel, with the values read under each type."""
    path = fresh(t)
    posts = t.posts().withColumns({"like_count": F.length("id").cast("double"), "Score": F.col("Score").cast("string")})
    writers.write_csv(posts.select(*[F.col(c).cast("string").alias(c) for c in _TYPED]), path)
    header = readers.read_columns(t.spark, path)
    back = readers.read_panel_csv(t.spark, path)
    types = dict(back.dtypes)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(types[c]).alias("type"), F.count(c).alias("n")) for i, c in enumerate(header)]
    return back.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query("read_annotations", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS quality, 'said \"' || toxic || '\"; or, not' AS note FROM labels")
def read_annotations(t):
    """Sheets with one delimiter and with the other hold the same rows."""
    rows = t.table("labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("quality"), F.concat(F.lit('said "'), F.col("toxic"), F.lit('"; or, not')).alias("note"))
    sheets = []
    for sep in (";", ","):
        sheets.append(fresh(t))
        rows.write.option("header", True).option("sep", sep).option("escape", '"').csv(sheets[-1])
    one, other = (readers.read_annotations(t.spark, path) for path in sheets)
    return one.intersectAll(other)


@query("hash_share", f"WITH {POSTS} SELECT id FROM posts WHERE right({keyed('id', 636)}, 1) IN ('0', '4', '8', 'c')")
def hash_share(t):
    """A quarter of the posts, by hash."""
    return t.posts().select("id").filter(scores.hash_share(F.col("id"), 636, 4))


@query("read_panel_csv", f"WITH {POSTS} SELECT id, author_id, lang, Score, hashtags FROM posts")
def read_panel_csv(t):
    path = fresh(t)
    out = t.posts().withColumn("created_at", F.col("created_at").cast("string"))
    writers.write_csv(out.withColumn("hashtags", F.coalesce("hashtags", F.lit(""))), path)
    return readers.read_panel_csv(t.spark, path, ["id", "author_id", "lang", "Score", "hashtags"], {"Score": "double"})


@query("csv_text_round_trip", f"WITH {TEXTS} SELECT id, lang, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM texts")
def csv_text_round_trip(t):
    path = fresh(t)
    writers.write_csv(t.texts().withColumn("text", F.translate("text", "\n\r", "  ")), path)
    return readers.read_panel_csv(t.spark, path).select("id", "lang", "text")


@query("latest_users_csv", f"WITH {POSTS} SELECT author_id, CAST(CASE WHEN CAST(author_id AS BIGINT) % 4 = 0 THEN 2 ELSE 1 END AS DOUBLE) * followers_count AS followers_count FROM users")
def latest_users_csv(t):
    base = fresh(t)
    users = t.users().select("author_id", "followers_count", "following_count", "tweet_count")
    twice = users.filter(F.col("author_id").try_cast("bigint") % 4 == 0).withColumn("followers_count", F.col("followers_count") * 2)
    older, newer = users.withColumn("tweet_count", F.lit(1.0)), twice.withColumn("tweet_count", F.lit(2.0))
    # both rows of an author end up in one file, the newer one further down
    both = older.unionByName(newer).repartition("author_id").sortWithinPartitions("tweet_count")
    writers.write_csv(both, base)
    return panel.latest_users(readers.read_users_csv(t.spark, base)).select("author_id", "followers_count")


@query("write_split", f"WITH {TEXTS} SELECT count(*) AS n_rows, true AS within_limit FROM texts")
def write_split(t):
    path = fresh(t)
    writers.write_split(t.texts().select("id", "lang"), path, rows=100)
    per_file = readers.read_batches(t.spark, path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 100).alias("within_limit"))


@query("write_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def write_by_month(t):
    path = fresh(t)
    writers.write_by_month(t.link_posts(), path)
    return t.spark.read.option("basePath", path).parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("replace_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate < DATE '1996-01-01' OR o_orderstatus = 'F' OR o_orderdate >= DATE '1997-01-01' GROUP BY 1")
def replace_months(t):
    """The months of 1996 are run again, with closed orders only; all others stay."""
    path = fresh(t)
    posts = t.link_posts()
    writers.write_by_month(posts, path)
    closed = t.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    again = posts.filter("created_at >= '1996-01-01' AND created_at < '1997-01-01'").join(closed, "id", "left_semi")
    writers.replace_months(again, path)
    return t.spark.read.option("basePath", path).parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))
