"""Input tables of the queries, in Spark and in SQL, and the registry.

The driver tables stand in for the panel data: events are posts of a short dense
panel, orders and lineitem are posts with links over seven years, supplier times
months is the rating table, pages are URLs and documents are post texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpanel.operators import panel
from feedpanel.plans import flows
from feedpanel.session import apply_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END = "2024-01-02", "2024-01-29"


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its twin over the same tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(apply_defaults(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def keyed(key: str, seed: int) -> str:
    """The order of a reproducible sample in SQL: hexadecimal digits sort like their number."""
    return f"substr(md5('{seed}/' || {key}), 1, 15)"


class Inputs:
    """Reads the driver tables and shapes them like panel data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    # --- dense panel -------------------------------------------------------
    def posts(self) -> DataFrame:
        e = self.table("events")
        k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
        e = e.withColumn("k", k).withColumn(
            "rated", F.col("event_type").isin("click", "view") & (F.col("k") < 60)
        )
        n_users = self.table("events").agg(F.max("user_id") + 1).scalar()
        score = (F.col("k") * 20 % 101).cast("double") + F.when(
            F.col("k").isin(7, 8, 10, 34), 0.5
        ).otherwise(0.0)
        reply = F.when(F.col("k") % 4 == 0, F.concat(F.lit("x"), F.col("k"))).otherwise(
            ((F.col("user_id") * 31 + F.col("k")) % n_users).cast("string")
        )
        return e.select(
            F.col("event_id").cast("string").alias("id"),
            F.col("user_id").cast("string").alias("author_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.expr("CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END").alias("lang"),
            F.when(F.col("rated"), F.concat(F.lit("d"), F.col("k"))).alias("ng_domain"),
            F.when(F.col("rated"), score).alias("Score"),
            F.when(F.col("rated"), F.expr("CASE k % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'Neutral' ELSE 'Right' END")).alias("Orientation"),
            F.when(F.col("k") <= 80, F.concat(F.lit("h"), F.col("k") % 10, F.lit(" h"), F.col("k") % 7)).alias("hashtags"),
            F.when(F.col("event_type") == "signup", reply).alias("in_reply_to_user_id"),
            F.expr("CASE WHEN k % 5 = 0 THEN 'retweeted' WHEN k % 5 = 1 THEN 'quoted' END").alias("tweet_type"),
        )

    def scores(self) -> DataFrame:
        v, i = F.col("value"), F.col("event_id")
        return (
            self.table("events")
            .filter(F.col("event_type") != "error")
            .select(
                i.cast("string").alias("id"),
                (v / (v + 20)).alias("anger_v2"),
                ((i * 7919 % 1000) / 1000.0).alias("fear_v2"),
                ((i * 104729 % 1000) / 1000.0).alias("disgust_v2"),
            )
        )

    def users(self) -> DataFrame:
        u = self.table("events").select("user_id").distinct()
        return u.select(
            F.col("user_id").cast("string").alias("author_id"),
            (F.col("user_id") * 7919 % 120000).cast("double").alias("followers_count"),
            (F.col("user_id") * 31 % 5000).cast("double").alias("following_count"),
            (F.col("user_id") * 17 % 90000).cast("double").alias("tweet_count"),
            F.when(
                F.col("user_id") % 11 != 0,
                F.add_months(F.lit("2021-01-15").cast("date"), (F.col("user_id") % 36).cast("int")),
            ).alias("account_created"),
        )

    def authors(self) -> DataFrame:
        return self.users().filter(F.col("author_id").try_cast("bigint") % 5 != 0)

    def panel(self) -> DataFrame:
        return panel.restrict_panel(self.posts(), self.authors(), START, END)

    def scored(self, langs: str = "all") -> DataFrame:
        return flows.scored_panel(self.posts(), self.authors(), self.scores(), langs, START, END)

    # --- posts with links --------------------------------------------------
    def link_posts(self) -> DataFrame:
        """One post per order; its links are the order's lines, joined by spaces."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.struct(
                "l_linenumber",
                F.concat(
                    F.lit("https://www.s"), F.col("l_suppkey"), F.lit(".example.com/"), F.col("l_linenumber")
                ).alias("url"),
            ).alias("line"),
        )
        urls = lines.groupBy("o_orderkey").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["url"]), " ").alias("expanded_urls")
        )
        return self.table("orders").join(urls, "o_orderkey", "left").select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_custkey").cast("string").alias("author_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            "expanded_urls",
        )

    def raw_ratings(self) -> DataFrame:
        """Twice-a-month ratings with free orientation labels and a yes/no criterion."""
        m = F.col("id")
        sup = self.table("supplier").select(
            "s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("id")
        )
        r = sup.filter((F.col("s_suppkey") + m) % 17 != 0).withColumn(
            "half", F.explode(F.array(F.lit(0), F.lit(1)))
        )
        return r.select(
            F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example.com")).alias("Domain"),
            F.expr("CASE WHEN s_nationkey % 4 = 0 THEN 'AT' ELSE 'DE' END").alias("Country"),
            F.date_add(F.add_months(F.lit("1998-01-01").cast("date"), m), F.col("half") * 14).alias("file_date"),
            ((F.col("s_suppkey") * 37 + m * 11 + F.col("half") * 3) % 101).cast("double").alias("Score"),
            F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'Far Right' WHEN 1 THEN 'Slightly Left' "
                   "WHEN 2 THEN NULL WHEN 3 THEN 'Right' ELSE 'Neutral' END").alias("Orientation"),
            F.expr("CASE (s_suppkey + id) % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' END").alias("crit_old"),
            F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'No' END").alias("crit_new"),
        )

    # --- urls and texts ----------------------------------------------------
    def pages_urls(self) -> DataFrame:
        return self.table("pages").select("url")

    def texts(self) -> DataFrame:
        d = self.table("documents")
        deco = F.expr(
            "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat('RT ', text) "
            "WHEN 2 THEN concat(text, ' https://t.co/x y') WHEN 3 THEN concat('@us_er1 ', text) "
            "ELSE concat('\U0001F600❤ ', text, '\\\\') END"
        )
        return d.select(F.col("doc_id").cast("string").alias("id"), "lang", deco.alias("text"))


# --- the same tables in SQL ------------------------------------------------
USERS = """
users AS (
  SELECT CAST(user_id AS VARCHAR) AS author_id, CAST(user_id * 7919 % 120000 AS DOUBLE) AS followers_count,
         CAST(user_id * 31 % 5000 AS DOUBLE) AS following_count, CAST(user_id * 17 % 90000 AS DOUBLE) AS tweet_count,
         CASE WHEN user_id % 11 <> 0 THEN CAST(DATE '2021-01-15' + to_months(CAST(user_id % 36 AS INTEGER)) AS DATE) END AS account_created
  FROM (SELECT DISTINCT user_id FROM events)),
authors AS (SELECT * FROM users WHERE CAST(author_id AS BIGINT) % 5 <> 0)"""

POSTS = f"""
raw AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         (SELECT max(user_id) + 1 FROM events) AS n_users FROM events),
flagged AS (SELECT *, event_type IN ('click', 'view') AND k < 60 AS rated FROM raw),
posts AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS author_id, ts AS created_at,
    CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS lang,
    CASE WHEN rated THEN 'd' || k END AS ng_domain,
    CASE WHEN rated THEN CAST(k * 20 % 101 AS DOUBLE) + CASE WHEN k IN (7, 8, 10, 34) THEN 0.5 ELSE 0 END END AS Score,
    CASE WHEN rated THEN CASE k % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'Neutral' ELSE 'Right' END END AS Orientation,
    CASE WHEN k <= 80 THEN 'h' || (k % 10) || ' h' || (k % 7) END AS hashtags,
    CASE WHEN event_type = 'signup' THEN
      CASE WHEN k % 4 = 0 THEN 'x' || k ELSE CAST((user_id * 31 + k) % n_users AS VARCHAR) END END AS in_reply_to_user_id,
    CASE WHEN k % 5 = 0 THEN 'retweeted' WHEN k % 5 = 1 THEN 'quoted' END AS tweet_type
  FROM flagged),
scores AS (
  SELECT CAST(event_id AS VARCHAR) AS id, value / (value + 20) AS anger_v2,
    (event_id * 7919 % 1000) / CAST(1000 AS DOUBLE) AS fear_v2,
    (event_id * 104729 % 1000) / CAST(1000 AS DOUBLE) AS disgust_v2
  FROM events WHERE event_type <> 'error'),
{USERS},
panel AS (
  SELECT *, CAST(created_at AS DATE) AS day FROM posts
  WHERE author_id IN (SELECT author_id FROM authors)
    AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}')"""


def scored_sql(langs: str = "all") -> str:
    """CTE chain up to ``scored``: panel posts with masked scores."""
    mask = {"all": "TRUE", "de_en": "lang IN ('de', 'en')", "de": "lang = 'de'"}[langs]
    cols = ", ".join(
        f"CASE WHEN {mask} THEN s.{e}_v2 END AS {e}_v2" for e in ("anger", "fear", "disgust")
    )
    return f"{POSTS},\nscored AS (SELECT p.*, {cols} FROM panel p LEFT JOIN scores s ON p.id = s.id)"


LINKS = """
link_posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author_id, o_orderdate AS created_at,
    u.expanded_urls FROM orders LEFT JOIN (
      SELECT l_orderkey, string_agg('https://www.s' || l_suppkey || '.example.com/' || l_linenumber, ' ' ORDER BY l_linenumber,
        'https://www.s' || l_suppkey || '.example.com/' || l_linenumber) AS expanded_urls
      FROM lineitem GROUP BY 1) u ON o_orderkey = u.l_orderkey)"""

RATINGS = """
raw_ratings AS (
  SELECT 's' || s_suppkey || '.example.com' AS Domain, CASE WHEN s_nationkey % 4 = 0 THEN 'AT' ELSE 'DE' END AS Country,
    CAST(DATE '1998-01-01' + to_months(CAST(m.i AS INTEGER)) AS DATE) + CAST(h.i * 14 AS INTEGER) AS file_date,
    CAST((s_suppkey * 37 + m.i * 11 + h.i * 3) % 101 AS DOUBLE) AS Score,
    CASE s_suppkey % 5 WHEN 0 THEN 'Far Right' WHEN 1 THEN 'Slightly Left' WHEN 2 THEN NULL WHEN 3 THEN 'Right' ELSE 'Neutral' END AS Orientation,
    CASE (s_suppkey + m.i) % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' END AS crit_old,
    CASE WHEN s_suppkey % 3 = 0 THEN 'No' END AS crit_new
  FROM supplier, range(48) m(i), range(2) h(i) WHERE (s_suppkey + m.i) % 17 <> 0)"""

TEXTS = """
texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'RT ' || text
    WHEN 2 THEN text || ' https://t.co/x y' WHEN 3 THEN '@us_er1 ' || text
    ELSE '\U0001F600❤ ' || text || chr(92) END AS text FROM documents)"""

# --- URL table: customers link to suppliers' sites in eight spellings --------
_LINK_KINDS = [
    "concat('https://www.', site, '/a/', n)",
    "concat('http://shop.', site, '/x?y=', n)",
    "concat('https://', replace(site, 'news', 'newss'), '/', n)",
    "concat('https://', replace(site, 'news', 'nws'), '/', n)",
    "concat('https://m.short.example/', n)",
    "concat('https://youtu.be/', n)",
    "concat('http:', n)",
    "concat('/', upper(site), ':80/ ', n, '/')",
]
_SITE = "concat('supplier-', lpad(CAST({} AS STRING), 6, '0'), '-news.com')"


def site_urls(t: Inputs) -> DataFrame:
    """(author_id, expanded_urls): two links per customer, joined by a space."""
    n_sup = t.table("supplier").count()
    c = t.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("n"))
    c = c.withColumn("site", F.expr(_SITE.format(f"c_custkey % {n_sup + 20}")))
    url = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_LINK_KINDS)) + " END"
    c = c.withColumn("url", F.regexp_replace(F.expr(url), " ", "%20"))
    return c.select(
        F.col("n").alias("author_id"),
        F.concat_ws(" ", "url", F.concat(F.lit("https://"), "site", F.lit("/front"))).alias("expanded_urls"),
    )


def sites(t: Inputs) -> DataFrame:
    """Rated names: the suppliers' sites."""
    return t.table("supplier").select(F.expr(_SITE.format("s_suppkey")).alias("ng_domain"))


def resolution(t: Inputs) -> DataFrame:
    """Expansion results of the short links; every third request failed."""
    c = t.table("customer").filter("c_custkey % 8 = 4 AND c_custkey % 5 <> 0")
    site = _SITE.format("c_custkey % 90")
    return c.select(
        F.expr("concat('https://m.short.example/', c_custkey)").alias("url"),
        F.expr(
            f"CASE WHEN c_custkey % 3 = 0 THEN concat('Cannot connect to host ', {site}, ':443 ssl:default') "
            f"WHEN c_custkey % 7 = 0 THEN 'http:timeout' ELSE concat('https://', {site}, '/', c_custkey) END"
        ).alias("unraveled_url"),
        F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 200 END").alias("status_code"),
    )


def _duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def domain_sql(url: str) -> str:
    """extract_domain in SQL."""
    u = f"replace(lower(regexp_replace(regexp_replace({url}, '^/+|/+$', '', 'g'), '^\\s+|\\s+$', '', 'g')), ' ', '')"
    rest = f"CASE WHEN starts_with({u}, 'http') THEN CASE WHEN contains({u}, '//') THEN split_part({u}, '//', 2) END ELSE {u} END"
    return f"split_part(replace({rest}, 'www.', ''), '/', 1)"


_N_SUP = "(SELECT count(*) FROM supplier)"
SITES = f"""
sited AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS n, {_duck(_SITE.format(f'c_custkey % ({_N_SUP} + 20)'))} AS site FROM customer),
site_urls AS (SELECT n AS author_id, replace(CASE c_custkey % 8 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_LINK_KINDS))} END, ' ', '%20')
  || ' https://' || site || '/front' AS expanded_urls FROM sited),
urls AS (SELECT url, {domain_sql('url')} AS domain FROM (SELECT DISTINCT unnest(string_split(expanded_urls, ' ')) AS url FROM site_urls)),
sites AS (SELECT {_duck(_SITE.format('s_suppkey'))} AS ng_domain FROM supplier),
resolution AS (SELECT concat('https://m.short.example/', c_custkey) AS url, CASE WHEN c_custkey % 3 = 0 THEN concat('Cannot connect to host ', {_duck(_SITE.format('c_custkey % 90'))}, ':443 ssl:default')
  WHEN c_custkey % 7 = 0 THEN 'http:timeout' ELSE concat('https://', {_duck(_SITE.format('c_custkey % 90'))}, '/', c_custkey) END AS unraveled_url,
  CASE WHEN c_custkey % 3 <> 0 THEN 200 END AS status_code FROM customer WHERE c_custkey % 8 = 4 AND c_custkey % 5 <> 0),
resolved AS (SELECT url, status_code, host AS unraveled_url, {domain_sql('host')} AS domain FROM (SELECT DISTINCT url, status_code,
  CASE WHEN starts_with(unraveled_url, 'Cannot') THEN split_part(split_part(unraveled_url, ' ', 5), ':', 1) ELSE unraveled_url END AS host FROM resolution)),
shorteners AS (SELECT unnest(['m.short.example', 'youtu.be']) AS domain),
shortened AS (SELECT * FROM urls WHERE domain IN (SELECT domain FROM shorteners)),
unshortened AS (SELECT * FROM urls WHERE domain IS NULL OR domain NOT IN (SELECT domain FROM shorteners)),
expanded AS (SELECT url, unraveled_url, domain FROM resolved UNION ALL
  SELECT url, domain, CASE domain WHEN 'youtu.be' THEN 'youtube.com' WHEN 't.co' THEN 'twitter.com' WHEN 'fb.me' THEN 'facebook.com' WHEN 'tmblr.co' THEN 'tumblr.com' WHEN 'instagr.am' THEN 'instagram.com' ELSE domain END
  FROM shortened WHERE url NOT IN (SELECT url FROM resolved)),
all_urls AS (SELECT url, domain FROM expanded WHERE domain IS NOT NULL UNION ALL SELECT url, domain FROM unshortened WHERE domain IS NOT NULL)"""
