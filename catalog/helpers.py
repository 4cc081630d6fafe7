"""Column helpers and small steps that no larger query shows by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import USERS, query
from feedpanel.functions import scores as S
from feedpanel.functions import text as X
from feedpanel.operators import panel, release, validation


@query("drop_columns", f"WITH {USERS} SELECT author_id, following_count, tweet_count, account_created FROM users")
def drop_columns(t):
    return release.drop_columns(t.users(), ["followers_count", "username"])


@query("emotion_long", " UNION ALL ".join(f"SELECT event_id, '{c}' AS emotion, CAST({e} AS DOUBLE) AS value FROM events" for c, e in (("low", "event_id % 10"), ("high", "user_id"))))
def emotion_long(t):
    wide = t.table("events").select("event_id", (F.col("event_id") % 10).cast("double").alias("low"), F.col("user_id").cast("double").alias("high"))
    return panel.emotion_long(wide, ["event_id"], ["low", "high"], "emotion")


@query("finite_only", "SELECT event_id, value AS x FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def finite_only(t):
    x = F.expr("CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN double('-Infinity') WHEN event_id % 11 = 0 THEN NULL ELSE value END")
    return panel.finite_only(t.table("events").select("event_id", x.alias("x")), "x")


@query("odds_ratios", "SELECT o_orderkey, round(exp(o_custkey % 7 / 4.0), 6) AS odds FROM orders")
def odds_ratios(t):
    return t.table("orders").select("o_orderkey", F.round(S.odds_ratio(F.col("o_custkey") % 7 / 4.0), 6).alias("odds"))


@query("post_time", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def post_time(t):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.table("events").select("event_id", F.unix_micros(S.post_time(text)).alias("micros"))


@query("repair_utf8", "SELECT doc_id, text || chr(65533) AS text FROM documents")
def repair_utf8(t):
    raw = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))
    return t.table("documents").select("doc_id", X.repair_utf8(raw.cast("string")).alias("text"))


@query("annotations_with_key", "SELECT CAST(l.doc_id AS VARCHAR) AS id, l.toxic, CASE WHEN l.doc_id % 9 = 2 THEN '0' END AS uncodable, d.lang FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 9 > 1")
def annotations_with_key(t):
    mark = F.expr("CASE doc_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' 1.0' WHEN 2 THEN '0' END")
    coded = t.table("labels").select(F.col("doc_id").cast("string").alias("id"), "toxic", mark.alias("uncodable"))
    return validation.annotations_with_key(coded, t.table("documents").select(F.col("doc_id").cast("string").alias("id"), "lang"))
