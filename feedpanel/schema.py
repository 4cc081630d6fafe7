"""Column types of the raw tables. Ids, text and times are strings at the edge;
counts and scores are doubles."""

from __future__ import annotations

from pyspark.sql import types as T

EMOTIONS = ["anger", "fear", "disgust"]
LANG_SETS = {"de_en": ["de", "en"], "de": ["de"], "all": None}

# The columns of the raw post and user tables.
_TEXT = [
    "id", "conversation_id", "text", "lang", "created_at", "author_id",
    "location", "geo_location", "urls", "expanded_urls", "hashtags", "mentions",
    "tweet_type", "retweeted_id", "quoted_id", "in_reply_to_user_id", "file", "domain",
]
_NUMBERS = [
    "followers_count", "following_count", "tweet_count",
    "retweet_count", "reply_count", "quote_count", "like_count", "impression_count",
    "anger_v2", "fear_v2", "disgust_v2", "sadness_v2",
    "joy_v2", "enthusiasm_v2", "pride_v2", "hope_v2",
]

PANEL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in _NUMBERS]
)

POST_COLUMNS = [
    "id", "conversation_id", "text", "lang", "created_at", "author_id",
    "retweet_count", "reply_count", "quote_count", "like_count", "impression_count",
    "urls", "expanded_urls", "hashtags", "mentions", "tweet_type",
    "retweeted_id", "quoted_id", "in_reply_to_user_id",
]
USER_COLUMNS = [
    "author_id", "username", "name", "verified", "followers_count", "following_count",
    "tweet_count", "created_at", "description", "location", "expanded_urls",
]


def schema_for(columns: list[str]) -> T.StructType:
    """Types of the named columns; unknown names are strings."""
    known = {f.name: f for f in PANEL_SCHEMA.fields}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in columns])


def check_language_set(name: str) -> list[str] | None:
    if name not in LANG_SETS:
        raise ValueError(f"language set must be one of {sorted(LANG_SETS)}, got {name!r}")
    return LANG_SETS[name]
