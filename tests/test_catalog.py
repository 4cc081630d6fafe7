"""Registered queries at the smallest scale next to their SQL twins; check.py
runs all of them."""

import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"
SOME = [
    "daily_panel", "weekly_threshold_shares", "top_hashtags", "user_features", "window_features", "author_day",
    "event_windows", "variance_decomposition", "supersharer_groups", "match_domains", "merge_multilink",
    "share_failing", "spike_comparison", "filter_scorable", "reply_nodes", "cosharing_edges", "components",
    "spearman_matrix", "wilcoxon_groups", "evaluate_classifier", "granger_wald", "release_windows",
]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "tweet_count" in df.columns


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    message, detail = compare(spark, SF, name, entry.oracle_sql()[name], entry.queries()[name])
    assert message.startswith("ok"), (message, detail)
