"""The flows from raw tables to reports. A table that several later steps read
is written once to the work folder instead of being computed again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from feedpanel.functions.urls import PUBLIC_SUFFIXES
from feedpanel.operators import daily, domains, features, linking, panel, ratings, sharers, validation, windows
from feedpanel.operators.panel import PERIOD
from feedpanel.schema import EMOTIONS
from feedpanel.session import materialize


def scored_panel(
    posts: DataFrame,
    authors: DataFrame,
    scores: DataFrame,
    langs: str = "de_en",
    start: str = PERIOD[0],
    end: str = PERIOD[1],
) -> DataFrame:
    """Panel posts of the period with the scores of the chosen languages."""
    kept = panel.restrict_panel(posts, authors, start, end)
    return panel.mask_language(panel.attach_scores(kept, scores), langs)


_NARROW = ["id", "author_id", "created_at", "ng_domain", "Score", "Orientation", *[f"{e}_v2" for e in EMOTIONS]]


def stored_panel(scored: DataFrame) -> DataFrame:
    """The columns the reports need, joined once and written; no texts."""
    return materialize(scored.select(*_NARROW))


def daily_series(scored: DataFrame) -> DataFrame:
    """Daily panel; cutoffs and counts read the stored scores."""
    slim = stored_panel(scored)
    return daily.daily_panel(slim, daily.third_quartiles(slim, stored=True))


def user_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Features, author-days and supersharer groups of one scored panel."""
    slim = stored_panel(scored)
    author_days = materialize(features.author_day(slim))
    return {
        "features": features.user_features(slim),
        "daily": author_days,
        "groups": sharers.supersharer_groups(sharers.user_totals(author_days)),
    }


def window_tables(scored: DataFrame, hours: Sequence[float] = (1, 24), min_mean: int = 10) -> dict[float, DataFrame]:
    """Event windows for each window length."""
    slim = stored_panel(scored)
    return {h: windows.event_windows(slim, h, min_mean) for h in hours}


def matched_urls(
    posts: DataFrame,
    shorteners: DataFrame,
    resolution: DataFrame,
    rated: DataFrame,
    threshold: int = 97,
    suffixes: Sequence[str] = PUBLIC_SUFFIXES,
) -> DataFrame:
    """URLs of the posts with the rated domain behind them."""
    urls = materialize(linking.distinct_urls(posts))
    short, rest = linking.split_shortened(urls, shorteners)
    every = materialize(linking.unique_urls(linking.resolve_urls(short, resolution), rest))
    return linking.match_domains(every, rated, threshold, suffixes)


def rated_posts(
    posts: DataFrame, matched: DataFrame, raw_ratings: DataFrame, since: str = ratings.STABLE_SINCE, literal: bool = False
) -> DataFrame:
    """Posts with the score and orientation of the sources they link to."""
    return ratings.rate_posts(posts, matched, materialize(ratings.build_ratings(raw_ratings)), since, literal)


def domain_report(rated: DataFrame, q: float = 0.9) -> dict[str, DataFrame]:
    """Uses per day, their classes, spike days and what was shared on them."""
    uses = materialize(domains.domains_per_day(rated))
    classified = domains.classify_domains(uses)
    totals = materialize(domains.daily_untrustworthy(domains.classified_daily(classified)))
    days = domains.mark_spikes(totals, q)
    return {
        "uses": uses,
        "classified": classified,
        "spikes": days,
        "comparison": domains.spike_comparison(uses, days),
    }


def criterion_links(
    rated: DataFrame, raw_ratings: DataFrame, criteria: Sequence[str], since: str = ratings.STABLE_SINCE
) -> DataFrame:
    """Untrustworthy links with score and criterion of their source."""
    table = materialize(ratings.ratings_with_criterion(raw_ratings, criteria))
    return ratings.attach_criterion(ratings.untrustworthy_links(rated), table, since)


def validation_population(scored: DataFrame, done: DataFrame, langs: str = "de_en") -> DataFrame:
    """Scored posts of the languages that were not annotated before."""
    pop = panel.all_scored(panel.drop_languages(scored, langs))
    return validation.exclude_ids(pop, done).withColumn("stratum", validation.stratum())

