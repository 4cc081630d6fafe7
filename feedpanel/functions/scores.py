"""Score and time columns used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orientation labels that count as partisan, and their short form.
PARTISAN = ["Left", "Far Left", "Slightly Left", "Right", "Far Right", "Slightly Right"]
ORIENTATION_SHORT = {
    "Far Right": "Right",
    "Slightly Right": "Right",
    "Slightly Left": "Left",
    "Far Left": "Left",
}


def at_least(score: Column, cutoff: float | Column) -> Column:
    """1 when the score reaches the cutoff, else 0; no score counts as 0."""
    return F.coalesce((score >= cutoff).cast("int"), F.lit(0))


def score_band(score: Column) -> Column:
    """Rating band; scores between two bands (39.5, 59.5, ...) belong to none."""
    return (
        F.when(score <= 39, "max_caution")
        .when(score.between(40, 59), "caution")
        .when(score.between(60, 74), "exceptions")
        .when(score.between(75, 99), "generally_credible")
        .when(score == 100, "high_credibility")
    )


def untrust_degree(score: Column) -> Column:
    return (F.lit(100.0) - score) / F.lit(100.0)


def recode_orientation(label: Column) -> Column:
    short = label
    for old, new in ORIENTATION_SHORT.items():
        short = F.when(label == old, F.lit(new)).otherwise(short)
    return F.coalesce(short, F.lit("Neutral"))


def post_time(text: Column) -> Column:
    """ISO-8601 time with fraction and Z."""
    return F.try_to_timestamp(text)


def iso_week(day: Column) -> Column:
    """ISO year and week, ``2020-53``."""
    return F.concat_ws(
        "-",
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("string")


def week_start(day: Column, first: str = "monday") -> Column:
    """First day of the week that holds ``day``."""
    if first == "monday":
        return F.date_trunc("week", day).cast("date")
    if first == "sunday":
        return F.date_sub(day, F.dayofweek(day) - 1)
    raise ValueError("first must be 'monday' or 'sunday'")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Full seconds between two times, truncated."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 1000000)


def keyed_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows: the first 60 bits of md5 of ``seed/key``,
    which other engines give as well."""
    digits = F.substr(F.md5(F.concat_ws("/", F.lit(seed), key.cast("string")).cast("binary")), F.lit(1), F.lit(15))
    return F.conv(digits, 16, 10).cast("bigint")


def hash_share(key: Column, seed: int, k: int) -> Column:
    """True for about one key in ``k``."""
    return F.pmod(keyed_order(key, seed), F.lit(k)) == 0


def stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def odds_ratio(coef: Column) -> Column:
    return F.exp(coef)


def clipped_log_bin(score: Column, bins: int = 80, low: float = -5.0) -> Column:
    """Bin 0..bins-1 on a log10 scale from 10**low to 1; ends are clipped."""
    clipped = F.least(F.greatest(score, F.lit(10.0**low)), F.lit(1.0))
    raw = F.floor((F.log10(clipped) - low) / -low * bins)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def linear_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 between low and high, both ends inside."""
    raw = F.floor((value - low) / (high - low) * bins)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return part / F.nullif(whole, F.lit(0)) * scale
