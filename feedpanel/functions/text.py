"""Text columns: cleaning for the classifier, repair, small string helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges removed as pictographs. The last range is wide
# and also covers CJK and other scripts; that is what the scores were made with.
PICTOGRAPHS = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
# Characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    """Drops white space of any script from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column) -> Column:
    """Text for scoring: no pictographs, nothing from the first link to the end
    of its line, no handles; line feeds and backslashes become spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), PICTOGRAPHS, "")
    out = F.regexp_replace(out, r"(?d)https.*", "")
    out = F.regexp_replace(out, r"@[\p{L}\p{N}_]+", "")
    return strip_space(F.translate(out, "\n\\", "  "))


def with_costly(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds a column that is evaluated once per row, here: the optimizer neither
    copies the expression into later filters nor moves it below an aggregation."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def split_list(text: Column, sep: str = " ") -> Column:
    """List column stored as one string; empty strings give no elements."""
    parts = F.split(text, F.lit(f"\\Q{sep}\\E"))
    return F.filter(parts, lambda p: p != "")


def repair_utf8(raw: Column) -> Column:
    """Invalid byte sequences become the replacement character."""
    return F.make_valid_utf8(raw)


def recode_yes_no(text: Column) -> Column:
    """Tri-state boolean from free-form yes/no answers."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("yes", "y", "true", "1"), True).when(
        t.isin("no", "n", "false", "0"), False
    )
