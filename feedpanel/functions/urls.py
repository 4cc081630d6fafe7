"""URL columns: domain, registered domain, host named in a failed request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of more than one label that count as one public suffix.
# A full list can be passed in; every other suffix is the last label.
PUBLIC_SUFFIXES = [
    "co.at", "or.at", "gv.at", "ac.at", "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk",
    "com.au", "net.au", "org.au", "gov.au", "co.nz", "org.nz", "co.jp", "or.jp", "ne.jp",
    "com.br", "com.tr", "com.mx", "com.ar", "co.za", "co.il", "co.in", "co.kr", "com.cn",
    "com.pl", "com.ua", "com.sg", "com.hk", "com.tw",
]

# Links of these platforms are not expanded ...
PLATFORM_LINKS = ["youtu.be", "fb.me", "t.co", "instagr.am", "tmblr.co", "chang.it"]
# ... and these stand for the platform itself.
PLATFORM_ALIASES = {
    "youtu.be": "youtube.com",
    "t.co": "twitter.com",
    "fb.me": "facebook.com",
    "tmblr.co": "tumblr.com",
    "instagr.am": "instagram.com",
}


# Slashes, then white space, go from both ends; blanks go everywhere.
_EDGES_AND_BLANKS = r"^/*[\s\p{Z}\x1c-\x1f\x85]*|[\s\p{Z}\x1c-\x1f\x85]*/*$| "
# The part up to the next slash: after the first ``//`` if the text starts with
# http (no match without ``//``), else from the start.
_HOST_PART = r"^(?:http(?s:.*?)//|(?!http))([^/]*)"


def extract_domain(url: Column) -> Column:
    """Lower-case host part of a URL, every ``www.`` removed; port and query stay
    when no slash ends the host. Null for ``http`` URLs without ``//``."""
    u = F.regexp_replace(F.lower(url), _EDGES_AND_BLANKS, "")
    host = F.get(F.regexp_extract_all(u, F.lit(_HOST_PART), F.lit(1)), F.lit(0))
    return F.replace(host, F.lit("www."), F.lit(""))


def host_from_failure(text: Column) -> Column:
    """Host inside a "Cannot connect to host h:port ..." message, else the text."""
    host = F.get(F.split(F.get(F.split(text, " "), F.lit(4)), ":"), F.lit(0))
    return F.when(text.startswith("Cannot"), host).otherwise(text)


def registered_domain(domain: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """The label before the public suffix, with the suffix; null for single labels."""
    known = "|".join(x.replace(".", r"\.") for x in suffixes)
    pattern = rf"([^.]+\.(?:{known}|[^.]+))$"
    host = F.regexp_replace(domain, "[:?#].*$", "")
    return F.get(F.regexp_extract_all(host, F.lit(pattern), F.lit(1)), F.lit(0))
