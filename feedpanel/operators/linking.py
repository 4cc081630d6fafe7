"""URLs of posts and their match to rated domains: exact, registered, fuzzy.

Matching runs on distinct domains; URLs are joined to the finished domain map.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from feedpanel.functions import urls as U
from feedpanel.functions.text import split_list, with_costly
from feedpanel.operators.panel import keep_one
from feedpanel.session import materialize


def distinct_urls(posts: DataFrame) -> DataFrame:
    """Every URL of the posts once, with its domain."""
    urls = posts.select(F.explode(split_list(F.col("expanded_urls"))).alias("url")).distinct()
    return with_costly(urls, "domain", U.extract_domain(F.col("url")))


def split_shortened(urls: DataFrame, shorteners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shortened, other) by membership of the domain; no domain counts as other."""
    names = shorteners.select("domain").distinct()
    return urls.join(names, "domain", "left_semi"), urls.join(names, "domain", "left_anti")


def drop_platform_links(urls: DataFrame, platforms: Sequence[str] = U.PLATFORM_LINKS) -> DataFrame:
    return urls.filter(~F.coalesce(F.col("domain").isin(*platforms), F.lit(False)))


def top_domains(urls: DataFrame, k: int = 15) -> DataFrame:
    return (
        urls.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(k)
    )


def read_resolution(resolution: DataFrame) -> DataFrame:
    """Distinct expansion results with their domain; failed requests carry the
    host in the message."""
    out = resolution.distinct().withColumn("unraveled_url", U.host_from_failure(F.col("unraveled_url")))
    return with_costly(out, "domain", U.extract_domain(F.col("unraveled_url")))


def resolve_urls(shortened: DataFrame, resolution: DataFrame) -> DataFrame:
    """Expanded URLs, and the rest under its own domain or the platform's."""
    resolved = read_resolution(resolution).select("url", "unraveled_url", "domain")
    rest = shortened.join(resolved.select("url").distinct(), "url", "left_anti")
    platform = F.col("domain")
    for short, name in U.PLATFORM_ALIASES.items():
        platform = F.when(F.col("domain") == short, F.lit(name)).otherwise(platform)
    rest = rest.select("url", F.col("domain").alias("unraveled_url"), platform.alias("domain"))
    return resolved.unionByName(rest)


def resolution_report(resolution: DataFrame) -> DataFrame:
    """Timeouts against answered requests, and rows without a domain."""
    answered = F.count("status_code")
    timeouts = F.count(F.lit(1)) - answered
    return read_resolution(resolution).agg(
        timeouts.alias("n_timeouts"),
        (timeouts / F.nullif(answered, F.lit(0)) * 100).alias("pct_timeouts"),
        (F.count_if(F.col("domain").isNull()) / F.count(F.lit(1)) * 100).alias("pct_missing_domain"),
    )


def unique_urls(resolved: DataFrame, unshortened: DataFrame) -> DataFrame:
    """One row per URL with a domain; expanded URLs win over raw ones."""
    both = resolved.select("url", "domain", F.lit(0).alias("_from")).unionByName(
        unshortened.select("url", "domain", F.lit(1).alias("_from"))
    )
    return keep_one(both, ["url"], [F.col("_from"), F.col("domain").asc_nulls_last()]).drop("_from").dropna(
        subset=["domain"]
    )


def match_exact(domains: DataFrame, rated: DataFrame) -> DataFrame:
    names = rated.select(F.col("ng_domain")).distinct()
    return domains.join(names, domains["domain"] == names["ng_domain"])


def match_registered(
    domains: DataFrame, rated: DataFrame, suffixes: Sequence[str] = U.PUBLIC_SUFFIXES
) -> DataFrame:
    hosts = with_costly(domains, "host", U.registered_domain(F.col("domain"), suffixes))
    names = rated.select("ng_domain").distinct()
    return hosts.join(names, hosts["host"] == names["ng_domain"])


def indel_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Insertions and deletions between the strings of every pair.

    Counts the longest common subsequences of a batch side by side: a pair's row is
    a bit per character of ``a``, and each character of ``b`` moves all rows on by
    one addition (bit-parallel, words of 64 bits with carry).
    """
    out = np.zeros(len(a), np.int64)
    len_a, len_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.lexsort((len_b, -(-len_a // 64)))
    for lo in range(0, len(order), 2048):
        at = order[lo : lo + 2048]
        words = max(1, -(-int(len_a[at].max()) // 64))
        left = _code_points([a[i] for i in at], 64 * words, -1)
        right = _code_points([b[i] for i in at], max(1, int(len_b[at].max())), -2)
        row = np.full((len(at), words), ~np.uint64(0))
        for j in range(right.shape[1]):
            same = np.packbits(left == right[:, j, None], axis=1, bitorder="little").view(np.uint64)
            hit = row & same
            carry = np.zeros(len(at), np.uint64)
            total = np.empty_like(row)
            for w in range(words):
                part = row[:, w] + hit[:, w]
                total[:, w] = part + carry
                carry = ((part < row[:, w]) | (total[:, w] < part)).astype(np.uint64)
            row = total | (row & ~same)
        common = np.bitwise_count(~row).sum(1).astype(np.int64)
        out[at] = len_a[at] + len_b[at] - 2 * common
    return out


def _code_points(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of every text, filled up to ``width``."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(width) < np.array([len(t) for t in texts])[:, None]
    out = np.full(inside.shape, fill, np.int64)
    out[inside] = flat
    return out


@F.pandas_udf(IntegerType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_distances(list(a), list(b)), dtype="int32")


def indel_ratio(a, b):
    """Similarity 0-100: one minus distance over the summed lengths."""
    return (1 - indel(a, b) / (F.length(a) + F.length(b))) * 100


# Strings up to two edits apart meet in a shared reduced string.
_MAX_DELETIONS = 2


def _long_from(threshold: int) -> int:
    """The first length of a name that allows more edits than are left out."""
    c = 100 - threshold
    return (_MAX_DELETIONS + 1) * (100 - c) // (2 * c) + 1


def _max_edits_col(length, threshold: int):
    """Most edits a pair with a common subsequence of this length may have."""
    c = 100 - threshold
    return F.greatest(F.ceil(2 * c * length / (100 - c)) - 1, F.lit(0))


def _reduced(strings: DataFrame, col: str, threshold: int) -> DataFrame:
    """(col, reduced, removed): the string with up to two characters left out,
    as long as a pair meeting there can still pass the threshold."""
    level = strings.select(col, F.col(col).alias("reduced"), F.lit(1).alias("_from"))
    out = level.select(col, "reduced", F.lit(0).alias("removed"))
    for i in range(1, _MAX_DELETIONS + 1):
        size = F.length("reduced")
        may_go = (_max_edits_col(size - 1, threshold) >= i) & (F.col("_from") <= size)
        # going on from the last place only, every set of places comes up once
        level = level.filter(may_go).select(
            col, "reduced", F.explode(F.sequence(F.col("_from"), size)).alias("p")
        )
        cut = F.concat(F.expr("left(reduced, p - 1)"), F.expr("substr(reduced, p + 1)"))
        level = level.select(col, cut.alias("reduced"), F.col("p").alias("_from"))
        out = out.unionByName(level.select(col, "reduced", F.lit(i).alias("removed")).distinct())
    return out


def _fuzzy_by_deletion(hosts: DataFrame, rated: DataFrame, threshold: int) -> DataFrame:
    """Pairs of which one name is too short for more than two edits. Rated names that
    share a reduced string and a number of removed characters score alike against
    any host, so only the alphabetically first is kept before the join."""
    longest = _long_from(threshold) + _MAX_DELETIONS
    hosts, rated = hosts.filter(F.length("host") < longest), rated.filter(F.length("ng_domain") < longest)
    # shuffled at once, so that its size is measured after the strings are made
    left = _reduced(hosts, "host", threshold).repartition("reduced")
    right = (
        _reduced(rated, "ng_domain", threshold)
        .withColumnRenamed("removed", "added")
        .groupBy("reduced", "added")
        .agg(F.min("ng_domain").alias("ng_domain"))
    )
    edits = F.col("removed") + F.col("added")
    return (
        left.join(right, "reduced")
        .filter(edits <= _MAX_DELETIONS)
        .select("host", "ng_domain", edits.alias("distance"))
    )


# The longest and the shortest piece tried, as far as the threshold lets a name hold enough of them;
# the length that would list the fewest pairs among this many names is taken.
_LONGEST_PIECE, _SHORTEST_PIECE = 8, 4
_TRIED_NAMES = 4000


def _edits(length: int, threshold: int) -> int:
    """Most edits between a name of this length and any host that matches it."""
    c = 100 - threshold
    return max(-(-2 * c * length // (100 - c)) - 1, 0)


def _piece_lengths(threshold: int, shortest: int) -> list[int]:
    """Lengths of which every long name holds more pieces side by side than edits."""
    # edits grow by less than one per step of (100 - c) / 2c characters, so the shortest names are the hardest
    longest = min(n // (_edits(n, threshold) + 1) for n in range(shortest, shortest + 200))
    if longest < 1:
        raise ValueError("below a similarity of 67 long names need not share a piece")
    return list(range(min(_SHORTEST_PIECE, longest), min(_LONGEST_PIECE, longest) + 1))


def _rarest_apart(counts: list[np.ndarray], wanted: list[int], q: int) -> list[list[int]]:
    """Per name the starts (from 0) of so many pieces of ``q`` characters that do not
    overlap and are together the least frequent; ``counts`` has a number per start."""
    out: list[list[int]] = [[] for _ in counts]
    order = sorted(range(len(counts)), key=lambda i: len(counts[i]))
    while order:
        width, most = len(counts[order[-1]]), max(wanted[i] for i in order)
        size = max(1, 4_000_000 // (width * (most + 1)))
        at, order = order[-size:], order[:-size]
        cost = np.full((len(at), width), np.inf)
        for i, k in enumerate(at):
            cost[i, : len(counts[k])] = counts[k]
        # the least sum of j pieces that start before p
        least = np.full((most + 1, width + 1, len(at)), np.inf)
        least[0] = 0
        for p in range(1, width + 1):
            taken = cost[:, p - 1] + least[:-1, max(p - q, 0)]
            least[1:, p] = np.minimum(least[1:, p - 1], taken)
        left, upto, rows = np.array([wanted[k] for k in at]), np.full(len(at), width), np.arange(len(at))
        for p in range(width, 0, -1):
            hit = (left > 0) & (upto >= p) & (least[left, p, rows] < least[left, p - 1, rows])
            for i in np.flatnonzero(hit):
                out[at[i]].append(p - 1)
            left, upto = left - hit, np.where(hit, p - q, upto)
    return out


def _piece_length(names: DataFrame, threshold: int, shortest: int) -> int:
    """The length of a piece for which some of the names, taken by their hash, collide
    least. Any of them finds every match; only the work differs."""
    lengths = _piece_lengths(threshold, shortest)
    if len(lengths) == 1:
        return lengths[0]
    some = [r[0] for r in names.orderBy(F.xxhash64("ng_domain"), "ng_domain").limit(_TRIED_NAMES).collect()]
    wanted = [_edits(len(x), threshold) + 1 for x in some]
    collisions = {}
    for q in lengths:
        pieces = [[x[i : i + q] for i in range(len(x) - q + 1)] for x in some]
        times = Counter(piece for name in pieces for piece in name)
        counts = [np.array([times[piece] - 1 for piece in name], float) for name in pieces]
        collisions[q] = sum(c[at].sum() for c, at in zip(counts, _rarest_apart(counts, wanted, q), strict=True))
    return min(lengths, key=lambda q: (collisions[q], -q))


def _pieces(names: DataFrame, col: str, q: int, *others: str) -> DataFrame:
    """(others, at, piece): the hash of every run of ``q`` characters and its start from 0."""
    runs = F.transform(F.sequence(F.lit(1), F.length(col) - (q - 1)), lambda i: F.xxhash64(F.substr(F.col(col), i, F.lit(q))))
    return names.select(*others, F.posexplode(runs).alias("at", "piece"))


def _index(names: DataFrame, q: int, threshold: int) -> DataFrame:
    """(name, length, at, piece): of every rated name one piece more than edits are
    possible, side by side and as rare as can be. An edit changes one of them at
    most, so every match holds one of them unchanged."""
    pieces = materialize(_pieces(names, "ng_domain", q, "name", F.length("ng_domain").alias("length")))
    counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    ranked = pieces.join(counts, "piece").groupBy("name", "length").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "piece"))).alias("all")
    )

    @F.pandas_udf("array<int>")
    def rarest(counts: pd.Series, length: pd.Series) -> pd.Series:
        wanted = [_edits(int(n), threshold) + 1 for n in length]
        return pd.Series(_rarest_apart([np.asarray(c, float) for c in counts], wanted, q))

    chosen = ranked.withColumn("kept", rarest(F.col("all.n"), F.col("length")))
    return chosen.select("name", "length", F.explode("kept").alias("at"), F.col("all.piece").alias("hashes")).select(
        "name", "length", "at", F.get("hashes", F.col("at")).alias("piece")
    )


def fuzzy_candidates(hosts: DataFrame, rated: DataFrame, threshold: int = 97) -> DataFrame:
    """Pairs (host, ng_domain) of long names, for which three edits or more may be
    allowed: none that matches is missing. Rated names are listed under a few rare
    pieces that do not overlap, hosts look up all of theirs; the two places of a piece
    may be no farther apart than the edits allow. Pieces travel as hashes with the
    numbers of their names; the names come back with the pairs."""
    c, shortest = 100 - threshold, _long_from(threshold)
    _piece_lengths(threshold, shortest)
    number = F.monotonically_increasing_id()
    long_hosts = materialize(hosts.filter(F.length("host") >= shortest).select("host", number.alias("no")))
    long_rated = materialize(rated.filter(F.length("ng_domain") >= shortest).select("ng_domain", number.alias("name")))
    q = _piece_length(long_rated, threshold, shortest)
    index = materialize(_index(long_rated, q, threshold))
    probes = _pieces(long_hosts, "host", q, "no", F.length("host").alias("host_length")).withColumnRenamed("at", "host_at")
    # characters inserted or left out before the piece, and those behind it
    before = F.col("host_at") - F.col("at")
    behind = F.col("host_length") - F.col("length") - before
    near = (F.abs(before) + F.abs(behind)) * 100 < c * (F.col("host_length") + F.col("length"))
    pairs = probes.join(index, "piece").filter(near).select("no", "name").distinct()
    return pairs.join(long_rated, "name").join(long_hosts, "no").select("host", "ng_domain").distinct()


def _fuzzy_by_pieces(hosts: DataFrame, rated: DataFrame, threshold: int, longest: int) -> DataFrame:
    """Pairs of long names, up to ``longest`` rated ones, with their distance; candidates are verified."""
    c = 100 - threshold
    pairs = fuzzy_candidates(hosts, rated, threshold)
    # a changed character is two insertions or deletions, so the built-in distance never is the larger one; beyond
    # the edits that the longest name allows it is not counted to its end
    total = F.length("host") + F.length("ng_domain")
    edits = F.levenshtein("host", "ng_domain", _edits(longest, threshold))
    pairs = pairs.filter((edits >= 0) & (edits * 100 < c * total))
    return pairs.withColumn("distance", indel(F.col("host"), F.col("ng_domain")))


def match_fuzzy(hosts: DataFrame, rated: DataFrame, threshold: int = 97) -> DataFrame:
    """Best rated name per host with a similarity above the threshold; ties go to
    the alphabetically first name. From 100 on there is none, and below 67 long
    names are refused, as they need not share anything to match."""
    hosts = hosts.select("host").dropna().distinct()
    rated = materialize(rated.select("ng_domain").dropna().distinct())
    # lengths that differ by more than the edits allowed rule out any match
    c, size = 100 - threshold, F.length("ng_domain")
    if c <= 0:
        return hosts.limit(0).selectExpr("host", "host AS ng_domain", "0D AS similarity")
    ends = rated.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
    low, high = (ends["low"] or 0) * (100 - c) / (100 + c), (ends["high"] or 0) * (100 + c) / (100 - c)
    hosts = materialize(hosts.filter((F.length("host") > low) & (F.length("host") < high)))
    long_pairs = _fuzzy_by_pieces(hosts, rated, threshold, ends["high"] or 0)
    found = _fuzzy_by_deletion(hosts, rated, threshold).unionByName(long_pairs)
    total = F.length("host") + F.length("ng_domain")
    passing = found.filter(F.col("distance") * 100 < (100 - threshold) * total)
    best = passing.groupBy("host").agg(
        F.min(F.struct((F.col("distance") / total).alias("far"), "ng_domain")).alias("b")
    )
    return best.select(
        "host", F.col("b.ng_domain").alias("ng_domain"), ((1 - F.col("b.far")) * 100).alias("similarity")
    )


def match_domains(
    urls: DataFrame, rated: DataFrame, threshold: int = 97, suffixes: Sequence[str] = U.PUBLIC_SUFFIXES
) -> DataFrame:
    """(url, domain, ng_domain) of all URLs that match exactly, by registered
    domain or nearly; every URL of a nearly matching host is kept.

    Exact and registered matches are two joins over one table of distinct domains,
    which is stored: what neither finds goes on to near matching."""
    names = materialize(rated.select("ng_domain").dropna().distinct())
    hosts = with_costly(urls.select("domain").dropna().distinct(), "host", U.registered_domain(F.col("domain"), suffixes))
    exact = names.select(F.col("ng_domain").alias("_exact"))
    registered = names.select(F.col("ng_domain").alias("_registered"))
    # domains without a host get keys of their own, which match nothing, instead of one null key
    key = F.coalesce("host", F.concat(F.lit(" "), F.col("domain")))
    known = hosts.join(exact, F.col("domain") == F.col("_exact"), "left").join(registered, key == F.col("_registered"), "left")
    known = materialize(known)
    found = known.select("domain", "host", F.coalesce("_exact", "_registered").alias("ng_domain"), F.when(F.col("_exact").isNotNull(), "exact").otherwise("registered").alias("matched_by"))
    rest = found.filter("ng_domain IS NULL").select("domain", "host")
    near = rest.join(match_fuzzy(rest, names, threshold), "host")
    matched = found.filter("ng_domain IS NOT NULL").drop("host").unionByName(near.select("domain", "ng_domain", F.lit("fuzzy").alias("matched_by")))
    return urls.join(matched, "domain")


def match_rate(urls: DataFrame, matched: DataFrame) -> DataFrame:
    """Share of the URLs that match; ``urls`` is only counted."""
    n = urls.count()
    return matched.agg(F.count(F.lit(1)).alias("n_matched")).select(
        "n_matched", F.lit(n).cast("bigint").alias("n_urls"), (F.col("n_matched") / F.nullif(F.lit(n), F.lit(0)) * 100).alias("pct_matched")
    )
