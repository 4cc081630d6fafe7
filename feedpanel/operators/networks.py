"""Reply networks and co-sharing of sources."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.operators.ordered import row_numbers
from feedpanel.session import materialize


def replies(posts: DataFrame) -> DataFrame:
    return posts.filter("in_reply_to_user_id IS NOT NULL").select(
        F.col("author_id").alias("src"), F.col("in_reply_to_user_id").alias("dst")
    )


def _flag(df: DataFrame, sample: DataFrame, col: str, name: str) -> DataFrame:
    marks = sample.select(F.col("author_id").alias(col)).distinct().withColumn(name, F.lit(True))
    return df.join(marks, col, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def reply_edges(replies: DataFrame, sample: DataFrame) -> DataFrame:
    """Weight per (src, dst) with membership of both ends and the edge type."""
    edges = replies.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    edges = _flag(_flag(edges, sample, "src", "source_in_sample"), sample, "dst", "target_in_sample")
    kind = (
        F.when(F.col("source_in_sample") & F.col("target_in_sample"), "internal")
        .when(~F.col("target_in_sample"), "outgoing")
        .otherwise("incoming")
    )
    return edges.withColumn("edge_type", kind)


def internal_edges(replies: DataFrame, sample: DataFrame) -> DataFrame:
    """Edges with both ends in the sample."""
    edges = replies.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return induced_edges(edges, sample.select(F.col("author_id").alias("id")))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes.id``."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("id").alias("dst")), "dst", "left_semi"
    )


def reply_nodes(edges: DataFrame) -> DataFrame:
    """Replies received and sent per user, zero-filled. Works on the weighted
    edges, so the posts are read once."""
    ends = F.explode(
        F.array(
            F.struct(F.col("dst").alias("user_id"), F.col("weight").alias("received"), F.lit(0).cast("bigint").alias("sent")),
            F.struct(F.col("src").alias("user_id"), F.lit(0).cast("bigint").alias("received"), F.col("weight").alias("sent")),
        )
    )
    return (
        edges.select(ends.alias("e"))
        .groupBy("e.user_id")
        .agg(
            F.sum("e.received").alias("n_replies_received"),
            F.sum("e.sent").alias("n_replies_sent"),
            F.sum(F.col("e.received") + F.col("e.sent")).alias("total_activity"),
        )
    )


def with_sample_status(nodes: DataFrame, sample: DataFrame) -> DataFrame:
    out = _flag(nodes, sample, "user_id", "in_sample")
    return out.withColumn("sample_status", F.when(F.col("in_sample"), "inside").otherwise("outside"))


def reply_summary(edges: DataFrame) -> DataFrame:
    """Distinct targets and replies inside and outside the sample."""
    inside, weight = F.col("target_in_sample"), F.col("weight")
    targets = edges.groupBy("dst").agg(F.first("target_in_sample").alias("target_in_sample"), F.sum("weight").alias("weight"))
    return targets.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(inside).alias("targets_in_sample"),
        F.count_if(~inside).alias("targets_outside"),
        (F.count_if(inside) / F.count(F.lit(1)) * 100).alias("overlap_pct"),
        F.sum(F.when(inside, weight).otherwise(0)).alias("replies_in_sample"),
        F.sum(F.when(~inside, weight).otherwise(0)).alias("replies_outside"),
    )


def top_replied(replies: DataFrame, k: int = 20) -> DataFrame:
    return (
        replies.groupBy(F.col("dst").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("reply_count"))
        .orderBy(F.desc("reply_count"), "user_id")
        .limit(k)
    )


def ranked(df: DataFrame, by: str, *keys: str) -> DataFrame:
    """Heaviest first, ties by key."""
    return df.orderBy(F.desc(by), *keys)


def source_nodes(shares: DataFrame) -> DataFrame:
    """Mentions, most frequent rating (ties: the lower) and distinct users per domain."""
    good = (F.col("Score") >= 60).cast("int")
    return shares.groupBy("domain").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.mode(good, True).alias("Rating"),
        F.count_distinct("author_id").alias("unique_users"),
    )


# Widest tile of the domain x domain matrix that is multiplied densely, users whose
# rows one task multiplies at a time, and pairs of their domains one task should list.
_TILE = 1024
_USERS_PER_CHUNK = 4096
_PAIRS_PER_TASK = 8_000_000
# Pairs whose chunks' sums one task should bring together.
_PAIRS_PER_BLOCK = 4_000_000
# Pairs counted in one go, and multiplications of a dense product as costly as one of them.
_PAIRS_AT_ONCE = 2_000_000
_DENSE_PER_PAIR = 2000


def _dense(row_a, at_a, row_b, at_b, width_a: int, width_b: int):
    """(i, j, weight) of the pairs, by one product of two 0/1 tables."""
    rows, place = np.unique(np.concatenate([row_a, row_b]), return_inverse=True)
    left, right = np.zeros((len(rows), width_a), np.float32), np.zeros((len(rows), width_b), np.float32)
    left[place[: len(row_a)], at_a] = 1
    right[place[len(row_a) :], at_b] = 1
    product = left.T @ right
    i, j = np.nonzero(product)
    return i, j, product[i, j].astype("int64")


def _sparse(row_a, at_a, row_b, at_b, width_b: int, same: bool):
    """The same from the lists of pairs, a bounded number of them at a time; of two
    ``same`` tables only pairs of a domain and a later one."""
    order_a, order_b = np.lexsort((at_a, row_a)), np.lexsort((at_b, row_b))
    row_a, at_a, row_b, at_b = row_a[order_a], at_a[order_a], row_b[order_b], at_b[order_b]
    low = np.arange(1, len(row_a) + 1) if same else np.searchsorted(row_b, row_a)
    n = np.searchsorted(row_b, row_a, "right") - low
    upto = np.cumsum(n)
    cells, weights, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while start < len(n):
        listed = upto[start] - n[start]
        end = max(int(np.searchsorted(upto, listed + _PAIRS_AT_ONCE, "right")), start + 1)
        size = n[start:end]
        first = np.repeat(np.arange(start, end), size)
        within = np.arange(size.sum()) - np.repeat(upto[start:end] - size - listed, size)
        second = np.repeat(low[start:end], size) + within
        cell, weight = np.unique(at_a[first].astype(np.int64) * width_b + at_b[second], return_counts=True)
        cells.append(cell)
        weights.append(weight)
        start = end
    cell, place = np.unique(np.concatenate(cells), return_inverse=True)
    weight = np.bincount(place, np.concatenate(weights), len(cell)).astype("int64")
    return cell // width_b, cell % width_b, weight


def _multiply(pdf: pd.DataFrame) -> pd.DataFrame:
    """Users per pair of one domain of tile ``a`` and a later one of tile ``b``. Domains
    are numbered anew among those present; the cheaper way is taken."""
    a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
    row, no, t = pdf["row"].to_numpy(), pdf["no"].to_numpy(), pdf["t"].to_numpy()
    names_a, at_a = np.unique(no[t == a], return_inverse=True)
    names_b, at_b = (names_a, at_a) if a == b else np.unique(no[t == b], return_inverse=True)
    row_a, row_b = row[t == a], row[t == b]
    pairs = int((np.bincount(row_a, minlength=row.max() + 1) * np.bincount(row_b, minlength=row.max() + 1)).sum())
    users, size = len(np.unique(row)), len(names_a) * len(names_b)
    fits = max(size, users * max(len(names_a), len(names_b)) // 4) <= 4 * _TILE * _TILE
    if fits and users * size <= _DENSE_PER_PAIR * pairs:
        i, j, weight = _dense(row_a, at_a, row_b, at_b, len(names_a), len(names_b))
    else:
        i, j, weight = _sparse(row_a, at_a, row_b, at_b, max(len(names_b), 1), a == b)
    i_no, j_no = names_a[i].astype("int64"), names_b[j].astype("int64")
    low, high = np.minimum(i_no, j_no), np.maximum(i_no, j_no)
    # inside one tile every pair comes twice, and each domain with itself
    keep = i_no < j_no if a == b else np.ones(len(i_no), bool)
    return pd.DataFrame({"i": low[keep], "j": high[keep], "weight": weight[keep]})


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as all their lowest bytes, then all the next ones: high bytes are mostly alike and compress."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    found = np.frombuffer(planes, np.uint8).reshape(-1, n)
    wide[:, : len(found)] = found.T
    return wide.view("<u8").ravel().astype(np.int64)


def _packed(pairs: pd.DataFrame, side: int, wide: int) -> pd.DataFrame:
    """The pairs (i, j) of each of ``side`` x ``side`` blocks, by the remainders of i
    and j, in one row: sorted cells as steps from one to the next, and weights."""
    i, j, weight = pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["weight"].to_numpy()
    key = (i % side * side + j % side) * wide**2 + i // side * wide + j // side
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    block, cell = key // wide**2, key % wide**2
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    spans = list(zip(heads, np.append(heads[1:], len(block))))
    cells = [_planes(np.diff(cell[a:b], prepend=0)) for a, b in spans]
    return pd.DataFrame({"block": block[heads], "n": [b - a for a, b in spans], "cells": cells, "weights": [_planes(weight[a:b]) for a, b in spans]})


def _sum_block(pdf: pd.DataFrame, side: int, wide: int) -> pd.DataFrame:
    """(i, j, weight) of one block, summed over the chunks."""
    cell = np.concatenate([np.cumsum(_numbers(c, n)) for c, n in zip(pdf["cells"], pdf["n"])])
    weight = np.concatenate([_numbers(w, n) for w, n in zip(pdf["weights"], pdf["n"])])
    order = np.argsort(cell)
    cell, weight = cell[order], weight[order]
    heads = np.flatnonzero(np.diff(cell, prepend=-1))
    a, b = divmod(int(pdf["block"].iloc[0]), side)
    cell, weight = cell[heads], np.add.reduceat(weight, heads)
    return pd.DataFrame({"i": cell // wide * side + a, "j": cell % wide * side + b, "weight": weight})


def cosharing_edges(shares: DataFrame, tile: int = _TILE, users_per_chunk: int = _USERS_PER_CHUNK) -> DataFrame:
    """Users sharing both domains, for every unordered pair with at least one.

    The edges are the upper half of M'M for the 0/1 table M of users and domains.
    Users are cut into chunks. The domains of a chunk stay one tile while the pairs
    of its users are few, and are dealt over more tiles, at most one per ``tile``
    domains, as these grow; a task multiplies two tiles of one chunk and emits one
    number per pair, so pairs are summed before the shuffle and none of a user with
    many domains are listed by one task. A cell is sent as often as its chunk has
    tiles. Thin tables are multiplied pair by pair, full ones as matrices. Chunks may
    have few pairs in common, so their pairs travel packed, some bytes each, in blocks
    by the remainders of both domains, over which those of a frequent domain spread.
    """
    once = materialize(shares.select("author_id", "domain").distinct())
    names = materialize(row_numbers(once.select("domain").distinct(), ["domain"], "no").drop("no_total"))
    n_domains = names.agg(F.max("no")).first()[0] or 0
    most = -(-n_domains // tile) or 1
    d = F.count("domain")
    users = once.groupBy("author_id").agg(d.alias("d"))
    users = row_numbers(users, ["author_id"], "u").select(
        "author_id", "d", F.floor((F.col("u") - 1) / users_per_chunk).alias("chunk"), ((F.col("u") - 1) % users_per_chunk).cast("int").alias("row")
    )
    users = materialize(users)
    pairs = F.sum(F.col("d").cast("double") * F.col("d")) / 2
    tiles = F.least(F.greatest(F.ceil(F.sqrt(2 * pairs / _PAIRS_PER_TASK)), F.lit(1)), F.lit(most)).cast("int")
    chunks = users.groupBy("chunk").agg(tiles.alias("tiles"), pairs.alias("pairs"))
    listed = chunks.agg(F.sum(F.least("pairs", F.lit(n_domains * (n_domains - 1) / 2)))).first()[0] or 0
    partitions = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(min(math.ceil(math.sqrt(max(listed / _PAIRS_PER_BLOCK, partitions))), n_domains), 1)
    wide = n_domains // side + 1
    cells = once.join(names, "domain").join(users.join(chunks.drop("pairs"), "chunk"), "author_id").select(
        "chunk", "row", "tiles", F.col("no").cast("int").alias("no"), (F.col("no") % F.col("tiles")).cast("int").alias("t")
    )
    # a cell takes part in its own tile's products with all tiles of its chunk
    sided = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "chunk", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "row", "no", "t"
    )

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(_multiply(pdf), side, wide)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return _sum_block(pdf, side, wide)

    part = sided.groupBy("chunk", "a", "b").applyInPandas(multiply, "block bigint, n bigint, cells binary, weights binary")
    sums = part.groupBy("block").applyInPandas(total, "i bigint, j bigint, weight bigint")
    name = names.select(F.col("no").alias("i"), F.col("domain").alias("source"))
    other = names.select(F.col("no").alias("j"), F.col("domain").alias("target"))
    return sums.join(name, "i").join(other, "j").select("source", "target", "weight")
