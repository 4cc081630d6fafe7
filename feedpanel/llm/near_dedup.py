"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.llm.classes import connected
from feedpanel.llm.words import LOWER, SPACE, Words, blocks, mix, shingles
from feedpanel.session import materialize

_STEP = np.uint64(0xD1342543DE82EF95)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MASK = (1 << 64) - 1
_MAP = 4  # words of the bitmap of a text's differences

def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(hashes: np.ndarray, first: np.ndarray, width: int, weights: str):
    """Shingles of each row with their weights: 1 each ("set") or their number in the row ("count")."""
    made, offsets = shingles(hashes, first, width)
    row = np.repeat(np.arange(len(first) - 1), np.diff(offsets))
    if weights == "set":
        return made, row, np.ones(len(made))
    order = np.lexsort((made, row))
    made, row = made[order], row[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return made[at], row[at], np.diff(at, append=len(made)).astype(float)


def _cells(element: np.ndarray, row: np.ndarray, weight: np.ndarray):
    """Cuts [0, weight) of each element into the regions [0, 1), [1, 2), [2, 4), [4, 8) ..."""
    low, size, parts = 0.0, 1.0, []
    there = np.arange(len(element))
    while len(there):
        number = len(parts) + 1
        parts.append((mix(element[there] + np.uint64(number * int(_STEP) & _MASK)), row[there], np.full(len(there), low), np.full(len(there), size), weight[there]))
        low, size = low + size, size * (2.0 if low else 1.0)
        there = there[weight[there] > low]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """``rows`` x ``k`` signatures; two rows agree in a coordinate with the probability of their weighted similarity.

    Every region of an element is a target that darts hit in order of their rank, at a rate equal to its size; hashes of
    the region alone fix rank, place and coordinate of each dart. A row throws darts up to a rank at which about
    k ln k + 2 k of them hit below its weights, and keeps the earliest of each coordinate. Rows with an empty coordinate
    throw up to twice that rank again, which leaves the coordinates already found as they are.
    """
    signature = np.full(rows * k, _EMPTY, np.uint64)
    cells = _cells(element, row, weight)
    if cells is None:
        return signature.reshape(rows, k)
    total = np.bincount(row, weight, rows)
    limit = (k * log(k) + 2 * k) / np.maximum(total, 1e-300)
    full = (cells[2] + cells[3] <= cells[4]).all()  # every dart at a region hits
    while True:
        cell, at, low, size, top = cells
        rank, until, thrown, volley = np.zeros(len(cell)), limit[at], 0, 2
        while len(cell):
            steps = (np.arange(thrown + 1, thrown + volley + 1, dtype=np.uint64) * _STEP)[None, :]
            dart = mix(cell[:, None] ^ steps)
            gap = np.log1p(-_uniform(dart)) / -size[:, None]
            gap[:, 0] += rank
            ranks = np.cumsum(gap, axis=1)
            region, step = np.nonzero(ranks < until[:, None])
            place = mix(dart[region, step] + _STEP)
            rank_hit, at_hit = ranks[region, step], at[region]
            if not full:
                hit = low[region] + _uniform(mix(place + _STEP)) * size[region] < top[region]
                place, rank_hit, at_hit = place[hit], rank_hit[hit], at_hit[hit]
            slot = at_hit * k + (place >> np.uint64(32)).astype(np.int64) % k
            when = rank_hit.astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(signature, slot, (when << np.uint64(32)) | (place & np.uint64(0xFFFFFFFF)))
            alive = ranks[:, -1] < until
            cell, at, low, size, top, until, rank = (x[alive] for x in (cell, at, low, size, top, until, ranks[:, -1]))
            thrown, volley = thrown + volley, min(2 * volley, 64)
        again = (signature.reshape(rows, k) == _EMPTY).any(axis=1) & (total > 0)
        if not again.any():
            return signature.reshape(rows, k)
        limit = np.where(again, limit * 2, limit)
        keep = again[cells[1]]
        cells = [x[keep] for x in cells]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows, k = signature.shape
    parts = signature.reshape(rows, bands, k // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (rows, bands)).copy()
    for j in range(parts.shape[2]):
        key = mix(key * _STEP + parts[:, :, j])
    return key.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _signed(width: int, bands: int, band_rows: int, weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text")):
                words = Words(LOWER[data], offsets, SPACE)
                found = elements(words.hashes(), words.first, width, weights)
                keys = band_keys(signatures(*found, hi - lo, bands * band_rows), bands)
                count = np.diff(words.first)
                has = count > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, hi - lo), batch.column("_node").slice(lo, hi - lo), pa.array(count),
                     _lists(keys[has].ravel(), np.where(has, bands, 0))],
                    ["_id", "_node", "n_words", "bands"],
                )

    return run


def _element_sets(width: int, weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text")):
                words = Words(LOWER[data], offsets, SPACE)
                made, row, weight = elements(words.hashes(), words.first, width, weights)
                # the j-th occurrence counts as an element of its own: set similarity is then the weighted one
                times = weight.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                made = mix(np.repeat(made, times) + nth.astype(np.uint64) * _STEP)
                row = np.repeat(row, times)
                order = np.lexsort((made, row))
                made, row = made[order], row[order]
                new = np.ones(len(made), bool)
                new[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
                made, row = made[new], row[new]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_node").slice(lo, hi - lo), _lists(made.view(np.int64), np.bincount(row, minlength=hi - lo))],
                    ["node", "elements"],
                )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    same = F.size(F.array_intersect("ea", "eb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("same", same)
    union = F.size("ea") + F.size("eb") - F.col("same")
    return both.filter(F.col("same") / union >= similarity).select("a", "b")


def _crowded(members: DataFrame) -> DataFrame:
    """``(node, lead)``: texts that share a bucket, with the bucket's lead, its text that meets the most others."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("met")).filter("met > 1")
    shared = materialize(members.join(sizes, "bucket"))
    known = shared.groupBy("node").agg(F.sum("met").alias("known"))
    shared = shared.select("bucket", "node").join(known, "node")
    leads = shared.groupBy("bucket").agg(F.max(F.struct("known", "node"))["node"].alias("lead"))
    return shared.select("bucket", "node").join(leads, "bucket").select("node", "lead").distinct()


def _differences(tested: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """How texts differ from their lead, where the texts around a lead are not all of one class.

    ``more`` and ``less`` are the elements that only the text and only the lead has; ``far`` tells that the two are not linked.
    """
    roots = classes.select("node", "root")
    placed = tested.join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left").withColumn("root", F.coalesce("rb", "b"))
    mixed = placed.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("a")
    lead = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    text = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    rows = placed.select("a", "b", "root").join(mixed, "a").join(lead, "a").join(text, "b")
    rows = rows.select("a", "b", "root", F.size("eb").alias("n"), F.size("ea").alias("na"), F.array_except("eb", "ea").alias("more"), F.array_except("ea", "eb").alias("less"))
    same = F.col("n") - F.size("more")
    return rows.withColumn("far", same / (F.col("na") + F.size("more")) < similarity)


def _bits(elements: Column, part: int) -> Column:
    """The ``part``-th 64 bits of a bitmap of the elements."""
    def step(a: Column, e: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), e.bitwiseAND(63).cast("int"))
        return F.when(F.shiftright(e, 8).bitwiseAND(_MAP - 1) == part, a.bitwiseOR(bit)).otherwise(a)

    return F.aggregate(elements, F.lit(0).cast("bigint"), step)


def _unlinked_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs around a lead that may be linked although their classes differ; no linked pair is missed.

    Sets x, y are linked if they differ in at most c (|x| + |y|) elements, c = (1 - s) / (1 + s). With their differences
    dx, dy from the lead that is |dx| + |dy| - 2 |dx & dy|, so they need that many common differences. One of the two,
    say x, is far from the lead, else both were in its class; so they need more than (|dy| + c (|lead| - |y|)) / 2. If
    o is the first number above that, any |dy| - o + 1 differences of y hold a common one: those that only y has are
    taken first, and what the lead alone has if they do not suffice. Pairs whose sizes or bitmaps rule out enough common
    differences are dropped in the join; a pair that meets on the lead's elements has none of the others in common.
    """
    c = (1 - similarity) / (1 + similarity)
    each = rows.select(
        "a", "root", F.col("b").alias("x"), "n", F.size("more").alias("m"), F.size("less").alias("l"), "far", "more", "less",
        (F.floor((F.size("more") + F.size("less") + c * (F.col("na") - F.col("n")) - 1e-6) / 2) + 1).alias("least"),
    ).withColumn("spare", (F.col("m") + F.col("l") - F.col("least") + 1).cast("int"))
    for i in range(_MAP):  # of every difference one of 256 bits
        each = each.withColumn(f"w{i}", _bits(F.concat("more", "less"), i))
    each = each.withColumn("w", F.expr(" + ".join(f"bit_count(w{i})" for i in range(_MAP))))
    some_more = F.slice("more", 1, F.greatest(F.lit(0), F.least("m", "spare")))
    some_less = F.slice("less", 1, F.greatest(F.lit(0), F.col("spare") - F.col("m")))
    maps = [f"w{i}" for i in range(_MAP)]
    y_names = {"x": "y", "root": "ry", "n": "ny", "m": "my", "l": "ly", "w": "v"} | {w: w.replace("w", "v") for w in maps}
    # common differences share their bits, but for those that share a bit with another one
    shared = " + ".join(f"bit_count({w} & {y_names[w]})" for w in maps) + " + least(m + l - w, my + ly - v)"

    def met(x_elements, y_elements, common: str) -> DataFrame:
        kept = ["a", "x", "root", "n", "m", "l", "w", *maps]
        x = each.filter("far").select(*kept, F.explode(x_elements).alias("element"))
        y = each.select(*kept, F.explode(y_elements).alias("element")).withColumnsRenamed(y_names)
        possible = f"root <> ry AND 2 * least({common}, {shared}) >= m + l + my + ly - {c!r} * (n + ny) - 1e-6"
        return x.join(y, ["a", "element"]).filter(possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    by_more = met("more", some_more, "least(m, my) + least(l, ly)")
    by_less = met("less", some_less, "least(l, ly)")
    return by_more.unionAll(by_less).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
    bands: int = 30, band_rows: int = 5, weights: str = "set",
) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, node, class_id, class_size, kept)``.

    Two texts are linked if their shingles of ``width`` words (runs of anything but ASCII white space, A-Z as a-z) have
    a weighted Jaccard similarity of at least ``similarity``; classes are connected components of the links. Weights are
    1 per distinct shingle ("set") or its number of occurrences ("count"). ``node`` is the 64-bit hash of the text, so
    equal texts are one node; ``class_id`` is the least id of the class and ``kept`` is true for one (id, text) of it.

    Signatures come from DartMinHash; texts that agree in a band meet in its bucket. Each text is compared with the
    leads of its buckets, exactly, on the shingles. Other pairs of a bucket need a look only if the texts around the lead
    are not all of one class; those that can still be linked are found by a join of their differences from the lead
    (``_unlinked_pairs``) and compared, so every linked pair that meets counts and the pairs of a class are not listed.
    Texts around one lead that fall into several large groups, each alike in itself but not to the lead, are the case
    that still lists many pairs. A pair at the similarity limit meets in no bucket with probability
    (1 - similarity ** band_rows) ** bands, 7 in a million by default.

    Null, empty and blank texts have no shingle: each is a class of its own. A text of fewer words than ``width`` has
    one shingle. Rows without an id join classes, but are kept only if no row with an id is there; a class without
    any id has a null class_id. Repeated rows share node and class and are all ``kept`` together. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    base = base.withColumn("_node", F.xxhash64("_text"))
    signed = materialize(
        base.mapInArrow(_signed(width, bands, band_rows, weights), f"_id {kind}, _node bigint, n_words bigint, bands array<bigint>")
    )
    worded = signed.filter("n_words > 0")
    nodes = worded.groupBy("_node").agg(F.min("_id").alias("_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)
    member = nodes.select(F.col("_node").alias("node"), F.explode("bands").alias("bucket"))
    crowded = materialize(_crowded(member))

    wanted = crowded.select("node").distinct().join(nodes.select(F.col("_node").alias("node"), "_id"), "node")
    wanted = wanted.select("_id", F.col("node").alias("_node"))
    texts = base.join(wanted, base["_id"].eqNullSafe(wanted["_id"]) & (base["_node"] == wanted["_node"]), "left_semi")
    sets = texts.mapInArrow(_element_sets(width, weights), "node bigint, elements array<bigint>")
    sets = materialize(sets.dropDuplicates(["node"]))

    tested = crowded.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    edges = materialize(_verified(tested, sets, similarity))
    differences = materialize(_differences(tested, connected(edges), sets, similarity))
    more = _verified(_unlinked_pairs(differences, similarity), sets, similarity)
    classes = connected(edges.unionAll(more))

    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_node"))
    placed = nodes.select("_node", "_id", "copies").join(classes, F.col("_node") == F.col("node"), "left")
    placed = placed.select("_node", "_id", "copies", F.coalesce("root", "_node").alias("root"))
    heads = placed.groupBy("root").agg(F.min(order).alias("head"), F.sum("copies").alias("class_size"))
    heads = heads.select("root", F.col("head._id").alias("class_id"), F.col("head._node").alias("head_node"), "class_size")
    by_node = placed.select("_node", "root").join(heads, "root").drop("root")
    grouped = worded.select("_id", "_node").join(by_node, "_node")
    grouped = grouped.select(
        "_id", "_node", "class_id", "class_size",
        (F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_node") == F.col("head_node"))).alias("kept"),
    )
    alone = signed.filter("n_words = 0").select(
        "_id", "_node", F.col("_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept")
    )
    return grouped.unionAll(alone).withColumnsRenamed({"_id": id_col, "_node": "node"})


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class of ``near_duplicates``, all columns kept, whatever their names.

    Rows that repeat both id and text become one. Texts without words stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter("NOT kept")
    gone = gone.select(F.col(id_col).alias("_id"), F.col("node").alias("_node")).distinct()
    marked = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row"))
    same = marked["key"].eqNullSafe(gone["_id"]) & (marked["hash"] == gone["_node"])
    return marked.join(gone, same, "left_anti").dropDuplicates(["key", "hash"]).select("row.*")
