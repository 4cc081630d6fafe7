"""Benchmark passages in documents, found by suffix arrays over shards of the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.llm.words import LOWER, Words, blocks, mix
from feedpanel.session import materialize

#: Bytes of text in one shard, words of the benchmark that one pass sends to all tasks (more only if one item has more),
#: pairs of places that are compared at once.
SHARD_BYTES = 8 << 20
PASS_WORDS = 1 << 19
_PAIRS = 1 << 20
_GRAM = 4

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, behind one another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


class Passages:
    """Test suffixes of a part of the benchmark, packed for comparison with training suffixes.

    A test suffix begins at every word at which a window does. Suffixes that begin with the same window are one entry of
    the tables that are searched (``low``, ``high``, ``size``); ``window_of`` says which one each suffix has.
    """

    def __init__(self, pieces: list[np.ndarray], items: list[list[str]], window: int):
        length = np.array([len(p) for p in pieces], np.int64)
        self.items, self.window = items, window
        self.words = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(self.words)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.packed = 63 // self.bits
        self.depth = -(-window // self.packed) * self.packed
        end = np.cumsum(length)
        size = np.minimum(length, window)
        count = length - size + 1
        start = _ranges(end - length, count)  # first word of each test suffix
        piece, size = np.repeat(np.arange(len(pieces)), count), np.repeat(size, count)
        at = start[:, None] + np.arange(self.depth)
        beyond = np.arange(self.depth) >= size[:, None]
        ids = self._numbers(self.words)[np.minimum(at, max(len(self.words) - 1, 0))] if len(pieces) else at
        low = self._pack(np.where(beyond, 0, ids))
        high = self._pack(np.where(beyond, (1 << self.bits) - 1, ids))
        table = np.stack([*low, *high, size], 1)
        distinct, self.window_of = np.unique(table, axis=0, return_inverse=True)
        self.low, self.high, self.size = list(distinct.T[: len(low)]), list(distinct.T[len(low) : -1]), distinct[:, -1]
        # the items of each window
        self.held = np.unique(np.stack([self.window_of, piece], 1), axis=0)
        self.held_from = np.searchsorted(self.held[:, 0], np.arange(len(distinct) + 1))
        # suffixes by window, then by the word before them, 0 at the beginning of an item
        ahead = np.where(start > (end - length)[piece], self._numbers(self.words)[np.maximum(start - 1, 0)], 0) if len(pieces) else start
        self.span = len(self.vocabulary) + 1
        key = self.window_of * self.span + ahead
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.end = key[order], start[order], end[piece][order]
        self.grams = {}
        for k in np.unique(np.minimum(size, _GRAM)):
            begins = start[np.minimum(size, _GRAM) == k]
            self.grams[int(k)] = np.unique(_grams(self.words, begins, int(k)))

    def _numbers(self, words: np.ndarray) -> np.ndarray:
        """1, 2, ... for words of the benchmark and 0 for all others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def _pack(self, ids: np.ndarray) -> list[np.ndarray]:
        columns = []
        for i in range(0, self.depth, self.packed):
            key = np.zeros(len(ids), np.int64)
            for j in range(i, i + self.packed):
                key = (key << self.bits) | ids[:, j]
            columns.append(key)
        return columns

    def suffix_array(self, words: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sorted training suffixes of a shard and their first words, packed.

        Only suffixes whose first words (up to four) begin a window are sorted; no other can hold one.
        """
        keep = np.zeros(len(words), bool)
        for k, grams in self.grams.items():
            begins = np.flatnonzero(np.arange(len(words)) + k <= row_end)
            found = _grams(words, begins, k)
            at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
            keep[begins[grams[at] == found]] = True
        suffix = np.flatnonzero(keep)
        at = suffix[:, None] + np.arange(self.depth)
        inside = at < row_end[suffix][:, None]
        ids = np.where(inside, self._numbers(words[np.minimum(at, len(words) - 1)]), 0) if len(suffix) else at
        keys = self._pack(ids)
        order = np.lexsort(keys[::-1])
        return suffix[order], [k[order] for k in keys]

    def matches(self, words: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the shard, window) of every occurrence of every distinct window."""
        suffix, keys = self.suffix_array(words, row_end)
        lo, hi = _bound(keys, self.low, len(suffix), False), _bound(keys, self.high, len(suffix), True)
        count = hi - lo
        return suffix[_ranges(lo, count)], np.repeat(np.arange(len(self.size)), count)

    def longest(self, words, row, row_start, row_end, at, which, rows: int) -> np.ndarray:
        """Words of each row's longest verbatim match.

        Occurrences of a window are joined with the test suffixes that begin with it but follow another word than the
        occurrence does: where the words before are equal too, the match begins further left and is followed from there.
        """
        out = np.zeros(rows, np.int64)
        np.maximum.at(out, row[at], self.size[which])
        whole = self.size[which] == self.window
        at, which = at[whole], which[whole]
        if not len(at):
            return out
        inside = at > row_start[at]
        ahead = np.where(inside, self._numbers(words[np.maximum(at - 1, 0)]), 0)
        ahead = np.where(inside & (ahead > 0), ahead, -1)  # no word of the benchmark: no suffix follows it
        key = which * self.span
        first, last = np.searchsorted(self.key, key), np.searchsorted(self.key, key + self.span)
        same = np.where(ahead > 0, np.searchsorted(self.key, key + ahead), last)
        after = np.where(ahead > 0, np.searchsorted(self.key, key + ahead, "right"), last)
        begin, count = np.concatenate([first, after]), np.concatenate([same - first, last - after])
        place = np.concatenate([at, at])
        upto = np.cumsum(count)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, "right")))
            p, q = np.repeat(place[lo:hi], count[lo:hi]), _ranges(begin[lo:hi], count[lo:hi])
            length = np.full(len(p), self.window, np.int64)
            going = np.arange(len(p))
            while len(going):
                x, y = p[going] + length[going], self.start[q[going]] + length[going]
                there = (x < row_end[p[going]]) & (y < self.end[q[going]])
                going, x, y = going[there], x[there], y[there]
                going = going[words[x] == self.words[y]]
                length[going] += 1
            np.maximum.at(out, row[p], length)
            lo = hi
        return out


def _grams(words: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    total = words[begins]
    for j in range(1, k):
        total = mix(total + np.uint64(j)) + words[begins + j]
    return total


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], n: int, right: bool) -> np.ndarray:
    """Binary search of every wanted key tuple at once: first place not below it, or first place above it."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        below, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, want in zip(keys, wanted, strict=True):
            here = key[mid]
            below |= equal & (here < want)
            equal &= here == want
        move = open_ & (below | equal if right else below)
        lo, hi = np.where(move, mid + 1, lo), np.where(open_ & ~move, mid, hi)
    return lo


class Shard:
    """What one shard of texts has in common with ``passages``."""

    def __init__(self, passages: Passages, data: np.ndarray, offsets: np.ndarray):
        words = Words(LOWER[data], offsets, SEPARATOR)
        self.passages, self.first, self.n_words = passages, words.first, np.diff(words.first)
        self.rows = len(self.n_words)
        self.hit, self.longest = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        self.row, self.span_start, self.span_end = (np.zeros(0, np.int64) for _ in range(3))
        self.windows = np.zeros((0, 2), np.int64)
        if not len(words.start) or not len(passages.start):
            return
        hashes = words.hashes()
        row = words.row
        row_start, row_end = words.first[:-1][row], words.first[1:][row]
        at, which = passages.matches(hashes, row_end)
        if not len(at):
            return
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + passages.size[which], -1)
        covered = np.cumsum(cover[:-1]) > 0
        self.hit = np.bincount(row, covered, self.rows).astype(np.int64)
        # runs of matched words inside a row
        edge = np.arange(len(row)) == row_start
        begin = covered & (edge | ~np.append(False, covered[:-1]))
        stop = covered & (np.append(edge[1:], True) | ~np.append(covered[1:], False))
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
        self.row, self.span_start, self.span_end = row[begin], begin - row_start[begin], stop + 1 - row_start[begin]
        self.windows = np.unique(np.stack([row[at], which], 1), axis=0)
        self.places = hashes, row, row_start, row_end, at, which

    def found(self):
        """Of each row: item ids, [start, end) of the matched words, and the length of the longest match."""
        items: list[set[str]] = [set() for _ in range(self.rows)]
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.rows)]
        if not len(self.windows):
            return items, spans, self.longest
        p = self.passages
        row, window = self.windows.T
        count = p.held_from[window + 1] - p.held_from[window]
        held = np.stack([np.repeat(row, count), p.held[_ranges(p.held_from[window], count), 1]], 1)
        for r, piece in np.unique(held, axis=0).tolist():
            items[r].update(p.items[piece])
        for r, a, b in zip(self.row.tolist(), self.span_start.tolist(), self.span_end.tolist(), strict=True):
            spans[r].append((a, b))
        return items, spans, p.longest(*self.places, self.rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words, as word hashes."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column("text")):
            words = Words(LOWER[data], offsets, SEPARATOR)
            lists = pa.LargeListArray.from_arrays(pa.array(words.first), pa.array(words.hashes().view(np.int64))).cast(pa.list_(pa.int64()))
            found = pa.RecordBatch.from_arrays([batch.column("item").slice(lo, hi - lo), lists], ["item", "words"])
            yield found.filter(pa.array(np.diff(words.first) > 0))


def passages_of(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", pass_words: int = PASS_WORDS) -> list:
    """Broadcast ``Passages``, each of about ``pass_words`` words at most.

    The benchmark is measured first, and equal items become one. A part is a pass over the documents, so a larger
    benchmark costs more passes, not more memory; only a single item of more words makes a larger part.
    """
    spark = items.sparkSession
    base = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    pieces = base.mapInArrow(_hashed, "item string, words array<bigint>")
    pieces = pieces.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    pieces = materialize(pieces.withColumn("key", F.xxhash64("words")))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-2 * total // pass_words) if total > pass_words else 1
    made = []
    for part in range(parts):
        rows = pieces.filter(F.pmod("key", F.lit(parts)) == part).orderBy("key", "words").select("words", "items").toArrow()
        words = [np.asarray(w, np.int64).view(np.uint64) for w in rows.column("words").to_pylist()]
        made.append(spark.sparkContext.broadcast(Passages(words, rows.column("items").to_pylist(), window)))
    return made


_FOUND = (
    "_id {}, _hash bigint, n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<start:bigint,end:bigint>>, longest bigint"
)


def _search(passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text"), SHARD_BYTES):
                shard = Shard(passages.value, data, offsets)
                items, spans, longest = shard.found()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, hi - lo), batch.column("_hash").slice(lo, hi - lo), pa.array(shard.n_words),
                     pa.array(shard.hit), pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                     pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(longest)],
                    ["_id", "_hash", "n_words", "n_hit", "items", "spans", "longest"],
                )

    return run


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", pass_words: int = PASS_WORDS,
) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, longest)`` per row of ``docs``.

    Words are runs of digits, a-z (A-Z folded) and anything beyond ASCII. A window is ``window`` words of an item in a
    row, or all of an item with fewer. Each task sorts the suffixes of a shard of documents into an array, and every
    test suffix is looked up in it by binary search, equal windows once; matches are then followed to their full length. ``n_hit`` counts
    the words inside an occurrence of a window, ``items`` lists the ids of the items found (as strings), ``spans`` the
    matched words as [start, end), ``longest`` the words of the longest verbatim match. Words are compared by 64-bit hashes.

    Null and empty texts, of documents or items, have no words. Items that repeat a text share its windows; an item
    without an id contaminates but is not listed. Document ids may be null or repeat; each row is judged by itself.
    Other columns are ignored. Without documents the result is empty, without items nothing is contaminated.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    kind = base.schema["_id"].dataType.simpleString()
    found = [base.mapInArrow(_search(p), _FOUND.format(kind)) for p in passages_of(items, window, pass_words=pass_words)]
    if len(found) == 1:
        merged = found[0]
    else:
        merged = _merged(base, found)
    return merged.select(
        F.col("_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans", "longest",
    )


def _merged(base: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Findings of several passes by (id, text): the union of their items and spans, its words counted once."""
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    keys = ["_id", "_hash", "n_words"]
    one = every.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.max("longest").alias("longest"),
    )
    # of each span, the words not covered by the spans that begin before it
    one = one.withColumn("n_hit", F.expr(
        "aggregate(spans, named_struct('n', 0L, 'upto', 0L), (a, s) -> named_struct("
        "'n', a.n + greatest(0L, s.end - greatest(s.start, a.upto)), 'upto', greatest(a.upto, s.end)), a -> a.n)"
    ))
    one = one.withColumnsRenamed({"_id": "_key", "_hash": "_other"})
    same = base["_id"].eqNullSafe(one["_key"]) & base["_hash"].eqNullSafe(one["_other"])
    return base.select("_id", "_hash").join(one, same)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that share a window with an item; columns and all other rows stay as they are."""

    def run(passages, place: int) -> Callable:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [Shard(passages.value, data, offsets).hit for _, _, data, offsets in blocks(batch.column(place), SHARD_BYTES)]
                if hit:
                    yield batch.filter(pa.array(np.concatenate(hit) == 0))

        return kept

    for number, passages in enumerate(passages_of(items, window)):
        # a part at a time: what the last one left is stored before the next one is sent
        docs = (materialize(docs) if number else docs).mapInArrow(run(passages, docs.columns.index(text_col)), docs.schema)
    return docs
