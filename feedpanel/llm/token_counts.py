"""Token counts of documents from the piece counts of distinct pre-tokens."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.llm.words import LOWER, SPACE, Words, blocks
from feedpanel.session import materialize

#: Most frequent pre-tokens whose piece counts every task holds: 12 bytes each.
HEAD = 1 << 19
_HELD = 1 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True


def load(path: str):
    """The tokenizer of a ``tokenizers`` file, without truncation or padding."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Runs of non-spaces of a block, and each row's number of marks cut off their ends.

    The tokenizer lower-cases, drops white space and starts a new piece between a letter or digit and a following mark.
    So one final comma or full stop behind an ASCII letter or digit counts by itself, and A-Z fold, which changes no
    count, in runs of ASCII only: elsewhere a letter may compose with marks behind it before it is lower-cased. A block
    with a special token's opening keeps its case, since those are looked for before lower-casing.
    """
    words = Words(data, offsets, SPACE)
    words.data = data = data.copy() if b"<|" in data.tobytes() else _folded(data, words)
    last, before = data[words.end - 1], data[np.maximum(words.end - 2, 0)]
    cut = np.flatnonzero(_MARK[last] & _ALNUM[before] & (words.end - words.start > 1))
    words.end[cut] -= 1
    data[words.end[cut]] = 32
    return words, np.bincount(np.searchsorted(words.first, cut, "right") - 1, minlength=len(offsets) - 1)


def _folded(data: np.ndarray, words: Words) -> np.ndarray:
    """The block with A-Z folded in words of ASCII only."""
    wide, low = np.flatnonzero(data > 127), LOWER[data]
    if not len(wide):
        return low
    odd = np.flatnonzero(np.searchsorted(wide, words.end) > np.searchsorted(wide, words.start))
    start, length = words.start[odd], (words.end - words.start)[odd]
    at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    low[at] = data[at]
    return low


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    start, length = words.start[which], (words.end - words.start)[which]
    offsets = np.concatenate([[0], np.cumsum(length)])
    data = words.data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task with their numbers; given out whenever about a million are held."""
    held, size = [], 0

    def merged():
        table = pa.Table.from_batches(held).group_by(["hash", "word"]).aggregate([("n", "sum")])
        return table.rename_columns(["hash", "word", "n"])

    for batch in batches:
        for _, _, data, offsets in blocks(batch.column("_text")):
            words, _ = pre_tokens(data, offsets)
            if not len(words.start):
                continue
            hashes, where, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append(pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), _strings(words, where), pa.array(n)], ["hash", "word", "n"]))
            size += len(hashes)
            if size > 2 * _HELD:
                table = merged()
                size = len(table)
                held = table.combine_chunks().to_batches()
                if size > _HELD:
                    yield from held
                    held, size = [], 0
    if held:
        yield from merged().combine_chunks().to_batches(max_chunksize=50_000)


def _pieces(path: Callable[[], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path())
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n"), pa.array([len(x) for x in found], pa.int32())], ["hash", "n", "pieces"])

    return run


def _counted(head, mark_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = head.value
        context = TaskContext.get()
        number = context.partitionId() << 33
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text")):
                words, marks = pre_tokens(data, offsets)
                rows = hi - lo
                hashes, which = np.unique(words.hashes(), return_inverse=True)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                there = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                each = np.where(there, pieces[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
                sums = np.bincount(words.row, each[which], rows).astype(np.int64) + marks * mark_pieces
                tail = np.flatnonzero(~there[which])
                key = words.row[tail] * len(hashes) + which[tail]
                key, n = np.unique(key, return_counts=True)
                row, which = (key // len(hashes), key % len(hashes)) if len(hashes) else (key, key)
                lists = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + rows)), batch.column("_id").slice(lo, rows), pa.array(np.diff(offsets)), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes[which].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(n.astype(np.int32)))],
                    ["row", "_id", "n_bytes", "known", "hash", "n"],
                )
                number += rows

    return run


def token_counts(
    docs: DataFrame, path: Callable[[], str], limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD,
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` per row of ``docs``, as the tokenizer file counts each whole text.

    ``path()`` names the file on whatever machine asks. The file must tokenize the parts between white space apart from
    one another and lower-case them, as word_bpe_49k.json does. The distinct pre-tokens of all documents are cut into
    pieces once. Piece counts of the most frequent ones (at most ``head``) go to every task; the other pre-tokens of a
    document travel as (hash, frequency) and are joined to their piece counts; the sums of both parts are the result.
    No ids are kept. Pre-tokens are joined by 64-bit hashes.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat: each row is counted by itself. Other
    columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    distinct = base.select("_text").mapInArrow(_distinct, "hash bigint, word string, n bigint")
    vocabulary = distinct.groupBy("hash", "word").agg(F.sum("n").alias("n"))
    vocabulary = materialize(vocabulary.mapInArrow(_pieces(path), "hash bigint, n bigint, pieces int"))

    # the least frequency at which no more than `head` pre-tokens are left, from a histogram in steps of 2 ** (1 / 16)
    step = F.floor(F.log2("n") * 16)
    least, so_far = None, 0
    for r in vocabulary.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        so_far += r["count"]
        if so_far > head:
            break
        least = r.step
    first = vocabulary.filter(step >= F.lit(least)) if least is not None else vocabulary.limit(0)
    first = first.select("hash", "pieces").toArrow()
    known = first.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], first.column("pieces").to_numpy()[order]))

    tokenizer = load(path())
    mark_pieces = len(tokenizer.encode(",", add_special_tokens=False))
    if mark_pieces != len(tokenizer.encode(".", add_special_tokens=False)):
        raise ValueError("a comma and a full stop must have equally many pieces")
    counted = materialize(
        base.mapInArrow(_counted(shared, mark_pieces), f"row bigint, _id {id_type}, n_bytes bigint, known bigint, hash array<bigint>, n array<int>")
    )
    tail = counted.select("row", F.explode(F.arrays_zip("hash", "n")).alias("part")).select("row", "part.hash", "part.n")
    rare = vocabulary.select("hash", "pieces")
    sums = tail.join(rare, "hash").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0))
    return counted.drop("hash", "n").join(sums, "row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )
