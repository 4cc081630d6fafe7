import random

import numpy as np
import pytest

from brute import classes_of
from feedpanel.llm import near_dedup
from feedpanel.llm.classes import connected


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id bigint, text string{extra}")


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    wa, wb = rng.integers(1, 9, 400) * 1.0, rng.integers(1, 9, 400) * 1.0
    sig = near_dedup.signatures(np.concatenate([element, element]), np.repeat([0, 1], 400), np.concatenate([wa, wb]), 2, 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_signature_is_the_same_alone_and_in_a_block():
    e = np.arange(1, 60, dtype=np.uint64)
    alone = near_dedup.signatures(e[:7], np.zeros(7, int), np.ones(7), 1, 150)
    block = near_dedup.signatures(e, np.repeat([0, 1], [7, 52]), np.ones(59), 2, 150)
    assert (alone[0] == block[0]).all()


def test_corpus_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = classes_of({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_chains_and_buckets_of_unlike_texts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    shared, texts = [rng.choice(vocabulary) for _ in range(120)], {}

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1])
        return words

    for i in range(60):  # texts that share most of a passage
        texts[i] = " ".join(shared + [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))])
    walk = list(shared)
    for i in range(60, 110):  # a slow chain
        walk = edited(walk, 1)
        texts[i] = " ".join(walk)
    for i in range(110, 260):  # copies around the limit, in two groups
        texts[i] = " ".join(edited(walk if i % 2 else shared, rng.randint(1, 8)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, list(texts.items()))).collect()}
    assert got == classes_of(texts)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None, 9), (2, "", 9), (3, "  \n", 9), (4, "a b", 9), (5, "A  b", 8), (6, "a b", 7), (6, "a b", 7),
            (None, "a b", 1), (None, "lonely words here", 1), (7, long, 1), (8, long + " y", 1), (None, None, 1)]
    docs = frame(spark, rows, ", node int")
    got = sorted(near_dedup.near_duplicates(docs).drop("node").collect(), key=str)
    of = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in got}
    assert len(got) == len(rows)
    assert {(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 5, True), (5, 4, 5, False), (6, 4, 5, False),
            (None, 4, 5, False), (None, None, 1, True), (7, 7, 2, True), (8, 7, 2, False)} == of
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 7]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights,linked", [("set", True), ("count", False)])
def test_weights(spark, weights, linked):
    line = " ".join("abcdefgh")
    rows = [(1, line), (2, " ".join([line] * 6))]
    sizes = {r.class_size for r in near_dedup.near_duplicates(frame(spark, rows), weights=weights, similarity=0.3).collect()}
    assert sizes == ({2} if linked else {1})


def test_connected(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_any_columns_and_text_ids(spark):
    """Columns named like the operator's own stay as they are; ids may be texts."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text, *range(7)), ("a", text + " end", *range(7, 14)), ("z", "other words", *range(14, 21)), (None, text, *range(7))]
    table = spark.createDataFrame(rows, ["doc_id", "text", "_node", "_id", "node", "key", "row", "hash", "a.b"])
    assert sorted(tuple(r) for r in near_dedup.drop_near_duplicates(table).collect()) == [rows[1], rows[2]]
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(table).collect()} == {("a", "a"), ("b", "a"), (None, "a"), ("z", "z")}
