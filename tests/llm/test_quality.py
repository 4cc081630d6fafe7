import random
import re
from math import comb, log

import pytest
from pyspark.sql import functions as F

from brute import words_of
from feedpanel.llm import quality
from feedpanel.llm.quality import RULES, cutoffs, features, log_binomial_cdf


def brute(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    runs = {}
    for i in range(len(w) - 7):
        runs.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(lines), len(covered))


def measured_of(frame):
    return sorted((str(r["_id"]), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) for r in frame.collect())


def test_features_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert measured_of(features(docs)) == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())


def test_features_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "\n\na\n\n a\n", "#x$ %&|<>*", "é 😀 a b", "\x0ba\x0cb\rc", "a " * 7, "a " * 8, "a " * 9, "a b " * 20_000, "x" * 100_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["a b", "c", "", " ", "a  b"]) for _ in range(6)) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert measured_of(features(docs)) == sorted((str(i), *brute(t)) for i, t in enumerate(texts))


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.01), (3, 500, 0.02), (12, 9000, 0.005), (1, 2, 0.3)])
def test_binomial(spark, k, n, p):
    got = spark.range(1).select(log_binomial_cdf(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
    assert got == pytest.approx(log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), abs=1e-9)


def holdout(spark, n, bad):
    """n good rows in each of two strata; in "b" every ``bad``-th has many symbols."""
    r = spark.range(2 * n).withColumn("stratum", F.when(F.col("id") < n, "a").otherwise("b"))
    many = (F.col("stratum") == "b") & (F.col("id") % bad == 0)
    return r.select(
        F.col("id").alias("_id"), "stratum", F.lit(100).cast("bigint").alias("n_words"), F.lit(600).cast("bigint").alias("word_chars"),
        F.when(many, 240).otherwise(0).cast("bigint").alias("n_symbols"), F.lit(0).cast("bigint").alias("n_dup_lines"),
        F.lit(5).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_repeat_words"),
    )


def test_cutoffs_bound_false_rejections(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {(r.stratum, r.rule): r.cutoff for r in cutoffs(holdout(spark, 4000, 20), labels).collect()}
    strict = {rule: tried[0] for rule, (_, tried) in RULES.items()}
    assert all(got["a", rule] == c for rule, c in strict.items())
    assert ("b", "symbols") not in got and got["b", "repeats"] == strict["repeats"]  # 5 % would go: no cut-off is safe
    assert cutoffs(holdout(spark, 300, 20), labels).count() == 0  # too few holdouts to prove anything
    assert cutoffs(holdout(spark, 4000, 20), labels.limit(0)).count() == 0


def test_verdicts(spark, monkeypatch):
    monkeypatch.setitem(quality.RULES, "symbols", ("n_symbols / nullif(word_chars, 0)", (0.2,)))
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "en", 1) for i in range(3000)]
    rows += [(5000, good + " " + "#" * 90, "en", 1), (5001, good + " " + "#" * 90, None, 1), (5002, "short", "en", 1), (5003, None, "en", 1), (None, good, "en", 1), (7, good, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(1, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    got = quality.quality(docs, labels)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    lost = {(r.doc_id, r.base_failed) for r in got.filter("NOT kept").collect()}
    assert got.count() == len(rows) and lost == {(5000, False), (5002, True), (5003, True)}
    assert quality.quality(docs.limit(0), labels).count() == 0
