"""Validation sample and classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.functions import scores as S
from feedpanel.operators.ordered import first_rows, running_sums
from feedpanel.schema import EMOTIONS

# Strata in order of priority, rows per stratum and language.
PRIORITY = ["fear", "disgust", "anger"]
N_HIGH, N_LOW = 100, 200


def stratum(cut: float = 0.5, priority: Sequence[str] = PRIORITY) -> Column:
    """First emotion, in order of priority, whose score reaches the cut."""
    out = F.lit("low")
    for e in reversed(priority):
        out = F.when(F.col(f"{e}_v2") >= cut, f"{e}_hi").otherwise(out)
    return out


def exclude_ids(posts: DataFrame, done: DataFrame) -> DataFrame:
    return posts.join(done.select("id"), "id", "left_anti")


def stratum_sizes(pop: DataFrame) -> DataFrame:
    return pop.groupBy("lang", "stratum").agg(F.count(F.lit(1)).alias("N_stratum"))


def stratified_sample(
    pop: DataFrame, n_high: int = N_HIGH, n_low: int = N_LOW, seed: int = 636
) -> DataFrame:
    """Up to n rows per language and stratum in pseudo-random order, with stratum
    sizes and weights N/n."""
    wanted = F.when(F.col("stratum") == "low", n_low).otherwise(n_high)
    keyed = pop.withColumn("_order", S.keyed_order(F.col("id"), seed))
    drawn = first_rows(keyed, ["lang", "stratum"], ["_order", "id"], max(n_high, n_low))
    drawn = drawn.filter(F.col("rn") <= wanted).drop("rn", "_order")
    out = drawn.join(stratum_sizes(pop), ["lang", "stratum"])
    size = F.least(F.col("N_stratum"), wanted.cast("bigint"))
    return out.withColumns({"n_stratum": size, "weight": F.col("N_stratum") / size})


def blind(sample: DataFrame, emotions: Sequence[str] = EMOTIONS, seed: int = 637) -> DataFrame:
    """Sheet for the coders: no scores, no strata, rows in another order."""
    empty = [F.lit(None).cast("bigint").alias(f"{e}_manual") for e in emotions]
    return sample.orderBy(S.keyed_order(F.col("id"), seed)).select("id", "lang", "text_cleaned", *empty)


def drop_uncodable(coded: DataFrame) -> DataFrame:
    if "uncodable" not in coded.columns:
        return coded
    mark = F.trim(F.col("uncodable").cast("string"))
    return coded.filter(~F.coalesce(mark.isin("1", "1.0"), F.lit(False)))


def annotations_with_key(coded: DataFrame, key: DataFrame) -> DataFrame:
    return drop_uncodable(coded).join(key, "id")


def _ordered_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight of positives and negatives per score, with running totals."""
    w = F.col("w").cast("double")
    at = df.groupBy(*keys, "p").agg(
        F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg")
    )
    return running_sums(at, keys, ["p"], {"cpos": F.col("pos"), "cneg": F.col("neg")})


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from columns y (0/1), p and weight w; null unless
    both classes occur. Equal scores count half."""
    c = _ordered_counts(df.dropna(subset=["y", "p"]), keys)
    wins = F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") / 2))
    return c.groupBy(*keys).agg(
        (wins / F.nullif(F.max("cpos_total") * F.max("cneg_total"), F.lit(0.0))).alias("auc")
    )


def roc_points(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every score used as threshold."""
    c = _ordered_counts(df.dropna(subset=["y", "p"]), keys)

    def rate(total: str, upto: str, here: str) -> Column:
        return S.share(F.col(total) - F.col(upto) + F.col(here), F.col(total))

    return c.select(
        *keys, F.col("p").alias("threshold"),
        rate("cneg_total", "cneg", "neg").alias("fpr"), rate("cpos_total", "cpos", "pos").alias("tpr"),
    )


def precision_recall_f1(df: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted precision, recall and F1 of p >= threshold; 0 where undefined."""
    w, hit, true = F.col("w").cast("double"), F.col("p") >= threshold, F.col("y") == 1
    sums = df.dropna(subset=["y", "p"]).groupBy(*keys).agg(
        F.sum(F.when(hit & true, w).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(hit, w).otherwise(0.0)).alias("_hit"),
        F.sum(F.when(true, w).otherwise(0.0)).alias("_true"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(S.share(a, b), F.lit(0.0))

    tp, hits, trues = F.col("_tp"), F.col("_hit"), F.col("_true")
    return sums.select(
        *keys, ratio(tp, hits).alias("precision"), ratio(tp, trues).alias("recall"),
        ratio(2 * tp, hits + trues).alias("f1"),
    )


def evaluate(
    coded: DataFrame, emotions: Sequence[str] = EMOTIONS, thresholds: Sequence[float] = (0.5, 0.65)
) -> DataFrame:
    """AUC, precision, recall and F1 per language and pooled, emotion, weighting
    and threshold. Rows without a label are left out per emotion."""
    pooled = coded.withColumn("lang", F.explode(F.array(F.lit("de+en"), F.col("lang"))))
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(e).alias("emotion"), F.lit(tag).alias("weighting"),
                    F.col(f"{e}_manual").cast("int").alias("y"), F.col(f"{e}_v2").alias("p"),
                    (F.col("weight") if tag == "w" else F.lit(1.0)).cast("double").alias("w"),
                )
                for e in emotions
                for tag in ("w", "unw")
            ]
        )
    )
    long = pooled.select("lang", cells.alias("c")).select("lang", "c.*").filter("y IS NOT NULL")
    keys = ["lang", "emotion", "weighting"]
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    out = counts.join(roc_auc(long, keys), keys)
    by_threshold = None
    for t in thresholds:
        one = precision_recall_f1(long, t, keys).withColumn("threshold", F.lit(t))
        by_threshold = one if by_threshold is None else by_threshold.unionByName(one)
    return out.join(by_threshold, keys)


def agreement(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa, nominal Krippendorff's alpha and raw agreement of two
    coders with 0/1 labels, over the rows both coded."""
    both = pairs.dropna(subset=[a, b])
    one_a, one_b = (F.col(a) == 1).cast("int"), (F.col(b) == 1).cast("int")
    c = both.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum((F.col(a) == F.col(b)).cast("int")).cast("double").alias("same"),
        F.sum(one_a).cast("double").alias("a1"),
        F.sum(one_b).cast("double").alias("b1"),
    )
    n, same, a1, b1 = (F.col(x) for x in ("n", "same", "a1", "b1"))
    chance = (a1 * b1 + (n - a1) * (n - b1)) / (n * n)
    ones = a1 + b1
    zeros = 2 * n - ones
    expected = 2 * ones * zeros / (2 * n * (2 * n - 1))
    return c.select(
        *keys, n.cast("bigint").alias("n"), (same / n).alias("agreement"),
        S.share(same / n - chance, 1 - chance).alias("kappa"),
        (1 - S.share(1 - same / n, expected)).alias("alpha"),
    )
