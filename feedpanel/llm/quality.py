"""Quality rules with cut-offs whose false rejections are bounded on labelled holdouts."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.session import materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"  # fixed value of the contract
WINDOW = 8

#: Rule: (its statistic, higher is worse; the cut-offs tried). A document is rejected above the cut-off.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", (0.05, 0.1, 0.2, 0.3)),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", (0.1, 0.2, 0.3, 0.5)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.05, 0.1, 0.2, 0.25)),
    "word_length": ("word_chars / nullif(n_words, 0)", (9.0, 11.0, 14.0, 20.0)),
}


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(of: Column) -> Column:
    """Number of words that lie in a run of ``WINDOW`` words found twice or more, the first one included.

    Runs are compared by 64-bit hashes. Only an array with equal runs is sorted.
    """
    def starts(runs: Column) -> Column:
        """First places of all runs that occur twice, ascending."""
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                before, after = F.get(p, k - 1)["h"], F.get(p, k + 1)["h"]
                return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(p, same), lambda e: e["i"]))

        return _let(pairs, twice)

    def covered(places: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
        step = lambda a, i: F.struct(
            (a["n"] + WINDOW - F.greatest(F.lit(0), a["upto"] - i)).alias("n"), (i + WINDOW).alias("upto")
        )
        return F.aggregate(places, none, step, lambda a: a["n"])

    def counted(runs: Column) -> Column:
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("bigint")).otherwise(covered(starts(runs)))

    def hashed(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        runs = F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) <= WINDOW, F.lit(0).cast("bigint")).otherwise(_let(runs, counted))

    return _let(F.transform(of, lambda w: F.xxhash64(w)), hashed)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)`` per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    measured = _let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    in_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    return docs.select(
        F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("stratum"), measured.alias("m"), in_lines.alias("l"),
        without(SPACES).cast("bigint").alias("word_chars"), (F.length(text) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
    ).select("_id", "stratum", "m.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "m.n_repeat_words")


def base_failed() -> Column:
    """Fixed rule of the contract: under 20 words, or more than 30 % of the words in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Natural logarithm of P(X <= k) for X ~ Bin(n, p), summed term by term in logarithms."""
    first = n * F.lit(log(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + log(p / (1 - p))
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.when(k < 1, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), start, step, lambda a: a["total"]))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, id_col: str = "doc_id", good_col: str = "quality") -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest cut-off of each rule that is safe in the stratum; none if none is.

    Holdouts are the labelled good rows that pass the base rules. A cut-off is tested by the exact binomial probability
    of as few false rejections as seen if the true rate were ``risk`` / number of rules; it is safe if that probability is
    at most ``error`` / number of tests (Bonferroni over strata, rules and cut-offs). So with probability 1 - ``error`` all
    chosen cut-offs together reject at most the share ``risk`` of the good rows of every stratum.
    """
    good = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(good_col).alias("_good")).filter("_good = 1").select("_id")
    held = measured.filter(~base_failed()).join(good, "_id")
    tests = [(rule, c) for rule, (_, tried) in RULES.items() for c in tried]
    above = [F.sum((F.expr(RULES[rule][0]) > c).cast("bigint")).alias(f"k{i}") for i, (rule, c) in enumerate(tests)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    cells = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, c) in enumerate(tests)]
    cells = materialize(counts.select("stratum", "n", F.explode(F.array(*cells)).alias("c")).select("stratum", "n", "c.*"))
    number, each = max(cells.count(), 1), risk / len(RULES)
    # at or above the expected number of rejections no cut-off can be safe, so long sums are never made
    seen = F.when(F.col("k") < F.col("n") * each, F.col("k")).otherwise(F.lit(0))
    safe = (F.col("k") < F.col("n") * each) & (log_binomial_cdf(seen, F.col("n"), each) <= log(error / number))
    return cells.filter(safe).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality(
    docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` per row of ``docs``.

    ``kept`` is false for rows that fail the base rules, and for those above a cut-off that ``cutoffs`` chose for their
    stratum. Null and blank texts have no words and fail. A null stratum is one of its own. A row without a label, or
    whose label is null, only does not count for the cut-offs; of several labels of an id the best counts. Ids may be
    null (then unlabelled) or repeat; other columns are ignored; an empty table gives an empty result.
    """
    measured = materialize(features(docs, id_col, text_col, stratum_col))
    chosen = cutoffs(measured, labels, risk, error, id_col)
    limits = chosen.groupBy(F.col("stratum").alias("_stratum")).agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES))
    limits = materialize(limits)  # one row per stratum; its size is known before the join
    joined = measured.join(limits, measured["stratum"].eqNullSafe(limits["_stratum"]), "left")
    passed = F.lit(True)
    for rule, (statistic, _) in RULES.items():
        passed = passed & F.coalesce(F.expr(statistic) <= F.col(f"max_{rule}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(passed).alias("kept"),
    )
