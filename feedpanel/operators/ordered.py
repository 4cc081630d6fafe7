"""Ordered computations that stay parallel when one key holds most rows.

A plain window puts every row of a key into one task. Here the rows are first
range-split on (keys, order), so a hot key spreads over many splits, and stored so
that a split is read again by one task: this is the only shuffle of the rows. A
window then runs inside one split. As splits follow the order, only the first and
the last key of a split reach into others; what they inherit is computed from a
table with at most two rows per split, which every task gets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.session import materialize, placed

_PART, _SLOT = "_part", "_slot"


def split_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-splits on (keys, order); the split number becomes a stored column."""
    ranged = df.repartitionByRange(*keys, *order)
    return placed(ranged.withColumn(_PART, F.spark_partition_id()), _PART, _SLOT)


def _inside_split(keys: Sequence[str]):
    return Window.partitionBy(_SLOT, _PART, *keys)


def _edges(parts: DataFrame, keys: Sequence[str], *sums: Column) -> DataFrame:
    """Aggregates of the first and the last key of every split."""
    per_key = parts.groupBy(_SLOT, _PART, *keys).agg(*sums)
    if not keys:
        return per_key.drop(_SLOT)
    split = Window.partitionBy(_SLOT, _PART)
    place = {
        "_first": F.row_number().over(split.orderBy(*keys)),
        "_last": F.row_number().over(split.orderBy(*[F.desc(k) for k in keys])),
    }
    return per_key.withColumns(place).filter("_first = 1 OR _last = 1").drop(_SLOT, "_first", "_last")


def _inherit(parts: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their key inherits in their split. At most two rows per split
    are sent to all tasks, whatever the size of the table."""
    named = edges.withColumnsRenamed({k: f"_e_{k}" for k in [_PART, *keys]})
    match = F.col(_PART) == F.col(f"_e_{_PART}")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return parts.join(F.broadcast(named), match, "left").drop(*[f"_e_{k}" for k in [_PART, *keys]])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Adds for each name the sum up to the row (``name``) and over the key
    (``name_total``). Rows that tie on ``order`` are summed one after another.
    """
    values = {f"_v_{name}": F.coalesce(expr, F.lit(0)) for name, expr in sums.items()}
    parts = split_by_order(df.withColumns(values), keys, order)
    edges = _edges(parts, keys, *[F.sum(v).alias(v) for v in values])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        _PART,
        *keys,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in values],
        *[F.sum(v).over(by_key).alias(f"_t{v}") for v in values],
    )
    split = _inside_split(keys)
    upto = split.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumns({f"_u{v}": F.sum(v).over(upto) for v in values} | {f"_a{v}": F.sum(v).over(split) for v in values})
    out = _inherit(out, carry, keys).withColumns(
        {name: F.col(f"_u_v_{name}") + F.coalesce(F.col(f"_b_v_{name}"), F.lit(0)) for name in sums}
        | {f"{name}_total": F.coalesce(F.col(f"_t_v_{name}"), F.col(f"_a_v_{name}")) for name in sums}
    )
    return out.drop(_PART, _SLOT, *values, *[f"{kind}{v}" for v in values for kind in ("_u", "_a", "_b", "_t")])


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Adds ``prev_<col>``: the value in the row before, inside the same keys."""
    parts = split_by_order(df, keys, order)
    edges = _edges(parts, keys, F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail"))
    carry = edges.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(_PART)))
    back = _inside_split(keys).orderBy(*order)
    out = parts.withColumns({"_nth": F.row_number().over(back)} | {f"_l_{c}": F.lag(c).over(back) for c in cols})
    first = F.col("_nth") == 1
    out = _inherit(out, carry, keys).withColumns(
        {f"prev_{c}": F.when(first, F.col("_tail")[c]).otherwise(F.col(f"_l_{c}")) for c in cols}
    )
    return out.drop(_PART, _SLOT, "_nth", "_tail", *[f"_l_{c}" for c in cols])


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based position over the whole table, plus ``<name>_total`` = row count."""
    return running_sums(df, [], order, {name: F.lit(1).cast("bigint")})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows per key with their place ``rn``; order by ascending,
    unique columns. Rows are numbered split by split, whatever n, so a task holds
    no more of a key than its split."""
    out = running_sums(df, keys, order, {"rn": F.lit(1).cast("bigint")}).drop("rn_total")
    return out.filter(F.col("rn") <= n)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n`` copies, ``upto`` rows at or below it,
    ``size`` rows of the key and the average rank of the copies."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = running_sums(counts, keys, [value], {"upto": F.col("n")})
    return out.withColumnRenamed("upto_total", "size").withColumn(
        "avg_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per key, without holding a key in one task."""
    ranks = value_ranks(df, keys, value)
    picks = []
    for name, p in probs.items():
        at = (F.col("size") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("upto") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("upto") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
        ]
    out = ranks.groupBy(*keys).agg(F.max("size").alias("size"), *picks)
    for name, p in probs.items():
        at = (F.col("size") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (at - F.floor(at)) * (hi - lo))
    return out.select(*keys, *probs)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str
) -> DataFrame:
    """Adds ``name``: the latest non-null ``col`` at or before the row (as-of)."""
    parts = split_by_order(df, keys, order)
    known_at = F.when(F.col(col).isNotNull(), F.struct(*order))
    edges = _edges(parts, keys, F.max_by(col, known_at).alias("_val"))
    before = (
        Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = edges.select(_PART, *keys, F.last("_val", ignorenulls=True).over(before).alias("_val"))
    upto = _inside_split(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumn("_known", F.last(col, ignorenulls=True).over(upto))
    return _inherit(out, carry, keys).withColumn(name, F.coalesce("_known", "_val")).drop(_PART, _SLOT, "_known", "_val")


# Resolution of the sketch.
_SKETCH = 10_000


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float], stored: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of whole columns, one row per column
    (``variable``), without shuffling the columns. A column without values has a
    row of nulls.

    The columns are written once, unless ``df`` is ``stored`` already. A sketch brackets the wanted ranks, one pass
    counts the rows below each bracket, and only the values inside a bracket are
    ranked. A bracket that misses its ranks falls back to ranking the whole column.
    """
    spark = df.sparkSession
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    df = df if stored else materialize(df)
    slack = 3.0 / _SKETCH
    ends = [min(max(p + d, 0.0), 1.0) for p in probs.values() for d in (-slack, slack)]
    sketch = df.agg(
        *[F.percentile_approx(c, ends, _SKETCH).alias(f"q{i}") for i, c in enumerate(cols)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    brackets = []
    for i, c in enumerate(cols):
        for j, (name, p) in enumerate(probs.items()):
            if not sketch[f"n{i}"]:
                continue
            low, high = sketch[f"q{i}"][2 * j : 2 * j + 2]
            # the sketch need not return the very ends
            low = sketch[f"lo{i}"] if ends[2 * j] == 0.0 else low
            high = sketch[f"hi{i}"] if ends[2 * j + 1] == 1.0 else high
            brackets.append((c, name, (sketch[f"n{i}"] - 1) * p, float(low), float(high)))
    empty = [c for i, c in enumerate(cols) if not sketch[f"n{i}"]]
    schema = "variable string, " + ", ".join(f"`{n}` double" for n in probs)
    nulls = spark.createDataFrame([(c, *[None] * len(probs)) for c in empty], schema)
    if not brackets:
        return nulls
    counts = df.agg(
        *[F.count_if(F.col(c) < low).alias(f"b{k}") for k, (c, _, _, low, _) in enumerate(brackets)],
        *[F.count_if(F.col(c).between(low, high)).alias(f"w{k}") for k, (c, _, _, low, high) in enumerate(brackets)],
    ).first()
    cells, wanted = [], []
    for k, (c, name, at, low, high) in enumerate(brackets):
        below, inside = counts[f"b{k}"], counts[f"w{k}"]
        if not below <= int(at) <= math.ceil(at) < below + inside:
            low, high, below = sketch[f"lo{cols.index(c)}"], sketch[f"hi{cols.index(c)}"], 0
        held = F.when(F.col(c).between(low, high), F.col(c).cast("double"))
        cells.append(F.struct(F.lit(k).alias("k"), held.alias("x")))
        wanted.append((k, c, name, at - below))
    long = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("x IS NOT NULL")
    ranks = value_ranks(long, ["k"], "x").join(
        spark.createDataFrame(wanted, "k int, variable string, name string, at double"), "k"
    )
    at = F.col("at")
    lo = F.min(F.when(F.col("upto") > F.floor(at), F.col("x")))
    hi = F.min(F.when(F.col("upto") > F.ceil(at), F.col("x")))
    found = ranks.groupBy("variable", "name", "at").agg(lo.alias("lo"), hi.alias("hi"))
    value = F.col("lo") + (at - F.floor(at)) * (F.col("hi") - F.col("lo"))
    wide = found.groupBy("variable").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in probs])
    return wide.unionByName(nulls) if empty else wide
