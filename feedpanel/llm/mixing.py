"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.llm.quality import SPACES
from feedpanel.session import materialize

WEIGHTS = (5, 2, 1)  # fixed values of the contract: by source in code point order, repeating
MOST = 3  # times a source, and so a document, may be taken


def n_words(text):
    """Runs of anything but ASCII white space; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of every source of ``sizes(source, size, n)``.

    All sizes are shared by weight, but a source gets at most ``MOST`` times its size, and what is over goes to the
    others by weight again: the sources reach their limits in the order of limit / weight, so those before the first that
    stays below it are full. One row per source is held in one task.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), number % len(WEIGHTS))
    s = s.withColumn("number", number).withColumn("weight", weight.cast("bigint")).withColumn("full", MOST * F.col("source_size"))
    order = Window.partitionBy().orderBy(F.col("full") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", rest.cast("double") / weights)
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "number", "level"))).over(Window.partitionBy())
    s = s.withColumn("level", open_["level"])
    share = F.least(F.col("level") * F.col("weight"), F.col("full").cast("double"))
    return s.select("source", "source_size", F.coalesce(share, F.col("full").cast("double")).alias("target"))


def _digits(rows: int) -> int:
    """Hexadecimal digits that part ``rows`` rows into groups of about a thousand, or their square root if that is more."""
    groups, digits = rows / max(1000.0, sqrt(rows)), 0
    while 16**digits < groups:
        digits += 1
    return digits


def queue(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, source, size, nth, source_size, target, taken)`` of ``sizes(doc_id, source, size, n)``: n rows each, by ``nth``.

    Every source queues up to ``MOST`` passes over its documents, each in a new random order. A copy finishes at the
    virtual time at which its source's words so far, divided by the source's target, have gone through. All copies are
    ordered by finish time and taken until the total of all sizes is reached.
    """
    goal = materialize(targets(sizes))
    digits = _digits(sizes.count())
    passes = sizes.filter("size > 0").withColumn("pass", F.explode(F.array(*(F.lit(i) for i in range(MOST)))))
    # passes that can only finish long after the cut, which lies near time 1, are not queued
    queued = passes.join(goal, passes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    queued = queued.filter("pass * source_size < 1.5 * target + 1")
    queued = queued.withColumn("key", F.md5(F.concat_ws("/", F.lit(seed), "pass", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size").cast("binary")))
    queued = materialize(queued.withColumn("part", F.substring("key", 1, digits)).withColumn("words", F.col("size") * F.col("n")))

    lane, part = ["source", "pass"], ["source", "pass", "part"]
    earlier = Window.partitionBy(*lane).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.groupBy(*part).agg(F.sum("words").alias("all")).withColumn("start", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    starts = starts.select(F.col("source").alias("_source"), F.col("pass").alias("_pass"), F.col("part").alias("_part"), "start")
    inside = Window.partitionBy(*part).orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = queued.withColumn("upto", F.sum("words").over(inside) - F.col("words"))
    same = summed["source"].eqNullSafe(starts["_source"]) & (summed["pass"] == starts["_pass"]) & (summed["part"] == starts["_part"])
    placed = summed.join(starts, same).withColumn("before", F.col("pass") * F.col("source_size") + F.col("start") + F.col("upto"))
    rows = placed.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    finish = (F.col("before") + F.col("nth") * F.col("size")).cast("double") / F.col("target")
    rows = materialize(rows.select("doc_id", "source", "size", "nth", "pass", "key", finish.alias("finish")))

    # the cut: whole slots of time that fit into the budget, then the first copies of the next slot
    budget = goal.agg(F.sum("source_size")).first()[0] or 0
    slots = 16**digits
    slot = F.floor(F.col("finish") * slots)
    totals = rows.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    running = totals.withColumn("upto", F.sum("words").over(Window.partitionBy().orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = running.filter(F.col("upto") > budget).orderBy("slot").first()
    if cut is None:
        accepted = rows
    else:
        left = budget - (cut.upto - cut.words)
        order = Window.partitionBy().orderBy("finish", F.col("source").asc_nulls_last(), "pass", "key", "nth")
        last = rows.filter(slot == cut.slot).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        accepted = rows.filter(slot < cut.slot).unionAll(last.filter(F.col("upto") <= left).drop("upto"))
    taken = accepted.groupBy("doc_id", "source", "size", "nth").agg(F.sum("size").alias("taken"))
    taken = taken.withColumnsRenamed({"doc_id": "_doc_id", "source": "_source", "size": "_size", "nth": "_nth"})
    every = sizes.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")
    every = every.join(goal, every["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    same = every["doc_id"].eqNullSafe(taken["_doc_id"]) & every["source"].eqNullSafe(taken["_source"])
    same = same & (every["size"] == taken["_size"]) & (every["nth"] == taken["_nth"])
    return every.join(taken, same, "left").select(
        "doc_id", "source", "size", "nth", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    return materialize(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` per row of ``docs``; ``taken`` is 0 to ``MOST`` times ``size``.

    Sources weigh ``WEIGHTS`` in code point order, null last, and share the words of all documents (``targets``). Rows
    are queued by md5 of seed, pass, id and size, so reruns agree. Running totals are built from groups of rows of
    nearly equal numbers: no task holds a source, and rows equal in id, source and size are queued as one group.

    Null and blank texts have size 0 and are never taken. A null source is a source; ids may be null or repeat. Other
    columns are ignored; an empty table gives an empty result, and so do sizes that are all 0 take nothing.
    """
    return queue(_sizes(docs, id_col, text_col, source_col), seed).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken"
    )


def mixed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns and ``copies``: how often. Where ``docs`` has a column of that
    name, the new one takes the first free name of ``copies_1``, ``copies_2``, ... Rows equal in id, source and size share theirs evenly."""
    each = queue(_sizes(docs, id_col, text_col, source_col), seed).filter("size > 0").groupBy("doc_id", "source", "size")
    each = each.agg((F.sum("taken") / F.first("size") / F.count("*")).alias("_copies")).filter("_copies > 0")
    each = each.withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"})
    sized = docs.select(
        F.col(id_col).alias("key"), F.col(source_col).cast("string").alias("from"), n_words(F.col(text_col)).alias("words"), F.struct("*").alias("row")
    )
    same = sized["key"].eqNullSafe(each["_id"]) & sized["from"].eqNullSafe(each["_source"]) & (sized["words"] == each["_size"])
    name, n = "copies", 0
    while name.lower() in {c.lower() for c in docs.columns}:
        n += 1
        name = f"copies_{n}"
    return sized.join(each, same).select("row.*", F.col("_copies").alias(name))
