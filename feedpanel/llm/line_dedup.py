"""Near-equal lines across documents, by a join of deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpanel.llm.quality import _let
from feedpanel.session import materialize

#: Lines of fewer words are compared for equality only.
MIN_WORDS = 8
#: Rows of 64 bits of the map that keeps lines without a partner out of the second scan: two megabytes at most.
MAP_ROWS = 1 << 17
_CHUNK = 64
_OTHER_SPACES = ("  ", "\t", "\x0b", "\f", "\r")


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, node, line, string)`` of every line with a word, its words parted by single spaces; ``node`` is the text's hash."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    lines = base.select("doc_id", "node", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    odd = F.lit(False)
    for space in _OTHER_SPACES:
        odd = odd | F.contains("raw", F.lit(space))
    plain = F.when(odd, F.btrim(F.regexp_replace("raw", "[\\x20\\x09-\\x0D]+", " "))).otherwise(F.btrim("raw"))
    return lines.select("doc_id", "node", "line", plain.alias("string")).filter("string <> ''")


def _identity() -> list[Column]:
    return [F.xxhash64("string").alias("h1"), F.xxhash64(F.lit(7), "string").alias("h2")]


def _place() -> Column:
    """Order of lines: by document id (null last), line, and the text's hash, which tells apart texts that share an id."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("line").alias("line"), F.col("node").alias("node"))


def _n_words() -> Column:
    """Words of a line whose words are parted by single spaces."""
    return F.octet_length("string") - F.octet_length(F.replace(F.col("string"), F.lit(" "), F.lit(""))) + 1


def _end_keys(least: int) -> list[Column]:
    """Keys of both ends of a line of ``n`` words. Two lines that differ by one word share one of them.

    An end is the largest power of two that is at most half the line, so the two ends do not overlap and one edit leaves
    one of them alone. A line at whose length the power changes also has the ends of lines one word shorter. With a key
    goes the range of places [lo, hi) at which lines that share it can differ.
    """
    n = F.col("n")

    def end(size: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.length(F.bin(size)) - 2)

    keys = []
    for k, wanted in ((end(n), n >= least), (end(n - 1), (n > least) & (end(n) != end(n - 1)))):
        first = F.call_function("substring_index", F.col("string"), F.lit(" "), k)
        last = F.call_function("substring_index", F.col("string"), F.lit(" "), -k)
        for side, (part, lo, hi) in enumerate(((first, k, n), (last, F.lit(0), n - k))):
            keys.append(F.when(wanted, F.struct(F.xxhash64(k, F.lit(side), part).alias("key"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))))
    return keys


def _without_each(w: Column) -> Column:
    """Hashes of the line without its first, second, ... word, in time linear in its length but for a small factor.

    A line's hash is the exclusive or of its words' hashes with their places; behind a left-out word places move by one.
    """
    zero = F.lit(0).cast("bigint")
    xor = lambda a, x: a.bitwiseXOR(x)
    moved = F.transform(w, lambda x, i: F.xxhash64(x, i - 1))
    change = F.transform(w, lambda x, i: F.xxhash64(x, i).bitwiseXOR(F.xxhash64(x, i - 1)))
    none = F.struct(zero.alias("x"), F.array().cast("array<bigint>").alias("out"))

    def block(c: Column, k: Column) -> Column:
        return F.aggregate(
            F.slice(c, k * _CHUNK + 1, _CHUNK), none,
            lambda a, x: F.struct(a["x"].bitwiseXOR(x).alias("x"), F.concat(a["out"], F.array(a["x"])).alias("out")),
        )

    def before(c: Column) -> Column:
        """Exclusive or of all changes before each place, block by block."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _CHUNK).cast("int")), lambda k: block(c, k))
        return F.aggregate(
            blocks, none,
            lambda a, b: F.struct(a["x"].bitwiseXOR(b["x"]).alias("x"), F.concat(a["out"], F.transform(b["out"], lambda o: o.bitwiseXOR(a["x"]))).alias("out")),
        )["out"]

    def variants(m: Column) -> Column:
        return _let(F.aggregate(m, zero, xor), lambda total: F.zip_with(m, _let(change, before), lambda x, p: total.bitwiseXOR(x).bitwiseXOR(p)))

    return _let(moved, variants)


def _full(w: Column) -> Column:
    return F.aggregate(F.transform(w, lambda x, i: F.xxhash64(x, i)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _equal_start(a: Column, b: Column) -> Column:
    """Number of equal words at the start of two lines."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b)))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, left-out or changed word at most lies between two arrays of words."""
    shared = _equal_start(a, b) + _equal_start(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (shared >= F.greatest(F.size(a), F.size(b)) - 1)


def _in_map(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose h1 may be among those of ``keys``; a bitmap of fixed size is broadcast, so none that is there is lost."""
    slot, bit = F.pmod("h1", F.lit(MAP_ROWS)), F.shiftright("h1", 40).bitwiseAND(63).cast("int")
    bits = keys.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))
    bits = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("slot", slot).join(F.broadcast(bits), "slot")
    return marked.filter(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(1) == 1).select(rows.columns)


def _near(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h1, h2)`` of the lines within one edit of an earlier line."""
    ends = distinct.select("h1", "h2", "first", F.explode("ends").alias("e")).select("h1", "h2", "first", "e.*")
    shared = ends.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least < most").select("key")
    partnered = ends.join(shared, "key").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    partnered = materialize(partnered)

    scanned = _occurrences(docs, id_col, text_col).select(*_identity(), _place().alias("place"), "string")
    found = _in_map(partnered, scanned).join(partnered, ["h1", "h2"]).filter(F.col("place").eqNullSafe(F.col("first")))
    # numbered in the order of their places: a line's number says which line is earlier
    ordered = found.dropDuplicates(["h1", "h2"]).orderBy("place", "h1", "h2").withColumn("id", F.monotonically_increasing_id())
    lines = materialize(ordered.select("id", "h1", "h2", F.split("string", " ").alias("words"), "lo", "hi"))

    left_out = lines.select("id", "lo", "hi", F.posexplode(_without_each(F.col("words"))).alias("at", "key"))
    left_out = materialize(left_out.filter("at >= lo AND at < hi").select("id", "at", "key"))
    # the same line but for the word at one place: all of a bucket are alike, its first one stands for it
    firsts = left_out.groupBy("key", "at").agg(F.min("id").alias("other"), F.max("id").alias("last")).filter("other < last")
    changed = left_out.join(firsts.select("key", "at", "other"), ["key", "at"]).filter("id > other").select("id", "other")
    # a line that another one is with a word more
    whole = lines.select(_full(F.col("words")).alias("key"), F.col("id").alias("short"))
    longer = left_out.select("key", F.col("id").alias("long")).join(whole, "key").select("long", "short")
    longer = materialize(longer)
    first_longer = longer.groupBy("short").agg(F.min("long").alias("long")).filter("long < short")
    pairs = changed.unionAll(longer.filter("short < long").select(F.col("long").alias("id"), F.col("short").alias("other")))
    pairs = pairs.unionAll(first_longer.select(F.col("short").alias("id"), F.col("long").alias("other"))).distinct()

    own = lines.select("id", "h1", "h2", F.col("words").alias("mine"))
    others = lines.select(F.col("id").alias("other"), F.col("words").alias("theirs"))
    checked = pairs.join(own, "id").join(others, "other").filter(within_one_edit(F.col("mine"), F.col("theirs")))
    return checked.select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, node, n_lines, exact, near)`` per distinct (id, text) with a line: the numbers of the lines to drop.

    Lines are what newlines part, their numbers begin at 0; only lines with a word count. The earliest occurrence (by id,
    null last, then line, then the text's hash where texts share an id) of a line stays: later lines with the same words go (``exact``), and so do all occurrences of
    a line of ``min_words`` words or more that is within one edit of an earlier one of that length (``near``): a word
    inserted, left out or changed. Whether that earlier line itself goes plays no part, so the order of work cannot matter.

    Equal lines are merged first. Lines that share neither end with another one have no partner and are left aside.
    Each other line emits the hash of every variant with one word left out outside the shared end; equal variants meet in a join, in which only
    a variant's earliest line is looked at, so no pairs of a bucket are listed; the words of every pair found are
    compared. Rows that repeat id and text are one place.
    """
    lines = _occurrences(docs, id_col, text_col).withColumn("n", _n_words())
    ends = F.array_compact(F.array(*_end_keys(min_words))).alias("ends")
    occurrences = materialize(lines.select("doc_id", "node", "line", *_identity(), ends))
    distinct = occurrences.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.first("ends").alias("ends"))
    distinct = materialize(distinct)
    near = _near(distinct, docs, id_col, text_col).withColumn("near", F.lit(True))
    verdict = distinct.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    judged = occurrences.drop("ends").join(verdict, ["h1", "h2"])
    is_near = F.coalesce("near", F.lit(False))
    is_exact = ~is_near & (_place() > F.col("first"))
    return judged.groupBy("doc_id", "node").agg(
        F.size(F.collect_set("line")).cast("bigint").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(is_exact, F.col("line")))).alias("exact"),
        F.sort_array(F.collect_set(F.when(is_near, F.col("line")))).alias("near"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id_col, n_lines, n_exact, n_near, dropped)`` per row of ``docs``; ``dropped`` lists line numbers, comma-joined.

    Null, empty and blank texts have no lines. Ids may be null or repeat; other columns are ignored; an empty table gives
    an empty result.
    """
    found = dropped_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"doc_id": "_id", "node": "_node"})
    base = docs.select(F.col(id_col), F.xxhash64(text_col).alias("node"))
    same = base[id_col].eqNullSafe(found["_id"]) & (base["node"] == found["_node"])
    none = F.array().cast("array<int>")
    every = F.sort_array(F.concat(F.coalesce("exact", none), F.coalesce("near", none)))
    return base.join(found, same, "left").select(
        F.col(id_col), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("exact", none)).cast("bigint").alias("n_exact"), F.size(F.coalesce("near", none)).cast("bigint").alias("n_near"),
        F.array_join(every.cast("array<string>"), ",").alias("dropped"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the dropped lines, with all columns, whatever their names. A document none of whose lines stays
    goes; one without any line is left as it is."""
    found = dropped_lines(docs, id_col, text_col, min_words)
    found = found.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "n_lines", F.concat("exact", "near").alias("_dropped"))
    found = found.filter(F.size("_dropped") > 0).withColumn("_all", F.size("_dropped") == F.col("n_lines")).drop("n_lines")
    marked = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row"))
    same = marked["key"].eqNullSafe(found["_id"]) & (marked["hash"] == found["_node"])
    joined = marked.join(found, same, "left").filter("_all IS NULL OR NOT _all")
    before = F.col("row").getField(text_col)
    kept = _let(F.split(before, "\n"), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_dropped")), lambda i: F.get(x, i)), "\n"
    ))
    text = F.when(F.col("_dropped").isNull(), before).otherwise(kept)
    return joined.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
