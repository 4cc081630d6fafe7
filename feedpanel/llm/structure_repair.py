"""Repair of the turn structure of conversations: cheapest edits by a rank-convergence parallel Viterbi search.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its rows that must go (blank ones and repeats) are deleted;
every other row is kept, given the role its place asks for, or deleted, and empty turns may be inserted. Which edits are
cheapest is a shortest path through four states per row: nothing yet, after the system turn, after a user's turn and after
an assistant's.

Rows are cut into chunks that tasks search side by side. Backwards, every chunk but a conversation's last one starts from
a speculative cost vector. A fix-up pass hands each chunk the vector of the chunk behind it; the chunk searches again only
until its vector differs from the one it had by a constant, as then all further ones do. Passes repeat until no chunk's
first vector changes. Forwards, the least audit follows from the stitched costs row by row, and the state a chunk starts
in is speculated and fixed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from feedpanel.operators import ordered
from feedpanel.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK = 1024
BLOCK = 256

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NAMES = ("", "system", "user", "assistant")
#: State after the turn that an insertion or a new role may give in each state.
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
#: Turns to insert at the end in each state.
_MISSING = np.array([0, 2, 1, 0])
#: Kinds of rows by role initial, o for any other, upper case for truncated texts; the last one pads.
_KINDS = "suaoSUAO"
_PAD = len(_KINDS)
_LATE = np.array([0] * 4 + [TRUNCATED] * 4 + [0])
#: State after keeping a row of a kind, -1 where its role has no place.
_KEPT = np.full((_PAD + 1, 4), -1)
_KEPT[[0, 4], _START] = _SYSTEM
_KEPT[np.ix_([1, 5], [_START, _SYSTEM, _ASSISTANT])] = _USER
_KEPT[[2, 6], _USER] = _ASSISTANT
_FAR = 1 << 20


# --- the search -------------------------------------------------------------------
def _step(kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (rows x states) from before a row of each kind, given those from after it."""
    late = _LATE[kind][:, None]
    kept = _KEPT[kind]
    keep = np.where(kept >= 0, KEEP + late + np.take_along_axis(after, np.maximum(kept, 0), 1), _FAR)
    cost = np.minimum(np.minimum(keep, DELETE + after), REROLE + late + after[:, _NEXT])
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[:, _NEXT])
    return np.where((kind == _PAD)[:, None], after, cost)


def _move(kind: np.ndarray, after: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(insertions, edit, state after) of the ASCII-least cheapest edits of rows reached in ``state``."""
    total, late = _step(kind, after), _LATE[kind]
    at, row = state.copy(), np.arange(len(kind))
    edit = np.full(len(kind), " ")
    inserted, then = np.zeros(len(kind), int), state.copy()
    for _ in range(3):
        best, kept, turned = total[row, at], _KEPT[kind, at], _NEXT[at]
        keep = (kept >= 0) & (KEEP + late + after[row, np.maximum(kept, 0)] == best)
        choices = (("D", DELETE + after[row, at] == best, at), ("I", INSERT + total[row, turned] == best, turned), ("K", keep, kept), ("R", REROLE + late + after[row, turned] == best, turned))
        open_rows = edit == " "
        for name, fits, to in choices:
            chosen = open_rows & fits
            open_rows &= ~fits
            if name == "I":
                inserted[chosen] += 1
                at = np.where(chosen, to, at)
            else:
                edit[chosen] = name
                then[chosen] = to[chosen]
    pad = kind == _PAD
    return np.where(pad, 0, inserted), edit, np.where(pad, state, then)


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of about equal lengths together."""
    size = np.ceil(np.log2(lengths + 1)).astype(int)
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _kinds(texts: list[str]) -> np.ndarray:
    width = max(map(len, texts))
    code = np.full(128, _PAD)
    code[[ord(c) for c in _KINDS]] = range(len(_KINDS))
    return code[np.frombuffer("".join(t.ljust(width, "~") for t in texts).encode(), np.uint8).reshape(len(texts), width)]


def _stored(values: list[bytes | None], lengths: np.ndarray, width: int, items: int) -> np.ndarray:
    """Stored vectors of each place, -1 where a chunk has none yet; shorter chunks repeat their last one."""
    out = np.full((len(values), width + 1, items), -1)
    for i, v in enumerate(values):
        if v is not None:
            out[i, : lengths[i] + 1] = np.frombuffer(v, np.uint8).reshape(-1, items)
            out[i, lengths[i] + 1 :] = out[i, lengths[i]]
    return out


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Searches chunks from the cost vector ``given`` after them until theirs differ from the stored ones by a constant."""
    for frame in frames:
        lengths = frame["kinds"].str.len().to_numpy()
        costs, changed = [None] * len(frame), np.zeros(len(frame), bool)
        for rows in _groups(lengths):
            part = frame.iloc[rows]
            kinds = _kinds(list(part["kinds"]))
            width = kinds.shape[1]
            held = _stored(list(part["costs"]), lengths[rows], width, 4)
            vector = np.array([list(g) for g in part["given"]], int)
            vector -= vector.min(1, keepdims=True)
            active = (held[:, width] != vector).any(1)
            held[active, width] = vector[active]
            for p in range(width - 1, -1, -1):
                if not active.any():
                    break
                at = np.flatnonzero(active)
                vector = _step(kinds[at, p], held[at, p + 1])
                vector -= vector.min(1, keepdims=True)
                active[at] = (held[at, p] != vector).any(1)
                held[at, p] = vector
            changed[rows] = active
            for i, r in enumerate(rows):
                costs[r] = held[i, : lengths[r] + 1].astype(np.uint8).tobytes()
        yield frame.assign(costs=costs, changed=changed).drop(columns="given")


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows the least audit of chunks from the state ``given`` until it is in the state it was stored in."""
    for frame in frames:
        lengths = frame["kinds"].str.len().to_numpy()
        states, changed = [None] * len(frame), np.zeros(len(frame), bool)
        for rows in _groups(lengths):
            part = frame.iloc[rows]
            kinds = _kinds(list(part["kinds"]))
            width = kinds.shape[1]
            costs = _stored(list(part["costs"]), lengths[rows], width, 4)
            held = _stored(list(part["states"]), lengths[rows], width, 1)[:, :, 0]
            given = part["given"].to_numpy(int)
            active = held[:, 0] != given
            held[active, 0] = given[active]
            for p in range(width):
                if not active.any():
                    break
                at = np.flatnonzero(active)
                then = _move(kinds[at, p], costs[at, p + 1], held[at, p])[2]
                active[at] = held[at, p + 1] != then
                held[at, p + 1] = then
            changed[rows] = active
            for i, r in enumerate(rows):
                states[r] = held[i, : lengths[r] + 1].astype(np.uint8).tobytes()
        yield frame.assign(states=states, changed=changed).drop(columns="given")


def _emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One entry per row of a chunk: insertions before it, edit, roles of the insertions and the row's new role."""
    before = {}
    for state in range(4):
        at, roles = state, []
        before[state, 0] = []
        for k in (1, 2):
            at = int(_NEXT[at])
            roles = [*roles, _NAMES[at]]
            before[state, k] = roles
    for frame in frames:
        out = []
        for kinds, costs, states, last in zip(frame["kinds"], frame["costs"], frame["states"], frame["last"], strict=True):
            states = np.frombuffer(states, np.uint8).astype(int)
            after = np.frombuffer(costs, np.uint8).reshape(-1, 4)[1:].astype(int)
            inserted, edit, then = _move(_kinds([kinds])[0], after, states[:-1])
            rows = [
                {"edit": "I" * k + e, "inserted": before[s, k], "role": _NAMES[t] if e == "R" else None, "kept": e != "D"}
                for s, k, e, t in zip(states[:-1].tolist(), inserted.tolist(), edit.tolist(), then.tolist(), strict=True)
            ]
            missing = int(_MISSING[states[-1]]) if last else 0
            if missing:
                rows.append({"edit": "I" * missing, "inserted": before[int(states[-1]), missing], "role": None, "kept": False})
            out.append(rows)
        yield frame[["conv", "chunk"]].assign(rows=out)


def _passes(chunks: DataFrame, search, hand_over: Column, start: Column, toward: int) -> DataFrame:
    """Searches all chunks from ``start``, then hands each its neighbour's result until none changes."""
    schema = StructType([*chunks.schema.fields, StructField("changed", BooleanType())])
    done = materialize(chunks.withColumn("given", start).mapInPandas(search, schema))
    while not done.filter("changed").isEmpty():
        given = done.select("conv", (F.col("chunk") + toward).alias("chunk"), hand_over.alias("given"))
        linked = done.drop("changed").join(given, ["conv", "chunk"], "left").withColumn("given", F.coalesce("given", start))
        done = materialize(linked.mapInPandas(search, schema))
    return done.drop("changed")


def _first_vector(costs: Column) -> Column:
    return F.array(*[F.conv(F.hex(F.substring(costs, i + 1, 1)), 16, 10).cast("int") for i in range(4)])


def _last_state(states: Column) -> Column:
    return F.conv(F.hex(F.substring(states, -1, 1)), 16, 10).cast("int")


# --- rows ---------------------------------------------------------------------------
_WORD = r"[^\x20\x09-\x0D]"


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(conv, turn, role, text)`` with a number of their own (``id``), and their structure.

    The structure is ``(conv, id, turn, at, no, initial, fault, late, must)``: place in the conversation by turn (null
    first; ties by a hash of role and text, so equal rows are neighbours), place among the rows that need not go, and the
    row's first fault. Rows are ordered in range splits, so a long conversation is spread over tasks.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = materialize(rows.select("conv", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).withColumn("id", F.monotonically_increasing_id()))
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    initial = F.substring("role", 1, 1)
    ending = F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv", "turn", digest.alias("digest"), "id",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("open"),
    )
    first = narrow.groupBy("conv", "digest").agg(F.min(F.struct("turn", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated")
    narrow = narrow.join(first, "id", "left").withColumn("fault", fault)
    narrow = narrow.withColumn("must", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)))
    one = F.lit(1).cast("bigint")
    placed = ordered.running_sums(narrow, ["conv"], ["turn", "digest", "id"], {"at": one, "no": F.when(~F.col("must"), one)})
    late = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    return rows, materialize(placed.select("conv", "id", "turn", "at", F.when(~F.col("must"), F.col("no") - 1).alias("no"), "initial", "fault", late.alias("late"), "must"))


def edits(placed: DataFrame) -> DataFrame:
    """``(conv, no, edit, inserted, role, kept)``: the least audit of the cheapest edits, row by row.

    ``edit`` is the row's part of the audit, ``inserted`` the roles of the empty turns put before it, ``role`` its new
    role, if any. A last entry without a row of its own holds the turns put at the end. The number of passes is that of
    the chunks through which a choice reaches back: few, as a turn is inserted for less than the vectors may differ, but
    as many as there are chunks where a conversation has no role but unknown ones.
    """
    kind = F.when(F.col("late"), F.upper("initial")).otherwise(F.col("initial"))
    narrow = placed.filter(~F.col("must")).select("conv", "no", F.floor(F.col("no") / CHUNK).alias("chunk"), kind.alias("kind"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "kind"))), lambda r: r["kind"]), "")
    chunks = narrow.groupBy("conv", "chunk").agg(whole.alias("kinds"))
    ends = placed.filter(~F.col("must")).groupBy("conv").agg(F.floor(F.max("no") / CHUNK).alias("chunk")).withColumn("last", F.lit(True))
    chunks = chunks.join(ends, ["conv", "chunk"], "left").select("conv", "chunk", "kinds", F.coalesce("last", F.lit(False)).alias("last"), F.lit(None).cast("binary").alias("costs"))
    final = F.array(*[F.lit(int(n) * INSERT) for n in _MISSING])
    level = F.array(*[F.lit(0)] * 4)
    chunks = _passes(chunks, _backward, _first_vector(F.col("costs")), F.when(F.col("last"), final).otherwise(level), -1)
    chunks = chunks.withColumn("states", F.lit(None).cast("binary"))
    chunks = _passes(chunks, _forward, _last_state(F.col("states")), F.when(F.col("chunk") == 0, _START).otherwise(_ASSISTANT), 1)
    made = chunks.mapInPandas(_emit, "conv string, chunk bigint, rows array<struct<edit:string,inserted:array<string>,role:string,kept:boolean>>")
    return made.select("conv", "chunk", F.posexplode("rows").alias("place", "row")).select("conv", (F.col("chunk") * CHUNK + F.col("place")).alias("no"), "row.*")


def _turns(rows: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure with edits, and for every entry its turns in the repaired conversation."""
    found = edits(placed)
    where = placed.filter(~F.col("must")).select("conv", "no", "at", "id", "late")
    # the entry at the end follows all rows, also those that go
    entries = found.join(where, ["conv", "no"], "left").withColumn("at", F.coalesce("at", F.lit((1 << 63) - 1)))
    entries = materialize(entries)
    texts = rows.select("id", F.col("role").alias("said_by"), "text")
    own = entries.filter("kept").join(texts, "id").withColumn("own", F.array(F.struct(F.coalesce("role", "said_by").alias("role"), "text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest = entries.filter("NOT kept").withColumn("own", none)
    names = ["conv", "at", "edit", "inserted", "own"]
    put = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    all_turns = own.select(names).unionByName(rest.select(names)).select("conv", "at", "edit", F.concat(put, "own").alias("turns"))
    return entries, all_turns


def _conv() -> Column:
    """A conversation's key: text, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def repaired(turns: DataFrame) -> DataFrame:
    """``(conv_id, at, part, role, text)``: the turns of every repaired conversation of ``turns(conv_id, turn, role, text)``.

    They follow by ``at``, then ``part``. Null roles and texts count as one space; a null conv_id is one conversation; of
    conversations without a turn left nothing is returned. Other columns are ignored.
    """
    rows, placed = numbered(turns.select(_conv(), "turn", "role", "text"))
    _, made = _turns(rows, placed)
    made = made.select("conv", "at", F.posexplode("turns").alias("part", "said")).select("conv", "at", "part", "said.*")
    return turns.select(_conv(), "conv_id").distinct().join(made, "conv").drop("conv")


# --- report ---------------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the damage of a test, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    removes its full stops, 3 repeats it, 4 makes its role ``user``. Nulls count as one space there and in the texts."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("kind", kind).filter("kind != 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(turns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and a digest of the repair of every conversation of ``turns``.

    ``rows`` are the rows to repair (``turns`` themselves if none are given); a conversation that has none there has zeros,
    an empty audit and the hash of the empty text. The audit and the repaired text of a conversation are one value each.
    Nulls: a null conv_id is one conversation; null roles and texts are one space; null turns come first and count for no
    gap. Rows that repeat or tie are turns of their own. An empty table gives an empty result; other columns are ignored.
    """
    rows, placed = numbered((turns if rows is None else rows).select(_conv(), "turn", "role", "text"))
    entries, made = _turns(rows, placed)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    faults = placed.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"), F.count_if("must").alias("forced"))
    turn = placed.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = turn.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    # the last row of a block is the one before the next block's first
    place = F.col("at") - 1
    block = F.floor(place / BLOCK)
    blocks = F.when(place % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    initials = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "initial"))), lambda r: r["initial"]), "")
    lines = placed.select("conv", "at", "initial", F.explode(blocks).alias("block")).groupBy("conv", "block").agg(initials.alias("line"))
    pair = lambda i: ~F.substring("line", i, F.lit(2)).isin("su", "ua", "au")
    broken = F.when(F.length("line") > 1, F.size(F.filter(F.sequence(F.lit(1), F.length("line") - 1), pair))).otherwise(0)
    illegal = lines.groupBy("conv").agg(F.sum(broken).alias("illegal"))

    spent = F.when(F.col("edit").endswith("D"), DELETE).when(F.col("edit").endswith("R"), REROLE).otherwise(0) + F.size("inserted") * INSERT
    costs = entries.groupBy("conv").agg(F.sum(spent + F.when(F.col("kept") & F.col("late"), TRUNCATED).otherwise(0)).alias("spent"))

    forced = placed.filter("must").select("conv", "at", F.lit("D").alias("edit"), F.lit(None).cast("string").alias("said"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = made.select("conv", "at", "edit", F.when(F.size("turns") > 0, said).alias("said")).unionByName(forced)

    def joined(order: str) -> list[Column]:
        listed = F.sort_array(F.collect_list(F.struct(order, "edit", "said")))
        return [
            F.array_join(F.transform(listed, lambda r: r["edit"]), "").alias("edit"),
            F.array_join(F.filter(F.transform(listed, lambda r: r["said"]), lambda s: s.isNotNull()), "\n").alias("said"),
            F.max(F.when(F.col("said").isNotNull(), 1)).alias("some"),
        ]

    parts = pieces.withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).groupBy("conv", "block").agg(*joined("at"))
    parts = parts.withColumn("said", F.when(F.col("some") == 1, F.col("said")))
    whole = parts.groupBy("conv").agg(*joined("block"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    out = turns.select(_conv(), "conv_id").distinct()
    for table in (faults, gaps, illegal, costs, whole):
        out = out.join(table, "conv", "left")
    return out.select(
        "conv_id",
        *[zero(n).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")],
        (zero("forced") * DELETE + zero("spent")).alias("cost"),
        F.coalesce("edit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("said", F.lit("")), 256).alias("repaired_sha256"),
    )
