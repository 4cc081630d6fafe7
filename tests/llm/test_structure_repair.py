import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from feedpanel.llm import structure_repair
from feedpanel.llm.structure_repair import damaged, repair_report, repaired

WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying every edit at every row; the audit is least among the cheapest."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for initial, name in NAMES.items():
                if initial in NEXT[state]:
                    cost, audit, turns = best(i, initial, inserts + 1)
                    found.append((cost + 3, "I" + audit, ((name, ""), *turns)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, turns = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, turns))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    cost, audit, turns = best(i + 1, role[:1], 0)
                    found.append((cost + late, "K" + audit, ((role, text), *turns)))
                for initial, name in NAMES.items():
                    if initial in NEXT[state]:
                        cost, audit, turns = best(i + 1, initial, 0)
                        found.append((cost + late + 3, "R" + audit, ((name, text), *turns)))
        return min(found, default=(1 << 30, "", ()))

    return best(0, "", 0)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(ids, rows):
    out = []
    for conv in set(ids):
        mine = [(r[1] is not None, r[1] or 0, digest(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "), " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        mine.sort()
        turns, seen, told = [r[1] for r in mine if r[0]], set(), []
        for *_, role, text in mine:
            last = WORD.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            told.append((role, text, fault))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        cost, audit, kept = cheapest(tuple(told))
        faults = [sum(t[2] == f for t in told) for f in ("blank", "duplicate", "truncated")]
        whole = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((str(conv), gaps, *faults, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out)


def got(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((str(r.conv_id), *(r[n] for n in names)) for r in frame.collect())


def test_corpus(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert got(repair_report(turns, damaged(turns))) == brute([r[0] for r in rows], brute_damage(rows))


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, at int"


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(structure_repair, "CHUNK", 4)
    monkeypatch.setattr(structure_repair, "BLOCK", 3)


def test_random_roles_over_many_chunks(spark, small_chunks):
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["tool", "user", "assistant"], ["tool"], ["system", "tool", "", "unit"]])
        n = rng.choice([1, 2, 3, 5, 9, 40])
        for turn in range(n):
            role = roles[turn % len(roles)] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn + rng.choice([0, 0, 0, 2]), role, rng.choice(["a.", "b!", "c", "", " ", f"t{turn}.", f"t{turn}"])))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(repair_report(frame)) == brute([r[0] for r in rows], rows)


def test_long_conversation_and_many_repeats(spark, small_chunks):
    rows = [(1, t, "tool", f"{t}.") for t in range(101)]  # nothing decides between two orders of roles but the ends
    rows += [(2, 5, "user", "again.")] * 80 + [(2, 6, "assistant", "yes.")]
    rows += [(3, t, "user" if t % 2 else "assistant", f"{t}" + "." * (t % 3)) for t in range(200)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(repair_report(frame)) == brute([r[0] for r in rows], rows)


@pytest.mark.filterwarnings("ignore")
def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "x."), (1, 3, "user", "y"), (1, 3, "user", "y"), (1, 3, "assistant", ""), (None, 1, "user", "hé?\u2003"), (None, None, "assistant", "x" * 300_000), (None, 9, "assistant", "ok.\n")]
    rows += [(2, None, "system", "only."), (3, 1, "user", " \n"), (4, 2, "", "z."), (5, 7, "user\n", "q?")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(repair_report(frame)) == brute([r[0] for r in rows], rows)
    hurt = brute_damage(rows)
    assert got(repair_report(frame, damaged(frame))) == brute([r[0] for r in rows], hurt)
    nothing = hashlib.sha256(b"").hexdigest()
    assert set(got(repair_report(frame, frame.limit(0)))) == {(str(c), 0, 0, 0, 0, 0, 0, "", nothing) for c in (1, 2, 3, 4, 5, None)}
    assert repair_report(frame.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", "q."), (1, 2, "user", "r."), (2, 1, "user", "")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = [(r.conv_id, r.role, r.text) for r in repaired(frame).orderBy("conv_id", "at", "part").collect()]
    turns = cheapest((("assistant", "hi.", ""), ("user", "q.", ""), ("user", "r.", "")))[2]
    assert found == [(1, *t) for t in turns]
