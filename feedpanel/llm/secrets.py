"""Secrets in texts: known patterns, and strings that surroundings and dictionaries do not explain."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ADDED = "novel"

# --- base patterns: fixed values of the contract ------------------------------
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_CUES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# --- the method's own values ---------------------------------------------------
SENSITIVE = (
    "password passwd passphrase pwd secret token apikey api_key api-key access_key accesskey credential auth bearer "
    "private_key privatekey client_id signature cookie session salt"
).split()
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~-]{16,}")
_HEAD, _TAIL = re.compile(r"[A-Za-z0-9+/_=~-]*"), re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~-]*\Z")
IDENTIFIERS = (
    "abstract access account action address admin alias allow amount application argument array assert async attribute auth "
    "authentication authorization backend base64 batch binary block boolean buffer build button bytes cache callback category "
    "certificate channel char class client close cloud cluster collection column command comment commit common config "
    "configuration connection const container content context controller cookie count create credential current customer data "
    "database date debug decode default delete deploy description device dictionary directory document domain download driver "
    "element email enable encode encryption endpoint engine entity environment error event example exception export factory false "
    "field file filter final folder format frame function gateway generate group handler hash header host http identifier image "
    "import include index info init input insert instance integer interface internal item iterator json key language length level "
    "library limit link list listener load local login main manager master member memory message method model module name network "
    "number object option order output package page parameter password path payload permission private profile project property "
    "protocol provider proxy public query queue read record region request resource response result role root route sample schema "
    "secret security send server service session setting source state status storage string system table test time token type "
    "update user value version view write"
).split()
#: Runs that look random to a compressor, but are none.
SEQUENCES = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 01234567890123456789 2024-01-01T00:00:00 qwertyuiop xxxxxxxxxxxxxxxxxxxx"
SURROUNDING = 256
#: Characters measured at a time. zstandard entropy-codes literals from 64 bytes on, which takes a random string of few
#: different characters for a compressible one; below that a random string needs 1 byte per character whatever its alphabet.
PIECE = 63
#: Marginal bytes per character from which a string counts as incompressible: a random one needs 1, an identifier of
#: known words 0.5 to 0.8.
LEAST_BYTES_PER_CHAR = 0.9


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()
    assign = _ASSIGN.finditer(text) if any(c in low for c in _ASSIGN_CUES) else ()
    return {
        "assign": [m.span() for m in assign if len(m[2]) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text)],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


class Novelty:
    """Marginal compressed bytes of a string behind a text, primed with a dictionary of identifiers."""

    def __init__(self, identifiers: list[str], level: int = 3):
        forms = [*identifiers, *(w.capitalize() for w in identifiers), *(w.upper() for w in identifiers)]
        self.dictionary = ("_".join(forms) + " " + SEQUENCES).encode()
        self.level = level

    def bytes_of(self, before: str, string: str, after: str) -> int:
        """Bytes that ``string`` adds to the compressed size of its surroundings, its own copies there left out.

        It is measured in even pieces of ``PIECE`` characters at most, each behind what precedes it, so that literals
        are never entropy-coded and only repeats of the dictionary, the surroundings and the string itself save bytes.
        """
        before, after = _without_copies(before, string, after)
        parts = -(-len(string) // PIECE)
        cuts = [len(string) * i // parts for i in range(parts + 1)]
        total = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            known = self.dictionary + (before + string[max(0, a - SURROUNDING) : a]).encode() + b"\n" + after.encode()
            total += self._added(known, string[a:b].encode())
        return total

    def _added(self, known: bytes, piece: bytes) -> int:
        known = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(packer.compress(piece)) - len(packer.compress(b""))


def _without_copies(before: str, string: str, after: str) -> tuple[str, str]:
    """The surroundings without copies of the string, also those that their outer ends cut."""
    before, after = before.replace(string, ""), after.replace(string, "")
    head, tail = _HEAD.match(before)[0], _TAIL.search(after)[0]
    if len(head) >= 16 and string.endswith(head):
        before = before[len(head) :]
    if len(tail) >= 16 and string.startswith(tail):
        after = after[: len(after) - len(tail)]
    return before, after


#: What opens a value on the next line, and what closes the body of a private key.
_OPENS = re.compile(r"[:=|>({\[\"'][\x20\t\r]*\Z")
_KEY_OPENS, _KEY_CLOSES = "private key-----", "-----end"
_CUES = re.compile("|".join((*SENSITIVE, _KEY_OPENS)))


def _sensitive_lines(low: str) -> Iterator[tuple[int, int]]:
    """Lines with a sensitive word, the next line that is not blank where such a line ends by opening a value, and the
    lines of a private key."""
    done = 0
    for cue in _CUES.finditer(low):
        if cue.start() < done:
            continue
        start = low.rfind("\n", 0, cue.start()) + 1
        end = low.find("\n", cue.end())
        end = len(low) if end < 0 else end
        line = low[start:end]
        yield start, end
        done = end
        if line.rstrip().endswith(_KEY_OPENS) and "-----begin" in line:
            closes = low.find(_KEY_CLOSES, end)
            closes = len(low) if closes < 0 else closes
            yield end, closes
            done = closes
        elif _OPENS.search(line[-64:]):
            begin = end
            while begin < len(low) and low[begin].isspace():
                begin += 1
            last = low.find("\n", begin)
            last = len(low) if last < 0 else last
            # a line with a sensitive word of its own is found by that word
            if not _CUES.search(low, begin, last):
                yield begin, last
                done = last


def _random_looking(string: str) -> bool:
    """Letters and digits, or letters alone that change their case more often than names do."""
    if any(c.isdigit() for c in string):
        return any(c.isalpha() for c in string)
    changes = sum(x.isupper() != y.isupper() for x, y in zip(string, string[1:], strict=False))
    return 4 * changes >= len(string)


def novel_spans(text: str, novelty: Novelty, least: float) -> list[tuple[int, int]]:
    """Strings in a sensitive context that neither dictionary nor surroundings explain."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    found = []
    if not any(word in low for word in (*SENSITIVE, _KEY_OPENS)):
        return found
    for start, end in _sensitive_lines(low):
        for m in _CANDIDATE.finditer(text, start, end):
            a, b = m.span()
            if not _random_looking(text[a:b]):
                continue
            near = novelty.bytes_of(text[max(0, a - SURROUNDING) : a], text[a:b], text[b : b + SURROUNDING])
            if near >= least * (b - a):
                found.append((a, b))
    return found


def all_spans(text: str, novelty: Novelty, least: float = LEAST_BYTES_PER_CHAR):
    """(base spans by kind, added spans). An added span overlaps no base span."""
    base = plain_spans(text)
    taken = sorted(s for k in KINDS for s in base[k])
    ends, added = [], []
    for _, b in taken:
        ends.append(max(b, ends[-1] if ends else 0))
    for a, b in novel_spans(text, novelty, least):
        i = bisect_left(taken, (b,))  # base spans that begin before b
        if i == 0 or ends[i - 1] <= a:
            added.append((a, b))
    return base, added


def _joined(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]])))


def _scan(identifiers: list[str], least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(identifiers)
        for frame in frames:
            rows = []
            for text in frame["_text"]:
                base, added = all_spans(text or "", novelty, least)
                plain = [(a, b, k) for k in KINDS for a, b in base[k]]
                digest = hashlib.sha256(_joined(plain).encode()).hexdigest()
                rows.append((*(len(base[k]) for k in KINDS), digest, _joined(plain + [(a, b, ADDED) for a, b in added]), len(added)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])
            out.insert(0, "_id", frame["_id"].to_numpy())
            yield out

    return run


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: list[str] | None = None, least: float = LEAST_BYTES_PER_CHAR,
) -> DataFrame:
    """One row per row of ``docs``: the secrets in its whole text, as kind:start:end in code points, end exclusive.

    Base spans match the patterns (assignments, access keys, long hex). Added spans ("novel") are strings of 16 characters
    or more with letters and digits, or with letters of changing case, that overlap no base span and stay incompressible.
    They stand on a line with a sensitive word, on the next line where such a line ends by opening a value ("key:", "= ("),
    or in the body of a private key:
    a zstandard compressor primed with ``identifiers`` and the ``SURROUNDING`` characters on both sides still needs
    ``least`` bytes per character for them, whatever their length and alphabet (see ``Novelty.bytes_of``). A string made of identifiers or of what stands around it costs little and is
    not reported; copies of the string itself explain nothing. ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` are of the base spans, ``spans`` of all.

    Null and empty texts have no span. Ids may be null or repeat; each row is scanned by itself, in time linear in its
    length. Other columns are ignored, and an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    return base.mapInPandas(
        _scan(IDENTIFIERS if identifiers is None else identifiers, least),
        f"_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint",
    ).withColumnRenamed("_id", id_col)
