"""Personal data in texts, also behind look-alike letters, spelled digits and written-out "at" and "dot"."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# --- base patterns: fixed values of the contract ------------------------------
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> list[Span]:
    """A run of local characters ends at its @ only, so the search goes from @ to @ and back to the run's start."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def _ips(text: str) -> list[Span]:
    # parts of more than 3 digits may have leading zeros; they count by value
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Matches of the base patterns, leftmost and not overlapping within a kind."""
    numbers = any(d in text for d in "0123456789")
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text) if numbers and "." in text else [],
        "card": _cards(text) if numbers else [],
        "phone": _phones(text) if "+" in text else [],
    }


# --- transducers --------------------------------------------------------------
class Layer:
    """A rewritten text that can map its spans back to the text it was made from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement) in order, not overlapping."""
        parts, done, shift = [], 0, 0
        self.out_start, self.out_end, self.src_start, self.src_end = [], [], [], []
        for start, end, new in edits:
            parts += [text[done:start], new]
            self.out_start.append(start + shift)
            self.out_end.append(start + shift + len(new))
            self.src_start.append(start)
            self.src_end.append(end)
            shift += len(new) - (end - start)
            done = end
        self.text = "".join([*parts, text[done:]])

    def source(self, start: int, end: int) -> Span:
        """Smallest source span whose rewriting covers [start, end); a replaced part counts as a whole."""
        return self._place(start, False), self._place(end - 1, True) + 1

    def _place(self, at: int, last: bool) -> int:
        i = bisect_right(self.out_start, at) - 1
        while i >= 0 and self.out_start[i] == self.out_end[i]:  # deletions hold no character
            if self.out_end[i] <= at:
                return self._after(i, at)
            i -= 1
        if i < 0:
            return at
        if at < self.out_end[i]:
            return self.src_end[i] - 1 if last else self.src_start[i]
        return self._after(i, at)

    def _after(self, i: int, at: int) -> int:
        return self.src_end[i] + at - self.out_end[i]


# Cyrillic and Greek letters that look like Latin ones, and other forms of full stop, plus and hyphen.
_LOOKS = {
    **dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝһ", "ABEKMHOPCTYXaeopcyxijsdqwh", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυ", "ABEZHIKMNOPTYXovpu", strict=True)),
    **dict.fromkeys("\u2024\u3002\uff61\u2219", "."),
    **dict.fromkeys("\u207a\ufe62", "+"),
    **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63", "-"),
    **dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " "),
    "\ufe6b": "@",
}
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# full-width forms, mathematical letters and digits, circled, raised, lowered, Arabic-Indic and Persian digits
_STYLED = "\uff01-\uff5e\U0001d400-\U0001d7ff\u2460-\u249b\u00b2\u00b3\u00b9\u2070-\u2089\u0660-\u0669\u06f0-\u06f9"
_ODD = re.compile(f"[{re.escape(''.join(_LOOKS) + _HIDDEN)}{_STYLED}]")


def plain_letters(text: str) -> Layer:
    """Homoglyphs, styled letters and digits become ASCII; invisible characters go."""
    edits = []
    for m in _ODD.finditer(text):
        c = m[0]
        new = "" if c in _HIDDEN else _LOOKS.get(c)
        if new is None:
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if new != c:
            edits.append((m.start(), m.end(), new))
    return Layer(text, edits)


_NAMES = "zero one two three four five six seven eight nine".split()
_VALUE = {n: str(i) for i, n in enumerate(_NAMES)} | {"oh": "0"}
_NAME = "|".join(_VALUE)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:(?:{_NAME}|double (?:{_NAME})|triple (?:{_NAME}))(?![A-Za-z])[\x20,.-]{{0,2}}){{3,}}", re.I | re.A)
_SPELLED_CUE = re.compile(rf"(?<![A-Za-z])(?:{_NAME})[\x20,.-]{{1,2}}(?:double |triple )?(?:{_NAME})(?![A-Za-z])", re.I | re.A)
_SPOKEN = re.compile(rf"(?:(double|triple) )?({_NAME})(?![A-Za-z])", re.I | re.A)
_PLUS = re.compile(r"(?<![A-Za-z])plus\x20+(?=[0-9])", re.I | re.A)


def plain_digits(text: str) -> Layer:
    """Runs of three spelled digits or more become digits, each word by itself."""
    edits = []
    for run in _SPELLED.finditer(text):
        end = None
        for m in _SPOKEN.finditer(text, run.start(), run.end()):
            if end is not None:
                edits.append((end, m.start(), ""))
            times = {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)
            edits.append((m.start(), m.end(), _VALUE[m[2].lower()] * times))
            end = m.end()
    return Layer(text, [e for e in edits if e[0] < e[1]])


def plain_plus(text: str) -> Layer:
    """"plus" before a digit becomes +."""
    return Layer(text, [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)])


_AT = re.compile(r"\s{0,3}(?:[\[({<]\s?(?:at|@)\s?[\])}>]|(?<=\s)at(?=\s)|(?<![A-Za-z0-9])AT(?![A-Za-z0-9]))\s{0,3}", re.I | re.A)
_DOT = re.compile(r"\s{0,3}(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|(?<=\s)dot(?=\s)|(?<![A-Za-z0-9])DOT(?![A-Za-z0-9]))\s{0,3}", re.I | re.A)
_AROUND = re.compile(r"[A-Za-z0-9._%+-]")
_BARE_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s{0,3}(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|(?<=\s)dot(?=\s))\s{0,3}|\.)[A-Za-z0-9-]{2,}", re.I | re.A)


def plain_marks(text: str) -> Layer:
    """"[at]", "(at)" become @; a bare "at" does so only before a host whose dot is disguised too; so does "dot"."""
    edits = []
    for m in _AT.finditer(text):
        bracketed = any(c in m[0] for c in "[({<")
        before = m.start() > 0 and _AROUND.match(text, m.start() - 1)
        host = _BARE_HOST.match(text, m.end())
        if before and host and (bracketed or not re.fullmatch(r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+", host[0], re.A)):
            edits.append((*m.span(), "@"))
    for m in _DOT.finditer(text):
        if m.start() > 0 and _AROUND.match(text, m.start() - 1) and _AROUND.match(text, m.end()):
            edits.append((*m.span(), "."))
    edits.sort()
    apart, done = [], 0
    for e in edits:
        if e[0] >= done:
            apart.append(e)
            done = e[1]
    return Layer(text, apart)


_AT_HOST = re.compile(r"[\x20\t]{1,3}at[\x20\t]{1,3}(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*?\.[A-Za-z]{2,}(?![A-Za-z0-9-]))", re.I | re.A)
_MAILBOX = re.compile(
    r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z][A-Za-z0-9%+-]{0,62}[._][A-Za-z0-9._%+-]{0,62}|(?<![A-Za-z])e?-?mail[\x20\t]?:[\x20\t]{0,3}[A-Za-z0-9._%+-]{0,63})[A-Za-z0-9]\Z", re.I | re.A
)


def plain_at(text: str) -> Layer:
    """A bare "at" before a plain host becomes @ behind a name with a dot or underscore in it, or behind "mail:" and any name.

    "jane.doe at example.com" and "E-mail: jane at example.com" are addresses; "jane at example.com" has the form of
    "look at example.com" and stays.
    """
    return Layer(text, [(*m.span(), "@") for m in _AT_HOST.finditer(text) if _MAILBOX.search(text[max(0, m.start() - 160) : m.start()])])


_MARK_CUE = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|\sdot\s", re.I | re.A)


def disguised_spans(text: str) -> dict[str, list[Span]]:
    """Spans of ``text`` whose normalised form matches a base pattern; empty where nothing is disguised."""
    layers = []

    def put(make):
        layer = make(layers[-1].text if layers else text)
        if layer.out_start:
            layers.append(layer)

    if not text.isascii():
        put(plain_letters)
    now = layers[-1].text if layers else text
    low = now.lower()
    if any(name in low for name in _NAMES) and _SPELLED_CUE.search(now):
        put(plain_digits)
    if "plus" in low:
        put(plain_plus)
    if ("dot" in low or any(c in now for c in "[({<")) and _MARK_CUE.search(now):
        put(plain_marks)
    if "at" in low:
        put(plain_at)
    if not layers:
        return {}
    found = {}
    for kind, spans in plain_spans(layers[-1].text).items():
        back = []
        for start, end in spans:
            for layer in reversed(layers):
                start, end = layer.source(start, end)
            back.append((start, end))
        found[kind] = back
    return found


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, base and added spans) by kind; an added span overlaps no span of its kind."""
    base = plain_spans(text)
    hidden = disguised_spans(text)
    every = {}
    for kind in KINDS:
        plain, added, end = base[kind], [], 0
        for s in hidden.get(kind, ()):  # in order, as the way back to the source keeps it
            if s[0] >= end and all(s[1] <= a or b <= s[0] for a, b in _near(plain, s)):
                added.append(s)
                end = s[1]
        every[kind] = sorted(plain + added)
    return base, every


def _near(spans: list[Span], span: Span) -> list[Span]:
    i = bisect_right(spans, span)
    return spans[max(0, i - 1) : i + 1]


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["_text"]:
            base, every = all_spans(text or "")
            plain = {(kind, *s) for kind in KINDS for s in base[kind]}
            found = [(kind, a, b, (kind, a, b) not in plain) for kind in KINDS for a, b in every[kind]]
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), found))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])
        out.insert(0, "_id", frame["_id"].to_numpy())
        yield out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the personal data in its whole text.

    ``found`` lists (kind, start, end, disguised) by kind, then start, in code points of the source text, end exclusive.
    Base spans match the patterns in the text as it is. Three transducers then rewrite the text (look-alike letters and
    hidden characters; spelled digits; written-out marks), each keeping the way back to its source; matches in the
    rewritten text that overlap no span of their kind are added with their source span. ``n_*`` and ``base_sha256``
    are of the base spans, ``spans`` of all.

    Null and empty texts have no span. Ids may be null or repeat; each row is scanned by itself, in time linear in its
    length. Other columns are ignored, and an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    return base.mapInPandas(
        _scan,
        f"_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>",
    ).withColumnRenamed("_id", id_col)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, disguised ones included, replaced by its kind in angle brackets; null stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            _, every = all_spans(text)
            parts, done = [], 0
            for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in every[k]):
                if a >= done:
                    parts += [text[done:a], f"<{kind}>"]
                done = max(done, b)
            return "".join([*parts, text[done:]])

        return texts.map(one, na_action=None)

    return docs.withColumn(text_col, mask(F.col(text_col)))
