"""Licence notices in texts, found by a positional index of the rarest words of licence templates.

A template is a notice as a run of words. It stands at a place of a text if enough of its words stand at their distances
from that place, its key phrases among them. Words of templates are ranked by how few documents hold them (inverse document
frequency over all documents); the index holds for each template only its rarest words, as many as a match cannot do
without: of ``m`` words of which ``a`` must agree, any ``m - a + 1`` hold one that does. So a text's words are looked up
in short posting lists (template, place in it), the lists are intersected by relative place, and only places that came up
are verified. No match is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.llm.words import LOWER, Words, blocks

#: Share of a notice's words that must stand at their places.
SHARE = 0.8

#: Phrases whose every place counts, and their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

#: Label, notice, phrases of it that must stand there word by word.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
        ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ["with or without fee is hereby granted"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met""",
        ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
        ["neither the name of", "to endorse or promote products"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License
        at http://www.apache.org/licenses/LICENSE-2.0""",
        ["apache org licenses license 2 0"]),
    ("gpl-2.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License""",
        ["gnu general public license", "version 2 of the license"]),
    ("gpl-3.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License""",
        ["gnu general public license", "version 3 of the license"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("lgpl", """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
        ["gnu lesser general public license"]),
    ("agpl", """under the terms of the GNU Affero General Public License as published by the Free Software Foundation""",
        ["gnu affero general public license"]),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at""",
        ["mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0 universal"]),
    ("mit", "SPDX-License-Identifier: MIT", ["license identifier mit"]),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ["license identifier apache 2 0"]),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", ["license identifier bsd 3 clause"]),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0", ["license identifier gpl 2 0"]),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0", ["license identifier gpl 3 0"]),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", ["license identifier mpl 2 0"]),
]

#: Bytes that part words, after A-Z are lower-cased.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_VERIFIED = 1 << 20


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


@dataclass(frozen=True)
class Template:
    """``least`` of the words must agree, those at the places ``keys`` among them; ``base``: every place is reported."""

    label: str
    words: tuple[str, ...]
    keys: tuple[int, ...]
    least: int
    base: bool


def template(label: str, notice: str, phrases: list[str], share: float = SHARE, base: bool = False) -> Template:
    words, keys = words_of(notice), set()
    for phrase in map(words_of, phrases):
        places = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
        if not places:
            raise ValueError(f"a key phrase of {label} is not in its notice")
        keys |= set(range(places[0], places[0] + len(phrase)))
    return Template(label, tuple(words), tuple(sorted(keys)), max(len(keys), math.ceil(share * len(words) - 1e-9)), base)


def templates() -> list[Template]:
    return [template(label, phrase, [phrase], 1.0, True) for label, phrase in PHRASES] + [template(*n) for n in NOTICES]


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    found = Words(np.frombuffer(b" ".join(data) + b" ", np.uint8), offsets, SEPARATOR)
    return found.hashes()


class Index:
    """Postings (template, place) of the rarest words, by the number of documents that hold a word."""

    def __init__(self, known: list[Template], documents: dict[str, int]):
        self.known = known
        self.vocabulary = sorted({w for t in known for w in t.words})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = [np.array([self.number[w] for w in t.words]) for t in known]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for n, t in enumerate(known):
            rarest = sorted(range(len(t.words)), key=lambda i, t=t: (documents.get(t.words[i], 0), t.words[i], i))
            for place in rarest[: len(t.words) - t.least + 1]:
                self.postings.setdefault(self.number[t.words[place]], []).append((n, place))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("sorted_hashes", "order")}

    @cached_property
    def sorted_hashes(self) -> np.ndarray:
        return np.sort(_hashes(self.vocabulary))

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(_hashes(self.vocabulary))

    def number_words(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for all others."""
        at = np.minimum(np.searchsorted(self.sorted_hashes, hashes), len(self.vocabulary) - 1)
        return np.where(self.sorted_hashes[at] == hashes, self.order[at], -1)

    def matches(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, rows, first words, agreeing words) of all matches in the rows that begin at the words ``first``."""
        hits = np.flatnonzero(np.isin(ids, list(self.postings)))
        order = np.argsort(ids[hits], kind="stable")
        hits, kinds = hits[order], ids[hits][order]
        places: dict[int, list[np.ndarray]] = {}
        for word, listed in self.postings.items():
            lo, hi = np.searchsorted(kinds, [word, word + 1])
            for n, place in listed:
                places.setdefault(n, []).append((hits[lo:hi], place))
        for n, found in places.items():
            if not sum(len(at) for at, _ in found):
                continue
            # a template may begin before its row does, so its row is that of the word that was looked up
            begin = np.concatenate([at - place for at, place in found])
            row = np.searchsorted(first, np.concatenate([at for at, _ in found]), "right") - 1
            begin, row = np.unique(np.stack([begin, row]), axis=1)
            wanted, step = self.ids[n], max(1, _VERIFIED // len(self.ids[n]))
            for lo in range(0, len(begin), step):
                b, r = begin[lo : lo + step], row[lo : lo + step]
                at = b[:, None] + np.arange(len(wanted))
                inside = (at >= first[r][:, None]) & (at < first[r + 1][:, None])
                same = inside & (ids[np.clip(at, 0, len(ids) - 1)] == wanted)
                agreeing = same.sum(1)
                good = (agreeing >= self.known[n].least) & same[:, list(self.known[n].keys)].all(1)
                if good.any():
                    yield n, r[good], b[good], agreeing[good]


def _numbered(index: Index, texts: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, end, data, offsets in blocks(texts):
        words = Words(LOWER[data], offsets, SEPARATOR)
        yield row, end, index.number_words(words.hashes()), words.first


def document_frequencies(docs: DataFrame, known: list[Template], text_col: str = "text") -> dict[str, int]:
    """How many texts hold each word of the templates; as many numbers as those have words."""
    index = Index(known, {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for _, _, ids, first in _numbered(index, batch.column(0)):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                held = np.unique(row[ids >= 0] * len(total) + ids[ids >= 0])
                total += np.bincount(held % len(total), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": pa.array(index.vocabulary), "n": pa.array(total)})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "word string, n bigint")
    return {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


_SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "matches array<struct<label:string,first_word:bigint,last_word:bigint,score:double>>"
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """Licence labels of every text: ``id_col`` and the columns of the scan.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the first and last of them.
    ``labels`` holds the labels of all templates found, ``score`` the largest share of a template's words that agree (0
    without any), ``matches`` every match with its words (from 0; beyond the text's ends where a notice is cut there).
    Texts are read whole; a null text is empty, a text without a label has empty lists. Rows that repeat have a row each;
    other columns are ignored; an empty table gives an empty result. Words are compared by 64-bit hashes.
    """
    known = known or templates()
    index = Index(known, document_frequencies(docs, known, text_col))
    of_id = docs.select(F.col(id_col)).schema[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, ids, first in _numbered(index, batch.column(1)):
                found: list[list] = [[] for _ in range(end - row)]
                base: list[list] = [[] for _ in range(end - row)]
                for n, rows, begin, agreeing in index.matches(ids, first):
                    t, begin = index.known[n], begin - first[rows]
                    for r, b, a in zip(rows.tolist(), begin.tolist(), agreeing.tolist(), strict=True):
                        found[r].append((b, t.label, b + len(t.words) - 1, a / len(t.words)))
                        if t.base:
                            base[r].append((b, t.label))
                columns = {
                    "id": batch.column(0).slice(row, end - row),
                    "n_words": pa.array(np.diff(first)),
                    "n_base": pa.array([len(b) for b in base], pa.int64()),
                    "first_word": pa.array([min(b)[0] if b else None for b in base], pa.int64()),
                    "last_word": pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                    "base_labels": pa.array([",".join(sorted({x for _, x in b})) for b in base], pa.string()),
                    "labels": pa.array([",".join(sorted({m[1] for m in f})) for f in found], pa.string()),
                    "score": pa.array([max((m[3] for m in f), default=0.0) for f in found], pa.float64()),
                    "matches": pa.array(
                        [[{"label": label, "first_word": b, "last_word": e, "score": s} for b, label, e, s in sorted(f)] for f in found],
                        pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())])),
                    ),
                }
                yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, f"id {of_id.dataType.simpleString()}, {_SCHEMA}").withColumnRenamed("id", id_col)
