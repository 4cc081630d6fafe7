"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import re

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPACES.findall(text or "")


def shingle_set(text, width=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes_of(texts, similarity=0.8):
    """{key: least key of its class} for {key: text}; texts without words stand alone."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    where = {}
    for k in keys:
        for s in sets[k]:
            where.setdefault(s, []).append(k)
    for a in keys:
        met = {b for s in sets[a] for b in where[s] if b > a}
        for b in met:
            inter = len(sets[a] & sets[b])
            if inter / (len(sets[a]) + len(sets[b]) - inter) >= similarity:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}
