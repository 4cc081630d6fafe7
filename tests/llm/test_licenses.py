import random
import re

import pytest

from feedpanel.llm.licenses import Index, NOTICES, document_frequencies, license_scan, template, templates, words_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = []
    for t in templates():
        for begin in range(-len(t.words), len(words)):
            same = {i for i, w in enumerate(t.words) if 0 <= begin + i < len(words) and words[begin + i] == w}
            if len(same) >= t.least and same >= set(t.keys):
                found.append((begin, t, len(same) / len(t.words)))
    base = [(b, t.label) for b, t, _ in found if t.base]
    return (
        len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
        ",".join(sorted({x for _, x in base})), ",".join(sorted({t.label for _, t, _ in found})), max((s for *_, s in found), default=0.0),
    )


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def got(frame):
    return sorted((str(r.doc_id), repr([r[n] for n in NAMES])) for r in frame.collect())


def want(rows):
    return sorted((str(i), repr(list(brute(t)))) for i, t in rows)


def texts():
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", "MIT License", "mit  licenseé", "the MIT\n# License. MIT-license", "general public license general public license", "İMIT license", "apache license mit license " * 40])]
    filler = "the of and license public software in any version copy".split()
    for n, (_, notice, _) in enumerate(NOTICES):
        words = notice.split()
        for kind in range(6):
            w = list(words)
            if kind == 1:
                w[rng.randrange(len(w))] = "other"
            elif kind == 2:
                w = [x if rng.random() < 0.8 else "x" for x in w]
            elif kind == 3:
                w = w[: int(len(w) * 0.9)]
            elif kind == 4:
                w = w[max(1, len(w) // 10) :]
            elif kind == 5:
                w.insert(rng.randrange(len(w)), "inserted")
            lead = [rng.choice(filler) for _ in range(rng.choice([0, 3, 30]))] if kind not in (3, 4) else []
            tail = [rng.choice(filler) for _ in range(rng.choice([0, 5]))] if kind not in (3, 4) else []
            rows.append((100 * n + kind + 1000, " \n * ".join(lead + w + tail)))
    return rows


@pytest.mark.filterwarnings("ignore")
def test_against_brute_force(spark):
    rows = [*texts(), (5, "mit license"), (5, "mit license"), (None, "x " * 200_000 + "mit license " + "licensed under CC BY-NC 4.0")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, id int, matches string").repartition(3)
    assert got(license_scan(frame)) == want(rows)
    assert license_scan(frame.limit(0)).count() == 0
    assert dict(license_scan(frame.withColumn("doc_id", frame.doc_id.cast("string"))).dtypes)["doc_id"] == "string"


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = license_scan(docs)
    assert got(found) == want(rows)
    assert {r.labels for r in found.collect()} > {""}


def test_rarest_words_are_looked_up(spark):
    frame = spark.createDataFrame([("mit license",), ("license",), ("public license",), (None,)], "text string")
    known = [template("mit", "mit license", ["mit license"], 1.0, True), template("x", "public domain license text here", [], 0.6)]
    frequencies = document_frequencies(frame, known)
    assert frequencies == {"mit": 1, "license": 3, "public": 1, "domain": 0, "text": 0, "here": 0}
    index = Index(known, frequencies)
    assert {index.vocabulary[w] for w in index.postings} == {"mit", "domain", "here", "text"}
    assert words_of("GPL-3.0, v2") == ["gpl", "3", "0", "v2"]
    with pytest.raises(ValueError):
        template("x", "a b", ["c"])
