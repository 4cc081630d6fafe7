import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import test_decontaminate as decontaminate_tests
import test_line_dedup as line_tests
from brute import classes_of, words_of
from feedpanel.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of every stage, and the last one's output; a few odd rows are added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-3, "12 34", None, None, 5), (None, "The and of that with this.", "en", None, 26)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_order(steps):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["language", "line", "MinHash", "benchmark", "mixing"]
    for frame in steps[:-1]:
        assert frame.columns == steps[0].columns


def test_language_keeps_texts_with_words(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert not {-1, -2, -3} & after.keys() and None in after
    assert len(after) > 0.98 * len(before) - 3


def test_line_dedup(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    gone = {d: set(map(int, x.split(","))) if x else set() for d, *_, x in line_tests.brute(before, 8)}
    want = {}
    for doc, text in before:
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone[str(doc)]]
        if any(map(words_of, kept)) or not any(map(words_of, lines)):
            want[doc] = "\n".join(kept)
    after = rows(steps[2])
    assert {k: r.text for k, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_dedup(steps):
    texts = {r.doc_id: r.text for r in steps[2].collect() if r.doc_id is not None}
    classes = classes_of(texts)
    assert rows(steps[3]).keys() - {None} == {k for k, v in classes.items() if k == v}


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate_tests.brute([(r.doc_id, r.text) for r in steps[3].collect()], items, 10)
    assert {str(k) for k in rows(steps[4])} == {x[0] for x in found if not x[5]}


def test_mix_takes_the_budget(steps):
    total = sum(len(words_of(r.text)) for r in steps[4].collect())
    taken = sum(len(words_of(r.text)) * r.copies for r in steps[5].collect())
    assert 0.9 * total < taken <= total and {r.copies for r in steps[5].collect()} <= {1.0, 2.0, 3.0}


def test_entry_runs_the_pipeline(spark):
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    ops = {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert ops == {f"op{i}" for i in range(1, 14)}
    assert corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] > 50
