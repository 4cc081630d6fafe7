"""The corpus pipeline: five stages, each from a table of documents to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpanel.llm import decontaminate, language, line_dedup, mixing, near_dedup
from feedpanel.session import apply_defaults, materialize, work_tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language the network is sure of, go."""
    return language.keep_known(docs, language.fit(docs))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go, and documents of which no line stays; n_chars follows."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with ``copies``: how often."""
    return mixing.mixed_docs(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", new_lines),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
]

#: Signatures, a trained network and suffix arrays have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input.

    A stage's own work tables go when its result is written; the results stay until ``session.clean``. An empty table gives an empty result. Nulls, empty texts and repeated rows are treated as the stages' operators say.
    """
    apply_defaults(spark)
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        if number == len(STAGES):
            return stage(spark, docs, sf_dir)
        with work_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), outer=True)
    return docs
