"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every flow relies on. Joins carry no size hints: adaptive execution
# broadcasts a side only after measuring it and splits skewed partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    Tasks with two Python steps start two worker processes each. No more than one
    per core stay for later stages, so these load a scorer that often at most.
    """
    kept = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("feedpanel")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.factory.idleWorkerMaxPoolSize", str(kept))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_work: dict[str, str] = {}
_owners: list[list[str]] = [[]]


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    Only a local master may go without: it gets a fresh folder of its own, which
    goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if folder.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"{folder} must be mounted on every executor", stacklevel=2)
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_work:
        _local_work[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_work[application], ignore_errors=True)
    return _local_work[application]


def materialize(df: DataFrame, outer: bool = False) -> DataFrame:
    """Writes ``df`` once to the work folder and reads it back.

    Cuts the lineage; a lost executor costs only the tasks it was running. The
    table belongs to the innermost ``work_tables`` block (``outer``: the one
    around it), or to the session.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/feedpanel-{uuid.uuid4().hex}"
    _owners[-2 if outer and len(_owners) > 1 else -1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucket_table(df: DataFrame, n: int, cols: Sequence[str], outer: bool = False) -> DataFrame:
    spark, name = df.sparkSession, f"feedpanel_{uuid.uuid4().hex}"
    path = f"{work_folder(spark)}/{name}"
    _owners[-2 if outer and len(_owners) > 1 else -1].append(path)
    written = df.write.bucketBy(n, cols[0], *cols[1:])
    written.format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def bucketed(df: DataFrame, cols: Sequence[str], outer: bool = False) -> DataFrame:
    """Like ``materialize``, laid out in buckets of ``cols``: joins and groups on
    these columns read it without a shuffle.

    A bucket is read by one task, so the columns must not have frequent values
    (ids, not domains or days). There are as many buckets as shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _bucket_table(df.repartition(n, *cols), n, cols, outer)


@lru_cache(8)
def slots(n: int) -> tuple[int, ...]:
    """For each of ``n`` buckets the least whole number that Spark puts there."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(_spark_hash(value) % n, value)
        value += 1
    return tuple(found[i] for i in range(n))


def _spark_hash(value: int) -> int:
    """Spark's ``hash`` of an int: Murmur3 of four bytes with seed 42."""
    mask = (1 << 32) - 1
    k = value * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) * 0x1B873593 & mask
    h = 42 ^ k
    h = (h << 13 | h >> 19) & mask
    h = h * 5 + 0xE6546B64 & mask
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def placed(df: DataFrame, place: str, slot: str) -> DataFrame:
    """Like ``materialize``; rows with equal numbers in the int column ``place``
    (below the number of shuffle partitions) are read again by one task, and rows
    with others by other tasks. Windows and groups that have ``slot`` among their
    keys then need no shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.element_at(F.array(*[F.lit(v) for v in slots(n)]), F.col(place) + 1)
    return _bucket_table(df.withColumn(slot, number), n, [slot])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    while paths:
        name = paths.pop()
        if name.rsplit("/", 1)[1].startswith("feedpanel_"):
            spark.sql(f"DROP TABLE IF EXISTS {name.rsplit('/', 1)[1]}")
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored inside the block when it ends, also on failure.
    What is computed from them must be written before."""
    _owners.append([])
    try:
        yield
    finally:
        _delete(spark, _owners.pop())


def clean(spark: SparkSession) -> None:
    """Deletes all tables this process has stored outside such blocks."""
    _delete(spark, _owners[0])
