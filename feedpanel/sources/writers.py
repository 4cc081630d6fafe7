"""Writers. Nothing is overwritten unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compress: bool = True) -> None:
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer.csv(path, compression="gzip" if compress else "none")


def write_by_month(df: DataFrame, path: str, time: str = "created_at", mode: str = "errorifexists") -> None:
    """Parquet partitioned by month, so a period reads only its months. Rows of a
    month spread over several tasks; adaptive execution splits heavy months."""
    monthly = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    monthly.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def replace_months(df: DataFrame, path: str, time: str = "created_at") -> None:
    """Writes the months of ``df`` into a folder of ``write_by_month``. A month that is
    there already is replaced as a whole; months without rows in ``df`` stay as they
    are, so a rerun of one month leaves neither repeats nor gaps."""
    monthly = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    writer = monthly.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(path)


def write_split(df: DataFrame, path: str, rows: int = 30_000_000, mode: str = "errorifexists") -> None:
    """Compressed CSV files of at most ``rows`` rows."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("maxRecordsPerFile", rows).csv(
        path, compression="gzip"
    )
