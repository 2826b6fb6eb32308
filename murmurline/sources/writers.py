"""Writers and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.operators.ranking import global_position


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One output file per input split, no shuffle."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def with_total_class(summary: DataFrame, base: str) -> DataFrame:
    """Add the ``total`` class, a copy of class ``base``."""
    total = summary.where(F.col("class") == base).withColumn("class", F.lit("total"))
    return summary.unionByName(total)


def write_summary(summary: DataFrame, path: str, base: str | None = None) -> None:
    """One folder per class (S8); a summary is at most classes x 744 rows per series."""
    out = with_total_class(summary, base) if base else summary
    (out.repartition("class").write.mode("errorifexists").partitionBy("class")
        .option("header", True).csv(path))


def write_table(df: DataFrame, path: str) -> None:
    """Adjusted series and experiment tables."""
    df.write.mode("errorifexists").parquet(path)


def exact_blocks(df: DataFrame, order: str, block_size: int = 100_000) -> DataFrame:
    """Number rows by ``order`` and give each a ``block`` of exactly ``block_size`` rows."""
    placed = global_position(df, order)
    return placed.withColumn("block", F.floor((F.col("position") - 1) / block_size).cast("long"))


def write_blocks(df: DataFrame, path: str, block_size: int = 100_000) -> None:
    """Even files of at most ``block_size`` rows (S9): a count, then one round-robin shuffle."""
    files = max(1, -(-df.count() // block_size))
    df.repartition(files).write.mode("errorifexists").option("maxRecordsPerFile", block_size).parquet(path)
