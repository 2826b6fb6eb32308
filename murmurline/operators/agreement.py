"""Two ratings of the same posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def double_rated(old: DataFrame, new: DataFrame, key: str = "_id", label: str = "y") -> DataFrame:
    """(key, old, new) where both rounds gave a label."""
    return (old.select(key, F.col(label).alias("old")).join(new.select(key, F.col(label).alias("new")), key)
            .dropna("any", subset=["old", "new"]))


def agreed(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("old") == F.col("new"))


def disagreed(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("old") != F.col("new"))
