"""Correction of predicted counts by a confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Published confusion matrices, rows are the true class.
FIRST_PERSON_CONFUSION = [[50 / 54, 4 / 54], [10 / 46, 36 / 46]]
ALCOHOL_CONFUSION = [[4093 / 5355, 1262 / 5355], [1430 / 10295, 8865 / 10295]]
ALCOHOL_CONFUSION_LARGE = [[95351 / 100000, 4649 / 100000], [1430 / 10295, 8865 / 10295]]


def corrected(series: DataFrame, confusion: list[list[float]], shift: bool = True) -> DataFrame:
    """True counts (x, negative) from predicted x of total.

    Solves [t0, t1] M = [p0, p1] for every hour; with ``shift`` the positive
    series is moved so that its minimum is zero and the negative one is what
    remains of the total.
    """
    (a, b), (c, d) = confusion
    det = a * d - b * c
    p0, p1 = F.col("total") - F.col("x"), F.col("x")
    out = series.withColumns({"negative": (p0 * d - p1 * c) / det, "positive": (p1 * a - p0 * b) / det})
    if shift:
        low = F.min("positive").over(Window.partitionBy("series_id"))
        out = out.withColumn("positive", F.col("positive") - low)
        out = out.withColumn("negative", F.col("total") - F.col("positive"))
    return out.select("series_id", "t", F.col("positive").alias("x"), "negative", "total")
