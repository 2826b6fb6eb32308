"""Fourier analysis of series and segments.

Input rows are (series_id, t, x) with t from 1. Frequencies are exploded next
to each value and summed with map-side partial sums; the count that the angle
needs comes from a window on the same key, so there is one shuffle by series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def l2_normalise(series: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """x over the root of its summed squares."""
    return series.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*keys))))


def dft(series: DataFrame, ks: list[int]) -> DataFrame:
    """(series_id, k, n, re, im) at the listed frequencies."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    counted = series.select("series_id", (F.col("t") - 1).alias("t0"), "x", n.alias("n"))
    rows = counted.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    angle = F.lit(2 * math.pi) * ((F.col("k") * F.col("t0")) % F.col("n")) / F.col("n")
    return rows.groupBy("series_id", "k", "n").agg(
        F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def periodogram(series: DataFrame, ks: list[int]) -> DataFrame:
    """Squared modulus per frequency."""
    return dft(series, ks).select("series_id", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def phase(series: DataFrame, ks: list[int]) -> DataFrame:
    """Argument of each coefficient."""
    return dft(series, ks).select("series_id", "k", F.atan2("im", "re").alias("arg"))


def phase_shift(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """Phase distance of two sets of series with the same keys, per frequency."""
    fa = dft(a, ks).select("series_id", "k", F.col("re").alias("ra"), F.col("im").alias("ia"))
    fb = dft(b, ks).select("series_id", "k", F.col("re").alias("rb"), F.col("im").alias("ib"))
    turn = F.abs(F.atan2(F.col("ia") * F.col("rb") - F.col("ra") * F.col("ib"),
                         F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib"))) / F.lit(2 * math.pi)
    return fa.join(fb, ["series_id", "k"]).select("series_id", "k", turn.alias("shift"))


def extract_band(series: DataFrame, k: int) -> DataFrame:
    """Modulus of the inverse transform of coefficient k alone, with 1 as constant term."""
    w = Window.partitionBy("series_id")
    n = F.count("*").over(w)
    angle = F.lit(2 * math.pi) * ((F.lit(k) * (F.col("t") - 1)) % n) / n
    rows = series.select("series_id", "t", F.cos(angle).alias("c"), F.sin(angle).alias("s"), "x")
    re, im = F.sum(F.col("x") * F.col("c")).over(w), -F.sum(F.col("x") * F.col("s")).over(w)
    rows = rows.select("series_id", "t", "c", "s", re.alias("re"), im.alias("im"))
    real = 1 + F.col("re") * F.col("c") - F.col("im") * F.col("s")
    imag = F.col("re") * F.col("s") + F.col("im") * F.col("c")
    return rows.select("series_id", "t", F.sqrt(real * real + imag * imag).alias("x"))


def segments_as_series(segments: DataFrame) -> DataFrame:
    """Each segment as a series of its own, keyed ``series#segment``."""
    return segments.select(F.concat_ws("#", "series_id", F.col("seg").cast("string")).alias("series_id"),
                           (F.col("pos") + 1).alias("t"), "x")


def coefficient_segments(rows: DataFrame, value: str, index: str) -> DataFrame:
    """Rows keyed ``series#segment`` back to (series_id, seg, xs) with xs in index order."""
    key = F.split("series_id", "#")
    return (rows.groupBy("series_id")
                .agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("_p"))
                .select(key[0].alias("series_id"), key[1].cast("int").alias("seg"), F.col("_p.v").alias("xs")))
