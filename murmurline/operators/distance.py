"""Dissimilarity of segments within a group.

Input is one row per segment: ``series_id, seg, xs`` with the values in order.
The segments of a group are days or weeks of one calendar, at most 62; the
whole matrix of a group therefore fits one row, pairs come from slices of that
row, and the scale axis is the number of groups. No join takes place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SEGMENTS = 62

Measure = Callable[[Column, Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def euclidean(a: Column, b: Column) -> Column:
    """Root of summed squared differences."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2_normalised(xs: Column) -> Column:
    """Vector over its length."""
    norm = F.sqrt(_sum(F.transform(xs, lambda x: x * x)))
    return F.transform(xs, lambda x: x / norm)


def fourier(xs: Column, k: int) -> Column:
    """(re, im) of the k-th Fourier coefficient of an array."""
    angle = lambda i: F.lit(2 * np.pi * k) * i / F.size(xs)
    return F.struct(
        _sum(F.transform(xs, lambda x, i: x * F.cos(angle(i)))).alias("re"),
        (-_sum(F.transform(xs, lambda x, i: x * F.sin(angle(i))))).alias("im"))


def phase_distance(k: int) -> Measure:
    """Phase difference at frequency k as a share of a full turn."""

    def measure(a: Column, b: Column) -> Column:
        fa, fb = fourier(a, k), fourier(b, k)
        cross = fa["im"] * fb["re"] - fa["re"] * fb["im"]
        dot = fa["re"] * fb["re"] + fa["im"] * fb["im"]
        return F.abs(F.atan2(cross, dot)) / F.lit(2 * np.pi)

    return measure


PackedMeasure = Callable[[np.ndarray], np.ndarray]


def packed_euclidean(x: np.ndarray) -> np.ndarray:
    """:func:`euclidean` of all pairs of segments (replicate, segment, position) at once: (replicate, segment, segment)."""
    total = np.zeros((*x.shape[:2], x.shape[1]))
    for k in range(x.shape[2]):
        total += (x[:, :, None, k] - x[:, None, :, k]) ** 2
    return np.sqrt(total)


def packed_phase(k: int) -> PackedMeasure:
    """:func:`phase_distance` of all pairs of segments at once."""

    def measure(x: np.ndarray) -> np.ndarray:
        angle = 2 * np.pi * k * np.arange(x.shape[2]) / x.shape[2]
        re, im = x @ np.cos(angle), -(x @ np.sin(angle))
        cross = im[:, :, None] * re[:, None, :] - re[:, :, None] * im[:, None, :]
        dot = re[:, :, None] * re[:, None, :] + im[:, :, None] * im[:, None, :]
        return np.abs(np.arctan2(cross, dot)) / (2 * np.pi)

    return measure


def segment_pairs(segments: DataFrame, full: bool = False, value: str = "xs") -> DataFrame:
    """(group_id, a, b, xa, xb) for every pair of segments of a group."""
    # One row per (group, seg) and seg within the calendar: the list is bounded before it is built.
    seg = F.when(F.col("seg").between(1, MAX_SEGMENTS), F.col("seg")).otherwise(
        F.raise_error(F.lit(f"segment numbers run from 1 to {MAX_SEGMENTS}")))
    packed = (segments.groupBy(F.col("series_id").alias("group_id"))
              .agg(F.array_sort(F.collect_list(F.struct(seg.alias("seg"), F.col(value).alias("v")))).alias("m")))
    left = packed.select("group_id", "m", F.posexplode("m").alias("_i", "_a"))
    others = F.col("m") if full else F.slice("m", F.col("_i") + 2, F.lit(MAX_SEGMENTS))
    return (left.select("group_id", "_a", F.explode(others).alias("_b"))
                .select("group_id", F.col("_a.seg").alias("a"), F.col("_b.seg").alias("b"),
                        F.col("_a.v").alias("xa"), F.col("_b.v").alias("xb")))


def distances(segments: DataFrame, measure: Measure, full: bool = False, value: str = "xs") -> DataFrame:
    """Edge table (group_id, a, b, d), a < b unless ``full``."""
    pairs = segment_pairs(segments, full, value)
    return pairs.select("group_id", "a", "b", measure(F.col("xa"), F.col("xb")).alias("d"))


@F.pandas_udf(T.DoubleType())
def _dtw(a: pd.Series, b: pd.Series) -> pd.Series:
    """Warping cost of many pairs at once: one cell of all pairs per step."""
    x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
    n, m = x.shape[1], y.shape[1]
    above = np.full((m + 1, len(x)), np.inf)
    for i in range(n):
        row = np.full((m + 1, len(x)), np.inf)
        for j in range(m):
            cost = np.abs(x[:, i] - y[:, j])
            reached = np.minimum(np.minimum(above[j + 1], row[j]) + cost, above[j] + 2 * cost)
            row[j + 1] = cost if i == j == 0 else reached
        above = row
    return pd.Series(above[m])


def warping(a: Column, b: Column) -> Column:
    """Dynamic time warping, symmetric steps with weight 2 on the diagonal."""
    return _dtw(a, b)
