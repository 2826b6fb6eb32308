"""Composite jobs a user runs end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurline.functions.scores import proportion_error, ratio_or_zero
from murmurline.operators import clustering, correlation, distance, profiles, series, spectral, summary


def two_month_series(first: DataFrame, second: DataFrame, threshold: float | Column = 5000.0,
                     spans: tuple[tuple[int, int], tuple[int, int]] = (series.SLICES["june"], series.SLICES["sept"])) -> DataFrame:
    """Counts and totals of two 28-day months in a row, 1,344 hours per series (K1)."""
    parts = [series.slice_hours(series.clean_series(s, threshold), *span) for s, span in zip((first, second), spans)]
    return series.two_months(*parts)


def subclass_share(part: DataFrame, whole: DataFrame) -> DataFrame:
    """part/whole per hour with 0/0 as 0; both are two-month count series."""
    return series.combine_series(part, whole, ratio_or_zero(F.col("xa"), F.col("xb")))


def hour_of_week_band(shares: DataFrame) -> DataFrame:
    """Mean and quartiles over the weeks for each hour of the week (K3)."""
    weeks = series.split_segments(shares, 168)
    return (profiles.across_weeks(weeks).select("series_id", "pos", "mean")
            .join(profiles.quantile_band(weeks, ["series_id", "pos"]), ["series_id", "pos"]))


def hour_of_week_total(counts: DataFrame) -> DataFrame:
    """Sum over the weeks for each hour of the week (K4)."""
    return profiles.across_weeks(series.split_segments(counts.select("series_id", "t", "x"), 168)).select(
        "series_id", "pos", "total")


def cluster_segments(values: DataFrame, length: int, order: dict[str, int] | None = None, per_series: int = 31,
                     leave_out: list[int] | None = None, normalise: bool = False, measure: distance.Measure = distance.euclidean) -> DataFrame:
    """Tree over the days or weeks of one or several series.

    ``order`` puts the listed series side by side in one group: series number i
    gets the segment numbers from (i - 1) x ``per_series`` + 1. ``leave_out``
    drops segments by number.
    """
    segs = series.split_segments(values.select("series_id", "t", "x"), length)
    if order:
        place = F.coalesce(*[F.when(F.col("series_id") == s, F.lit(i - 1)) for s, i in order.items()])
        number = F.when(F.col("seg") <= per_series, F.col("seg") + place * per_series).otherwise(
            F.raise_error(F.lit(f"a series has more than {per_series} segments")))
        segs = segs.select(F.lit("all").alias("series_id"), number.cast("int").alias("seg"), "pos", "x")
    if leave_out:
        segs = segs.where(~F.col("seg").isin(*leave_out))
    arrays = series.segment_arrays(segs)
    if normalise:
        arrays = arrays.withColumn("xs", distance.l2_normalised(F.col("xs")))
    return clustering.average_linkage(distance.distances(arrays, measure))


def six_hour_series(counts: DataFrame, span: tuple[int, int] = (5, 116)) -> DataFrame:
    """Six-hour counts of 28 days."""
    grid = series.hour_grid(summary.six_hour_buckets(counts), step=6)
    return series.slice_hours(grid, *span)


def source_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of two profiles, each relative to its sum (K6)."""
    pairs = profiles.relative_to(a, "sum").select("series_id", "t", F.col("x").alias("xa")).join(
        profiles.relative_to(b, "sum").select("series_id", "t", F.col("x").alias("xb")), ["series_id", "t"])
    return correlation.pearson(pairs)


def by_week_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs of the same month side by side, week by week (K7)."""
    a = series.split_segments(old.select("series_id", "t", "x"), 168).withColumnRenamed("x", "old")
    b = series.split_segments(new.select("series_id", "t", "x"), 168).withColumnRenamed("x", "new")
    return a.join(b, ["series_id", "seg", "pos"])


def age_comparison(group: DataFrame) -> DataFrame:
    """L2-normalised weeks with their binomial band; input has x and total (K9)."""
    weeks = series.split_segments(group, 168)
    w = Window.partitionBy("series_id", "seg")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(w))
    err = F.lit(1.96) * proportion_error(F.col("x"), F.col("total")) * F.col("total") / norm
    mid = F.col("x") / norm
    return weeks.select("series_id", "seg", "pos", mid.alias("x"), (mid - err).alias("low"), (mid + err).alias("high"))


def window_periodogram(shares: DataFrame, first: int, last: int, ks: list[int]) -> DataFrame:
    """Periodogram of a stretch of hours."""
    return spectral.periodogram(series.slice_hours(shares.select("series_id", "t", "x"), first, last), ks)
