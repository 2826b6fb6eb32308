"""Hourly counts per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(ts: str | Column) -> Column:
    """Calendar month of a time, as in 2016-06."""
    return F.date_format(ts, "yyyy-MM")


def hourly_summary(df: DataFrame, flags: dict[str, Column], ts: str = "local_time",
                   by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by..., class, day, hour, sum, len) of every flag in one pass (A1, A2).

    The key is (day, hour), for rows of one month; :func:`monthly_summary` keeps months apart.

    One two-phase aggregate: each task reduces its rows to at most 31 x 24 per
    series before anything is shuffled, so a series holding most of the table
    costs no more than any other.
    """
    counted = (df.select(*by, F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"),
                         *[c.cast("long").alias(f"_f_{n}") for n, c in flags.items()])
                 .groupBy(*by, "day", "hour")
                 .agg(F.count("*").alias("len"), *[F.sum(f"_f_{n}").alias(n) for n in flags]))
    return (counted.unpivot([*by, "day", "hour", "len"], list(flags), "class", "sum")
                   .select(*by, "class", "day", "hour", "sum", "len"))


def monthly_summary(df: DataFrame, flags: dict[str, Column], ts: str = "local_time", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by..., month, class, day, hour, sum, len): any number of months, of any length, in one run (A1, A2)."""
    return hourly_summary(df.withColumn("month", month_of(ts)), flags, ts, (*by, "month"))


def month_series(summary: DataFrame, series: str = "class") -> DataFrame:
    """Summary rows with a series of its own for each month, keyed ``series@month``, and the days of the month."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    return summary.select(F.concat_ws("@", series, "month").alias("series_id"), "day", "hour", "sum", "len",
                          F.dayofmonth(F.last_day(first)).alias("days"))


def merge_summaries(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of partial summaries (A3), by month where they have one."""
    by = (*by, "month") if "month" in partials.columns and "month" not in by else by
    return (partials.groupBy(*by, "class", "day", "hour")
                    .agg(F.sum("sum").cast("long").alias("sum"), F.sum("len").cast("long").alias("len")))


def volume_total(summary: DataFrame, base: str) -> DataFrame:
    """Rows per hour, from the ``len`` of any one class (A4)."""
    return summary.where(F.col("class") == base).select(
        *[c for c in summary.columns if c not in ("class", "sum", "len")], F.col("len").alias("tweets"))


def as_series(summary: DataFrame, series: str | Column) -> DataFrame:
    """Summary rows keyed by ``series_id``."""
    key = F.col(series) if isinstance(series, str) else series
    return summary.select(key.cast("string").alias("series_id"), "day", "hour", "sum", "len")


def six_hour_buckets(summary: DataFrame) -> DataFrame:
    """Six consecutive hours to one row, four rows a day."""
    return (summary.groupBy("series_id", "day", (F.floor(F.col("hour") / 6) * 6).cast("int").alias("hour"))
                   .agg(F.sum("sum").cast("long").alias("sum"), F.sum("len").cast("long").alias("len")))
