"""Regular hourly series from summaries, and their reshaping.

A clean series has the columns ``series_id, t, x, total``; ``t`` is the
1-based hour. Every window is partitioned by the series, and a series has at
most 31 x 24 rows per month, so no task ever holds more than that per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_PER_DAY = 24
HOURS_PER_WEEK = 168

# 28-day slices used for the months, as (first, last) hour.
SLICES = {
    "june": (33, 704),
    "sept": (9, 680),
    "june_local": (49, 720),
    "sept_local": (25, 696),
    "age": (33, 704),
}


def hour_grid(summary: DataFrame, days: int = 30, step: int = 1, keep_outside: bool = True) -> DataFrame:
    """Every hour 1..days x 24 of every series; missing hours count 0.

    Each observed hour also emits the gap up to the next one, so the grid needs
    neither a join nor a second shuffle. Observed hours after the grid (day 31)
    stay as extra rows, as in a full outer merge, unless ``keep_outside`` is off.
    """
    per_day = HOURS_PER_DAY // step
    last = days * per_day
    slot = ((F.col("day") - 1) * per_day + F.floor(F.col("hour") / step) + 1).cast("int")
    seen = summary.select("series_id", slot.alias("slot"), "sum", "len")
    if not keep_outside:
        seen = seen.where(F.col("slot") <= last)
    w = Window.partitionBy("series_id").orderBy("slot")
    following = F.lead("slot").over(w)
    spread = (seen
              .withColumn("_from", F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(F.col("slot")))
              .withColumn("_to", F.least(F.coalesce(following, F.lit(last + 1)) - 1, F.lit(last)))
              .withColumn("t", F.explode(F.when(F.col("slot") > last, F.array("slot"))
                                          .otherwise(F.sequence("_from", "_to")))))
    here = F.col("t") == F.col("slot")
    return spread.select(
        "series_id", "t",
        F.greatest(F.when(here, F.col("sum")).otherwise(0), F.lit(0)).cast("double").alias("x"),
        F.greatest(F.when(here, F.col("len")).otherwise(0), F.lit(0)).cast("double").alias("total"))


def month_grid(summary: DataFrame) -> DataFrame:
    """Every hour of every month of :func:`~murmurline.operators.summary.month_series`, whatever the month's length."""
    seen = summary.select("series_id", ((F.col("day") - 1) * HOURS_PER_DAY + F.col("hour") + 1).cast("int").alias("slot"), "sum", "len", "days")
    w = Window.partitionBy("series_id").orderBy("slot")
    start = F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(F.col("slot"))
    stop = F.coalesce(F.lead("slot").over(w) - 1, F.col("days") * HOURS_PER_DAY)
    rows = seen.select("series_id", "slot", "sum", "len", start.alias("_from"), stop.alias("_to")).withColumn("t", F.explode(F.sequence("_from", "_to")))
    here = F.col("t") == F.col("slot")
    return rows.select("series_id", "t", F.when(here, F.col("sum")).otherwise(0).cast("double").alias("x"),
                       F.when(here, F.col("len")).otherwise(0).cast("double").alias("total"))


def mask_low_volume(grid: DataFrame, threshold: float | Column = 5000.0) -> DataFrame:
    """Both values null where the total is below the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    enough = F.col("total") >= limit
    return grid.select("series_id", "t", F.when(enough, F.col("x")).alias("x"),
                       F.when(enough, F.col("total")).alias("total"))


def share_of_mean(fraction: float) -> Column:
    """Threshold relative to the mean hourly total of the series."""
    return F.lit(fraction) * F.avg("total").over(Window.partitionBy("series_id"))


def carry_forward(masked: DataFrame, columns: tuple[str, ...] = ("x", "total"), compat: bool = False) -> DataFrame:
    """Last observed value carried forward.

    Leading nulls stay in place; with ``compat`` they are dropped and the hours
    renumbered, which shifts every later position.
    """
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = masked.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c)
                             for c in masked.columns])
    if not compat:
        return filled
    kept = filled.where(F.coalesce(*columns).isNotNull())
    return kept.withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("t")))


def clean_series(summary: DataFrame, threshold: float | Column = 5000.0, days: int = 30,
                 compat: bool = False) -> DataFrame:
    """Grid, low-volume mask and carry-forward in one go."""
    return carry_forward(mask_low_volume(hour_grid(summary, days), threshold), compat=compat)


def slice_hours(series: DataFrame, first: int, last: int) -> DataFrame:
    """Hours first..last, renumbered from 1."""
    return series.where(F.col("t").between(first, last)).withColumn("t", F.col("t") - F.lit(first - 1))


def proportion(series: DataFrame) -> DataFrame:
    """x becomes x / total."""
    return series.withColumn("x", F.try_divide(F.col("x"), F.col("total")))


def month_share(summary: DataFrame, span: tuple[int, int], threshold: float | Column = 5000.0) -> DataFrame:
    """Proportion series of a 28-day month (K2)."""
    return proportion(slice_hours(clean_series(summary, threshold), *span))


def two_months(first: DataFrame, second: DataFrame, hours: int = 672) -> DataFrame:
    """Second month appended to the first under the same series key."""
    return first.unionByName(second.withColumn("t", F.col("t") + F.lit(hours)))


def seasonal_log_difference(series: DataFrame, lag: int = HOURS_PER_WEEK, shift: float = 0.0) -> DataFrame:
    """log(x) minus log(x) one period earlier; the first period is dropped."""
    w = Window.partitionBy("series_id").orderBy("t")
    logged = F.ln(F.col("x") + F.lit(shift)) if shift else F.ln("x")
    diffed = series.select("series_id", "t", logged.alias("_l")).withColumn("x", F.col("_l") - F.lag("_l", lag).over(w))
    return (diffed.where(F.col("t") > lag)
                  .select("series_id", (F.col("t") - lag).alias("t"), "x"))


def split_segments(series: DataFrame, length: int) -> DataFrame:
    """Days (24), weeks (168) or six-hour days (4): ``seg`` from 1, ``pos`` from 0."""
    t0 = F.col("t") - 1
    return series.select("series_id", (F.floor(t0 / length) + 1).cast("int").alias("seg"),
                         (t0 % length).cast("int").alias("pos"),
                         *[c for c in series.columns if c not in ("series_id", "t")])


def weekday_cube(series: DataFrame) -> DataFrame:
    """(weekday 1..7, hour 0..23, week 1..) of every hour."""
    t0 = F.col("t") - 1
    return series.select("series_id", (F.floor((t0 % HOURS_PER_WEEK) / 24) + 1).cast("int").alias("weekday"),
                         (t0 % 24).cast("int").alias("hour"),
                         (F.floor(t0 / HOURS_PER_WEEK) + 1).cast("int").alias("week"), "x")


def two_months_by_weekday(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hour-of-week rows of two months.

    First month: weekday (day - 1) mod 7, rows 25..696; second month: weekday
    day mod 7, rows 1..672. Input is in (day, hour) order with x and total.
    """
    day = F.floor((F.col("t") - 1) / 24) + 1
    a = first.where(F.col("t").between(25, 696)).withColumn("dow", F.pmod(day - 1, F.lit(7)))
    b = second.where(F.col("t").between(1, 672)).withColumn("dow", F.pmod(day, F.lit(7)))
    both = a.unionByName(b)
    return both.select("series_id", F.col("dow").cast("int").alias("dow"),
                       ((F.col("t") - 1) % 24).cast("int").alias("hour"), "x", "total")


def centered_mean(series: DataFrame, width: int, columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """Centered moving average; positions without a full window are dropped."""
    half = width // 2
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(-half, half)
    out = series.select(*[c for c in series.columns if c not in columns],
                        *[F.avg(c).over(w).alias(c) for c in columns], F.count("*").over(w).alias("_n"))
    return out.where(F.col("_n") == 2 * half + 1).drop("_n")


def lag_matrix(series: DataFrame, lags: int) -> DataFrame:
    """Rows of ``lags`` consecutive values and the value that follows them."""
    w = Window.partitionBy("series_id").orderBy("t")
    before = F.collect_list("x").over(w.rowsBetween(-lags, -1))
    return (series.select("series_id", "t", before.alias("features"), F.col("x").alias("y"))
                  .where(F.size("features") == lags)
                  .select("series_id", (F.col("t") - lags).cast("int").alias("row"), "features", "y"))


def combine_series(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """Hour-by-hour arithmetic of two series, columns a.x and b.x as ``xa``, ``xb``."""
    joined = (a.select("series_id", "t", F.col("x").alias("xa"))
               .join(b.select("series_id", "t", F.col("x").alias("xb")), ["series_id", "t"]))
    return joined.select("series_id", "t", value.alias("x"))


def wide_segments(segments: DataFrame, numbers: list[int], prefix: str = "seg") -> DataFrame:
    """One column per listed segment (U5); the list is a calendar, so the width is fixed."""
    out = segments.groupBy("series_id", "pos").pivot("seg", numbers).agg(F.first("x"))
    return out.select("series_id", "pos", *[F.col(str(n)).alias(f"{prefix}_{n}") for n in numbers])


def long_segments(wide: DataFrame, prefix: str = "seg") -> DataFrame:
    """Inverse of :func:`wide_segments` (U4)."""
    cols = [c for c in wide.columns if c.startswith(f"{prefix}_")]
    out = wide.unpivot(["series_id", "pos"], cols, "seg", "x")
    return out.withColumn("seg", F.substring_index("seg", "_", -1).cast("int"))


def segment_arrays(segments: DataFrame, value: str = "x") -> DataFrame:
    """One row per segment with its values in order; at most 168 (week) values each."""
    return (segments.groupBy("series_id", "seg")
                    .agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("_p"))
                    .select("series_id", "seg", F.col("_p.v").alias("xs")))


def series_arrays(series: DataFrame, value: str = "x") -> DataFrame:
    """One row per series with its values in order; at most two months of hours."""
    return (series.groupBy("series_id")
                  .agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("_p"))
                  .select("series_id", F.col("_p.v").alias("xs")))
