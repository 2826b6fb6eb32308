"""Profiles over days and weeks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurline.functions.scores import proportion_error
from murmurline.session import cut_lineage


def hour_of_week_share(rows: DataFrame) -> DataFrame:
    """sum(x) / sum(total) per (weekday, hour) (A5)."""
    return rows.groupBy("series_id", "dow", "hour").agg((F.sum("x") / F.sum("total")).alias("prop"))


def across_weeks(segments: DataFrame, value: str = "x") -> DataFrame:
    """Mean and sum over the weeks for each hour of the week."""
    return segments.groupBy("series_id", "pos").agg(F.avg(value).alias("mean"), F.sum(value).alias("total"))


#: Most values of a group that one task ranks, and bins of a histogram that narrows down a larger group.
GROUP_VALUES, BINS = 100_000, 1024
#: The greatest finite number.
_MOST = float(np.finfo(float).max)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], most: int = GROUP_VALUES) -> DataFrame:
    """(keys..., q): linearly interpolated quantiles of the known values of each group, in the order of ``probs``.

    Groups of up to ``most`` values are ranked as they are. A larger group, however large, is narrowed down: a histogram
    tells in which bin a rank lies, then only that bin's values count, until few are left or all are equal. No task ever
    holds the values of a large group; values are written once and read again for each narrowing.
    """
    rows = cut_lineage(df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_v"))
                       .where("_v IS NOT NULL AND NOT isnan(_v)"), "quantile-values")
    ks = [f"_k{i}" for i in range(len(keys))]
    sizes = cut_lineage(rows.groupBy(*ks).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "group-sizes")
    large = sizes.where(F.col("_n") > most)
    array = "array(" + ", ".join(repr(float(p)) for p in probs) + ")"
    some = large.limit(1).count() > 0
    small = _matching(rows, large, ks, "left_anti") if some else rows
    out = small.groupBy(*ks).agg(F.expr(f"percentile(_v, {array})").alias("q"))
    if some:
        out = out.unionByName(_selected(rows, large, ks, probs, most))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "q")


def _matching(rows: DataFrame, groups: DataFrame, ks: list[str], how: str) -> DataFrame:
    """Join on keys that may be null."""
    other = groups.select(*[F.col(k).alias(f"{k}_") for k in ks], *[c for c in groups.columns if c not in ks])
    same = F.lit(True)
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    joined = rows.join(other, same, how)
    return joined if how == "left_anti" else joined.drop(*[f"{k}_" for k in ks])


def _selected(rows: DataFrame, large: DataFrame, ks: list[str], probs: list[float], most: int) -> DataFrame:
    """Quantiles of groups too large for one task."""
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[r.cast("long") for x in h for r in (F.floor(x), F.ceil(x))]))
    # one row per group and wanted rank (from 0): the values it may lie between and how many values are below them
    state = cut_lineage(large.select(*ks, "_lo", "_hi", F.col("_n").alias("_m"), F.lit(0).cast("long").alias("_below"), F.explode(ranks).alias("_r")), "ranks")
    round_no = 0
    while state.where((F.col("_m") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        open_ranks = (F.col("_m") > most) & (F.col("_lo") < F.col("_hi"))
        done = state.where(~open_ranks)
        mine = _matching(rows, state.where(open_ranks), ks, "inner").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # bins of equal width of the values or, every other time, of their logarithms; both grow with the values, and the
        # least and the greatest value never share a bin of the first kind
        low, high = F.greatest("_lo", F.lit(-_MOST)), F.least("_hi", F.lit(_MOST))
        half = F.when((low < -_MOST / 4) | (high > _MOST / 4), 0.5).otherwise(1.0)
        scale = F.asinh if round_no % 2 else lambda c: c * half
        place = F.try_divide(scale(F.col("_v")) - scale(low), scale(high) - scale(low)) * BINS
        bins = mine.withColumn("_bin", F.least(F.greatest(F.coalesce(place, F.lit(0.0)), F.lit(0.0)), F.lit(BINS - 1.0)).cast("int"))
        counts = bins.groupBy(*ks, "_r", "_below", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*ks, "_r").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = counts.withColumn("_below", F.col("_below") + before).where(
            (F.col("_r") >= F.col("_below")) & (F.col("_r") < F.col("_below") + F.col("_c")))
        state = cut_lineage(narrowed.select(*ks, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_c").alias("_m"), "_below", "_r")
                            .unionByName(done), "ranks")
        round_no += 1
    left = _matching(rows, state.where("_lo < _hi"), ks, "inner").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    counted = left.groupBy(*ks, "_r", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*ks, "_r").orderBy("_v")) + F.col("_below")
    ranked = counted.withColumn("_upto", upto).where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
    values = ranked.select(*ks, "_r", "_v").unionByName(state.where("_lo = _hi").select(*ks, "_r", F.col("_lo").alias("_v")))
    packed = values.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))  # two ranks a quantile
    whole = _matching(packed, large.select(*ks, "_n"), ks, "inner")

    def quantile(x):
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when(low == high, a).otherwise((high - x) * a + (x - low) * b)

    return whole.select(*ks, F.array(*[quantile(x) for x in h]).alias("q"))


def quantile_band(df: DataFrame, keys: list[str], value: str = "x", low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Linear-interpolated quantiles per key."""
    return exact_quantiles(df, keys, value, [low, high]).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def relative_to(series: DataFrame, stat: str = "avg") -> DataFrame:
    """x over its series mean (``avg``) or sum (``sum``)."""
    base = getattr(F, stat)("x").over(Window.partitionBy("series_id"))
    return series.withColumn("x", F.col("x") / base)


def replicate_band(df: DataFrame, keys: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean, variance, normal 95 % interval and quantiles of replicates."""
    kept = cut_lineage(df.select(*keys, value), "replicates")
    half = F.lit(1.96) * F.sqrt("var") / F.sqrt("n")
    moments = kept.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("n"))
    ks = [f"_k{i}" for i in range(len(keys))]
    quantiles = exact_quantiles(kept, keys, value, [low, high]).toDF(*ks, "_q")
    same = F.lit(True)
    for k, q in zip(keys, ks):
        same = same & F.col(k).eqNullSafe(F.col(q))
    return moments.join(quantiles, same, "left").select(
        *keys, "mean", "var", "n", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
        F.col("_q")[0].alias("q_low"), F.col("_q")[1].alias("q_high"))


def proportion_band(series: DataFrame, z: float = 1.96) -> DataFrame:
    """Share with its binomial band (A10)."""
    p = F.col("x") / F.col("total")
    err = F.lit(z) * proportion_error(F.col("x"), F.col("total"))
    return series.select("series_id", "t", p.alias("p"), (p - err).alias("low"), (p + err).alias("high"))


def weekday_profile(cube: DataFrame) -> DataFrame:
    """Mean over weeks of each weekday and hour."""
    return cube.groupBy("series_id", "weekday", "hour").agg(F.avg("x").alias("x"))


def quotient_of_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    """Week-summed a over week-summed b per hour of the week."""
    sa = a.groupBy("series_id", "pos").agg(F.sum("x").alias("sa"))
    sb = b.groupBy("series_id", "pos").agg(F.sum("x").alias("sb"))
    return sa.join(sb, ["series_id", "pos"]).select("series_id", "pos", F.try_divide("sa", "sb").alias("x"))
