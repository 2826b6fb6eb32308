"""Continuous and discrete wavelet transforms per series.

Both treat a series as one period of an endless one: what leaves at one end
comes in at the other. Near the ends of a series, within some two scales, values
therefore mix its first and last hours; nothing is padded.

The continuous transform multiplies the series' Fourier coefficients with the
wavelet's response at every scale and sums the products at every hour; the
discrete pyramid is an array expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurline.operators.spectral import dft

#: (angular frequency, scale) -> response
Response = Callable[[Column, Column], Column]
#: Products below this share of a scale's largest one are lost in the rounding of the sum and left out.
LOST = 1e-18


def gaussian2_response(omega: Column, scale: Column) -> Column:
    """Second-derivative Gaussian, unit energy."""
    u = omega * scale
    return F.sqrt(scale) * F.lit(math.sqrt(8.0 / 3.0) * math.pi ** 0.25) * u * u * F.exp(F.lit(-0.5) * u * u)


def morlet_response(omega: Column, scale: Column, w0: float = 2 * math.pi) -> Column:
    """Complex Morlet, positive frequencies only."""
    off = omega * scale - F.lit(w0)
    return F.when(omega >= 0, F.exp(F.lit(-0.5) * off * off)).otherwise(0.0)


def even_scale(number: Column, low: float = 0.05, high: float = 7.0, n: int = 800) -> Column:
    """Scale ``number`` of ``n`` from ``low`` to ``high`` days, evenly spaced on a log axis, in hours."""
    return F.lit(24.0 * low) * F.exp((number - 1) * F.lit(math.log(high / low) / (n - 1)))


def octave_scale(number: Column, voices: int = 20) -> Column:
    """Scale 1.. is octave 1 voice 0; number 43 is octave 3 voice 2."""
    return F.pow(F.lit(2.0), F.lit(1.0) + (number - 1) / F.lit(float(voices)))


def cwt(series: DataFrame, numbers: list[int], scale: Callable[[Column], Column], response: Response) -> DataFrame:
    """(series_id, scale_no, t, re, im) of the listed scales (N19, N20), from rows (series_id, t, x) with t from 1.

    A series of n hours has n / 2 + 1 coefficients, the others being their conjugates. Their products with the responses
    are rows; those of one series and scale, at most n / 2 + 1, are summed at every hour by one small matrix product.
    Products that cannot change the sum are left out, which at large scales is nearly all of them.
    """
    longest = series.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    spectrum = dft(series, list(range(longest // 2 + 1))).where(2 * F.col("k") <= F.col("n"))
    rows = spectrum.withColumn("scale_no", F.explode(F.array(*[F.lit(i) for i in numbers])))
    omega, s = F.lit(2 * math.pi) * F.col("k") / F.col("n"), scale(F.col("scale_no"))
    # the coefficient at n / 2 counts as a negative frequency, that at 0 as itself alone
    plus = F.when(2 * F.col("k") == F.col("n"), 0.0).otherwise(response(omega, s))
    minus = F.when(F.col("k") == 0, 0.0).otherwise(response(-omega, s))
    rows = rows.select("series_id", "n", "scale_no", "k", "re", "im", plus.alias("p"), minus.alias("m"))
    # few bytes but much work: a set number of partitions is not merged again, and serves the window and the grouping
    rows = rows.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "scale_no")
    size = (F.abs("p") + F.abs("m")) * (F.abs("re") + F.abs("im"))
    rows = rows.withColumn("_size", size).withColumn("_most", F.max("_size").over(Window.partitionBy("series_id", "scale_no")))
    rows = rows.where(F.col("_size") >= F.col("_most") * F.lit(LOST))
    terms = F.struct("k", (F.col("re") * (F.col("p") + F.col("m")) / F.col("n")).alias("a"), (F.col("im") * (F.col("p") + F.col("m")) / F.col("n")).alias("b"),
                     (F.col("re") * (F.col("p") - F.col("m")) / F.col("n")).alias("c"), (F.col("im") * (F.col("p") - F.col("m")) / F.col("n")).alias("d"))
    packed = rows.groupBy("series_id", "n", "scale_no").agg(F.collect_list(terms).alias("q")).select(
        "series_id", "n", "scale_no", *[F.col(f"q.{c}").alias(c) for c in "kabcd"])
    return packed.mapInArrow(_summed_waves, "series_id string, scale_no int, t int, re double, im double")


def _summed_waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the waves of a series and scale (frequency k; a, b for the real and c, d for the imaginary part) at every hour."""
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for first in range(0, batch.num_rows, 64):  # bounds the rows of one output batch
            by_length: dict[int, list[dict]] = {}
            for row in batch.slice(first, 64).to_pylist():
                by_length.setdefault(row["n"], []).append(row)
            for n, rows in by_length.items():
                if n not in tables:
                    turn = 2 * np.pi * (np.outer(np.arange(n // 2 + 1), np.arange(n)) % n) / n
                    tables[n] = np.cos(turn), np.sin(turn)
                cos, sin = tables[n]
                parts = np.zeros((4, len(rows), n // 2 + 1))
                for i, row in enumerate(rows):
                    parts[:, i, row["k"]] = [row[x] for x in "abcd"]
                a, b, c, d = parts
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([r["series_id"] for r in rows], n), pa.string()),
                    pa.array(np.repeat(np.array([r["scale_no"] for r in rows], np.int32), n)),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(rows))),
                    pa.array((a @ cos - b @ sin).ravel()), pa.array((c @ sin + d @ cos).ravel())], names=["series_id", "scale_no", "t", "re", "im"])


# Daubechies scaling filter with eight taps.
DAUBECHIES_8 = [
    0.2303778133074431, 0.7148465705484058, 0.6308807679358788, -0.0279837694166834,
    -0.1870348117179132, 0.0308413818353661, 0.0328830116666778, -0.0105974017850021,
]


def _filtered(v: Column, taps: list[float]) -> Column:
    """Circular filter that keeps every second position."""
    n = F.size(v)

    def at(u: Column) -> Column:
        terms = [F.lit(h) * F.element_at(v, F.pmod(2 * u + 1 - tap, n) + 1) for tap, h in enumerate(taps)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), at)


def dwt(arrays: DataFrame, levels: int = 6, scaling: list[float] = DAUBECHIES_8) -> DataFrame:
    """(series_id, band, level, pos, value): wavelet bands W1.. and scaling bands V1..."""
    taps = len(scaling)
    wavelet = [(-1) ** i * scaling[taps - 1 - i] for i in range(taps)]
    out = arrays.select("series_id", F.col("xs").alias("v0"))
    for level in range(1, levels + 1):
        previous = F.col(f"v{level - 1}")
        out = out.withColumns({f"w{level}": _filtered(previous, wavelet), f"v{level}": _filtered(previous, scaling)})
    bands = [F.struct(F.lit(b).alias("band"), F.lit(i).alias("level"), F.col(f"{b.lower()}{i}").alias("xs"))
             for i in range(1, levels + 1) for b in ("W", "V")]
    return (out.select("series_id", F.explode(F.array(*bands)).alias("b"))
               .select("series_id", "b.band", "b.level", F.posexplode("b.xs").alias("pos", "value")))
