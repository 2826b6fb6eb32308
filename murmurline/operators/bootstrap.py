"""Bootstrap of hourly series and stability of their trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.operators import clustering, profiles
from murmurline.operators.distance import PackedMeasure

_DRAWN = "series_id string, pct int, sample int, half int, slots array<int>, sums array<bigint>, lens array<bigint>"


def replicate_keys(packed: DataFrame, percents: list[int], samples: int, halves: int) -> DataFrame:
    """One row per (series, percent, sample, half), spread over the cluster."""
    grid = (packed.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
                  .withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
                  .withColumn("half", F.explode(F.sequence(F.lit(1), F.lit(halves)))))
    return grid.repartition("series_id", "pct", "sample", "half")


def _packed(summary: DataFrame, *keys: str) -> DataFrame:
    """One row per series: its hour slots in order with their counts; at most a month of hours."""
    slot = (F.col("day") - 1) * 24 + F.col("hour")
    return (summary.groupBy("series_id", *keys)
            .agg(F.array_sort(F.collect_list(F.struct(slot.cast("int").alias("slot"), "sum", "len"))).alias("h"))
            .select("series_id", *keys, F.col("h.slot").alias("slots"), F.col("h.sum").alias("sums"), F.col("h.len").alias("lens")))


def _resampled(series_id: str, pct: int, sample: int, half: int, seed: int, count: np.ndarray, total: np.ndarray,
               p_mode: str, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Drawn hits and posts of every hour, seeded by the replicate's key."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{series_id}|{pct}|{sample}|{half}|{seed}"))
    n = int(np.floor((size or total.sum()) * pct / 100))
    drawn = rng.multinomial(n, total / total.sum())
    split = count / total if p_mode == "share" else count / (count + total)
    return rng.binomial(drawn, split), drawn


def draw(summary: DataFrame, percents: list[int], samples: int = 1, halves: int = 1, seed: int = 0,
         p_mode: str = "share", size: int | None = None) -> DataFrame:
    """Resampled hourly counts (C5): rows (series_id, pct, sample, half, day, hour, sum, len).

    Hours are drawn multinomially by their totals, then each hour splits
    binomially. ``p_mode`` "share" splits with count/total, "odds" with
    count/(count + total). ``size`` fixes the number of posts that 100 percent
    stands for; by default it is the total of each series. Draws are seeded by
    the replicate's key, so a retried task gives the same rows.
    """

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums, lens = [], []
            for r in batch.itertuples(index=False):
                s, n = _resampled(r.series_id, r.pct, r.sample, r.half, seed, np.asarray(r.sums, float), np.asarray(r.lens, float), p_mode, size)
                sums.append(s)
                lens.append(n)
            yield batch.assign(sums=sums, lens=lens)[["series_id", "pct", "sample", "half", "slots", "sums", "lens"]]

    drawn = replicate_keys(_packed(summary), percents, samples, halves).mapInPandas(resample, _DRAWN)
    rows = drawn.select("series_id", "pct", "sample", "half", F.explode(F.arrays_zip("slots", "sums", "lens")).alias("h"))
    return rows.select("series_id", "pct", "sample", "half", (F.floor(F.col("h.slots") / 24) + 1).cast("int").alias("day"),
                       (F.col("h.slots") % 24).cast("int").alias("hour"), F.col("h.sums").alias("sum"), F.col("h.lens").alias("len"))


def filled_shares(slots: np.ndarray, sums: np.ndarray, lens: np.ndarray, span: tuple[int, int], threshold: float) -> np.ndarray:
    """Share of each hour first..last (replicate, hour) from drawn counts (replicate, slot).

    An hour below the threshold, or without any post, takes the counts of the last known hour before it, as in W1 and W2;
    hours before the first known one take that one's. Without a known hour shares are NaN.
    """
    hours = max(span[1], int(slots.max(initial=0)) + 1)
    x, total = np.zeros((len(sums), hours)), np.zeros((len(sums), hours))
    x[:, slots], total[:, slots] = sums, lens
    known = (total >= threshold) & (total > 0)
    last = np.maximum.accumulate(np.where(known, np.arange(hours), -1), axis=1)
    first = np.where(known.any(1), known.argmax(1), 0)
    source = np.where(last < 0, first[:, None], last)
    with np.errstate(invalid="ignore"):
        share = np.take_along_axis(x, source, 1) / np.take_along_axis(total, source, 1)
    share[~known.any(1)] = np.nan
    return share[:, span[0] - 1:span[1]]


_SCORES = "group_id string, dend string, pct int, sample int, baker double, cophenetic double"


def tree_scores(summary: DataFrame, measures: dict[str, PackedMeasure], months: dict[str, tuple[int, tuple[int, int]]],
                percents: list[int], samples: int, threshold: float = 1000.0, seed: int = 0, length: int = 24,
                group: Column | None = None) -> DataFrame:
    """(group_id, dend, pct, sample, baker, cophenetic) of the trees of paired resamples.

    One row per group and percent carries the packed hours of its months; all samples of that row are drawn, filled, cut
    into days, compared and joined to trees together, for every measure from the same draw. Rows spread over as many
    tasks as there are percents, and a group is never more than its months of hours. Null where a tree is unknown.
    """
    key = F.lit("all") if group is None else group
    packed = _packed(summary.where(F.col("series_id").isin(*months)).withColumn("group_id", key), "group_id")
    rows = packed.groupBy("group_id").agg(F.collect_list(F.struct("series_id", "slots", "sums", "lens")).alias("m"))
    grid = rows.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents]))).repartition(len(percents))
    order = sorted(months, key=lambda name: months[name][0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                held = {m["series_id"]: m for m in r.m}
                if set(held) != set(months):
                    continue
                halves = []
                for half in (1, 2):
                    parts = []
                    for name in order:
                        m = held[name]
                        count, total = np.asarray(m["sums"], float), np.asarray(m["lens"], float)
                        drawn = [_resampled(name, r.pct, s, half, seed, count, total, "share", None) for s in range(1, samples + 1)]
                        share = filled_shares(np.asarray(m["slots"]), np.stack([d[0] for d in drawn]), np.stack([d[1] for d in drawn]),
                                              months[name][1], threshold)
                        parts.append(share.reshape(samples, -1, length))
                    halves.append(np.concatenate(parts, axis=1))
                for name, measure in measures.items():
                    d = [measure(x) for x in halves]
                    known = ~np.isnan(d[0]).any((1, 2)) & ~np.isnan(d[1]).any((1, 2))
                    baker, cophenetic = np.full(samples, np.nan), np.full(samples, np.nan)
                    if known.any():
                        baker[known], cophenetic[known] = clustering.packed_correlation(*(clustering.average_merges(x[known]) for x in d))
                    yield pd.DataFrame({"group_id": r.group_id, "dend": name, "pct": np.int32(r.pct), "sample": np.arange(1, samples + 1, dtype=np.int32),
                                        "baker": baker, "cophenetic": cophenetic})

    return grid.select("group_id", "pct", "m").mapInPandas(score, _SCORES)


def stability(summary: DataFrame, measures: dict[str, PackedMeasure], months: dict[str, tuple[int, tuple[int, int]]],
              percents: list[int], samples: int, threshold: float = 1000.0, seed: int = 0, length: int = 24) -> DataFrame:
    """Correlation of the trees of paired resamples, by percent and measure.

    ``months`` maps a series to (month number, (first hour, last hour)). Rows:
    (dend, pct, mean, var, n, ci_low, ci_high, q_low, q_high) of Baker's gamma.
    """
    scores = tree_scores(summary, measures, months, percents, samples, threshold, seed, length)
    return profiles.replicate_band(scores.where(F.col("baker").isNotNull() & ~F.isnan("baker")), ["dend", "pct"], "baker")
