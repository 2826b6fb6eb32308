"""Clustering of the segments of each group.

Edges come as (group_id, a, b, d) with a < b. A group is one calendar's days or
weeks, at most 62 items; the kernels therefore see at most 1,891 edges, and the
number of groups is what grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGE = "group_id string, step int, left array<int>, right array<int>, height double"
LABEL = "group_id string, item int, cluster int, medoid int"


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    items = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
    d = np.zeros((len(items), len(items)))
    i, j = np.searchsorted(items, pdf["a"]), np.searchsorted(items, pdf["b"])
    d[i, j] = d[j, i] = pdf["d"].to_numpy(float)
    return items, d


def average_merges(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (tree, step) of many distance matrices (tree, item, item) at once, as slots left < right and heights.

    Nearest-neighbour chains, all trees in step: a chain grows from a cluster to its nearest one until two are each
    other's nearest and join, which average linkage allows in any order. Steps are sorted by height afterwards. A cluster
    sits in the slot of its least item. A tree costs O(items^2) instead of a search of the whole matrix a step.
    """
    trees, n, _ = d.shape
    d = d.astype(float)
    d[:, np.arange(n), np.arange(n)] = np.inf
    size, reached, alive = np.ones((trees, n)), np.zeros((trees, n)), np.ones((trees, n), bool)
    chain, top, done = np.zeros((trees, n + 1), int), np.zeros(trees, int), np.zeros(trees, int)
    left, right, height = np.zeros((trees, n - 1), int), np.zeros((trees, n - 1), int), np.zeros((trees, n - 1))
    at = np.arange(trees)
    while n > 1 and len(at):
        fresh = at[top[at] == 0]
        chain[fresh, 0], top[fresh] = alive[fresh].argmax(1), 1
        x = chain[at, top[at] - 1]
        away = d[at, x]
        near = away.argmin(1)
        least = away[np.arange(len(at)), near]
        before = chain[at, np.maximum(top[at] - 2, 0)]
        mutual = (top[at] > 1) & (away[np.arange(len(at)), before] <= least)
        grow = ~mutual
        chain[at[grow], top[at[grow]]] = near[grow]
        top[at[grow]] += 1
        t = at[mutual]
        if not len(t):
            continue
        i, j = np.minimum(x[mutual], before[mutual]), np.maximum(x[mutual], before[mutual])
        # a height that rounding leaves below one of its parts is raised to it, so that sorting keeps parts first
        reached[t, i] = np.maximum(least[mutual], np.maximum(reached[t, i], reached[t, j]))
        left[t, done[t]], right[t, done[t]], height[t, done[t]] = i, j, reached[t, i]
        wi, wj = size[t, i][:, None], size[t, j][:, None]
        joined = (wi * d[t, i] + wj * d[t, j]) / (wi + wj)
        d[t, i], d[t, :, i] = joined, joined
        d[t, i, i] = d[t, j] = np.inf
        d[t, :, j] = np.inf
        size[t, i] += size[t, j]
        alive[t, j] = False
        top[t] -= 2
        done[t] += 1
        at = at[done[at] < n - 1]
    order = np.argsort(height, axis=1, kind="stable")
    return tuple(np.take_along_axis(v, order, 1) for v in (left, right, height))


def pair_levels(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step (from 0) at which each pair of items joins (tree, item, item; both triangles), and pairs by (tree, step)."""
    trees, steps = left.shape
    label = np.broadcast_to(np.arange(steps + 1), (trees, steps + 1)).copy()
    level, pairs = np.zeros((trees, steps + 1, steps + 1), np.int16), np.zeros((trees, steps), int)
    for s in range(steps):
        a, b = label == left[:, s, None], label == right[:, s, None]
        both = a[:, :, None] & b[:, None, :]
        level += np.int16(s) * (both | both.transpose(0, 2, 1))
        pairs[:, s] = a.sum(1) * b.sum(1)
        label = np.where(b, left[:, s, None], label)
    return level, pairs


def packed_correlation(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Baker's gamma and the cophenetic correlation of the merges of paired trees, as in :func:`tree_correlation`."""
    ranks, heights = [], []
    for left, right, height in (a, b):
        level, pairs = pair_levels(left, right)
        upper = np.triu_indices(level.shape[1], 1)
        flat = level[:, upper[0], upper[1]].astype(int)
        mean_rank = np.cumsum(pairs, 1) - (pairs - 1) / 2
        ranks.append(np.take_along_axis(mean_rank, flat, 1))
        heights.append(np.take_along_axis(height, flat, 1))

    def corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))

    return corr(*ranks), corr(*heights)


def _merge_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Average linkage of one group; none if a distance is unknown."""
    items, d = _matrix(pdf)
    if np.isnan(d).any():
        return pd.DataFrame(columns=["group_id", "step", "left", "right", "height"])
    members = [[int(i)] for i in items]
    rows = []
    for step, (i, j, h) in enumerate(zip(*(v[0].tolist() for v in average_merges(d[None]))), 1):
        rows.append((step, members[i], members[j], h))
        members[i] = members[i] + members[j]
    out = pd.DataFrame(rows, columns=["step", "left", "right", "height"])
    out.insert(0, "group_id", pdf["group_id"].iloc[0])
    return out


def average_linkage(edges: DataFrame) -> DataFrame:
    """Merge table of every group."""
    return edges.groupBy("group_id").applyInPandas(_merge_steps, MERGE)


def cut_tree(merges: DataFrame, k: int) -> DataFrame:
    """(group_id, item, cluster) with k clusters, numbered by their smallest item.

    The last k - 1 merges are undone: an item belongs to the latest kept merge
    that contains it, or stands alone.
    """
    sized = merges.withColumn("_n", F.max("step").over(Window.partitionBy("group_id")))
    items = sized.withColumn("item", F.explode(F.concat("left", "right")))
    kept = F.when(F.col("step") <= F.col("_n") - (k - 1), F.struct("step", F.array_min(F.concat("left", "right")).alias("root")))
    root = items.groupBy("group_id", "item").agg(F.coalesce(F.max(kept)["root"], F.col("item")).alias("root"))
    return root.withColumn("cluster", F.dense_rank().over(Window.partitionBy("group_id").orderBy("root"))).drop("root")


def _k_medoids_kernel(k: int):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        items, d = _matrix(pdf)
        chosen = [int(np.argmin(d.sum(axis=0)))]
        while len(chosen) < k:
            near = d[:, chosen].min(axis=1)
            gain = np.maximum(near[:, None] - d, 0).sum(axis=0)
            gain[chosen] = -1.0
            chosen.append(int(np.argmax(gain)))
        cost = d[:, chosen].min(axis=1).sum()
        while True:
            best = (cost - 1e-12, None)
            for at in range(k):
                kept = [c for i, c in enumerate(chosen) if i != at]
                near = d[:, kept].min(axis=1) if kept else np.full(len(items), np.inf)
                totals = np.minimum(near[:, None], d).sum(axis=0)
                totals[kept] = np.inf
                swap = int(np.argmin(totals))
                if totals[swap] < best[0]:
                    best = (totals[swap], kept + [swap])
            if best[1] is None:
                break
            cost, chosen = best
        chosen = sorted(chosen)
        nearest = np.argmin(d[:, chosen], axis=1)
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[0], "item": items.astype("int32"),
                             "cluster": (nearest + 1).astype("int32"),
                             "medoid": items[np.array(chosen)[nearest]].astype("int32")})

    return kernel


def k_medoids(edges: DataFrame, k: int) -> DataFrame:
    """(group_id, item, cluster, medoid) by greedy build and best swaps."""
    return edges.groupBy("group_id").applyInPandas(_k_medoids_kernel(k), LABEL)


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("group_id", F.explode(F.array(
        F.struct(F.col("a").alias("item"), F.col("b").alias("other"), "d"),
        F.struct(F.col("b").alias("item"), F.col("a").alias("other"), "d"))).alias("e")).select("group_id", "e.*")


def silhouettes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(group_id, item, cluster, neighbour, sil_width) from edges and labels (C4)."""
    own = labels.select("group_id", "item", "cluster")
    theirs = labels.select("group_id", F.col("item").alias("other"), F.col("cluster").alias("other_cluster"))
    means = (both_directions(edges).join(theirs, ["group_id", "other"])
             .groupBy("group_id", "item", "other_cluster").agg(F.avg("d").alias("m")))
    rows = means.join(own, ["group_id", "item"])
    same = F.col("cluster") == F.col("other_cluster")
    sums = rows.groupBy("group_id", "item", "cluster").agg(
        F.max(F.when(same, F.col("m"))).alias("a"),
        F.min(F.when(~same, F.struct("m", "other_cluster"))).alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b.m") - F.col("a"), F.greatest(F.col("a"), F.col("b.m"))), F.lit(0.0)))
    return sums.select("group_id", "item", "cluster", F.col("b.other_cluster").alias("neighbour"), width.alias("sil_width"))


def merge_levels(merges: DataFrame) -> DataFrame:
    """(group_id, a, b, step, height) at which each pair of items first joins.

    A pair joins exactly once, so a tree of n items gives n(n-1)/2 rows.
    """
    left = merges.select("group_id", "step", "height", "right", F.explode("left").alias("x"))
    both = left.select("group_id", "step", "height", "x", F.explode("right").alias("y"))
    return both.select("group_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "step", "height")


def tree_correlation(first: DataFrame, second: DataFrame) -> DataFrame:
    """(group_id, baker, cophenetic) of two merge tables with the same groups and items.

    Baker's gamma is the rank correlation of the merge levels, the cophenetic
    correlation the linear one of the heights.
    """
    a = merge_levels(first).select("group_id", "a", "b", F.col("step").alias("sa"), F.col("height").alias("ha"))
    b = merge_levels(second).select("group_id", "a", "b", F.col("step").alias("sb"), F.col("height").alias("hb"))
    pairs = a.join(b, ["group_id", "a", "b"])

    def mean_rank(c: str):
        tied = Window.partitionBy("group_id", c)
        return F.rank().over(Window.partitionBy("group_id").orderBy(c)) + (F.count("*").over(tied) - 1) / 2

    ranked = pairs.select("group_id", "ha", "hb", mean_rank("sa").alias("ra"), mean_rank("sb").alias("rb"))
    return ranked.groupBy("group_id").agg(F.corr("ra", "rb").alias("baker"), F.corr("ha", "hb").alias("cophenetic"))
