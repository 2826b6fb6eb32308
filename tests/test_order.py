"""Order over range partitions with ties, ROC curves keyed by class, quantiles of large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurline.operators import evaluation, profiles, ranking


def tied(spark, n=4000):
    """Nine of ten rows have one value."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 0, (F.col("id") % 700).cast("double")).otherwise(5.0).alias("v"))


def test_ties_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # keeps small partitions apart
    parts = ranking.range_parts(tied(spark), [F.col("v"), F.col("id")]).where("v = 5.0").groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 3600 / 2
    # without ties of their own, rows are ordered by all their columns
    placed = ranking.global_position(tied(spark), "v").collect()
    assert sorted(r["position"] for r in placed) == list(range(1, 4001))
    assert [r["v"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(r["v"] for r in placed)


@pytest.mark.parametrize("descending", [False, True])
def test_positions_with_ties(spark, descending):
    got = ranking.global_position(tied(spark, 500), "v", ("id",), descending).collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0] if descending else x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == want


def test_percentiles_and_vocabulary(spark):
    rng = random.Random(1)
    terms = list({"prefix-" + "".join(rng.choice("abé日") for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    df = spark.createDataFrame([(t, float(rng.randrange(3))) for t in terms + terms], "term string, coef double")
    got = {r["term"]: r["column"] for r in ranking.sorted_vocabulary(df).collect()}
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(terms, key=str.encode) and sorted(got.values()) == list(range(1, len(terms) + 1))
    one = df.dropDuplicates(["term"])
    ranks = {r["term"]: (r["coef"], r["percentile"]) for r in ranking.percentile_rank(one, "coef", ("term",)).collect()}
    order = sorted(ranks, key=lambda t: (ranks[t][0], t.encode()))
    assert all(ranks[t][1] == pytest.approx(i / len(order)) for i, t in enumerate(order))


def test_sums_and_neighbours_of_each_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i, rng.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o int, id int, w int").repartition(5)
    got = ranking.in_order(df, [F.col("o").desc(), F.col("id")], ("k",), ("w",), ("id", "o")).collect()
    for key in ("a", "b", None):
        total, last = 0, (None, None)
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: (-r["o"], r["id"])):
            assert (r["w_before"], r["id_previous"], r["o_previous"]) == (total, *last)
            total, last = total + r["w"], (r["id"], r["o"])
    assert len(got) == 700
    assert ranking.in_order(df.where("false"), [F.col("o")], (), ("w",), ("id",)).count() == 0


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_curves_of_all_classes_at_once(spark):
    rng = np.random.default_rng(3)
    y, scores = rng.integers(0, 4, 400), np.round(rng.random((400, 4)), 1)  # nearly all scores are tied
    df = spark.createDataFrame([(int(a), *map(float, s)) for a, s in zip(y, scores)], "y int, s0 double, s1 double, s2 double, s3 double").repartition(6)
    got = {r["curve"]: r["auc"] for r in evaluation.roc_by_class(df, {c: f"s{c}" for c in range(4)}).collect()}
    curves = {}
    for c in range(4):
        assert got[str(c)] == pytest.approx(auc(scores[:, c], y == c))
        cut = np.unique(scores[:, c])[::-1]
        curves[c] = [(0.0, 0.0)] + [((scores[y != c, c] >= s).mean(), (scores[y == c, c] >= s).mean()) for s in cut]
    assert got["micro"] == pytest.approx(auc(scores.ravel(order="F"), np.concatenate([y == c for c in range(4)])))
    grid = np.unique([x for p in curves.values() for x, _ in p])

    def at(points, x):
        """Upper value at a point of the curve, straight line between two of them."""
        own = [t for f, t in points if f == x]
        if own:
            return max(own)
        left, right = max(f for f, _ in points if f < x), min(f for f, _ in points if f > x)
        a, b = max(t for f, t in points if f == left), min(t for f, t in points if f == right)
        return a + (b - a) * (x - left) / (right - left)

    mean = np.array([np.mean([at(p, x) for p in curves.values()]) for x in grid])
    assert got["macro"] == pytest.approx(((grid[1:] - grid[:-1]) * (mean[1:] + mean[:-1]) / 2).sum(), abs=1e-9)


def values(kind, rng):
    return {
        "even": lambda: rng.random(3000),
        "tied": lambda: np.where(rng.random(3000) < 0.9, 7.0, rng.random(3000)),
        "equal": lambda: np.full(2000, -3.5),
        "skewed": lambda: rng.choice([-1.0, 1.0], 3000) * 10.0 ** rng.uniform(-300, 300, 3000),
        "narrow": lambda: 1e9 + rng.random(3000) * 1e-6,
        "far": lambda: np.concatenate([rng.random(2000), [1e308, -1e308, np.inf]]),
        "few": lambda: rng.random(5),
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "tied", "equal", "skewed", "narrow", "far", "few"])
def test_quantiles_of_large_groups(spark, kind):
    x = values(kind, np.random.default_rng(5))
    rows = [("g", float(v)) for v in x] + [(None, float(v)) for v in range(11)] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    whole = {r["k"]: r["q"] for r in profiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    parts = {r["k"]: r["q"] for r in profiles.exact_quantiles(df, ["k"], "v", probs, most=20).collect()}
    assert set(whole) == {"g", None} and whole == parts
    if kind != "far":
        assert np.allclose(parts["g"], np.quantile(x, probs), rtol=1e-12)


def test_bands_with_null_keys(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(30)] + [(None, 1.0), (None, 2.0)], "k string, v double")
    band = {r["k"]: r for r in profiles.replicate_band(df, ["k"], "v").collect()}
    assert band["a"]["n"] == 30 and band["a"]["q_low"] == pytest.approx(2.9) and band[None]["q_high"] == pytest.approx(1.9)
