"""Models trained together against Spark's own fits, trees of packed replicates against trees of rows."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from murmurline.ml import classifiers, joint
from murmurline.ml.features import SmoothTfidf
from murmurline.operators import bootstrap, clustering, distance, series
from murmurline.operators.evaluation import overall_scores
from murmurline.operators.ranking import hash_folds, stable_hash


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        y = rng.randrange(2)
        rows.append((i, [rng.choice("abcdefgh" if y else "efghijkl") + str(rng.randrange(3)) for _ in range(rng.randrange(0, 15))], float(y)))
    return spark.createDataFrame(rows, "key long, tokens array<string>, label double").repartition(5).cache()


def test_joint_fit_equals_single_fits(spark, labelled):
    data = labelled.withColumn("fold", F.col("key") % 3)
    blocks, vocabulary, terms = joint.pack(data, "key", "tokens", "label", ["fold"])
    models = joint.fit(blocks, terms, 3, lambda tags: tags[:, :1] != np.arange(3), c=2.0, iterations=500, tol=1e-12)
    names = [r["term"] for r in vocabulary.orderBy("column").collect()]
    for fold in range(3):
        train = data.where(F.col("fold") != fold)
        n = train.count()
        lr = classifiers.logistic(n, 2.0, 1000).setTol(1e-13)
        fitted = Pipeline(stages=[SmoothTfidf(inputCol="tokens", outputCol="features"), lr]).fit(train)
        weights = {r["term"]: r for r in classifiers.term_weights(spark, fitted).collect()}
        assert models.rows[fold] == n
        for k, term in enumerate(names):
            have = weights.get(term)
            assert abs(models.coef[k, fold] - (have["coef"] if have else 0)) < 1e-6
            assert abs(models.idf[k, fold] - (have["idf"] if have else 0)) < 1e-9
        assert abs(models.intercept[fold] - fitted.stages[-1].intercept) < 1e-6


def test_learning_curve_equals_fits_one_by_one(labelled):
    got = {(r["size"], r["part"]): (r["rows"], r["mean"], r["std"]) for r in classifiers.learning_curve(labelled, "key", pieces=3, folds=3).collect()}
    data = hash_folds(labelled, "key", 3, 1).withColumn("_share", F.pmod(stable_hash(F.col("key"), 2), F.lit(10_000)) / 10_000.0)
    assert {k[0] for k in got} == {1 / 3, 2 / 3}
    for size in (1 / 3, 2 / 3):
        scores, rows = {"train": [], "test": []}, []
        for fold in range(3):
            train, test = data.where((F.col("fold") != fold) & (F.col("_share") < size)), data.where(F.col("fold") == fold)
            rows.append(train.count())
            fitted = Pipeline(stages=[SmoothTfidf(inputCol="tokens", outputCol="features"), classifiers.logistic(rows[-1], 1.0).setTol(1e-12)]).fit(train)
            for part, df in (("train", train), ("test", test)):
                scores[part].append(overall_scores(fitted.transform(df), "label", "prediction").first()["weighted_f1"])
        for part in scores:
            assert got[(size, part)] == pytest.approx((np.mean(rows), np.mean(scores[part]), np.std(scores[part])))


def test_models_of_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(1, ["a"], 1.0, 0), (2, ["b"], 1.0, 0), (3, ["a", "b"], 0.0, 1), (4, [], 1.0, 1), (5, ["c"], 0.0, 1)],
                               "key long, tokens array<string>, label double, g long")
    blocks, _, terms = joint.pack(df, "key", "tokens", "label", ["g"])
    models = joint.fit(blocks, terms, 3, lambda tags: tags[:, :1] == np.array([0, 1, 2]))
    assert models.intercept[0] == np.inf and models.rows.tolist() == [2, 3, 0] and np.isfinite(models.coef).all()


def test_sums_merge_slice_by_slice(spark, labelled, monkeypatch):
    blocks, _, terms = joint.pack(labelled.repartition(9), "key", "tokens", "label", ["key"])
    one = joint.frequencies(blocks, terms, 2, lambda tags: tags % 2 == np.arange(2))
    monkeypatch.setattr(joint, "SLICE", 7)
    many = joint.summed(blocks, 3, lambda b, t: t.__iadd__([len(b.labels), b.counts.sum(), 1]), fan_in=2)
    assert many[0] == 160 and one[1].sum() == 160


def naive_merges(d):
    """The two closest clusters of the whole matrix join, step by step."""
    n, d = len(d), d.copy()
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        out.append((i, j, d[i, j]))
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = d[j] = np.inf
        d[:, j] = np.inf
        size[i] += size[j]
    return out


def test_chains_give_the_trees_of_whole_searches():
    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 30):
        x = rng.normal(size=(12, n, 4))
        d = distance.packed_euclidean(x)
        left, right, height = clustering.average_merges(d)
        for t in range(12):
            want = naive_merges(d[t])
            assert [(a, b) for a, b, _ in want] == list(zip(left[t].tolist(), right[t].tolist()))
            assert np.allclose([h for *_, h in want], height[t], rtol=1e-12)
    tied = np.array([[[0.0], [0.0], [1.0], [1.0], [2.0]]])
    left, right, height = clustering.average_merges(distance.packed_euclidean(tied))
    assert height[0].tolist() == sorted(height[0].tolist()) and height[0][0] == 0


def test_packed_measures_equal_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 24))
    df = spark.createDataFrame([("g", i + 1, v.tolist()) for i, v in enumerate(x)], "series_id string, seg int, xs array<double>")
    for column, packed in ((distance.euclidean, distance.packed_euclidean), (distance.phase_distance(1), distance.packed_phase(1))):
        d = packed(x[None])[0]
        for r in distance.distances(df, column).collect():
            assert r["d"] == pytest.approx(d[r["a"] - 1, r["b"] - 1], abs=1e-12)


def test_packed_correlation_equals_that_of_merge_tables(spark):
    rng = np.random.default_rng(3)
    trees, packed = [], []
    for half in range(2):
        x = rng.normal(size=(3, 10, 5))
        rows = [(f"g{t}", i + 1, x[t, i].tolist()) for t in range(3) for i in range(10)]
        df = spark.createDataFrame(rows, "series_id string, seg int, xs array<double>")
        trees.append(clustering.average_linkage(distance.distances(df, distance.euclidean)))
        packed.append(clustering.average_merges(distance.packed_euclidean(x)))
    baker, cophenetic = clustering.packed_correlation(*packed)
    for r in clustering.tree_correlation(*trees).collect():
        t = int(r["group_id"][1:])
        assert (r["baker"], r["cophenetic"]) == (pytest.approx(baker[t]), pytest.approx(cophenetic[t]))


def test_sweep_equals_trees_of_drawn_rows(spark):
    """One resample of one fraction, followed row by row through draw, fill, days, distances and trees."""
    rng = np.random.default_rng(4)
    rows = [(m, day, hour, int(rng.integers(0, 9)), int(rng.integers(9, 30))) for m in ("a", "b") for day in range(1, 31) for hour in range(24)]
    summary = spark.createDataFrame(rows, "series_id string, day int, hour int, sum long, len long")
    months = {"a": (1, series.SLICES["june"]), "b": (2, series.SLICES["sept"])}
    got = bootstrap.tree_scores(summary, {"e": distance.packed_euclidean, "p": distance.packed_phase(1)}, months, [40, 90], 2, threshold=3.0, seed=6)
    got = {(r["dend"], r["pct"], r["sample"]): (r["baker"], r["cophenetic"]) for r in got.collect()}
    drawn = bootstrap.draw(summary, [40, 90], samples=2, halves=2, seed=6)
    key = F.concat_ws("|", "series_id", "pct", "sample", "half")
    clean = series.clean_series(drawn.select(key.alias("series_id"), "day", "hour", "sum", "len"), 3.0)
    parts = F.split("series_id", r"\|")
    month = F.when(parts[0] == "a", 0).otherwise(1)
    first = F.when(parts[0] == "a", months["a"][1][0]).otherwise(months["b"][1][0])
    cut = series.proportion(clean.where(F.col("t").between(first, first + 671)).withColumn("t", F.col("t") - first + 1))
    assert cut.where("x IS NULL").count() == 0
    segs = series.split_segments(cut.select("series_id", "t", "x"), 24)
    segs = segs.select(F.concat_ws("|", parts[1], parts[2], parts[3]).alias("series_id"), (F.col("seg") + month * 28).cast("int").alias("seg"), "pos", "x")
    for name, measure in (("e", distance.euclidean), ("p", distance.phase_distance(1))):
        trees = clustering.average_linkage(distance.distances(series.segment_arrays(segs), measure))
        half = trees.withColumn("half", F.split("group_id", r"\|")[2]).withColumn("group_id", F.substring_index("group_id", "|", 2))
        want = clustering.tree_correlation(half.where("half = '1'").drop("half"), half.where("half = '2'").drop("half"))
        for r in want.collect():
            pct, sample = map(int, r["group_id"].split("|"))
            assert got[(name, pct, sample)] == (pytest.approx(r["baker"]), pytest.approx(r["cophenetic"]))
    assert len(got) == 8


def test_shares_of_hours_without_posts():
    slots, sums, lens = np.array([0, 1, 2, 4]), np.array([[1, 2, 0, 3], [0, 0, 0, 0]]), np.array([[0, 4, 0, 6], [0, 0, 0, 0]])
    got = bootstrap.filled_shares(slots, sums, lens, (1, 6), 0.0)
    assert got[0].tolist() == [0.5, 0.5, 0.5, 0.5, 0.5, 0.5] and np.isnan(got[1]).all()
