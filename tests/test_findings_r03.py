"""Cases of the third review: work that was done again, or grew too wide."""

import math
import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from murmurline.functions import text as X
from murmurline.ml import cascade, classifiers, features, joint
from murmurline.plans.queries import storage


def labelled(spark):
    rng = random.Random(2)
    words = ["beer", "wine's", "the", "dog", "a.b", "x", "yes!"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(8)), i % 2, i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "id long, text string, y int, z int")


def test_tasks_on_one_frame_share_features(spark, monkeypatch):
    fits = []
    fit = CountVectorizer._fit
    monkeypatch.setattr(CountVectorizer, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    df = labelled(spark)
    got = classifiers.train_set({"y": (df, F.col("y")), "z": (df, F.col("z"))}, classes={"z": 3}, iterations=100, max_terms=100_000)
    assert len(fits) == 1 and [len(m.stages) for m in got.values()] == [3, 3]
    single = classifiers.ngram_pipeline(60, iterations=100, max_terms=100_000).fit(df.withColumn("label", F.col("y").cast("double")))
    a = {r["id"]: r["p"] for r in cascade.scored(single, df, [None, "p"]).collect()}
    b = {r["id"]: r["p"] for r in cascade.scored(got["y"], df, [None, "p"]).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_cascade_makes_shared_features_once(spark):
    df = labelled(spark)
    m = classifiers.train_set({"y": (df, F.col("y")), "z": (df, F.col("z"))}, classes={"z": 3}, iterations=100, max_terms=100_000)
    ready, rest, name = cascade.with_features([m["y"], m["y"], m["z"]], df)
    assert name == "features" and [len(r.stages) for r in rest] == [1, 1, 1] and ready.columns == [*df.columns, "features"]
    out = cascade.AlcoholCascade(m["y"], m["y"], m["z"])(df, 0.5)
    assert out.count() == 60 and "features" not in out.columns
    want = {r["id"]: r["p"] for r in cascade.scored(m["y"], df, [None, "p"]).collect()}
    for r in out.collect():
        assert abs(r["predict_alc"] - want[r["id"]]) < 1e-12
        assert r["predict_fpa_given_alc"] == (r["predict_alc"] if r["predict_alc"] > 0.5 else 0.0)


def test_terms_are_counted_without_a_shuffle_of_terms(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (None, "cc"), (2, None)], "id long, text string")
    counts = features.term_counts(df, "id", X.plain_tokens(F.col("text")))
    assert {tuple(r) for r in counts.collect()} == {(1, "aa", 3), (1, "bb", 1), (None, "cc", 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_models_trained_a_few_at_a_time(spark, monkeypatch):
    df = labelled(spark).select("id", X.plain_tokens(F.col("text")).alias("tokens"), F.col("y").cast("double").alias("label"))
    whole = classifiers.learning_curve(df, "id", pieces=3, folds=2, iterations=10).orderBy("size", "part").collect()
    sizes, fit = [], joint.fit
    monkeypatch.setattr(joint, "fit", lambda blocks, terms, models, *more: sizes.append(models) or fit(blocks, terms, models, *more))
    monkeypatch.setattr(classifiers, "MODEL_NUMBERS", 15)  # of 5 terms
    parts = classifiers.learning_curve(df, "id", pieces=3, folds=2, iterations=10).orderBy("size", "part").collect()
    assert sizes == [3, 1] and [tuple(r) for r in parts] == [tuple(r) for r in whole]


def test_csv_files_are_bounded_and_columns_come_before_texts(spark, monkeypatch, tmp_path):
    events = [(i % 9, f"2024-01-01 00:00:0{i % 9}", i % 4, "view", 1.0, '{"k": 1}') for i in range(10)]  # 0 comes twice
    (spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
     .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet"))
    texts = [(0, 'a "quoted"\nline'), (1, "b, c"), (2, "plain")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(storage, "FILE_ROWS", 2)
    path = storage._write_csv(storage.raw_tweets(spark, str(tmp_path)).coalesce(1), "tweets")
    files = spark.read.format("binaryFile").load(path)
    assert files.count() == 5
    back = storage.s1(spark, str(tmp_path))
    assert back.count() == 10 and back.where(F.col("digest").isin(*[r[0] for r in spark.createDataFrame(texts, "d long, t string").select(F.md5("t")).collect()])).count() == 10
    extra = spark.createDataFrame([(i % 9, f"p{i}") for i in range(10)], "id long, place string")
    assert storage.raw_tweets(spark, str(tmp_path), extra).count() == 12  # both rows of 0 meet both of extra


def test_offsets_of_long_texts(spark):
    text = " ".join(f"w{i}, it's" for i in range(700))
    got = spark.createDataFrame([(text,), ("",)], "t string").select(X.aligned_tokens(F.col("t")).alias("a")).collect()
    assert got[1]["a"] == [] and all(text[t["start"]:t["start"] + len(t["tok"])] == t["tok"] for t in got[0]["a"])
    assert "".join(t["tok"] for t in got[0]["a"]) == text.replace(" ", "") and len(got[0]["a"]) == 2800


def test_capped_vocabulary_is_counted_as_rows(spark, monkeypatch):
    seen = []
    fit = CountVectorizer._fit
    monkeypatch.setattr(CountVectorizer, "_fit", lambda self, df: seen.append([list(r[0]) for r in df.collect()]) or fit(self, df))
    rows = [(["b", "a", "b", "c"],), (["b", "d", "d"],), (["e"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    for most, want in ((1, {"b"}), (2, {"b", "d"}), (3, {"b", "d", "a"}), (9, set("abcde"))):
        seen.clear()
        model = features.SmoothTfidf(inputCol="tokens", outputCol="features", maxTerms=most).fit(df.dropna())
        assert set(model.stages[0].vocabulary) == want
        assert sorted(seen[0]) == [[t] for t in sorted(want)]  # a row a kept term, not the texts
    scale = dict(zip(model.stages[0].vocabulary, model.stages[1].getScalingVec().toArray()))
    assert abs(scale["b"] - (math.log(5 / 3) + 1)) < 1e-12 and abs(scale["e"] - (math.log(5 / 2) + 1)) < 1e-12


def test_fits_use_as_many_tasks_as_entries_need(spark, monkeypatch):
    df = labelled(spark).repartition(6)
    parts = []
    fit = LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, data: parts.append(data.rdd.getNumPartitions()) or fit(self, data))
    tasks = {"y": (df, F.col("y")), "z": (df, F.col("z")), "y2": (df, F.col("y"))}
    few = classifiers.train_set(tasks, classes={"z": 3}, iterations=20, max_terms=1000)
    assert parts == [1] * 5
    parts.clear()
    monkeypatch.setattr(classifiers, "ENTRIES", 1)
    many = classifiers.train_set(tasks, classes={"z": 3}, iterations=20, max_terms=1000)
    assert len(parts) == 5 and min(parts) > 1
    for name in tasks:
        names = ["p0", "p1", "p2"] if name == "z" else [None, "p1"]
        a, b = ({r["id"]: r for r in cascade.scored(m[name], df, names).collect()} for m in (few, many))
        assert len(a) == 60 and all(abs(a[k][n] - b[k][n]) < 1e-6 for k in a for n in names if n)
