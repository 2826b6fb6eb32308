"""Cases that once gave wrong results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmurline.functions import text as X
from murmurline.ml.classifiers import prior_weights
from murmurline.ml.features import tfidf_rows
from murmurline.operators.columns import parsed_timestamps
from murmurline.session import scratch_path
from murmurline.sources.store import ParquetStore


def test_backslash_is_no_edge_mark(spark):
    df = spark.createDataFrame([("\\foo bar",), ("(foo) bar",)], "text string")
    got = [r[0] for r in df.select(X.tweet_tokens(F.col("text"))).collect()]
    assert got[0][0].startswith("\\foo") and got[1] == ["(", "foo", ")", "bar"]


@pytest.mark.parametrize("text", ["2008-08-27 13:08:45", "Wed Aug 27 13:08:45 +0000 2008", "08/27/2008 13:08:45", "27 Aug 2008 13:08:45"])
def test_time_forms(spark, text):
    got = parsed_timestamps(spark.createDataFrame([(text,), ("not a date",), (None,)], "t string"), "t").collect()
    assert [r["t"] for r in got] == [dt.datetime(2008, 8, 27, 13, 8, 45)]


def test_unlisted_classes_weigh_one(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "label int")
    assert [r["weight"] for r in prior_weights(df, {0: 0.9, 1: 0.1}).collect()] == [0.9, 0.1, 1.0]


def test_every_term_has_a_weight_unless_a_cap_is_asked_for(spark):
    df = spark.createDataFrame([(i, f"common rare{i}") for i in range(50)], "id long, text string")
    tokens = X.plain_tokens(F.col("text"))
    assert tfidf_rows(df, "id", tokens).count() == 100
    assert tfidf_rows(df, "id", tokens, 1).count() == 50


def test_updated_store_is_seen_by_every_reader(spark):
    old = ParquetStore(spark, scratch_path(spark, "store"))
    old.insert_tweets(spark.createDataFrame([(1, "a", "0"), (2, "b", "0")], "id long, text string, lat string"))
    root = scratch_path(spark, "store")
    new = old.update_tweets(spark.createDataFrame([(2, "9")], "id long, lat string"), root)
    for store in (new, ParquetStore(spark, root)):
        assert {r["tweet_id"]: r["lat"] for r in store.tweets().collect()} == {"1": "0", "2": "9"}
    assert {r["lat"] for r in old.tweets().collect()} == {"0"}
