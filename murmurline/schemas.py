"""Explicit schemas of every source; nothing is inferred at read time."""

from pyspark.sql import types as T

TWEETS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("utc_offset", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

PLACED_TWEETS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("id", T.LongType()),
    T.StructField("place", T.StringType()),
    T.StructField("utc_offset", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
])

TRAINING = T.StructType([
    T.StructField("labels", T.StringType()),
    T.StructField("text", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("day", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("sum", T.LongType()),
    T.StructField("len", T.LongType()),
])

CROWD = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("Answer", T.StringType()),
    T.StructField("text", T.StringType()),
])

USER = T.StructType([
    T.StructField("created_at", T.StringType()),
    T.StructField("favourites_count", T.LongType()),
    T.StructField("followers_count", T.LongType()),
    T.StructField("friends_count", T.LongType()),
    T.StructField("statuses_count", T.LongType()),
    T.StructField("verified", T.BooleanType()),
])

LABELS = T.StructType([
    T.StructField("alcohol", T.IntegerType()),
    T.StructField("first_person", T.IntegerType()),
    T.StructField("first_person_level", T.IntegerType()),
    T.StructField("alcohol_related", T.IntegerType()),
    T.StructField("raw", T.StringType()),
])

DB_TWEETS = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("lat", T.StringType()),
    T.StructField("lon", T.StringType()),
    T.StructField("utc_offset", T.IntegerType()),
])

DB_PREDICTIONS = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("Alcohol", T.DoubleType()),
    T.StructField("FirstPerson", T.DoubleType()),
    T.StructField("Casual", T.DoubleType()),
    T.StructField("Looking", T.DoubleType()),
    T.StructField("Reflecting", T.DoubleType()),
    T.StructField("description", T.StringType()),
])

DB_LABELS = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("label", T.StringType()),
])
