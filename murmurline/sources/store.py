"""Keyed store of tweets, predictions and labels.

Tables live either in a database reached over JDBC or in parquet folders with
the same calls. The parquet form never rewrites a folder in place: an update
writes to a root the caller names and gives the store there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline import schemas

TWEETS_TABLE = "uploaded_tweets"
PREDICTION_TABLE = "predictions"
LABEL_TABLE = "labels"


def tweet_rows(df: DataFrame) -> DataFrame:
    """Frame in tweet columns to the stored columns; absent ones become null."""
    def pick(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    return df.select(
        pick("id", "string").alias("tweet_id"), pick("text", "string").alias("text"),
        pick("created_at", "timestamp_ntz").alias("date"), pick("lat", "string").alias("lat"),
        pick("lon", "string").alias("lon"), pick("utc_offset", "int").alias("utc_offset"),
    )


def prediction_rows(df: DataFrame, tweet_id: str = "tweet_id", alc: str = "alcohol",
                    fpa: str = "first person", casual: str = "casual", looking: str = "looking",
                    reflecting: str = "reflecting", description: str = "") -> DataFrame:
    """Score columns renamed to the stored prediction columns."""
    def score(name: str, out: str) -> Column:
        return F.col(f"`{name}`").cast("double").alias(out)

    return df.select(
        F.col(tweet_id).cast("string").alias("tweet_id"), score(alc, "Alcohol"), score(fpa, "FirstPerson"),
        score(casual, "Casual"), score(looking, "Looking"), score(reflecting, "Reflecting"),
        F.lit(description).alias("description"),
    )


def updated_rows(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed update: changed values win, rows without a change stay.

    The change set is reduced to one row per key first (of several changes of
    one key the greatest value is kept), so the join cannot multiply rows.
    """
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"new_{c}") for c in columns])
    keep = [F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in current.columns]
    return current.join(new, key, "left").select(*keep)


def between_dates(tweets: DataFrame, predictions: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive date-ranged join of tweets with their predictions."""
    wanted = tweets.where(F.col("date").between(F.lit(start).cast("timestamp_ntz"),
                                                F.lit(end).cast("timestamp_ntz")))
    return wanted.join(predictions, "tweet_id", "inner").select(
        F.col("tweet_id").alias("id"), "text", F.col("date").alias("created_at"), "lat", "lon", "utc_offset",
        F.col("Alcohol").alias("predict_alc"), F.col("FirstPerson").alias("predict_fpa"),
        F.col("Casual").alias("predict_casual"), F.col("Looking").alias("predict_looking"),
        F.col("Reflecting").alias("predict_reflecting"))


@dataclass
class ParquetStore:
    """Append, update and ranged read over parquet folders, one per table."""

    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path(table))

    def insert_tweets(self, df: DataFrame) -> None:
        self._append(TWEETS_TABLE, tweet_rows(df))

    def insert_tweets_csv(self, path: str) -> None:
        from murmurline.sources.readers import read_csv_folder
        self.insert_tweets(read_csv_folder(self.spark, path, schemas.TWEETS))

    def save_prediction(self, df: DataFrame, **columns: str) -> None:
        self._append(PREDICTION_TABLE, prediction_rows(df, **columns))

    def save_labels(self, df: DataFrame, tweet_id_col: str = "tweet_id", label_col: str = "labels") -> None:
        self._append(LABEL_TABLE, df.select(F.col(tweet_id_col).cast("string").alias("tweet_id"),
                                            F.col(label_col).cast("string").alias("label")))

    def update_tweets(self, df: DataFrame, root: str) -> "ParquetStore":
        """New lat, lon and utc_offset by id: writes all tweets below ``root`` and returns the store there.

        The tables that do not change are copied, so the new store is whole and this one stays as it is.
        """
        changes = tweet_rows(df).select("tweet_id", "lat", "lon", "utc_offset")
        merged = updated_rows(self.tweets(), changes, "tweet_id", ["lat", "lon", "utc_offset"])
        merged.write.parquet(f"{root}/{TWEETS_TABLE}")
        for table, read in ((PREDICTION_TABLE, self.predictions), (LABEL_TABLE, self.labels)):
            if self._exists(table):
                read().write.parquet(f"{root}/{table}")
        return ParquetStore(self.spark, root)

    def _exists(self, table: str) -> bool:
        try:
            self.spark.read.parquet(self._path(table))
        except AnalysisException:
            return False
        return True

    def tweets(self) -> DataFrame:
        return self.spark.read.schema(schemas.DB_TWEETS).parquet(self._path(TWEETS_TABLE))

    def predictions(self) -> DataFrame:
        return self.spark.read.schema(schemas.DB_PREDICTIONS).parquet(self._path(PREDICTION_TABLE))

    def labels(self) -> DataFrame:
        return self.spark.read.schema(schemas.DB_LABELS).parquet(self._path(LABEL_TABLE))

    def read_as_df(self, start: str, end: str) -> DataFrame:
        return between_dates(self.tweets(), self.predictions(), start, end)


@dataclass
class JdbcStore:
    """The same calls against a database; rows leave executors in batches."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    tweet_batch: int = 500
    prediction_batch: int = 1000

    def _append(self, table: str, df: DataFrame, batch: int) -> None:
        (df.write.mode("append").option("batchsize", batch)
           .jdbc(self.url, table, properties=self.properties))

    def insert_tweets(self, df: DataFrame) -> None:
        self._append(TWEETS_TABLE, tweet_rows(df), self.tweet_batch)

    def save_prediction(self, df: DataFrame, **columns: str) -> None:
        self._append(PREDICTION_TABLE, prediction_rows(df, **columns), self.prediction_batch)

    def save_labels(self, df: DataFrame, tweet_id_col: str = "tweet_id", label_col: str = "labels") -> None:
        self._append(LABEL_TABLE, df.select(F.col(tweet_id_col).cast("string").alias("tweet_id"),
                                            F.col(label_col).cast("string").alias("label")), self.prediction_batch)

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def read_as_df(self, start: str, end: str) -> DataFrame:
        return between_dates(self._read(TWEETS_TABLE), self._read(PREDICTION_TABLE), start, end)
