"""Hourly counts over a file stream.

Each micro-batch writes its own partial summary into a folder named after the
batch, replacing whatever an interrupted attempt left there, so a replayed
batch counts once. Readers merge the partials; late posts need no special rule.
:func:`final_hours` is for sinks that want each hour once and for all: it keeps
open hours in the state of the stream and gives them out when no post can come
any more that is not later than the allowed delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.operators.summary import hourly_summary, monthly_summary

PARTIAL = "class string, day int, hour int, sum long, len long, batch long"
MONTH_PARTIAL = "month string, " + PARTIAL


def hourly_stream(posts: DataFrame, score: Callable[[DataFrame], DataFrame], flags: dict[str, Column], path: str,
                  progress: str, ts: str = "local_time", wait: bool = True, months: bool = False):
    """Start the stream over all files present; with ``wait`` return when they are done. ``months`` adds the month to the key."""
    summarise = monthly_summary if months else hourly_summary

    def write(batch: DataFrame, number: int) -> None:
        part = summarise(score(batch), flags, ts)
        part.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")  # at most classes x 744 rows

    stream = (posts.writeStream.foreachBatch(write).option("checkpointLocation", progress)
              .trigger(availableNow=True).start())
    if wait:
        stream.awaitTermination()
    return stream


def read_partials(spark: SparkSession, path: str, months: bool = False) -> DataFrame:
    return spark.read.schema(MONTH_PARTIAL if months else PARTIAL).option("basePath", path).parquet(path)


def final_hours(posts: DataFrame, flags: dict[str, Column], ts: str = "local_time", delay: str = "2 hours") -> DataFrame:
    """Rows (hour, class, sum, len) of every clock hour of a stream, each once, in append mode.

    Counts of open hours are state, one entry an hour, whatever the number of posts. An hour closes when the greatest
    time seen lies ``delay`` after its end, as judged before each batch; a post for an hour that was closed before the last
    batch is late and left out (the stream reports how many).
    """
    timed = posts.select(F.col(ts).cast("timestamp").alias("_ts"), *[c.cast("long").alias(n) for n, c in flags.items()]).withWatermark("_ts", delay)
    counted = timed.groupBy(F.window("_ts", "1 hour").alias("_w")).agg(F.count("*").alias("len"), *[F.sum(n).alias(n) for n in flags])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("sum")) for n in flags])).alias("e")
    return counted.select(F.col("_w.start").alias("hour"), "len", each).select("hour", "e.class", "e.sum", "len")


def late_posts(query) -> int:
    """Posts that a stream of :func:`final_hours` has left out as late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
