import time

from pyspark.sql import functions as F

from murmurline import schemas
from murmurline.operators import series, summary
from murmurline.session import cut_lineage, scratch_path, scratch_root
from murmurline.sources import readers, writers
from murmurline.streaming.hourly import final_hours, hourly_stream, late_posts, read_partials

SF = "/root/testdata/sf0.001"


def stream_of_events(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{SF}/events*.parquet")


def test_hours_close_once_and_late_posts_are_told(spark):
    """Four batches; the last brings a post for an hour that has been given out."""
    folder = scratch_path(spark, "posts")
    for batch in (["2016-06-30 23:10:00", "2016-06-30 23:50:00", "2016-07-01 00:05:00"], ["2016-07-01 09:00:00"],
                  ["2016-07-01 20:00:00", "2016-07-01 20:30:00"], ["2016-06-30 23:20:00", "2016-07-01 21:00:00"]):
        spark.createDataFrame([(t, "a" if t.endswith("0:00") else "b") for t in batch], "ts string, kind string").select(
            F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by age
    posts = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(folder)
    q = (final_hours(posts, {"a": F.col("kind") == "a"}, "ts").writeStream.format("memory").queryName("final").outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "final")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {str(r["hour"]): (r["class"], r["sum"], r["len"]) for r in spark.table("final").collect()}
    assert got == {"2016-06-30 23:00:00": ("a", 2, 2), "2016-07-01 00:00:00": ("a", 0, 1), "2016-07-01 09:00:00": ("a", 1, 1)}
    assert spark.table("final").count() == 3 and late_posts(q) == 1


def test_months_stay_apart(spark):
    """Two months, one of 31 days, summarised, streamed and laid on grids in one run."""
    rows = [(f"2016-{m:02d}-{d:02d} {h:02d}:15:00", d % 2) for m, days in ((6, 30), (7, 31)) for d in range(1, days + 1) for h in (0, 5, 23) if (m, d) != (7, 31) or h == 5]
    df = spark.createDataFrame(rows, "ts string, y int").withColumn("local_time", F.to_timestamp("ts"))
    flags = {"odd": F.col("y") == 1}
    got = {(r["month"], r["day"], r["hour"]): (r["sum"], r["len"]) for r in summary.monthly_summary(df, flags).collect()}
    assert len(got) == len(rows) and got[("2016-06", 1, 5)] == (1, 1) and got[("2016-07", 31, 5)] == (1, 1) and ("2016-06", 31, 5) not in got
    folder, path = scratch_path(spark, "months"), scratch_path(spark, "partials")
    df.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    hourly_stream(stream, lambda d: d, flags, path, scratch_path(spark, "progress"), months=True)
    merged = summary.merge_summaries(read_partials(spark, path, months=True))
    assert {(r["month"], r["day"], r["hour"]): (r["sum"], r["len"]) for r in merged.collect()} == got
    grid = series.month_grid(summary.month_series(merged)).groupBy("series_id").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("total").alias("s"))
    assert {r["series_id"]: (r["n"], r["last"], r["s"]) for r in grid.collect()} == {"odd@2016-06": (720, 720, 90.0), "odd@2016-07": (744, 744, 91.0)}


def test_a_replayed_batch_counts_once(spark):
    path = scratch_path(spark, "partials")

    def run():
        hourly_stream(stream_of_events(spark), lambda d: d, {"purchase": (F.col("event_type") == "purchase")}, path,
                      scratch_path(spark, "progress"), ts="ts")

    run()
    first = read_partials(spark, path).agg(F.sum("len"), F.sum("sum")).first()
    run()  # progress lost: the same batch number is written again
    assert read_partials(spark, path).agg(F.sum("len"), F.sum("sum")).first() == first
    assert first[0] == 1000


def test_quarantine_keeps_every_line(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("1,a,2,x",), ("oops,b,3,y",), ("4,c,5,z",)], "v string").coalesce(1).write.text(path)
    schema = schemas.T.StructType([schemas.T.StructField(n, t) for n, t in (
        ("id", schemas.T.LongType()), ("created_at", schemas.T.StringType()),
        ("utc_offset", schemas.T.IntegerType()), ("text", schemas.T.StringType()))])
    good, bad, _ = readers.read_with_quarantine(spark, path, schema, header=False)
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ["oops,b,3,y"]
    assert good.select("text").count() == 2


def test_exact_blocks(spark):
    got = writers.exact_blocks(spark.range(25), "id", 10).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in got} == {0: 10, 1: 10, 2: 5}


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    assert sorted(map(tuple, cut_lineage(df).collect())) == sorted(map(tuple, df.collect()))
    assert scratch_root(spark) == scratch_root(spark)
