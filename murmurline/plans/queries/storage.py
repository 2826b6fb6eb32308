"""S: sources, sinks, layout; every query writes to the shared folder and reads back. E1: file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline import schemas
from murmurline.functions import scores
from murmurline.operators import correction, summary
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import _ALC, _monthly_sql, _summary_sql
from murmurline.plans.queries.statistics import _A, _B, _DET
from murmurline.plans.registry import query
from murmurline.session import scratch_path
from murmurline.sources import readers, writers
from murmurline.sources.store import ParquetStore
from murmurline.streaming.hourly import hourly_stream, read_partials

_RAW_SQL = B.TWEETS_SQL + """, raw AS (SELECT t.id, strftime(t.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, t.utc_offset,
  d.text FROM tweets t JOIN documents d ON d.doc_id = t.id % (SELECT count(*) FROM documents))"""


#: Records of one written CSV file; packed files have one reader each.
FILE_ROWS = 50_000


def raw_tweets(spark, sf, more=None):
    """All tweets, with documents in turn as texts; columns of ``more`` come by id, before the texts make the rows wide."""
    docs = readers.read_table(spark, sf, "documents").select("doc_id", "text")
    t = B.tweets(spark, sf).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "utc_offset")
    t = t if more is None else t.join(more, "id")
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a task writes what its tweets become
    return t.join(docs, F.col("id") % docs.count() == F.col("doc_id")).drop("doc_id")


def _write_csv(df, name, header=True):
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", header).option("escape", '"').option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).csv(path)
    return path


@query("s1_csv_folder", sql(_RAW_SQL, "SELECT id, created_at, utc_offset, md5(text) AS digest FROM raw"))
def s1(spark, sf):
    back = readers.read_csv_folder(spark, _write_csv(raw_tweets(spark, sf), "tweets"))
    return back.select("id", "created_at", "utc_offset", F.md5("text").alias("digest"))


@query("s2_headerless_csv", sql(_RAW_SQL, """SELECT r.id, (t.user_id % 90)::DOUBLE AS lat, (-(t.user_id % 180))::DOUBLE AS lon, t.place, r.created_at
  FROM raw r JOIN tweets t ON r.id = t.id"""))
def s2(spark, sf):
    extra = B.tweets(spark, sf).select("id", (F.col("user_id") % 90).cast("double").alias("lat"),
                                       (-(F.col("user_id") % 180)).cast("double").alias("lon"), "place")
    rows = raw_tweets(spark, sf, extra).select(schemas.PLACED_TWEETS.fieldNames())
    back = readers.read_csv_folder(spark, _write_csv(rows, "placed", header=False), schemas.PLACED_TWEETS, header=False)
    return back.select("id", "lat", "lon", "place", "created_at")


@query("s3_training_csv", """SELECT CAST(l.quality AS VARCHAR) AS labels, md5(d.text) AS digest FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def s3(spark, sf):
    rows = readers.read_table(spark, sf, "labels").join(readers.read_table(spark, sf, "documents"), "doc_id").select(
        F.col("quality").cast("string").alias("class"), F.col("text").alias("body"))
    return readers.read_training_csv(spark, _write_csv(rows, "training")).select("labels", F.md5("text").alias("digest"))


def _written_summary(spark, sf):
    path = scratch_path(spark, "summary")
    writers.write_summary(summary.hourly_summary(B.local_scored(spark, sf), scores.alcohol_flags()), path, base="casual")
    return path


@query("s4_summary_csv", sql(B.SCORED_SQL, f"SELECT day, hour, sum, len FROM ({_summary_sql({'alc': _ALC['alc']}, 'scored')})"))
def s4(spark, sf):
    return readers.read_summary_csv(spark, _written_summary(spark, sf) + "/class=alc")


@query("s5_summary_columns", sql(B.SCORED_SQL, f"SELECT day, hour, sum, len FROM ({_summary_sql({'fpa': _ALC['fpa']}, 'scored')})"))
def s5(spark, sf):
    tree = readers.read_summary_tree(spark, _written_summary(spark, sf))
    return readers.summary_series(tree.where(F.col("class") == "fpa"))


@query("s6_quarantine", """SELECT CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE 'good' END AS part, count(*) AS n FROM events GROUP BY ALL""")
def s6(spark, sf):
    """Every seventeenth line has a broken number; it is set aside with its text."""
    path = scratch_path(spark, "dirty")
    ev = readers.read_table(spark, sf, "events")
    broken = F.when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))
    ev.select(F.concat_ws(",", broken, "event_type").alias("line")).write.text(path)
    good, bad, _ = readers.read_with_quarantine(
        spark, path, schemas.T.StructType([schemas.T.StructField("event_id", schemas.T.LongType()),
                                           schemas.T.StructField("event_type", schemas.T.StringType())]), header=False)
    return (good.agg(F.lit("good").alias("part"), F.count("event_id").alias("n"))
            .unionByName(bad.agg(F.lit("bad").alias("part"), F.count("line").alias("n"))))


@query("s7_write_predictions", sql(B.SCORED_SQL, f"SELECT id, {sql6('predict_alc')} AS predict_alc FROM scored"))
def s7(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = B.local_scored(spark, sf).select("id", r6("predict_alc").alias("predict_alc"))
    writers.write_predictions(rows, path)
    return spark.read.schema("id long, predict_alc double").parquet(path)


@query("s8_write_summary_per_class", sql(B.SCORED_SQL, _summary_sql({**_ALC, "total": _ALC["casual"]}, "scored")))
def s8(spark, sf):
    return readers.read_summary_tree(spark, _written_summary(spark, sf)).select("class", "day", "hour", "sum", "len")


@query("s9_exact_blocks", """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS block FROM events""")
def s9(spark, sf):
    ev = readers.read_table(spark, sf, "events").select("event_id")
    return writers.exact_blocks(ev, "event_id", 1000).select("event_id", "block")


@query("s9_even_files", "SELECT count(*) AS n, true AS within FROM events")
def s9_files(spark, sf):
    path = scratch_path(spark, "blocks")
    writers.write_blocks(readers.read_table(spark, sf, "events").select("event_id", "event_type"), path, 1000)
    back = spark.read.schema("event_id long, event_type string").parquet(path)
    per = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), (F.max("c") <= 1000).alias("within"))


def _store(spark, sf):
    store = ParquetStore(spark, scratch_path(spark, "store"))
    t = B.tweets(spark, sf).select("id", F.lit(None).cast("string").alias("text"), "created_at",
                                   (F.col("user_id") % 90).alias("lat"), F.lit(None).cast("string").alias("lon"), "utc_offset")
    store.insert_tweets(t)
    return store


def _prediction_frame(spark, sf):
    return B.local_scored(spark, sf).select(
        F.col("id").alias("tweet_id"), F.col("predict_alc").alias("alcohol"), F.col("predict_fpa").alias("first person"),
        F.col("predict_present").alias("casual"), F.col("predict_future").alias("looking"), F.col("predict_past").alias("reflecting"))


@query("s10_append_tweets", sql(B.TWEETS_SQL, "SELECT CAST(id AS VARCHAR) AS tweet_id, created_at AS date, CAST(user_id % 90 AS VARCHAR) AS lat FROM tweets"))
def s10(spark, sf):
    return _store(spark, sf).tweets().select("tweet_id", "date", "lat")


_DB = ", ".join(f"{sql6(c)} AS {a}" for c, a in (("predict_alc", "\"Alcohol\""), ("predict_fpa", "\"FirstPerson\""),
                                                 ("predict_present", "\"Casual\"")))


@query("s11_save_prediction", sql(B.SCORED_SQL, f"SELECT CAST(id AS VARCHAR) AS tweet_id, {_DB}, 'fixed scores' AS description FROM scored"))
def s11(spark, sf):
    store = ParquetStore(spark, scratch_path(spark, "store"))
    store.save_prediction(_prediction_frame(spark, sf), description="fixed scores")
    return store.predictions().select("tweet_id", r6("Alcohol").alias("Alcohol"), r6("FirstPerson").alias("FirstPerson"),
                                      r6("Casual").alias("Casual"), "description")


@query("s12_save_labels", "SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CAST(quality AS VARCHAR) AS label FROM labels")
def s12(spark, sf):
    store = ParquetStore(spark, scratch_path(spark, "store"))
    store.save_labels(readers.read_table(spark, sf, "labels"), "doc_id", "quality")
    return store.labels()


@query("s13_keyed_update", sql(B.TWEETS_SQL, """SELECT CAST(id AS VARCHAR) AS tweet_id,
  CASE WHEN id % 3 = 0 THEN '1.5' ELSE CAST(user_id % 90 AS VARCHAR) END AS lat,
  CASE WHEN id % 3 = 0 THEN '2.5' END AS lon, utc_offset FROM tweets"""))
def s13(spark, sf):
    store = _store(spark, sf)
    store = store.update_tweets(B.tweets(spark, sf).where("id % 3 = 0").select("id", F.lit("1.5").alias("lat"), F.lit("2.5").alias("lon")),
                                scratch_path(spark, "store"))
    return store.tweets().select("tweet_id", "lat", "lon", "utc_offset")


@query("s14_dated_read", sql(B.SCORED_SQL, f"""SELECT CAST(t.id AS VARCHAR) AS id, t.created_at, {sql6("s.predict_alc")} AS predict_alc
  FROM tweets t JOIN scored s ON t.id = s.id WHERE t.created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"""))
def s14(spark, sf):
    store = _store(spark, sf)
    store.save_prediction(_prediction_frame(spark, sf), description="fixed scores")
    return store.read_as_df("2024-01-05", "2024-01-20").select("id", "created_at", r6("predict_alc").alias("predict_alc"))


@query("s16_write_adjusted", sql(B.CLEAN_SQL + f", co AS (SELECT series_id, t, (x * {_A!r}::DOUBLE - (total - x) * {_B!r}::DOUBLE) / {_DET!r}::DOUBLE AS x FROM clean)",
                                 f"SELECT series_id, t, {sql6('x')} AS x FROM co"))
def s16(spark, sf):
    path = scratch_path(spark, "adjusted")
    writers.write_table(correction.corrected(B.alc_clean(spark, sf), correction.ALCOHOL_CONFUSION_LARGE, shift=False), path)
    return spark.read.schema("series_id string, t int, x double").parquet(path).withColumn("x", r6("x"))


def _streamed(spark, sf, months):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events*.parquet")
    path, state = scratch_path(spark, "partials"), scratch_path(spark, "progress")
    hourly_stream(files, lambda rows: B.alcohol_scores(B.with_local_time_by_offset(B.tweets_of(rows))),
                  scores.alcohol_flags(), path, state, months=months)
    return summary.merge_summaries(read_partials(spark, path, months))


@query("e1_stream_hourly_summary", sql(B.SCORED_SQL, _summary_sql(_ALC, "scored")))
def e1(spark, sf):
    """Hourly summary of a file stream: partial sums per batch, merged on read."""
    return _streamed(spark, sf, False)


@query("e1_stream_monthly_summary", sql(B.SCORED_SQL, _monthly_sql(_ALC, "scored")))
def e1_months(spark, sf):
    return _streamed(spark, sf, True)
