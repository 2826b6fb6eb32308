"""P: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions import places, scores
from murmurline.operators import ranking
from murmurline.operators.columns import parsed_timestamps, exploded_records, pick
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.registry import query
from murmurline.sources.readers import read_table


@query("p1_item_getter", "SELECT doc_id, text FROM documents")
def p1(spark, sf):
    return pick(read_table(spark, sf, "documents"), "doc_id", "text")


@query("p2_explode_record", sql(B.TWEETS_SQL, "SELECT id, k AS \"props.k\" FROM tweets"))
def p2(spark, sf):
    flat = exploded_records(B.tweets(spark, sf), props=["k"])
    return flat.select("id", F.col("`props.k`"))


_HOLES = ("SELECT doc_id, CASE WHEN n_chars % 7 <> 0 THEN lang END AS lang, "
          "CASE WHEN n_chars % 5 <> 0 THEN source END AS source FROM documents")


def _with_holes(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("lang")).alias("lang"),
                    F.when(F.col("n_chars") % 5 != 0, F.col("source")).alias("source"))


@query("p3_drop_any_null", f"SELECT * FROM ({_HOLES}) WHERE lang IS NOT NULL AND source IS NOT NULL")
def p3(spark, sf):
    return _with_holes(spark, sf).dropna("any")


@query("p4_drop_subset_null", f"SELECT * FROM ({_HOLES}) WHERE lang IS NOT NULL")
def p4(spark, sf):
    return _with_holes(spark, sf).dropna(subset=["lang"])


_DIRTY = ("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not a date' WHEN event_id % 13 = 0 THEN NULL "
          "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at FROM events")


@query("p5_parse_timestamp",
       f"SELECT event_id, TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM ({_DIRTY}) "
       "WHERE TRY_CAST(created_at AS TIMESTAMP) IS NOT NULL")
def p5(spark, sf):
    e = read_table(spark, sf, "events")
    text = F.when(F.col("event_id") % 11 == 0, F.lit("not a date")).when(
        F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return parsed_timestamps(e.select("event_id", text.alias("created_at")), "created_at")


@query("p6_local_time_offset", sql(B.LOCAL_SQL, "SELECT id, utc_offset, local_time FROM local"))
def p6(spark, sf):
    return places.with_local_time_by_offset(B.tweets(spark, sf)).select("id", "utc_offset", "local_time")


_STATE_SQL = """CASE WHEN place LIKE '%USA%' THEN
    CASE left(place, greatest(length(place) - 5, 0)) WHEN 'Texas' THEN 'TX' WHEN 'Guam' THEN 'GU'
      WHEN 'Georgia' THEN 'GA' ELSE '<Other>' END
  WHEN right(place, 2) IN ('TX', 'OR', 'PA') THEN right(place, 2) ELSE '<Other>' END"""
_HOURS_SQL = "CASE location WHEN 'TX' THEN -6 WHEN 'GA' THEN -5 WHEN 'OR' THEN -8 WHEN 'PA' THEN -5 ELSE 0 END"
_PLACED_SQL = B.TWEETS_SQL + f""", placed AS (SELECT id, created_at, place, {_STATE_SQL} AS location FROM tweets),
 zoned AS (SELECT *, {_HOURS_SQL} AS tz FROM placed)"""


@query("p7_place_to_state", sql(_PLACED_SQL, "SELECT id, place, location FROM placed"))
def p7(spark, sf):
    return B.tweets(spark, sf).select("id", "place", places.state_of(F.col("place")).alias("location"))


@query("p8_state_to_hours", sql(_PLACED_SQL, "SELECT id, location, CAST(tz AS INTEGER) AS tz FROM zoned"))
def p8(spark, sf):
    t = B.tweets(spark, sf).select("id", places.state_of(F.col("place")).alias("location"))
    return t.withColumn("tz", places.state_hours(F.col("location")))


@query("p9_convert_to_local", sql(_PLACED_SQL, """SELECT id, location, CAST(tz AS INTEGER) AS tz,
  created_at + to_hours(tz) AS local_time FROM zoned WHERE location <> '<Other>'"""))
def p9(spark, sf):
    return places.with_local_time_by_state(B.tweets(spark, sf)).select("id", "location", "tz", "local_time")


@query("p10_alcohol_flags", sql(B.SCORED_SQL, """SELECT id, CAST(predict_present > 0.6 AS INTEGER) AS casual,
  CAST(predict_future > 0.6 AS INTEGER) AS looking, CAST(predict_past > 0.6 AS INTEGER) AS reflecting,
  CAST(predict_alc > 0.5 AS INTEGER) AS alc, CAST(predict_fpa > 0.75 AS INTEGER) AS fpa,
  CAST(alc_key AS INTEGER) AS alc_key FROM scored"""))
def p10(spark, sf):
    return B.local_scored(spark, sf).select("id", *[c.alias(n) for n, c in scores.alcohol_flags().items()])


_TOB = B.LOCAL_SQL + """, tgate AS (SELECT *, least(value / 80, 1) AS predict_tob, (k + 1) / 100 AS predict_com,
  CASE WHEN least(value / 80, 1) > 0.2 THEN (99 - k) / 99 ELSE 0 END AS g_fp,
  CASE WHEN least(value / 80, 1) > 0.2 THEN (id % 10) / 10 ELSE 0 END AS g_cur,
  CASE WHEN least(value / 80, 1) > 0.2 THEN (user_id % 10) / 10 ELSE 0 END AS g_present FROM local), tscored AS (
  SELECT *, predict_tob * g_fp AS predict_fp, predict_tob * g_fp * g_cur AS predict_cur,
    predict_tob * g_fp * g_present AS predict_present, event_type = 'signup' AS shisha FROM tgate)"""
_TOB_FLAGS = {"present": "predict_present > 0.5", "tob": "predict_tob > 0.5", "fp": "predict_fp > 0.5",
              "cur": "predict_cur > 0.5", "com": "predict_com > 0.5", "psh": "predict_cur > 0.5 AND shisha"}


def tobacco_local(spark, sf):
    return B.tobacco_scores(places.with_local_time_by_offset(B.tweets(spark, sf)))


@query("p11_tobacco_flags", sql(_TOB, "SELECT id, " + ", ".join(
    f"CAST({e} AS INTEGER) AS {n}" for n, e in _TOB_FLAGS.items()) + " FROM tscored"))
def p11(spark, sf):
    return tobacco_local(spark, sf).select("id", *[c.alias(n) for n, c in scores.tobacco_flags().items()])


@query("p12_probability_counts", sql(B.SCORED_SQL, """SELECT count(*) FILTER (WHERE predict_alc > 0.75) AS alc_75,
  count(*) FILTER (WHERE predict_fpa > 0.85) AS fpa_85, count(*) FILTER (WHERE predict_fpa > 0.95) AS fpa_95,
  count(*) FILTER (WHERE predict_fpa_given_alc > 0.75) AS fpa_given_alc_75 FROM scored"""))
def p12(spark, sf):
    return B.local_scored(spark, sf).agg(
        F.count_if(F.col("predict_alc") > 0.75).alias("alc_75"),
        F.count_if(F.col("predict_fpa") > 0.85).alias("fpa_85"),
        F.count_if(F.col("predict_fpa") > 0.95).alias("fpa_95"),
        F.count_if(F.col("predict_fpa_given_alc") > 0.75).alias("fpa_given_alc_75"))


@query("p12_probability_sample", sql(B.SCORED_SQL, f"""SELECT id, {sql6('predict_fpa')} AS predict_fpa FROM scored WHERE predict_fpa > 0.85
  ORDER BY CAST('0x' || substr(md5(concat_ws('|', id, '7')), 1, 15) AS BIGINT), id LIMIT 10"""))
def p12_sample(spark, sf):
    likely = B.local_scored(spark, sf).where(F.col("predict_fpa") > 0.85)
    return ranking.sample_rows(likely, 10, "id", seed=7).select("id", r6("predict_fpa").alias("predict_fpa"))


@query("p13_split_by_mask", sql(B.TWEETS_SQL, """SELECT 'keyword' AS part, count(*) AS n FROM tweets WHERE alc_key
  UNION ALL SELECT 'rest', count(*) FROM tweets WHERE NOT alc_key"""))
def p13(spark, sf):
    t = B.tweets(spark, sf)
    with_key, without = t.where("alc_key"), t.where("NOT alc_key")
    return (with_key.agg(F.lit("keyword").alias("part"), F.count("*").alias("n"))
            .unionByName(without.agg(F.lit("rest").alias("part"), F.count("*").alias("n"))))


@query("p14_hour_and_day", sql(B.LOCAL_SQL, """SELECT id, CAST(hour(local_time) AS INTEGER) AS hour,
  CAST(day(local_time) AS INTEGER) AS day FROM local"""))
def p14(spark, sf):
    t = places.with_local_time_by_offset(B.tweets(spark, sf))
    return t.select("id", F.hour("local_time").alias("hour"), F.dayofmonth("local_time").alias("day"))


@query("p15_label_recode", """SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS y,
  CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id % 4 END AS level FROM events""")
def p15(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", scores.recode(F.col("event_type"), "error").alias("y"),
                    scores.fold_heavy(F.col("event_id") % 4).alias("level"))


@query("p16_label_equality", "SELECT event_id, CAST(event_type = 'view' AS DOUBLE) AS y FROM events")
def p16(spark, sf):
    return read_table(spark, sf, "events").select("event_id", (F.col("event_type") == "view").cast("double").alias("y"))


@query("p17_drop_empty_answers", """SELECT event_id, answer FROM (
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{}' ELSE event_type END AS answer FROM events) WHERE answer <> '{}'""")
def p17(spark, sf):
    e = read_table(spark, sf, "events")
    answer = F.when(F.col("event_id") % 9 == 0, "{}").otherwise(F.col("event_type")).alias("answer")
    return e.select("event_id", answer).where(F.col("answer") != "{}")


@query("p18_fill_zero", """SELECT event_id, 0.0::DOUBLE AS predict_fpa,
  coalesce(CASE WHEN value > 50 THEN value END, 0) AS v FROM events""")
def p18(spark, sf):
    e = read_table(spark, sf, "events")
    return (e.select("event_id", F.lit(0.0).alias("predict_fpa"), F.when(F.col("value") > 50, F.col("value")).alias("v"))
             .fillna(0, ["v"]))


@query("p19_ratio_or_zero", sql(B.HOURLY_SQL, f"""SELECT c.day, c.hour, {sql6(
  "coalesce(c.sum / CASE WHEN v.sum <> 0 THEN v.sum END, 0)")} AS ratio
  FROM hourly c JOIN hourly v ON c.day = v.day AND c.hour = v.hour
  WHERE c.series_id = 'click' AND v.series_id = 'view'"""))
def p19(spark, sf):
    h = B.alc_summary(spark, sf)
    c = B.month(h, B.MONTH_A).select("day", "hour", F.col("sum").alias("c"))
    v = B.month(h, B.MONTH_B).select("day", "hour", F.col("sum").alias("v"))
    return c.join(v, ["day", "hour"]).select("day", "hour", r6(scores.ratio_or_zero(F.col("c"), F.col("v"))).alias("ratio"))


@query("p20_distinct_values", "SELECT DISTINCT event_type FROM events")
def p20(spark, sf):
    return read_table(spark, sf, "events").select("event_type").distinct()


@query("n22_product_rule", sql(B.SCORED_SQL, "SELECT id, " + ", ".join(
    f"{sql6(c)} AS {c}" for c in ("predict_alc", "predict_fpa", "predict_present", "predict_future", "predict_past"))
    + " FROM scored"))
def n22(spark, sf):
    return B.local_scored(spark, sf).select("id", *[r6(c).alias(c) for c in (
        "predict_alc", "predict_fpa", "predict_present", "predict_future", "predict_past")])
