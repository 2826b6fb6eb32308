"""A: hourly counts, profiles, quantiles, distinct and confusion counts; U: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions import scores
from murmurline.functions.text import plain_tokens
from murmurline.operators import profiles, ranking, series, summary
from murmurline.operators.evaluation import confusion_counts
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.columns import _TOB, _TOB_FLAGS, tobacco_local
from murmurline.plans.registry import query
from murmurline.session import spread
from murmurline.sources.readers import read_table

_ALC = {"casual": "predict_present > 0.6", "looking": "predict_future > 0.6", "reflecting": "predict_past > 0.6",
        "alc": "predict_alc > 0.5", "fpa": "predict_fpa > 0.75", "alc_key": "alc_key"}


def _summary_sql(flags: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS class, CAST(day(local_time) AS INTEGER) AS day, CAST(hour(local_time) AS INTEGER) AS hour, "
        f"count(*) FILTER (WHERE {e}) AS sum, count(*) AS len FROM {source} GROUP BY ALL" for n, e in flags.items())


@query("a1_hourly_counts", sql(B.SCORED_SQL, _summary_sql(_ALC, "scored")))
def a1(spark, sf):
    return summary.hourly_summary(B.local_scored(spark, sf), scores.alcohol_flags())


@query("a2_tobacco_hourly_counts", sql(_TOB, _summary_sql(_TOB_FLAGS, "tscored")))
def a2(spark, sf):
    return summary.hourly_summary(tobacco_local(spark, sf), scores.tobacco_flags())


def _monthly_sql(flags: dict[str, str], source: str) -> str:
    return _summary_sql(flags, source).replace(" AS class, ", " AS class, strftime(local_time, '%Y-%m') AS month, ")


@query("a1_monthly_counts", sql(B.SCORED_SQL, _monthly_sql(_ALC, "scored")))
def a1_months(spark, sf):
    """Any number of months in one run."""
    return summary.monthly_summary(B.local_scored(spark, sf), scores.alcohol_flags())


@query("a2_tobacco_monthly_counts", sql(_TOB, _monthly_sql(_TOB_FLAGS, "tscored")))
def a2_months(spark, sf):
    return summary.monthly_summary(tobacco_local(spark, sf), scores.tobacco_flags())


@query("a3_merge_partials", sql(B.SCORED_SQL, _summary_sql(_ALC, "scored")))
def a3(spark, sf):
    """Partial summaries per event type merged again equal the one-pass summary."""
    return summary.merge_summaries(B.hourly(spark, sf).drop("series_id"))


@query("a4_volume_total", sql(B.LOCAL_SQL, """SELECT CAST(day(local_time) AS INTEGER) AS day,
  CAST(hour(local_time) AS INTEGER) AS hour, count(*) AS tweets FROM local GROUP BY ALL"""))
def a4(spark, sf):
    return summary.volume_total(summary.hourly_summary(B.local_scored(spark, sf), scores.alcohol_flags()), "casual")


_DOW_SQL = B.GRID_SQL + """, both_months AS (
  SELECT CAST(((t - 1) // 24) % 7 AS INTEGER) AS dow, CAST((t - 1) % 24 AS INTEGER) AS hour, x, total
  FROM grid WHERE series_id = 'click' AND t BETWEEN 25 AND 696
  UNION ALL SELECT CAST(((t - 1) // 24 + 1) % 7 AS INTEGER), CAST((t - 1) % 24 AS INTEGER), x, total
  FROM grid WHERE series_id = 'view' AND t BETWEEN 1 AND 672)"""


def hour_of_week_rows(spark, sf):
    grid = series.hour_grid(B.alc_summary(spark, sf))
    return series.two_months_by_weekday(B.month(grid, B.MONTH_A, "both"), B.month(grid, B.MONTH_B, "both"))


@query("a5_hour_of_week_share", sql(_DOW_SQL, f"""SELECT dow, hour, {sql6("sum(x) / sum(total)")} AS prop
  FROM both_months GROUP BY ALL"""))
def a5(spark, sf):
    return profiles.hour_of_week_share(hour_of_week_rows(spark, sf)).select("dow", "hour", r6("prop").alias("prop"))


@query("a6_across_weeks", sql(B.WEEKS_SQL, f"""SELECT series_id, pos, {sql6("avg(x)")} AS mean, {sql6("sum(x)")} AS total
  FROM weeks GROUP BY ALL"""))
def a6(spark, sf):
    out = profiles.across_weeks(series.split_segments(B.alc_share(spark, sf), 168))
    return out.select("series_id", "pos", r6("mean").alias("mean"), r6("total").alias("total"))


@query("a7_quantiles", sql(B.WEEKS_SQL, f"""SELECT series_id, pos, {sql6("quantile_cont(x, 0.25)")} AS low,
  {sql6("quantile_cont(x, 0.75)")} AS high FROM weeks GROUP BY ALL"""))
def a7(spark, sf):
    out = profiles.quantile_band(series.split_segments(B.alc_share(spark, sf), 168), ["series_id", "pos"])
    return out.select("series_id", "pos", r6("low").alias("low"), r6("high").alias("high"))


@query("a8_ratio_to_mean", sql(B.SHARE_SQL, f"""SELECT series_id, t,
  {sql6("x / avg(x) OVER (PARTITION BY series_id)")} AS x FROM share"""))
def a8(spark, sf):
    return profiles.relative_to(B.alc_share(spark, sf), "avg").select("series_id", "t", r6("x").alias("x"))


@query("a8_ratio_to_sum", sql(B.SHARE_SQL, f"""SELECT series_id, t,
  {sql6("x / sum(x) OVER (PARTITION BY series_id)")} AS x FROM share"""))
def a8_sum(spark, sf):
    return profiles.relative_to(B.alc_share(spark, sf), "sum").select("series_id", "t", r6("x").alias("x"))


_H = "1.96 * sqrt(var_samp(value)) / sqrt(count(*))"


@query("a9_replicate_band", f"""SELECT user_id, {sql6("avg(value)")} AS mean, round(var_samp(value), 4) AS var,
  count(value) AS n, {sql6(f"avg(value) - {_H}")} AS ci_low, {sql6(f"avg(value) + {_H}")} AS ci_high,
  {sql6("quantile_cont(value, 0.1)")} AS q_low, {sql6("quantile_cont(value, 0.9)")} AS q_high
  FROM events GROUP BY user_id""")
def a9(spark, sf):
    out = profiles.replicate_band(read_table(spark, sf, "events"), ["user_id"], "value")
    return out.select("user_id", "n", F.round("var", 4).alias("var"), *[r6(c).alias(c) for c in ("mean", "ci_low", "ci_high", "q_low", "q_high")])


_BAND = "1.96 * sqrt(x / total - (x / total) * (x / total)) / sqrt(total)"


@query("a10_proportion_band", sql(B.CLEAN_SQL, f"""SELECT series_id, t, {sql6("x / total")} AS p,
  {sql6(f"x / total - {_BAND}")} AS low, {sql6(f"x / total + {_BAND}")} AS high FROM clean"""))
def a10(spark, sf):
    out = profiles.proportion_band(B.alc_clean(spark, sf))
    return out.select("series_id", "t", *[r6(c).alias(c) for c in ("p", "low", "high")])


_CUBE_SQL = B.SHARE_SQL + """, cube_rows AS (SELECT series_id, CAST(((t - 1) % 168) // 24 + 1 AS INTEGER) AS weekday,
  CAST((t - 1) % 24 AS INTEGER) AS hour, CAST((t - 1) // 168 + 1 AS INTEGER) AS week, x FROM share)"""


@query("a11_weekday_profile", sql(_CUBE_SQL, f"""SELECT series_id, weekday, hour, {sql6("avg(x)")} AS x
  FROM cube_rows GROUP BY ALL"""))
def a11(spark, sf):
    return profiles.weekday_profile(series.weekday_cube(B.alc_share(spark, sf))).withColumn("x", r6("x"))


@query("a12_label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a12(spark, sf):
    return read_table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


TERMS_SQL = ("terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term "
             "FROM documents)")


def document_terms(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(plain_tokens(F.col("text"))).alias("term"))


@query("a13_distinct_vocabulary", sql(TERMS_SQL, "SELECT DISTINCT term FROM terms"))
def a13(spark, sf):
    return document_terms(spark, sf).select("term").distinct()


@query("a14_drop_duplicates", """SELECT user_id, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def a14(spark, sf):
    e = read_table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return ranking.first_per_key(e, ["user_id"], ["event_id"])


RATED_SQL = """rated AS (SELECT doc_id, quality AS y,
  CAST(CASE WHEN doc_id % 4 = 1 THEN 1 - quality ELSE quality END AS INTEGER) AS yhat FROM labels)"""


def rated(spark, sf):
    """Labels with a second rater who disagrees on every fourth document."""
    lab = read_table(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").alias("y"), F.when(
        F.col("doc_id") % 4 == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("yhat"))


@query("a15_confusion_matrix", sql(RATED_SQL, f"""SELECT y, yhat, count(*) AS n,
  {sql6("count(*) / sum(count(*)) OVER (PARTITION BY y)")} AS share FROM rated GROUP BY y, yhat"""))
def a15(spark, sf):
    return confusion_counts(rated(spark, sf)).withColumn("share", r6("share"))


@query("a16_row_norms", sql(TERMS_SQL, f"""SELECT doc_id, count(*) AS terms, {sql6("sqrt(sum(c * c))")} AS norm,
  CAST(sum(c) AS BIGINT) AS total FROM (SELECT doc_id, term, count(*) AS c FROM terms GROUP BY ALL) GROUP BY doc_id"""))
def a16(spark, sf):
    counts = document_terms(spark, sf).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return counts.groupBy("doc_id").agg(F.count("*").alias("terms"), r6(F.sqrt(F.sum(F.col("c") * F.col("c")))).alias("norm"),
                                        F.sum("c").alias("total"))


@query("a17_minimum", sql(B.GRID_SQL, """SELECT series_id, min(total) AS low,
  arg_min(t, (total, t)) AS at FROM grid GROUP BY series_id"""))
def a17(spark, sf):
    grid = series.hour_grid(B.alc_summary(spark, sf))
    return grid.groupBy("series_id").agg(F.min("total").alias("low"), F.min_by("t", F.struct("total", "t")).alias("at"))


@query("a18_six_hour_buckets", sql(B.HOURLY_SQL, """SELECT series_id, day, CAST(hour // 6 * 6 AS INTEGER) AS hour,
  CAST(sum(sum) AS BIGINT) AS sum, CAST(sum(len) AS BIGINT) AS len FROM hourly GROUP BY ALL"""))
def a18(spark, sf):
    return summary.six_hour_buckets(B.alc_summary(spark, sf))


@query("u1_union_months", sql(B.SHARE_SQL, f"""SELECT t, {sql6("x")} AS x FROM share WHERE series_id = 'click'
  UNION ALL SELECT t + 672, {sql6("x")} FROM share WHERE series_id = 'view'"""))
def u1(spark, sf):
    share = B.alc_share(spark, sf)
    both = series.two_months(B.month(share, B.MONTH_A, "both"), B.month(share, B.MONTH_B, "both"))
    return both.select("t", r6("x").alias("x"))


@query("u2_vocabulary_intersection", """SELECT DISTINCT a.term FROM
  (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents WHERE lang = 'en') a
  JOIN (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents WHERE lang = 'fr') b
  ON a.term = b.term""")
def u2(spark, sf):
    d = read_table(spark, sf, "documents")
    terms = d.select("lang", F.explode(plain_tokens(F.col("text"))).alias("term"))
    return terms.where("lang = 'en'").select("term").intersect(terms.where("lang = 'fr'").select("term"))


@query("u3_index_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf):
    d, lab = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    return d.select("doc_id").join(lab.select("doc_id"), "doc_id", "left_anti")


@query("u4_wide_to_long", sql(B.WEEKS_SQL, f"SELECT series_id, pos, seg, {sql6('x')} AS x FROM weeks"))
def u4(spark, sf):
    wide = series.wide_segments(series.split_segments(B.alc_share(spark, sf), 168), [1, 2, 3, 4])
    return series.long_segments(wide).select("series_id", "pos", "seg", r6("x").alias("x"))


@query("u5_long_to_wide", sql(B.WEEKS_SQL, "SELECT series_id, pos, " + ", ".join(
    f"{sql6(f'max(x) FILTER (WHERE seg = {i})')} AS seg_{i}" for i in (1, 2, 3, 4)) + " FROM weeks GROUP BY ALL"))
def u5(spark, sf):
    wide = series.wide_segments(series.split_segments(B.alc_share(spark, sf), 168), [1, 2, 3, 4])
    return wide.select("series_id", "pos", *[r6(f"seg_{i}").alias(f"seg_{i}") for i in (1, 2, 3, 4)])
