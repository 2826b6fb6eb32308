"""W: grids, masks, carry-forward, slices, segments and moving statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions import scores
from murmurline.operators import profiles, ranking, series
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import _CUBE_SQL, _DOW_SQL, hour_of_week_rows
from murmurline.plans.registry import query


def _share(spark, sf):
    return B.alc_share(spark, sf).select("series_id", "t", "x")


@query("w1_locf", sql(B.CLEAN_SQL, "SELECT * FROM clean"))
def w1(spark, sf):
    masked = series.mask_low_volume(series.hour_grid(B.alc_summary(spark, sf)), series.share_of_mean(B.LOW_SHARE))
    return series.carry_forward(masked)


@query("w1_locf_compat", sql(B.CLEAN_SQL, """SELECT series_id,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) AS INTEGER) AS t, x, total
  FROM clean WHERE total IS NOT NULL"""))
def w1_compat(spark, sf):
    masked = series.mask_low_volume(series.hour_grid(B.alc_summary(spark, sf)), series.share_of_mean(B.LOW_SHARE))
    return series.carry_forward(masked, compat=True)


@query("w2_low_volume_mask", sql(B.MASK_SQL, "SELECT * FROM masked"))
def w2(spark, sf):
    return series.mask_low_volume(series.hour_grid(B.alc_summary(spark, sf)), series.share_of_mean(B.LOW_SHARE))


@query("w3_hour_grid", sql(B.GRID_SQL, "SELECT * FROM grid"))
def w3(spark, sf):
    return series.hour_grid(B.alc_summary(spark, sf))


@query("w3_hour_grid_thirty_days", sql(B.GRID_SQL, "SELECT * FROM grid WHERE t <= 720"))
def w3_thirty(spark, sf):
    return series.hour_grid(B.alc_summary(spark, sf), keep_outside=False)


@query("w4_clean_series", sql(B.CLEAN_SQL, "SELECT * FROM clean"))
def w4(spark, sf):
    return B.alc_clean(spark, sf)


@query("w5_slice_hours", sql(B.CLEAN_SQL, """SELECT series_id, CAST(t - 8 AS INTEGER) AS t, x, total FROM clean
  WHERE t BETWEEN 9 AND 680"""))
def w5(spark, sf):
    return series.slice_hours(B.alc_clean(spark, sf), *series.SLICES["sept"])


@query("w6_proportion", sql(B.CLEAN_SQL, f"SELECT series_id, t, {sql6('x / total')} AS x FROM clean"))
def w6(spark, sf):
    return series.proportion(B.alc_clean(spark, sf)).select("series_id", "t", r6("x").alias("x"))


@query("w7_seasonal_log_difference", sql(B.SHARE_SQL, f"""SELECT series_id, CAST(t - 168 AS INTEGER) AS t,
  {sql6("d")} AS x FROM (SELECT *, ln(x + 0.001) - lag(ln(x + 0.001), 168)
  OVER (PARTITION BY series_id ORDER BY t) AS d FROM share) WHERE t > 168"""))
def w7(spark, sf):
    return series.seasonal_log_difference(_share(spark, sf), shift=0.001).withColumn("x", r6("x"))


@query("w8_split_by_day", sql(B.DAYS_SQL, f"SELECT series_id, seg, pos, {sql6('x')} AS x FROM days"))
def w8(spark, sf):
    return series.split_segments(_share(spark, sf), 24).withColumn("x", r6("x"))


@query("w9_split_by_week", sql(B.WEEKS_SQL, f"SELECT series_id, seg, pos, {sql6('x')} AS x FROM weeks"))
def w9(spark, sf):
    return series.split_segments(_share(spark, sf), 168).withColumn("x", r6("x"))


@query("w10_day_of_week_cube", sql(_CUBE_SQL, f"SELECT series_id, weekday, hour, week, {sql6('x')} AS x FROM cube_rows"))
def w10(spark, sf):
    return series.weekday_cube(_share(spark, sf)).withColumn("x", r6("x"))


@query("w11_two_months_by_weekday", sql(_DOW_SQL, "SELECT dow, hour, x, total FROM both_months"))
def w11(spark, sf):
    return hour_of_week_rows(spark, sf).drop("series_id")


@query("w12_centered_mean_5", sql(B.SHARE_SQL, f"""SELECT series_id, CAST(t AS INTEGER) AS t, {sql6("m")} AS x FROM (
  SELECT *, avg(x) OVER w AS m, count(*) OVER w AS n FROM share
  WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5"""))
def w12(spark, sf):
    return series.centered_mean(_share(spark, sf), 5).withColumn("x", r6("x"))


_CLASS_SQL = B.SCORED_SQL + """, ch AS (SELECT CAST((day(local_time) - 1) * 24 + hour(local_time) + 1 AS INTEGER) AS t,
   count(*) FILTER (WHERE predict_present > 0.3) AS cas, count(*) FILTER (WHERE predict_future > 0.3) AS look,
   count(*) FILTER (WHERE predict_past > 0.3) AS ref FROM scored GROUP BY ALL),
  cg AS (SELECT CAST(t AS INTEGER) AS t, coalesce(cas, 0) AS cas, coalesce(look, 0) AS look, coalesce(ref, 0) AS ref
    FROM (SELECT unnest(range(1, 721)) AS t) g FULL JOIN ch USING (t)),
  cs AS (SELECT t, coalesce(cas / nullif(cas + look + ref, 0), 0) AS cas, coalesce(look / nullif(cas + look + ref, 0), 0) AS look,
    coalesce(ref / nullif(cas + look + ref, 0), 0) AS ref FROM cg)"""


@query("w13_rolling_share_3", sql(_CLASS_SQL, f"""SELECT t, {sql6("mc")} AS cas, {sql6("ml")} AS look, {sql6("mr")} AS ref
  FROM (SELECT t, avg(cas) OVER w AS mc, avg(look) OVER w AS ml, avg(ref) OVER w AS mr, count(*) OVER w AS n FROM cs
  WINDOW w AS (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE n = 3"""))
def w13(spark, sf):
    from murmurline.operators.summary import hourly_summary
    flags = {"cas": scores.flag("predict_present", 0.3), "look": scores.flag("predict_future", 0.3),
             "ref": scores.flag("predict_past", 0.3)}
    s = hourly_summary(B.local_scored(spark, sf), flags).withColumnRenamed("class", "series_id")
    wide = series.hour_grid(s).groupBy("t").pivot("series_id", list(flags)).agg(F.first("x"))
    fp = F.col("cas") + F.col("look") + F.col("ref")
    shares = wide.select(F.lit("all").alias("series_id"), "t", *[scores.ratio_or_zero(F.col(n), fp).alias(n) for n in flags])
    out = series.centered_mean(shares, 3, tuple(flags))
    return out.select("t", *[r6(n).alias(n) for n in flags])


@query("w14_lag_matrix", sql(B.SHARE_SQL, f"""SELECT series_id, CAST(t - 50 AS INTEGER) AS row,
  {sql6("list_sum(f)")} AS feature_sum, {sql6("f[1]")} AS first, {sql6("f[50]")} AS last, {sql6("x")} AS y FROM (
  SELECT *, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS f FROM share)
  WHERE len(f) = 50"""))
def w14(spark, sf):
    m = series.lag_matrix(_share(spark, sf), 50)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return m.select("series_id", "row", r6(total).alias("feature_sum"), r6(F.col("features")[0]).alias("first"),
                    r6(F.col("features")[49]).alias("last"), r6("y").alias("y"))


_RANK_BASE = """weights AS (SELECT event_type || '_' || k AS term, sum(value - 50) AS coef FROM (
  SELECT event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, value FROM events) GROUP BY ALL)"""


def term_weights(spark, sf):
    """Signed sums per event type and JSON key, in place of model coefficients."""
    t = B.tweets(spark, sf)
    return t.groupBy(F.concat_ws("_", "event_type", F.col("props.k").cast("string")).alias("term")).agg(
        F.sum(F.col("value") - 50).alias("coef"))


@query("w18_percentile_rank", sql(_RANK_BASE, f"""SELECT term, {sql6("coef")} AS coef,
  {sql6("(row_number() OVER (ORDER BY round(coef, 6), term) - 1) / count(*) OVER ()")} AS percentile FROM weights"""))
def w18(spark, sf):
    w = term_weights(spark, sf).withColumn("coef", r6("coef"))
    return ranking.percentile_rank(w, "coef", ("term",)).withColumn("percentile", r6("percentile"))


@query("w19_series_arithmetic", sql(B.CLEAN_SQL, f"""SELECT a.t, {sql6("coalesce(a.x / nullif(b.x, 0), 0)")} AS ratio,
  {sql6("b.x - a.x")} AS diff FROM clean a JOIN clean b USING (t) WHERE a.series_id = 'click' AND b.series_id = 'view'"""))
def w19(spark, sf):
    clean = B.alc_clean(spark, sf)
    a, b = B.month(clean, B.MONTH_A, "s"), B.month(clean, B.MONTH_B, "s")
    both = series.combine_series(a, b, F.struct(scores.ratio_or_zero(F.col("xa"), F.col("xb")).alias("ratio"),
                                                (F.col("xb") - F.col("xa")).alias("diff")))
    return both.select("t", r6("x.ratio").alias("ratio"), r6("x.diff").alias("diff"))


_SUMS_SQL = B.CLEAN_SQL + """, w4 AS (SELECT series_id, CAST((t - 33) % 168 AS INTEGER) AS pos, sum(x) AS s
  FROM clean WHERE t BETWEEN 33 AND 704 GROUP BY ALL)"""


@query("w20_quotient_of_sums", sql(_SUMS_SQL, f"""SELECT a.pos, {sql6("a.s / nullif(b.s, 0)")} AS x
  FROM w4 a JOIN w4 b USING (pos) WHERE a.series_id = 'click' AND b.series_id = 'view'"""))
def w20(spark, sf):
    weeks = series.split_segments(series.slice_hours(B.alc_clean(spark, sf), *series.SLICES["june"]), 168)
    out = profiles.quotient_of_sums(B.month(weeks, B.MONTH_A, "s"), B.month(weeks, B.MONTH_B, "s"))
    return out.select("pos", r6("x").alias("x"))
