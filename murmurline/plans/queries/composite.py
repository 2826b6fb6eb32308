"""K: user-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.operators import clustering, distance, profiles, series, spectral
from murmurline.functions import scores
from murmurline.functions.places import with_local_time_by_offset
from murmurline.operators.summary import as_series, hourly_summary
from murmurline.plans import bindings as B
from murmurline.plans import jobs
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import _DOW_SQL, hour_of_week_rows
from murmurline.plans.queries.statistics import _PI2, dft_sql
from murmurline.plans.registry import query

_TWO = B.CLEAN_SQL + """, two AS (SELECT t - 32 AS t, x, total FROM clean WHERE series_id = 'click' AND t BETWEEN 33 AND 704
  UNION ALL SELECT t - 8 + 672, x, total FROM clean WHERE series_id = 'view' AND t BETWEEN 9 AND 680)"""


def _months(spark, sf):
    s = B.alc_summary(spark, sf)
    return B.month(s, B.MONTH_A, "both"), B.month(s, B.MONTH_B, "both")


def two_months(spark, sf):
    return jobs.two_month_series(*_months(spark, sf), threshold=series.share_of_mean(B.LOW_SHARE))


@query("k1_two_month_series", sql(_TWO, "SELECT CAST(t AS INTEGER) AS t, x, total FROM two"))
def k1(spark, sf):
    return two_months(spark, sf).select("t", "x", "total")


@query("k2_month_share", sql(B.SHARE_SQL, f"SELECT series_id, CAST(t AS INTEGER) AS t, {sql6('x')} AS x FROM share"))
def k2(spark, sf):
    out = series.month_share(B.alc_summary(spark, sf), series.SLICES["june"], series.share_of_mean(B.LOW_SHARE))
    return out.select("series_id", "t", r6("x").alias("x"))


_PART = _TWO + """, part AS (SELECT t, coalesce(x / nullif(total, 0), 0) AS x FROM two),
  pw AS (SELECT CAST((t - 1) % 168 AS INTEGER) AS pos, CAST((t - 1) // 168 + 1 AS INTEGER) AS seg, x FROM part)"""


def part_share(spark, sf):
    two = two_months(spark, sf)
    return jobs.subclass_share(two, two.withColumn("x", F.col("total")))


@query("k3_subclass_share_band", sql(_PART, f"""SELECT pos, {sql6("avg(x)")} AS mean, {sql6("quantile_cont(x, 0.25)")} AS low,
  {sql6("quantile_cont(x, 0.75)")} AS high FROM pw GROUP BY pos"""))
def k3(spark, sf):
    out = jobs.hour_of_week_band(part_share(spark, sf))
    return out.select("pos", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query("k3_subclass_share_tree")
def k3_tree(spark, sf):
    mean = jobs.hour_of_week_band(part_share(spark, sf)).select("series_id", (F.col("pos") + 1).alias("t"), F.col("mean").alias("x"))
    return jobs.cluster_segments(mean, 24).withColumn("height", r6("height"))


@query("k4_total_by_hour_of_week", sql(_TWO, """SELECT CAST((t - 1) % 168 AS INTEGER) AS pos, sum(x) AS total FROM two GROUP BY ALL"""))
def k4(spark, sf):
    return jobs.hour_of_week_total(two_months(spark, sf)).select("pos", "total")


@query("k5_absolute_counts_tree")
def k5(spark, sf):
    return jobs.cluster_segments(two_months(spark, sf), 24).withColumn("height", r6("height"))


_SIX = B.HOURLY_SQL + """, six AS (SELECT h.series_id, g.t - 4 AS t, CAST(coalesce(sum(x.sum), 0) AS DOUBLE) AS x
  FROM (SELECT DISTINCT series_id FROM hourly) h CROSS JOIN (SELECT unnest(range(5, 117)) AS t) g
  LEFT JOIN hourly x ON x.series_id = h.series_id AND (x.day - 1) * 4 + x.hour // 6 + 1 = g.t GROUP BY h.series_id, g.t)"""


@query("k5_six_hour_counts", sql(_SIX, "SELECT series_id, CAST(t AS INTEGER) AS t, x FROM six"))
def k5_six(spark, sf):
    return jobs.six_hour_series(B.alc_summary(spark, sf)).select("series_id", "t", "x")


@query("k5_six_hour_tree")
def k5_six_tree(spark, sf):
    return jobs.cluster_segments(jobs.six_hour_series(B.alc_summary(spark, sf)), 4).withColumn("height", r6("height"))


_CMP = _DOW_SQL + """, ot AS (SELECT dow, hour, sum(x) / sum(total) AS xa FROM both_months GROUP BY ALL),
  sh AS (SELECT CAST(((t - 1) // 24) % 7 AS INTEGER) AS dow, CAST((t - 1) % 24 AS INTEGER) AS hour, sum(total) AS xb
    FROM grid WHERE series_id = 'signup' AND t <= 672 GROUP BY ALL),
  cm AS (SELECT xa / (SELECT sum(xa) FROM ot) AS xa, xb / (SELECT sum(xb) FROM sh) AS xb FROM ot JOIN sh USING (dow, hour))"""


@query("k6_cross_source_comparison", sql(_CMP, f"SELECT count(*) AS n, {sql6('corr(xa, xb)')} AS r FROM cm"))
def k6(spark, sf):
    """Hour-of-week share of one source against the activity of another."""
    slot = (F.col("dow") * 24 + F.col("hour") + 1).alias("t")
    a = profiles.hour_of_week_share(hour_of_week_rows(spark, sf)).select(F.lit("s").alias("series_id"), slot, F.col("prop").alias("x"))
    grid = B.month(series.hour_grid(B.alc_summary(spark, sf)), "signup", "s").where("t <= 672")
    b = (series.split_segments(grid, 168).groupBy("series_id", "pos").agg(F.sum("total").alias("x"))
         .select("series_id", (F.col("pos") + 1).alias("t"), "x"))
    return jobs.source_comparison(a, b).select("n", r6("r").alias("r"))


@query("k6_trend_cross_correlation", sql(_TWO + """, tr AS (SELECT t, x / total AS xa, CAST(y AS DOUBLE) AS xb FROM two JOIN (
    SELECT t AS t2, total AS y FROM grid WHERE series_id = 'signup' AND t <= 672) g ON t2 = t),
  ce AS (SELECT t, xa / (SELECT avg(xa) FROM tr) AS a, xb / (SELECT avg(xb) FROM tr) AS b FROM tr),
  cd AS (SELECT t, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM ce)""", f"""SELECT CAST(l.lag AS INTEGER) AS lag,
  {sql6("coalesce(sum(x.a * y.b), 0) / (SELECT sqrt(sum(a * a) * sum(b * b)) FROM cd)")} AS ccf
  FROM cd y CROSS JOIN (SELECT unnest(range(-24, 25)) AS lag) l LEFT JOIN cd x ON x.t = y.t + l.lag GROUP BY l.lag"""))
def k6_trend(spark, sf):
    from murmurline.operators import correlation
    share = series.proportion(two_months(spark, sf)).where("t <= 672").select("series_id", "t", "x")
    grid = B.month(series.hour_grid(B.alc_summary(spark, sf)), "signup", "both").where("t <= 672")
    a = profiles.relative_to(share).select("series_id", "t", F.col("x").alias("xa"))
    b = profiles.relative_to(grid.select("series_id", "t", F.col("total").alias("x"))).select("series_id", "t", F.col("x").alias("xb"))
    return correlation.ccf(a.join(b, ["series_id", "t"]), 24).select("lag", r6("ccf").alias("ccf"))


_NEW_SQL = B.SHARE_SQL.replace("least(value / 100, 1) > 0.5", "least(value / 100, 1) > 0.6")


@query("k7_threshold_comparison", f"""SELECT o.series_id, o.seg, o.pos, {sql6("o.x")} AS old, {sql6("n.x")} AS new
  FROM ({sql(B.WEEKS_SQL, "SELECT * FROM weeks")}) o JOIN ({sql(B.WEEKS_SQL.replace(B.SHARE_SQL, _NEW_SQL), "SELECT * FROM weeks")}) n
  ON o.series_id = n.series_id AND o.seg = n.seg AND o.pos = n.pos""")
def k7(spark, sf):
    low = series.share_of_mean(B.LOW_SHARE)
    raised = as_series(B.hourly(spark, sf, {"alc": scores.flag("predict_alc", 0.6)}), "series_id")
    out = jobs.by_week_comparison(*[series.month_share(s, series.SLICES["june"], low) for s in (B.alc_summary(spark, sf), raised)])
    return out.select("series_id", "seg", "pos", r6("old").alias("old"), r6("new").alias("new"))


def _utc_and_local(spark, sf):
    rows = B.alcohol_scores(with_local_time_by_offset(B.tweets(spark, sf)))
    flags = {"alc": scores.flag("predict_alc", 0.5)}
    utc = as_series(hourly_summary(rows, flags, ts="created_at"), F.lit("utc"))
    local = as_series(hourly_summary(rows, flags, ts="local_time"), F.lit("local"))
    return series.hour_grid(utc.unionByName(local)).select("series_id", "t", F.col("total").alias("x"))


_SHIFT = B.LOCAL_SQL + """, hu AS (SELECT 'utc' AS series_id, (day(created_at) - 1) * 24 + hour(created_at) + 1 AS t, count(*) AS x FROM local GROUP BY ALL
  UNION ALL SELECT 'local', (day(local_time) - 1) * 24 + hour(local_time) + 1, count(*) FROM local GROUP BY ALL),
  gu AS (SELECT s.series_id, g.t - 48 AS t, coalesce(h.x, 0) AS x FROM (SELECT unnest(['utc', 'local']) AS series_id) s
   CROSS JOIN (SELECT unnest(range(49, 673)) AS t) g LEFT JOIN hu h ON h.series_id = s.series_id AND h.t = g.t)"""


@query("k8_clock_shift", sql(_SHIFT + dft_sql("[26]", "gu"), f"""SELECT CAST(a.k AS INTEGER) AS k, {sql6(
    f"24 * abs(atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im)) / {_PI2}")} AS hours
  FROM ft a JOIN ft b ON a.k = b.k WHERE a.series_id = 'utc' AND b.series_id = 'local'"""))
def k8(spark, sf):
    """Daily phase between UTC and local totals over 26 days, in hours."""
    cut = series.slice_hours(_utc_and_local(spark, sf), 49, 672)
    out = spectral.phase_shift(B.month(cut, "utc", "s"), B.month(cut, "local", "s"), [26])
    return out.select("k", r6(F.col("shift") * 24).alias("hours"))


@query("k8_clock_shift_clusters")
def k8_tree(spark, sf):
    cut = series.slice_hours(_utc_and_local(spark, sf), 49, 192)
    segs = series.split_segments(cut, 24)
    together = segs.select(F.lit("days").alias("series_id"),
                           (F.col("seg") + F.when(F.col("series_id") == "utc", 0).otherwise(6)).cast("int").alias("seg"), "pos", "x")
    edges = distance.distances(series.segment_arrays(together), distance.phase_distance(1))
    return clustering.k_medoids(edges, 2)


_AGE = B.CLEAN_SQL + """, ag AS (SELECT series_id, CAST((t - 33) // 168 + 1 AS INTEGER) AS seg, CAST((t - 33) % 168 AS INTEGER) AS pos, x, total
  FROM clean WHERE t BETWEEN 33 AND 704), an AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY series_id, seg)) AS n,
  1.96 * sqrt(x / total - (x / total) * (x / total)) / sqrt(total) * total AS e FROM ag)"""


@query("k9_age_comparison", sql(_AGE, f"""SELECT series_id, seg, pos, {sql6("x / n")} AS x, {sql6("x / n - e / n")} AS low,
  {sql6("x / n + e / n")} AS high FROM an"""))
def k9(spark, sf):
    out = jobs.age_comparison(series.slice_hours(B.alc_clean(spark, sf), *series.SLICES["age"]))
    return out.select("series_id", "seg", "pos", *[r6(c).alias(c) for c in ("x", "low", "high")])


@query("k10_two_week_periodogram", sql(
    B.CLEAN_SQL + ", cw AS (SELECT series_id, t - 383 AS t, x / total AS x FROM clean WHERE t BETWEEN 384 AND 720)"
    + dft_sql("range(1, 100)", "cw"), f"SELECT series_id, CAST(k AS INTEGER) AS k, {sql6('re * re + im * im')} AS power FROM ft"))
def k10(spark, sf):
    out = jobs.window_periodogram(series.proportion(B.alc_clean(spark, sf)), 384, 720, list(range(1, 100)))
    return out.withColumn("power", r6("power"))
