"""The given tables seen as tweets, posts, labels and series; Spark and SQL side by side.

``events`` stands for tweets: id, time and user are its own; the UTC offset and
place follow from the user, scores from ``value``, ``props`` and the ids.
Offsets include one outside the kept range. Series are keyed by event type;
``click`` plays the first month and ``view`` the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline.functions.places import with_local_time_by_offset
from murmurline.functions.scores import ALCOHOL_CHAIN, TOBACCO_CHAIN, alcohol_flags, flag, with_marginals
from murmurline.operators import series as S
from murmurline.operators.summary import as_series, hourly_summary
from murmurline.sources.readers import read_table

PLACES = ["Texas, USA", "Austin, TX", "Guam, USA", "London", "Portland, OR", "Georgia, USA", "Reading, PA, USA"]
PROPS = T.StructType([T.StructField("k", T.IntegerType())])
MONTH_A, MONTH_B = "click", "view"
LOW_SHARE = 0.6


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return tweets_of(read_table(spark, sf, "events"))


def tweets_of(ev: DataFrame) -> DataFrame:
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("user_id") % len(PLACES) + 1).cast("int"))
    return ev.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type", "value",
        F.from_json("props", PROPS).alias("props"),
        (F.lit(-14400) - 3600 * (F.col("user_id") % 6)).cast("int").alias("utc_offset"), place.alias("place"),
        (F.col("event_type") == "purchase").alias("alc_key"))


def alcohol_scores(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    raw = df.withColumns({
        "predict_alc": F.least(F.col("value") / 100, F.lit(1.0)),
        "predict_fpa_given_alc": (F.lit(99) - F.col("props.k")) / F.lit(99.0),
        "predict_present_given_fpa": (F.col("id") % 10) / F.lit(10.0),
        "predict_future_given_fpa": (F.col("user_id") % 10) / F.lit(10.0),
        "predict_past_given_fpa": ((F.col("id") + F.col("user_id")) % 10) / F.lit(10.0)})
    return with_marginals(raw, "predict_alc", threshold, ALCOHOL_CHAIN)


def tobacco_scores(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    raw = df.withColumns({
        "predict_tob": F.least(F.col("value") / 80, F.lit(1.0)),
        "predict_com": (F.col("props.k") + 1) / F.lit(100.0),
        "predict_fp_given_tob": (F.lit(99) - F.col("props.k")) / F.lit(99.0),
        "predict_cur_given_fp": (F.col("id") % 10) / F.lit(10.0),
        "predict_present_given_fp": (F.col("user_id") % 10) / F.lit(10.0)})
    raw = (raw.withColumn("predict_not_cur_given_fp", 1 - F.col("predict_cur_given_fp"))
              .withColumn("predict_not_present_given_fp", 1 - F.col("predict_present_given_fp"))
              .withColumn("shisha", F.col("event_type") == "signup"))
    return with_marginals(raw, "predict_tob", threshold, TOBACCO_CHAIN)


def local_scored(spark: SparkSession, sf: str) -> DataFrame:
    return alcohol_scores(with_local_time_by_offset(tweets(spark, sf)))


def hourly(spark: SparkSession, sf: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """series_id, class, day, hour, sum, len by event type."""
    out = hourly_summary(local_scored(spark, sf), flags or alcohol_flags(), by=("event_type",))
    return out.withColumnRenamed("event_type", "series_id")


def alc_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows of the class ``alc`` only."""
    return as_series(hourly(spark, sf, {"alc": flag("predict_alc", 0.5)}), "series_id")


def alc_clean(spark: SparkSession, sf: str) -> DataFrame:
    return S.clean_series(alc_summary(spark, sf), S.share_of_mean(LOW_SHARE))


def alc_share(spark: SparkSession, sf: str, span: tuple[int, int] = S.SLICES["june"]) -> DataFrame:
    """Proportion series of 28 days."""
    return S.proportion(S.slice_hours(alc_clean(spark, sf), *span))


def month(df: DataFrame, series_id: str, name: str | None = None) -> DataFrame:
    out = df.where(F.col("series_id") == series_id)
    return out.withColumn("series_id", F.lit(name)) if name else out


# ---- the same in SQL -------------------------------------------------------

_PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in PLACES) + f"][CAST(user_id % {len(PLACES)} AS INTEGER) + 1]"

TWEETS_SQL = f"""tweets AS (
  SELECT event_id AS id, ts AS created_at, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CAST(-14400 - 3600 * (user_id % 6) AS INTEGER) AS utc_offset, {_PLACE_SQL} AS place,
         event_type = 'purchase' AS alc_key
  FROM events)"""

LOCAL_SQL = TWEETS_SQL + """, local AS (
  SELECT *, created_at + to_seconds(utc_offset) AS local_time FROM tweets
  WHERE utc_offset BETWEEN -28800 AND -14400)"""

SCORED_SQL = LOCAL_SQL + """, gated AS (
  SELECT *, least(value / 100, 1) AS predict_alc,
    CASE WHEN least(value / 100, 1) > 0.5 THEN (99 - k) / 99 ELSE 0 END AS predict_fpa_given_alc,
    CASE WHEN least(value / 100, 1) > 0.5 THEN (id % 10) / 10 ELSE 0 END AS g_present,
    CASE WHEN least(value / 100, 1) > 0.5 THEN (user_id % 10) / 10 ELSE 0 END AS g_future,
    CASE WHEN least(value / 100, 1) > 0.5 THEN ((id + user_id) % 10) / 10 ELSE 0 END AS g_past
  FROM local), scored AS (
  SELECT *, predict_alc * predict_fpa_given_alc AS predict_fpa,
    predict_alc * predict_fpa_given_alc * g_present AS predict_present,
    predict_alc * predict_fpa_given_alc * g_future AS predict_future,
    predict_alc * predict_fpa_given_alc * g_past AS predict_past
  FROM gated)"""

HOURLY_SQL = LOCAL_SQL + """, hourly AS (
  SELECT event_type AS series_id, CAST(day(local_time) AS INTEGER) AS day, CAST(hour(local_time) AS INTEGER) AS hour,
         count(*) FILTER (WHERE least(value / 100, 1) > 0.5) AS sum, count(*) AS len
  FROM local GROUP BY ALL)"""

GRID_SQL = HOURLY_SQL + """, grid AS (
  SELECT g.series_id, CAST(g.t AS INTEGER) AS t, CAST(coalesce(h.sum, 0) AS DOUBLE) AS x,
         CAST(coalesce(h.len, 0) AS DOUBLE) AS total
  FROM (SELECT s.series_id, g.t FROM (SELECT DISTINCT series_id FROM hourly) s CROSS JOIN (SELECT unnest(range(1, 721)) AS t) g
        UNION SELECT series_id, (day - 1) * 24 + hour + 1 FROM hourly) g
  LEFT JOIN hourly h ON h.series_id = g.series_id AND (h.day - 1) * 24 + h.hour + 1 = g.t)"""

MASK_SQL = GRID_SQL + f""", masked AS (
  SELECT series_id, t, CASE WHEN total >= {LOW_SHARE} * m THEN x END AS x,
         CASE WHEN total >= {LOW_SHARE} * m THEN total END AS total
  FROM (SELECT *, avg(total) OVER (PARTITION BY series_id) AS m FROM grid))"""

CLEAN_SQL = MASK_SQL + """, clean AS (
  SELECT series_id, t, last_value(x IGNORE NULLS) OVER w AS x, last_value(total IGNORE NULLS) OVER w AS total
  FROM masked WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SHARE_SQL = CLEAN_SQL + """, share AS (
  SELECT series_id, t - 32 AS t, x / total AS x FROM clean WHERE t BETWEEN 33 AND 704)"""

DAYS_SQL = SHARE_SQL + """, days AS (
  SELECT series_id, CAST((t - 1) // 24 + 1 AS INTEGER) AS seg, CAST((t - 1) % 24 AS INTEGER) AS pos, x FROM share)"""

WEEKS_SQL = SHARE_SQL + """, weeks AS (
  SELECT series_id, CAST((t - 1) // 168 + 1 AS INTEGER) AS seg, CAST((t - 1) % 168 AS INTEGER) AS pos, x FROM share)"""


def sql(base: str, body: str) -> str:
    return f"WITH {base}\n{body}"


def sql6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE"
