"""J: joins; T: sorts, top-k and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions.text import utf8
from murmurline.operators import ranking, series
from murmurline.operators.distance import distances, euclidean
from murmurline.operators.joins import keyed_scores, outer_union
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import TERMS_SQL, document_terms
from murmurline.plans.queries.hourly_series import _RANK_BASE, term_weights
from murmurline.plans.registry import query
from murmurline.sources.readers import read_table


@query("j1_tweets_join_predictions", sql(B.SCORED_SQL, f"""SELECT t.id, t.place, {sql6("s.predict_alc")} AS predict_alc
  FROM tweets t JOIN scored s ON t.id = s.id"""))
def j1(spark, sf):
    scored = B.local_scored(spark, sf).select("id", "predict_alc")
    return B.tweets(spark, sf).join(scored, "id").select("id", "place", r6("predict_alc").alias("predict_alc"))


@query("j2_outer_merge", sql(B.TWEETS_SQL, """SELECT id, alc_key, CASE WHEN alc_key THEN least(value / 100, 1) END AS predict_alc
  FROM tweets"""))
def j2(spark, sf):
    t = B.tweets(spark, sf).select("id", "alc_key", "value")
    scored = t.where("alc_key").withColumn("predict_alc", F.least(F.col("value") / 100, F.lit(1.0)))
    return outer_union(t.where("NOT alc_key"), scored).select("id", "alc_key", "predict_alc")


@query("j3_join_subset_back", sql(B.TWEETS_SQL, """SELECT id, CASE WHEN value > 50 THEN value / 100 ELSE 0 END AS score
  FROM tweets"""))
def j3(spark, sf):
    t = B.tweets(spark, sf).select("id", "value")
    part = t.where("value > 50").select("id", (F.col("value") / 100).alias("score"))
    return keyed_scores(t.select("id"), part, "id", ["score"])


@query("j4_grid_outer_merge", sql(B.GRID_SQL, "SELECT series_id, t, x FROM grid"))
def j4(spark, sf):
    return series.hour_grid(B.alc_summary(spark, sf)).select("series_id", "t", "x")


@query("j5_index_aligned_add", """SELECT d.doc_id, d.lang, l.quality AS new_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j5(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("new_label"))
    return read_table(spark, sf, "documents").select("doc_id", "lang").join(lab, "doc_id", "left")


@query("j6_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j6(spark, sf):
    good = read_table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return read_table(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("j7_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7(spark, sf):
    done = read_table(spark, sf, "labels").select("doc_id")
    return read_table(spark, sf, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


_LANG_DF = TERMS_SQL.replace("SELECT doc_id,", "SELECT doc_id, lang,")


@query("j8_vocabulary_join", sql(_LANG_DF, """SELECT a.term, a.n AS n_en, b.n AS n_de FROM
  (SELECT term, count(*) AS n FROM terms WHERE lang = 'en' GROUP BY ALL) a JOIN
  (SELECT term, count(*) AS n FROM terms WHERE lang = 'de' GROUP BY ALL) b ON a.term = b.term"""))
def j8(spark, sf):
    from murmurline.functions.text import plain_tokens
    d = read_table(spark, sf, "documents")
    counts = (d.select("lang", F.explode(plain_tokens(F.col("text"))).alias("term"))
              .groupBy("term", "lang").agg(F.count("*").alias("n")))
    en = counts.where("lang = 'en'").select("term", F.col("n").alias("n_en"))
    return en.join(counts.where("lang = 'de'").select("term", F.col("n").alias("n_de")), "term")


@query("j9_all_pairs", sql(B.DAYS_SQL, f"""SELECT a.series_id AS group_id, a.seg AS a, b.seg AS b,
  {sql6("sqrt(sum((a.x - b.x) * (a.x - b.x)))")} AS d FROM days a JOIN days b
  ON a.series_id = b.series_id AND a.pos = b.pos GROUP BY ALL"""))
def j9(spark, sf):
    """Full matrix: both halves and the diagonal of the days of each series."""
    days = series.segment_arrays(series.split_segments(B.alc_share(spark, sf), 24))
    return distances(days, euclidean, full=True).withColumn("d", r6("d"))


@query("j10_column_bind", sql(B.SHARE_SQL, f"""SELECT a.t, {sql6("a.x")} AS first, {sql6("b.x")} AS second
  FROM share a JOIN share b USING (t) WHERE a.series_id = 'click' AND b.series_id = 'view'"""))
def j10(spark, sf):
    share = B.alc_share(spark, sf)
    a = B.month(share, B.MONTH_A).select("t", F.col("x").alias("first"))
    b = B.month(share, B.MONTH_B).select("t", F.col("x").alias("second"))
    return a.join(b, "t").select("t", r6("first").alias("first"), r6("second").alias("second"))


@query("j11_dimension_join", sql(B.TWEETS_SQL, """SELECT id, right(place, 2) AS state,
  CASE right(place, 2) WHEN 'TX' THEN 'Texas' WHEN 'OR' THEN 'Oregon' END AS name,
  CAST(CASE right(place, 2) WHEN 'TX' THEN -6 WHEN 'OR' THEN -8 END AS INTEGER) AS tz
  FROM tweets WHERE right(place, 2) IN ('TX', 'OR')"""))
def j11(spark, sf):
    from murmurline.functions.places import states
    t = B.tweets(spark, sf).select("id", F.right("place", F.lit(2)).alias("state"))
    return t.join(F.broadcast(states(spark)), "state")  # 57 rows, fixed


def hash_sql(key: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 15) AS BIGINT)"


@query("t1_make_batch", f"""SELECT _id, text, random_number, CASE WHEN r <= 100 THEN 'batch' ELSE 'pool' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY random_number, _id) AS r FROM (
    SELECT CAST(doc_id AS VARCHAR) AS _id, encode(text) AS text, {hash_sql('text')} AS random_number FROM documents))""")
def t1(spark, sf):
    d = read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), "text", ranking.stable_hash(F.col("text")).alias("random_number"))
    batch, rest = ranking.next_batch(d, 100)
    out = batch.select("_id", utf8(F.col("text")).alias("text"), "random_number", F.lit("batch").alias("part"))
    return out.unionByName(rest.select("_id", utf8(F.col("text")).alias("text"), "random_number", F.lit("pool").alias("part")))


@query("t1_batch_by_position", "SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 100")
def t1_ordered(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    batch, _ = ranking.next_batch(d, 100, key="doc_id", order="n_chars")
    return batch.select("doc_id")


@query("t2_hash_sort_key", f"SELECT doc_id, {hash_sql('text')} AS random_number FROM documents")
def t2(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", ranking.stable_hash(F.col("text")).alias("random_number"))


@query("t3_sample_per_source", """SELECT source, CAST(floor(count(*) * 0.1) AS BIGINT) AS n FROM documents GROUP BY source""")
def t3(spark, sf):
    """Exact sizes per source; the rows themselves follow the hash."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return ranking.sample_fraction(d, "source", "doc_id", 0.1, seed=3).groupBy("source").agg(F.count("*").alias("n"))


@query("t3_sampled_rows", f"""SELECT source, doc_id FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY {hash_sql('doc_id', 3)}, doc_id) AS r FROM documents) WHERE r <= floor(n * 0.1)""")
def t3_rows(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return ranking.sample_fraction(d, "source", "doc_id", 0.1, seed=3).select("source", "doc_id")


@query("t4_random_rows", f"SELECT doc_id, lang FROM documents ORDER BY {hash_sql('doc_id', 5)}, doc_id LIMIT 10")
def t4(spark, sf):
    return ranking.sample_rows(read_table(spark, sf, "documents").select("doc_id", "lang"), 10, "doc_id", seed=5)


@query("t5_top_terms", sql(_RANK_BASE, f"""(SELECT term, {sql6("coef")} AS coef, 'high' AS side FROM weights
  ORDER BY round(coef, 6) DESC, term LIMIT 10) UNION ALL (SELECT term, {sql6("coef")}, 'low' FROM weights
  ORDER BY round(coef, 6), term LIMIT 10)"""))
def t5(spark, sf):
    w = term_weights(spark, sf).withColumn("coef", r6("coef"))
    return (ranking.top_terms(w, "coef", 10).withColumn("side", F.lit("high"))
            .unionByName(ranking.top_terms(w, "coef", 10, largest=False).withColumn("side", F.lit("low"))))


_SHIFT_SQL = """kv AS (SELECT event_type, 'k' || CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS term, value FROM events),
 wt AS (SELECT event_type, term, round(sum(value - 50), 6) AS coef FROM kv GROUP BY ALL),
 pr AS (SELECT event_type, term, (row_number() OVER (PARTITION BY event_type ORDER BY coef, term) - 1)
   / count(*) OVER (PARTITION BY event_type) AS p FROM wt)"""


@query("t6_percentile_shift", sql(_SHIFT_SQL, f"""SELECT a.term, {sql6("a.p")} AS a, {sql6("b.p")} AS b, {sql6("a.p - b.p")} AS diff
  FROM pr a JOIN pr b ON a.term = b.term AND a.event_type = 'click' AND b.event_type = 'view'
  ORDER BY round(abs(a.p - b.p), 9) DESC, a.term LIMIT 20"""))
def t6(spark, sf):
    t = B.tweets(spark, sf).select("event_type", F.concat(F.lit("k"), F.col("props.k").cast("string")).alias("term"), "value")
    w = t.groupBy("event_type", "term").agg(r6(F.sum(F.col("value") - 50)).alias("coef"))
    ranks = {m: ranking.percentile_rank(w.where(F.col("event_type") == m), "coef", ("term",)) for m in (B.MONTH_A, B.MONTH_B)}
    out = ranking.largest_shifts(ranks[B.MONTH_A], ranks[B.MONTH_B], 20)
    return out.select("term", *[r6(c).alias(c) for c in ("a", "b", "diff")])


@query("t7_sorted_vocabulary", sql(TERMS_SQL, """SELECT term, row_number() OVER (ORDER BY term) AS column
  FROM (SELECT DISTINCT term FROM terms)""").replace("AS column", 'AS "column"'))
def t7(spark, sf):
    return ranking.sorted_vocabulary(document_terms(spark, sf))


@query("t8_vocabulary_cap", sql(TERMS_SQL, "SELECT term, count(*) AS n FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 2000"))
def t8(spark, sf):
    counts = document_terms(spark, sf).groupBy("term").agg(F.count("*").alias("n"))
    return ranking.frequent_terms(counts, 2000)


@query("t9_head", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 6")
def t9(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id").limit(6)


@query("t10_train_test_split", f"SELECT {hash_sql('doc_id', 23)} % 100 < 33 AS test, quality, count(*) AS n FROM labels GROUP BY ALL")
def t10(spark, sf):
    lab = ranking.hash_split(read_table(spark, sf, "labels"), "doc_id", 33, seed=23)
    return lab.groupBy("test", "quality").agg(F.count("*").alias("n"))
