"""X: keyword filters, cleaning, tokens, n-grams, TF-IDF, crowd labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions import text as X
from murmurline.functions.labels import FIRST_PERSON_LEVEL, NOT_RELATED, RELATED_KIND, LabelSelector, parse_answers
from murmurline.ml.features import document_frequencies, term_counts, tfidf_rows
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import TERMS_SQL
from murmurline.plans.registry import query
from murmurline.session import scratch_path, spread
from murmurline.sources.readers import read_table

FREQUENT = ["the", "and", "beer", "der", "que", "is"]


def posts(spark, sf):
    """Documents, and pages turned into short posts with links, mentions and faces."""
    d = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("post_id"), "text")
    face = F.element_at(F.array(*[F.lit(f) for f in (":)", ":(", ":-D =(", "ok")]), (F.col("page_id") % 4 + 1).cast("int"))
    p = read_table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("post_id"),
        F.concat(F.lit("\"Sooo good: see "), "url", F.lit("  via @user_"), F.col("page_id") % 7, F.lit(" #tag"),
                 F.col("page_id") % 3, F.lit(" it's "), face, F.lit("\"")).alias("text"))
    return spread(d.unionByName(p))


POSTS_SQL = """posts AS (SELECT 'd' || doc_id AS post_id, text FROM documents UNION ALL
  SELECT 'p' || page_id, '"Sooo good: see ' || url || '  via @user_' || (page_id % 7) || ' #tag' || (page_id % 3) || ' it''s '
    || [':)', ':(', ':-D =(', 'ok'][CAST(page_id % 4 AS INTEGER) + 1] || '"' FROM pages)"""


def _keywords_sql(column: str, keywords: list[str]) -> str:
    return f"list_has_any(string_split_regex({column}, '\\s+'), {keywords!r})".replace('"', "'")


@query("x1_keyword_prefilter", f"""SELECT doc_id, {_keywords_sql("lower(text)", X.ALCOHOL_KEYWORDS).replace("'jack daniel's'", "'jack daniel''s'").replace("'ballantine's'", "'ballantine''s'")} AS alc_key,
  {_keywords_sql("lower(text)", FREQUENT)} AS frequent FROM documents""")
def x1(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", X.has_keyword(F.col("text")).alias("alc_key"),
                    X.has_keyword(F.col("text"), FREQUENT).alias("frequent"))


@query("x2_keyword_case_sensitive", f"""SELECT doc_id, {_keywords_sql("text", X.SAMPLING_KEYWORDS)} AS alc_key,
  {_keywords_sql("text", FREQUENT)} AS frequent FROM documents""")
def x2(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", X.has_keyword(F.col("text"), X.SAMPLING_KEYWORDS, lower=False).alias("alc_key"),
                    X.has_keyword(F.col("text"), FREQUENT, lower=False).alias("frequent"))


_STARTS = ["The", "La", "Der", "En"]


@query("x3_regex_at_start", f"""SELECT doc_id, regexp_matches(text, '^({"|".join(X.SAMPLING_KEYWORDS)})') AS alc_key,
  regexp_matches(text, '^({"|".join(_STARTS)})') AS frequent FROM documents""")
def x3(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", X.starts_with_keyword(F.col("text")).alias("alc_key"),
                    X.starts_with_keyword(F.col("text"), _STARTS).alias("frequent"))


@query("x4_shisha_substring", f"""SELECT doc_id, regexp_matches(lower(text), '{"|".join(X.SHISHA_TERMS)}') AS shisha,
  regexp_matches(lower(text), 'tion|ment|ung') AS ending FROM documents""")
def x4(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", X.mentions_shisha(F.col("text")).alias("shisha"),
                    X.mentions_shisha(F.col("text"), ["tion", "ment", "ung"]).alias("ending"))


@query("x5_plain_ascii", sql(POSTS_SQL, r"""SELECT post_id, trim(regexp_replace(regexp_replace(regexp_replace(text,
  '[!$%&*+,\-./:;<=>?\[\\\]^_`{|}~]', ' ', 'g'), '@[A-Za-z0-9]+', '-MENTION-', 'g'), '[^\x21-\x7E]+', ' ', 'g')) AS text FROM posts"""))
def x5(spark, sf):
    return posts(spark, sf).select("post_id", X.plain_ascii(F.col("text")).alias("text"))


_NORMAL_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '(www\.|https?://)\S+', 'URL', 'g'), '@\S+', 'AT_USER', 'g'), '\s+', ' ', 'g'), '#(\S+)', '\1', 'g'), '''"')"""


@query("x6_normalise_tweet", sql(POSTS_SQL, f"SELECT post_id, {_NORMAL_SQL} AS text FROM posts"))
def x6(spark, sf):
    return posts(spark, sf).select("post_id", X.normalise_tweet(F.col("text")).alias("text"))


_REPEATS_SQL = """letters AS (SELECT post_id, unnest(string_split(text, '')) AS c,
  unnest(range(1, length(text) + 1)) AS i FROM posts),
 kept AS (SELECT post_id, i, c FROM (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM letters
  WINDOW w AS (PARTITION BY post_id ORDER BY i)) WHERE c1 IS NULL OR c2 IS NULL OR c <> c1 OR c <> c2)"""


@query("x7_cap_repeats", sql(POSTS_SQL + ", " + _REPEATS_SQL,
                             "SELECT post_id, string_agg(c, '' ORDER BY i) AS text FROM kept GROUP BY post_id"))
def x7(spark, sf):
    return posts(spark, sf).select("post_id", X.cap_repeats(F.col("text")).alias("text"))


_FEATURES_SQL = POSTS_SQL + f""", word_rows AS (SELECT post_id, w, row_number() OVER (PARTITION BY post_id ORDER BY n) AS n FROM (
   SELECT post_id, unnest(string_split(s, ' ')) AS w, unnest(range(1, len(string_split(s, ' ')) + 1)) AS n FROM (
    SELECT post_id, {_NORMAL_SQL} AS s FROM posts)) WHERE w <> ''),
 chars AS (SELECT post_id, n, unnest(string_split(w, '')) AS c, unnest(range(1, length(w) + 1)) AS i FROM word_rows),
 capped AS (SELECT post_id, n, string_agg(c, '' ORDER BY i) AS w FROM (
   SELECT *, lag(c) OVER v AS c1, lag(c, 2) OVER v AS c2 FROM chars WINDOW v AS (PARTITION BY post_id, n ORDER BY i))
   WHERE c1 IS NULL OR c2 IS NULL OR c <> c1 OR c <> c2 GROUP BY post_id, n),
 feats AS (SELECT post_id, n, lower(trim(w, '''"?,.')) AS f FROM capped
   WHERE regexp_matches(trim(w, '''"?,.'), '^[a-zA-Z][a-zA-Z0-9]*$'))"""


@query("x8_feature_words", sql(_FEATURES_SQL, """SELECT p.post_id, coalesce(string_agg(f, ' ' ORDER BY n), '') AS features,
  CAST(count(f) AS INTEGER) AS n FROM posts p LEFT JOIN feats f ON p.post_id = f.post_id GROUP BY p.post_id"""))
def x8(spark, sf):
    f = posts(spark, sf).select("post_id", X.feature_words(X.normalise_tweet(F.col("text"))).alias("f"))
    return f.select("post_id", F.array_join("f", " ").alias("features"), F.size("f").alias("n"))


_STOP_SQL = TERMS_SQL + """, stops AS (SELECT term FROM terms GROUP BY term
  HAVING count(DISTINCT doc_id) > 0.3 * (SELECT count(*) FROM documents))"""


@query("x9_stop_words", sql(_STOP_SQL, """SELECT doc_id, count(*) AS n FROM terms
  WHERE term NOT IN (SELECT term FROM stops) GROUP BY doc_id"""))
def x9(spark, sf):
    """Words found in over 30 % of the documents, saved as a list and loaded again."""
    counts = term_counts(read_table(spark, sf, "documents"), "doc_id", X.plain_tokens(F.col("text")))
    df = document_frequencies(counts)
    path = scratch_path(spark, "stop-words")
    limit = 0.3 * read_table(spark, sf, "documents").count()
    df.where(F.col("df") > limit).select("term").write.text(path)
    stops = X.load_stop_words(spark, path).select(F.col("word").alias("term"))
    return counts.join(stops, "term", "left_anti").groupBy("doc_id").agg(F.sum("tf").alias("n"))


@query("x10_binary_bag", sql(TERMS_SQL, "SELECT DISTINCT doc_id, term, 1 AS present FROM terms"))
def x10(spark, sf):
    counts = term_counts(read_table(spark, sf, "documents"), "doc_id", X.plain_tokens(F.col("text")))
    return counts.select("doc_id", "term", F.lit(1).alias("present"))


@query("x11_tweet_tokens")
def x11(spark, sf):
    t = posts(spark, sf).select("post_id", X.tweet_tokens(F.col("text")).alias("t"))
    return t.select("post_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("x12_squeeze_whitespace", sql(POSTS_SQL, r"SELECT post_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM posts"))
def x12(spark, sf):
    return posts(spark, sf).select("post_id", X.squeeze_whitespace(F.col("text")).alias("text"))


@query("x13_token_alignment", sql(POSTS_SQL, "SELECT post_id, true AS consistent FROM posts"))
def x13(spark, sf):
    """Every token is found at its offset in the squeezed text, and offsets grow."""
    a = posts(spark, sf).select("post_id", X.squeeze_whitespace(F.col("text")).alias("s"), X.aligned_tokens(F.col("text")).alias("a"))
    e = a.select("post_id", F.length("s").alias("n"), F.replace("s", F.lit(" "), F.lit("")).alias("dense"), "a")
    ends = F.transform("a", lambda t: t["start"] + F.length(t["tok"]))
    starts = F.col("a.start")
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), ends,
                      lambda nxt, end: F.coalesce(nxt - end, F.lit(0)).between(0, 1))
    return e.select("post_id", (
        (F.array_join("a.tok", "") == F.col("dense")) & F.forall(gaps, lambda g: g)
        & (F.coalesce(F.array_max(ends), F.lit(0)) == F.col("n"))).alias("consistent"))


@query("x14_emoticons", sql(POSTS_SQL, r"""SELECT post_id, CASE WHEN h AND s THEN 'BOTH_HS' WHEN h THEN 'HAPPY' WHEN s THEN 'SAD' ELSE 'NA' END AS mood
  FROM (SELECT post_id, regexp_matches(text, '\^_\^|[:=](|o|O|-)[D)\]]') AS h, regexp_matches(text, '[:=](|o|O|-)[(\[]') AS s FROM posts)"""))
def x14(spark, sf):
    return posts(spark, sf).select("post_id", X.emoticon_mood(F.col("text")).alias("mood"))


_GRAMS_SQL = TERMS_SQL.replace("terms AS (SELECT doc_id, unnest(", "lists AS (SELECT doc_id, (") + """, flat AS (
  SELECT doc_id, unnest(term) AS w, unnest(range(1, len(term) + 1)) AS i FROM lists),
 grams AS (SELECT doc_id, 1 AS n, w AS g FROM flat UNION ALL
  SELECT a.doc_id, 2, a.w || ' ' || b.w FROM flat a JOIN flat b ON a.doc_id = b.doc_id AND b.i = a.i + 1 UNION ALL
  SELECT a.doc_id, 3, a.w || ' ' || b.w || ' ' || c.w FROM flat a JOIN flat b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    JOIN flat c ON a.doc_id = c.doc_id AND c.i = a.i + 2)"""


@query("x15_ngrams", sql(_GRAMS_SQL, """SELECT doc_id, CAST(n AS INTEGER) AS n, count(*) AS grams, count(DISTINCT g) AS distinct_grams,
  min(g) AS first_gram, max(g) AS last_gram FROM grams GROUP BY doc_id, n"""))
def x15(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.plain_tokens(F.col("text")).alias("t"))
    sized = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), X.ngrams(F.col("t"), n).alias("g"))
                                                   for n in (1, 2, 3)])).alias("e")).select("doc_id", "e.*")
    return sized.where(F.size("g") > 0).select(
        "doc_id", "n", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"),
        F.array_min("g").alias("first_gram"), F.array_max("g").alias("last_gram"))


_TFIDF_SQL = TERMS_SQL + """, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))"""


@query("x16_tfidf", sql(_TFIDF_SQL, f"SELECT doc_id, term, {sql6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w"))
def x16(spark, sf):
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    out = tfidf_rows(d, "doc_id", X.plain_tokens(F.col("text")))
    return out.select("doc_id", "term", r6("weight").alias("weight"))


@query("x17_normalised_rows", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS before,
  1.0::DOUBLE AS after FROM embeddings""")
def x17(spark, sf):
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = read_table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = Normalizer(inputCol="v", outputCol="u", p=2.0).transform(e)

    def norm(c):
        return F.round(F.sqrt(F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)), 4)

    return out.select("vec_id", norm("v").alias("before"), norm("u").alias("after"))


@query("x18_utf8", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, md5(text) AS digest FROM documents")
def x18(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", X.utf8(F.col("text")).alias("b"))
    return d.select("doc_id", F.octet_length("b").alias("bytes"), F.md5("b").alias("digest"))


_ANSWERS = [NOT_RELATED, *FIRST_PERSON_LEVEL, *RELATED_KIND, "{}", "Alcohol Consumption", "Something else"]
_ANSWER_SQL = "answers AS (SELECT event_id AS _id, [" + ", ".join(f"'{a}'" for a in _ANSWERS) + (
    f"][CAST(event_id % {len(_ANSWERS)} AS INTEGER) + 1] AS answer FROM events)")
_PARSED_SQL = _ANSWER_SQL + """, parsed AS (SELECT _id, answer,
  CAST(CASE WHEN answer = 'Not Alcohol Related' THEN 0 WHEN answer <> 'Something else' THEN 1 END AS INTEGER) AS alcohol,
  CAST(CASE WHEN answer LIKE 'First%' THEN 1 WHEN answer LIKE 'Alcohol Related%' THEN 0 END AS INTEGER) AS first_person,
  CAST(CASE WHEN answer LIKE '%Looking%' THEN 1 WHEN answer LIKE '%Reflecting%' THEN 2 WHEN answer LIKE 'First%' THEN 0 END AS INTEGER) AS first_person_level,
  CAST(CASE WHEN answer LIKE '%Discussion' THEN 0 WHEN answer LIKE '%Promotional%' THEN 1 END AS INTEGER) AS alcohol_related,
  CASE WHEN answer LIKE 'Alcohol Related%' THEN answer END AS raw FROM answers WHERE answer NOT IN ('{}', 'Something else'))"""


def answers(spark, sf):
    pick = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    return read_table(spark, sf, "events").select(F.col("event_id").alias("_id"), pick.alias("Answer"))


@query("x19_crowd_answers", sql(_PARSED_SQL, "SELECT _id, alcohol, first_person, first_person_level, alcohol_related, raw FROM parsed"))
def x19(spark, sf):
    good, _ = parse_answers(answers(spark, sf))
    return good.select("_id", "labels.*")


@query("x19_unknown_answers", sql(_ANSWER_SQL, "SELECT _id, answer AS \"Answer\" FROM answers WHERE answer = 'Something else'"))
def x19_unknown(spark, sf):
    return parse_answers(answers(spark, sf))[1]


@query("x20_label_selection", sql(_PARSED_SQL, """SELECT 'alcohol' AS kind, _id, alcohol AS y FROM parsed WHERE alcohol IS NOT NULL
  UNION ALL SELECT 'first_person', _id, first_person FROM parsed WHERE first_person IS NOT NULL
  UNION ALL SELECT 'level', _id, first_person_level FROM parsed WHERE first_person_level IS NOT NULL
  UNION ALL SELECT 'flat', _id, coalesce(first_person_level + 2, alcohol) FROM parsed"""))
def x20(spark, sf):
    pick = LabelSelector(parse_answers(answers(spark, sf))[0])
    kinds = {"alcohol": pick.alcohol(), "first_person": pick.first_person(), "level": pick.first_person_level(), "flat": pick.flat()}
    frames = [df.select(F.lit(k).alias("kind"), "_id", "y") for k, df in kinds.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
