"""M: training, scoring and evaluation of classifiers; S15: stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.functions import text as X
from murmurline.ml import cascade, classifiers, features
from murmurline.ml.taxonomy import Taxonomy
from murmurline.operators import agreement, evaluation, ranking
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.aggregates import RATED_SQL, rated
from murmurline.plans.registry import query
from murmurline.session import scratch_path, spread
from murmurline.sources.readers import read_table

#: The reference settings: 100 iterations, the 200,000 most frequent 1-3-grams.
_FIT = {"iterations": 100, "max_terms": features.MAX_TERMS}
_models: dict[tuple[str, str], dict] = {}


def training(spark, sf):
    """Labelled documents: text, quality, toxic, and a three-way level."""
    lab = read_table(spark, sf, "labels").withColumn("level", (F.col("doc_id") % 3).cast("int"))
    return spread(read_table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id"))


def models(spark, sf, *names):
    """The models of both cascades, or the named ones; each is trained once per session and folder."""
    have = _models.setdefault((spark.sparkContext.applicationId, sf), {})
    labels = {"quality": F.col("quality"), "toxic": F.col("toxic"), "odd": F.col("doc_id") % 2,
              "fresh": (F.col("doc_id") % 5 == 0).cast("int"), "level": F.col("level")}
    new = [n for n in names or labels if n not in have]
    if new:
        data = training(spark, sf)
        have.update(classifiers.train_set({n: (data, labels[n]) for n in new}, classes={"level": 3}, **_FIT))
    return {n: have[n] for n in names or labels}


def posts(spark, sf):
    return spread(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("m1_tfidf_classifier")
def m1(spark, sf):
    data = training(spark, sf).withColumn("label", F.col("quality").cast("double"))
    model = classifiers.tfidf_pipeline(classifiers.logistic(data.count(), 1.0)).fit(data)
    return cascade.scored(model, posts(spark, sf), [None, "p"]).select("id", r6("p").alias("p"))


@query("m2_ngram_classifier")
def m2(spark, sf):
    return cascade.scored(models(spark, sf, "toxic")["toxic"], posts(spark, sf), [None, "p"]).select("id", r6("p").alias("p"))


@query("m3_train_set")
def m3(spark, sf):
    rows = [(name, len(m.stages)) for name, m in models(spark, sf).items()]
    n = training(spark, sf).count()
    return spark.createDataFrame(rows, "model string, stages int").withColumn("rows", F.lit(n))


def alcohol_cascade(spark, sf):
    m = models(spark, sf, "quality", "toxic", "level")
    return cascade.AlcoholCascade(m["quality"], m["toxic"], m["level"])


@query("m4_alcohol_cascade")
def m4(spark, sf):
    out = alcohol_cascade(spark, sf)(posts(spark, sf), 0.5).drop("text")
    return out.select("id", *[r6(c).alias(c) for c in out.columns if c != "id"])


@query("m5_tobacco_cascade")
def m5(spark, sf):
    m = models(spark, sf, "quality", "toxic", "odd", "fresh")
    run = cascade.TobaccoCascade(m["quality"], m["toxic"], m["odd"], m["fresh"], m["odd"])
    out = run(posts(spark, sf)).drop("text")
    return out.select("id", *[r6(c).alias(c) for c in out.columns if c != "id"])


@query("m6_batch_score_job", "SELECT doc_id AS id, list_has_any(string_split_regex(lower(text), '\\s+'), ['the', 'der', 'que']) AS alc_key, "
       "list_has_any(string_split_regex(lower(text), '\\s+'), ['the', 'der', 'que']) AS was_scored FROM documents")
def m6(spark, sf):
    """Only keyword rows carry scores; all rows come back."""
    out = cascade.score_alcohol(posts(spark, sf), alcohol_cascade(spark, sf), 0.5, ["the", "der", "que"])
    return out.select("id", "alc_key", F.col("predict_fpa").isNotNull().alias("was_scored"))


@query("m6_tobacco_score_job")
def m6_tobacco(spark, sf):
    m = models(spark, sf, "quality", "toxic", "odd", "fresh")
    run = cascade.TobaccoCascade(m["quality"], m["toxic"], m["odd"], m["fresh"], m["odd"])
    out = cascade.score_tobacco(posts(spark, sf), run)
    return out.select("id", "shisha", r6("predict_tob").alias("predict_tob"), r6("predict_present").alias("predict_present"))


def age_model(spark, sf):
    names = F.element_at(F.array(F.lit("underAge"), F.lit("legalAge"), F.lit("other")), F.col("level") + 1)
    data = training(spark, sf).select("text", classifiers.age_label(names).cast("double").alias("label"))
    return classifiers.age_pipeline(data.count()).fit(data)


@query("m7_age_svm")
def m7(spark, sf):
    out = age_model(spark, sf).transform(posts(spark, sf))
    return out.select("id", F.col("prediction").cast("int").alias("age"))


@query("m8_age_of_first_person", "SELECT doc_id AS id, (doc_id % 100) / 100 > 0.75 AS has_age FROM documents")
def m8(spark, sf):
    rows = posts(spark, sf).withColumn("predict_fpa", (F.col("id") % 100) / F.lit(100.0))
    return classifiers.predicted_age(age_model(spark, sf), rows).select("id", F.col("age").isNotNull().alias("has_age"))


@query("m9_taxonomy")
def m9(spark, sf):
    m = models(spark, sf, "level", "odd", "quality")
    leaf = Taxonomy("level", {0: "casual", 1: "looking", 2: "reflecting"}, m["level"])
    middle = Taxonomy("person", {0: "related", 1: "first_person"}, m["odd"]).add_children({1: leaf})
    root = Taxonomy("topic", {0: "other", 1: "topic"}, m["quality"]).add_children({1: middle})
    return root.predict(posts(spark, sf), deep=True).select("id", "label", "label_name")


_SCORES_SQL = """sc AS (SELECT event_id, CAST(event_type IN ('click', 'view') AS INTEGER) AS y, round(value / 10, 1) AS score FROM events)"""


def fixed_scores(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.col("event_type").isin("click", "view").cast("int").alias("y"),
                    F.round(F.col("value") / 10, 1).alias("score"))


def _roc_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp
  FROM (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM {source} GROUP BY score))"""


@query("m10_roc_curve", sql(_SCORES_SQL + ", " + _roc_sql("sc", "r"), f"""SELECT score,
  {sql6("fp / (SELECT max(fp) FROM r)")} AS fpr, {sql6("tp / (SELECT max(tp) FROM r)")} AS tpr FROM r"""))
def m10(spark, sf):
    out = evaluation.roc_rates(evaluation.roc_points(fixed_scores(spark, sf)))
    return out.select("score", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("m10_roc_auc", sql(_SCORES_SQL + ", " + _roc_sql("sc", "r"), f"""SELECT {sql6("sum(n * (tp - p / 2)) / (sum(n) * sum(p))")} AS auc FROM r"""))
def m10_auc(spark, sf):
    return evaluation.roc_auc(evaluation.roc_points(fixed_scores(spark, sf))).select(r6("auc").alias("auc"))


_MULTI_SQL = """ms AS (SELECT event_id, event_id % 3 AS y, round(value / 10, 1) AS s0, (user_id % 50) / 10 AS s1, k / 10 AS s2 FROM (
   SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)),
  lg AS (SELECT 0 AS c, s0 AS score, CAST(y = 0 AS INTEGER) AS y FROM ms UNION ALL SELECT 1, s1, CAST(y = 1 AS INTEGER) FROM ms
   UNION ALL SELECT 2, s2, CAST(y = 2 AS INTEGER) FROM ms),
  pc AS (SELECT c, score, sum(y) AS p, count(*) - sum(y) AS n FROM lg GROUP BY c, score),
  cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS i
   FROM pc WINDOW w AS (PARTITION BY c ORDER BY score DESC)),
  rt AS (SELECT c, fp / max(fp) OVER (PARTITION BY c) AS fpr, tp / max(tp) OVER (PARTITION BY c) AS tpr, i, p, n, np, nn FROM cu),
  kp AS (SELECT c, fpr, tpr FROM rt WHERE i = 1 OR np IS NULL OR np <> p OR nn <> n UNION ALL SELECT DISTINCT c, 0, 0 FROM rt),
  cn AS (SELECT c, fpr, min(tpr) AS lo, max(tpr) AS hi FROM kp GROUP BY c, fpr),
  gr AS (SELECT DISTINCT fpr FROM cn),
  ip AS (SELECT g.fpr, k.c, o.hi AS own,
    (SELECT arg_max(hi, fpr) FROM cn WHERE cn.c = k.c AND cn.fpr < g.fpr) AS ly, (SELECT max(fpr) FROM cn WHERE cn.c = k.c AND cn.fpr < g.fpr) AS lx,
    (SELECT arg_min(lo, fpr) FROM cn WHERE cn.c = k.c AND cn.fpr > g.fpr) AS ry, (SELECT min(fpr) FROM cn WHERE cn.c = k.c AND cn.fpr > g.fpr) AS rx
    FROM gr g CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) k LEFT JOIN cn o ON o.c = k.c AND o.fpr = g.fpr),
  mt AS (SELECT fpr, avg(coalesce(own, ly + (ry - ly) * (fpr - lx) / (rx - lx))) AS tpr FROM ip GROUP BY fpr),
  mi AS (SELECT score, sum(p) AS p, sum(n) AS n FROM pc GROUP BY score),
  mc AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM mi)"""


@query("m11_multiclass_roc", sql(_MULTI_SQL, f"""SELECT CAST(c AS VARCHAR) AS curve, {sql6("sum(n * (tp - p / 2)) / (sum(n) * sum(p))")} AS auc FROM cu GROUP BY c
  UNION ALL SELECT 'micro', {sql6("sum(n * (tp - p / 2)) / (sum(n) * sum(p))")} FROM mc
  UNION ALL SELECT 'macro', {sql6("sum(a)")} FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr)) / 2 AS a FROM mt)"""))
def m11(spark, sf):
    t = B.tweets(spark, sf)
    rows = t.select((F.col("id") % 3).alias("y"), F.round(F.col("value") / 10, 1).alias("s0"),
                    ((F.col("user_id") % 50) / F.lit(10.0)).alias("s1"), (F.col("props.k") / F.lit(10.0)).alias("s2"))
    out = evaluation.roc_by_class(rows, {0: "s0", 1: "s1", 2: "s2"})
    return out.select("curve", r6("auc").alias("auc"))


_REPORT_SQL = RATED_SQL + """, lb AS (SELECT DISTINCT y AS label FROM rated UNION SELECT yhat FROM rated),
  pr AS (SELECT label, (SELECT count(*) FROM rated WHERE y = label AND yhat = label) AS hit,
    (SELECT count(*) FROM rated WHERE y = label) AS t, (SELECT count(*) FROM rated WHERE yhat = label) AS p FROM lb)"""


@query("m12_class_report", sql(_REPORT_SQL, f"""SELECT label, {sql6("hit / p")} AS precision, {sql6("hit / t")} AS recall,
  {sql6("2 * hit / (t + p)")} AS f1, t AS support FROM pr"""))
def m12(spark, sf):
    out = evaluation.class_report(rated(spark, sf))
    return out.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("m12_overall_scores", sql(_REPORT_SQL, f"""SELECT {sql6("sum(hit) / sum(t)")} AS accuracy, {sql6("sum(hit / p * t) / sum(t)")} AS weighted_precision,
  {sql6("sum(2 * hit / (t + p) * t) / sum(t)")} AS weighted_f1 FROM pr"""))
def m12_all(spark, sf):
    out = evaluation.overall_scores(rated(spark, sf))
    return out.select(*[r6(c).alias(c) for c in ("accuracy", "weighted_precision", "weighted_f1")])


@query("m13_cohen_kappa", sql(RATED_SQL, f"""SELECT n, {sql6("(po - pe) / (1 - pe)")} AS kappa FROM (SELECT count(*) AS n, avg(CAST(y = yhat AS DOUBLE)) AS po,
  avg(y) * avg(yhat) + (1 - avg(y)) * (1 - avg(yhat)) AS pe FROM rated)"""))
def m13(spark, sf):
    return evaluation.cohen_kappa(rated(spark, sf)).select("n", r6("kappa").alias("kappa"))


@query("m14_double_label_agreement", sql(RATED_SQL, "SELECT doc_id, y = yhat AS agreed FROM rated"))
def m14(spark, sf):
    lab = rated(spark, sf)
    both = agreement.double_rated(lab.select("doc_id", "y"), lab.select("doc_id", F.col("yhat").alias("y")), "doc_id")
    return (agreement.agreed(both).select("doc_id", F.lit(True).alias("agreed"))
            .unionByName(agreement.disagreed(both).select("doc_id", F.lit(False).alias("agreed"))))


@query("m15_learning_curve")
def m15(spark, sf):
    data = training(spark, sf).select("doc_id", X.plain_tokens(F.col("text")).alias("tokens"), F.col("quality").cast("double").alias("label"))
    return classifiers.learning_curve(data, "doc_id", folds=5)


@query("m16_prior_weights", "SELECT doc_id, CASE quality WHEN 0 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE END AS weight FROM labels")
def m16(spark, sf):
    return classifiers.prior_weights(read_table(spark, sf, "labels"), {0: 0.99, 1: 0.01}, "quality").select("doc_id", "weight")


@query("m16_weighted_confusion")
def m16_confusion(spark, sf):
    data = classifiers.prior_weights(training(spark, sf).withColumn("label", F.col("quality").cast("double")), {0: 0.99, 1: 0.01})
    data = ranking.hash_split(data, "doc_id", 33, seed=26)
    train = data.where("NOT test")
    model = classifiers.tfidf_pipeline(classifiers.logistic(train.count(), 1.0, weight="weight")).fit(train)
    return evaluation.confusion_counts(model.transform(data.where("test")), "quality", "prediction").withColumn("share", r6("share"))


@query("m17_term_weights")
def m17(spark, sf):
    return classifiers.term_weights(spark, models(spark, sf, "quality")["quality"]).select(
        "term", *[r6(c).alias(c) for c in ("coef", "idf", "weight", "coef_idf")])


@query("s15_stored_model", "SELECT doc_id AS id, true AS same FROM documents")
def s15(spark, sf):
    """A saved and reloaded model gives the same scores."""
    path = scratch_path(spark, "model")
    fitted = models(spark, sf, "quality")["quality"]
    classifiers.save_model(fitted, path)
    a = cascade.scored(fitted, posts(spark, sf), [None, "p"]).select("id", "p")
    b = cascade.scored(classifiers.load_model(path), posts(spark, sf), [None, "p"]).select("id", F.col("p").alias("q"))
    return a.join(b, "id").select("id", (F.abs(F.col("p") - F.col("q")) < 1e-12).alias("same"))
