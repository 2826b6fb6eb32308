"""Term counts and TF-IDF.

Two forms: long rows (document, term, weight) in SQL terms, and Spark ML stages
for the classifiers. Inverse document frequency is ln((1+n)/(1+df)) + 1; Spark's
own ``IDF`` lacks the + 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurline.functions import text as X
from murmurline.session import cut_lineage

#: The cap of the n-gram models; other models keep every term.
MAX_TERMS = 200_000
#: The largest vocabulary a counting stage can be asked for: no cap.
ALL_TERMS = 2**31 - 1


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf). Texts are dealt by key before they become terms, so the many rows of terms need no shuffle."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.repartition(parts, key).select(key, F.explode(tokens).alias("term"))
            .groupBy(key, "term").agg(F.count("*").alias("tf")))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df) from one row per document and term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_rows(docs: DataFrame, key: str, tokens: Column, max_terms: int | None = None) -> DataFrame:
    """(key, term, weight) with rows of unit length, over all terms or the ``max_terms`` most frequent ones.

    Counts are written once, as two branches read them. Document frequencies are
    joined by term: a shuffled join, in which adaptive execution splits a term
    found in most documents, without sorting, as a task's share of the
    vocabulary is small. The length of a row is a window over its own terms.
    """
    counts = cut_lineage(term_counts(docs, key, tokens), "term-counts")
    n = docs.count()
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    if max_terms is not None:
        vocabulary = vocabulary.orderBy(F.desc("n"), "term").limit(max_terms)
    idf = vocabulary.select("term", (F.ln((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf.hint("shuffle_hash"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("weight"))


def most_frequent(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """(term) of the ``most`` most frequent terms of a token column; of equally frequent ones those that sort first."""
    counts = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(most).select("term")


class TokenColumn(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a token array by a named expression: ``plain``, ``tweet`` or ``features``, with n-grams."""

    kind = Param(Params._dummy(), "kind", "token expression", TypeConverters.toString)
    grams = Param(Params._dummy(), "grams", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "tokens", kind: str = "plain", grams: int = 1):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", kind="plain", grams=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.joined(self.singles(dataset))

    def singles(self, dataset: DataFrame) -> DataFrame:
        """The first half of the stage: the token array without n-grams."""
        source = F.col(self.getInputCol())
        made = {
            "plain": lambda: X.plain_tokens(source),
            "tweet": lambda: X.tweet_tokens(F.lower(source)),
            "features": lambda: X.feature_words(X.normalise_tweet(source)),
        }[self.getOrDefault(self.kind)]()
        return dataset.withColumn(self.getOutputCol(), made)

    def joined(self, dataset: DataFrame) -> DataFrame:
        """The second half: n-grams of the token array in its place."""
        n, out = self.getOrDefault(self.grams), self.getOutputCol()
        return dataset if n == 1 else dataset.withColumn(out, X.ngrams_up_to(F.col(out), n))


class SmoothTfidf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts over the vocabulary (capped only if ``maxTerms`` is given), smooth idf with + 1, unit rows."""

    maxTerms = Param(Params._dummy(), "maxTerms", "vocabulary cap", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "tokens", outputCol: str = "features", maxTerms: int = ALL_TERMS):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="features", maxTerms=ALL_TERMS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return self.fitted(dataset.select(self.getInputCol()))[0]

    def fitted(self, dataset: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda counted: counted) -> tuple[PipelineModel, DataFrame]:
        """The fitted stage, and ``dataset`` with its features; ``keep`` may write the counted rows, which are read for the weights and again by users."""
        tokens, out, most = self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.maxTerms)
        seen = dataset.select(tokens)
        if most < ALL_TERMS:  # counted as rows; the vectorizer then sees the terms that stay, and no others
            seen = most_frequent(seen, tokens, most).select(F.array("term").alias(tokens))
        counts = CountVectorizer(inputCol=tokens, outputCol=f"{out}_tf", vocabSize=most).fit(seen)
        counted = keep(counts.transform(dataset))
        idf = IDF(inputCol=f"{out}_tf", outputCol=f"{out}_w").fit(counted)
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0),
                                   inputCol=f"{out}_tf", outputCol=f"{out}_w")
        weigh = [scale, Normalizer(inputCol=f"{out}_w", outputCol=out, p=2.0)]
        return PipelineModel([counts, *weigh]), PipelineModel(weigh).transform(counted)


def text_features(kind: str = "plain", grams: int = 1, max_terms: int = ALL_TERMS) -> list:
    """Stages text -> tokens -> TF-IDF for a Pipeline."""
    return [TokenColumn(inputCol="text", outputCol="tokens", kind=kind, grams=grams),
            SmoothTfidf(inputCol="tokens", outputCol="features", maxTerms=max_terms)]


