"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. quality rules: a document that fails a rule goes;
2. n-gram Jaccard join: of each group of near copies the document with the least doc_id stays;
3. substring dedup: words of windows that also start in a document with a smaller doc_id go;
4. mixing: documents are repeated, cut or left out until each source has its share of the words;
5. BPE: the texts as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.llm import bpe, jaccard_join, mixing, quality_rules, substring_dedup
from murmurline.llm.queries import BYTE_BPE
from murmurline.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and ids of each row."""
    encoded = bpe.with_ids(docs, BYTE_BPE)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", good_quality),
    ("jaccard_join", without_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("bpe", as_tokens),
]
#: The last stage has no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
