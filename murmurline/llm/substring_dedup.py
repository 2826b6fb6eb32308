"""Substring dedup: seed and extend over winnowed anchors.

A window is LENGTH consecutive words. A word is removed if a window that covers it also starts in a document with a
smaller doc_id; windows are judged on the input.

*Seed.* Every window holds LENGTH - GRAM + 1 runs of GRAM words; its anchor is the least of their hashes. The anchor
depends on the window's words only, so equal windows have equal anchors, and neighbouring windows mostly share one: a
text of n words has about 2n / (LENGTH - GRAM + 2) anchors. Documents are joined on anchors; only anchors of two or
more different texts go on.

*Extend.* A document is extended both ways around its shared anchors: every window whose anchor is shared gets a hash of
all its words, and (anchor, hash) groups find the smallest document of each window. Extending by groups and not by pairs
keeps n copies at n rows per window. Overlapping repeated windows merge into maximal repeats, and their words go. A window
that more than one row in HOT has, of which there are HOT at most, is looked up in a list that all tasks get, so it need
not meet its rows in one task; the others are joined.

Texts with equal word sequences form a class, found first; only the smallest document of a class is seeded and
extended, and the others are repeats as a whole. Group keys are pre-aggregated before each shuffle, and the join back to
positions is an ordinary join that adaptive execution splits. Texts cross a shuffle in compressed form.

Defined cases: null and empty texts have no words (n_words 0, kept_sha256 of the empty string). Texts below LENGTH words
lose nothing. Rows with the same doc_id never remove each other's words. Rows without a doc_id come after all others:
they have no smaller doc_id, lose nothing and take nothing from other rows. Very long texts are judged whole, in one task
each. Extra columns are ignored by ``substring_dedup``; ``drop_repeats`` keeps the columns it is given, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline.llm.common import WordHashes, batches_of, binaries, compressed, mix, text_key, unzip
from murmurline.session import cut_lineage, remove_scratch

LENGTH, GRAM = 50, 25
#: A window with more than one of so many rows is hot; a list holds them.
HOT = 1000

_BASE_A, _BASE_H = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KEYS = "doc_id bigint, tkey bigint"
_SEEDS = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                    ("anchors", pa.list_(pa.int64()))])
_WINDOWS = pa.schema([("anchor", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32())])
_WORDS = WordHashes()


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.up, self.down = (self._start(b) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _start(base: int) -> np.ndarray:
        return np.array([1, base], np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:  # wraps modulo 2^64
            self.up, self.down = (np.concatenate([p, p * (p[-1:] * p[1])]) for p in (self.up, self.down))
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of n values in time that does not depend on n: differences of a running polynomial."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.setdefault(base, _Powers(base)).of(len(words))
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=run[1:])
    return mix((run[n:] - run[:-n]) * down[:len(words) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of each run of n, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[:len(x) - (n - width)], x[n - width:])


def window_anchors(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of every window."""
    grams = run_hashes(words, gram, _BASE_A)
    return sliding_min(grams, length - gram + 1) if len(words) >= length else np.zeros(0, np.uint64)


def _seeds(length: int, gram: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, raw in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text"))):
                    words = raw.split() if raw else []
                    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                    anchors = np.unique(window_anchors(_WORDS.of(words), length, gram)) if len(words) >= length else np.zeros(0, np.uint64)
                    yield doc, text_key(raw), len(words), int(digest[0]), int(digest[1]), anchors.view(np.int64)
        yield from batches_of(rows(), _SEEDS)
    return seeds


def _windows(length: int, gram: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, raw, shared in zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(),
                                             unzip(batch.column("z")), batch.column("anchors")):
                words = _WORDS.of(raw.split())
                anchors = window_anchors(words, length, gram).view(np.int64)
                at = np.flatnonzero(np.isin(anchors, shared.values.to_numpy(zero_copy_only=False)))
                whole = run_hashes(words, length, _BASE_H).view(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors[at]), pa.array(whole[at]), pa.array(np.full(n, doc)), pa.array(np.full(n, key)),
                    pa.array(at.astype(np.int32))], schema=_WINDOWS)
    return windows


def _gone(n: int, all_gone: bool | None, starts, length: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    if all_gone:
        return np.ones(n, bool)
    edges = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        starts = np.unique(np.asarray(starts, np.int64))
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def _apply(length: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                            ("kept_sha256", pa.string()), ("kept_text", pa.string())])

        def rows():
            for batch in batches:
                for doc, key, raw, every, starts in zip(
                        batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), unzip(batch.column("z")),
                        batch.column("every").to_pylist(), batch.column("starts").to_pylist()):
                    words, removed = raw.split(), 0
                    if every or starts:
                        gone = _gone(len(words), every, starts, length)
                        removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone) if not g] if removed else words)
                    yield (doc, key, len(words), removed, hashlib.sha256(kept).hexdigest(),
                           kept.decode("utf-8", "replace") if removed else None)
        yield from batches_of(rows(), schema, 500)
    return apply


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, tkey, every, starts: texts that are repeats as a whole, and start positions of repeated windows."""
    docs = docs.where("doc_id IS NOT NULL")
    seeds = cut_lineage(docs.select("doc_id", "text").mapInArrow(
        _seeds(length, gram), f"{_KEYS}, n_words bigint, d1 bigint, d2 bigint, anchors array<bigint>"), "seeds")
    long = seeds.where(F.col("n_words") >= length)
    owners = long.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tkey")).alias("owner"))
    classes = cut_lineage(long.select("doc_id", "tkey", "d1", "d2").distinct().join(owners, ["d1", "d2"]), "classes")
    shared = long.select(F.explode("anchors").alias("anchor"), "d1").groupBy("anchor").agg(
        F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("anchor")
    first = classes.where((F.col("doc_id") == F.col("owner.doc_id")) & (F.col("tkey") == F.col("owner.tkey"))).select("doc_id", "tkey")
    own = long.select("doc_id", "tkey", F.explode("anchors").alias("anchor")).join(shared, "anchor").join(
        first, ["doc_id", "tkey"]).groupBy("doc_id", "tkey").agg(F.collect_set("anchor").alias("anchors"))
    texts = compressed(docs)
    windows = cut_lineage(texts.join(own, ["doc_id", "tkey"]).select("doc_id", "tkey", "z", "anchors").mapInArrow(
        _windows(length, gram), f"anchor bigint, h bigint, {_KEYS}, pos int"), "windows")
    least = cut_lineage(windows.groupBy("anchor", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
                        .where("lo < hi").drop("hi"), "repeated-windows")
    hot = (F.col("n") * HOT > windows.count())  # at most HOT of them
    often = F.broadcast(least.where(hot).select("anchor", "h", "lo"))
    later = windows.join(often, ["anchor", "h"]).unionByName(
        windows.join(often, ["anchor", "h"], "left_anti").join(least.where(~hot).select("anchor", "h", "lo"), ["anchor", "h"]))
    starts = later.where("lo < doc_id").groupBy("doc_id", "tkey").agg(
        F.collect_set("pos").alias("starts")).select(F.struct("doc_id", "tkey").alias("owner"), "starts")
    every = F.col("doc_id") > F.col("owner.doc_id")
    found = cut_lineage(classes.join(starts, "owner", "left").select(
        "doc_id", "tkey", every.alias("every"), F.when(~every, F.col("starts")).alias("starts")).where("every OR starts IS NOT NULL"), "repeats")
    remove_scratch(windows, seeds)
    return found


def _judged(docs: DataFrame, length: int, gram: int) -> DataFrame:
    texts = compressed(docs)
    joined = texts.join(repeats(docs, length, gram), ["doc_id", "tkey"], "left")
    return joined.select("doc_id", "tkey", "z", "every", "starts").mapInArrow(
        _apply(length), f"{_KEYS}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return _judged(docs, length, gram).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, every, starts in zip(binaries(batch.column("text")), batch.column("every").to_pylist(), batch.column("starts").to_pylist()):
                if raw is not None and (every or starts):
                    words = raw.split()
                    raw = b" ".join([w for w, g in zip(words, _gone(len(words), every, starts, length)) if not g])
                texts.append(None if raw is None else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])
    return cut


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``; a text that loses words has the rest joined by one space.

    A column ``n_chars`` is set to the characters of the text.
    """
    # the given columns travel as one, so that none can clash with those of the join
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").alias("id"), "text")
    keyed = packed.mapInArrow(_with_key, T.StructType([*packed.schema.fields, T.StructField("key", T.LongType())]))
    found = repeats(docs, length, gram).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "every", "starts")
    joined = keyed.join(found, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    cut = joined.select("row", "text", "every", "starts").mapInArrow(_cut(length), T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    kept = {"text": F.col("text"), "n_chars": F.length("text")}
    return cut.select(*[(kept[f.name] if f.name in kept else F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("key", pa.array(map(text_key, binaries(batch.column("text"))), pa.int64()))


def sql(source: str = "documents", length: int = LENGTH) -> str:
    """The same in DuckDB SQL: named tables that end with ``deduped`` (doc_id unique)."""
    return f"""worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {source}),
placed AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + {length - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {length} + 2)) AS pos FROM worded)),
seen AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM placed),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + {length})))) AS gone FROM seen WHERE least < doc_id GROUP BY doc_id),
deduped AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)))) END, ' ') AS kept
  FROM worded w LEFT JOIN gone g ON w.doc_id = g.doc_id)"""


SQL = f"""WITH {sql()}
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM deduped"""
