"""Helpers the operators share: reading, whole-text words, hashes, global order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline.session import cut_lineage

#: Entries a per-process word cache may hold.
CACHE_ENTRIES = 100_000
#: Bytes of text that one step of a vectorised kernel looks at.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([pa.field(f.name, kinds[f.dataType.simpleString()], f.nullable) for f in schema.fields])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def sliced(batches: Iterable[pa.RecordBatch], size: int = STEP_BYTES, rows: int = 2000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(max(end, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end


def binaries(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


class Remembered(dict):
    """key -> make(key), made when first asked for. Holds up to ``most`` keys in two generations: when the young one is
    full it becomes the old one, from which keys in use come back, so frequent keys stay. Long keys are not kept."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 200:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordHashes(Remembered):
    """word -> 64-bit hash."""

    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest, CACHE_ENTRIES // 2)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that :func:`word_hashes` looks at together, and the longest word that it sums up byte by byte.
PIECE, LONG_WORD = 1 << 18, 256
_BYTES = np.arange(256, dtype=np.uint64)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint64(32), _BYTES)
#: A 64-bit value for each byte, the same for A-Z and a-z; none for white space.
_VALUES = np.where(_SPACE, np.uint64(0), mix((_FOLDED + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
_POWERS = np.cumprod(np.full(LONG_WORD, 0xD6E8FEB86659FD93, np.uint64))
_SPACES = re.compile(rb"[\x20\x09-\x0d]")


def _short_words(raw: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of raw[at:end], which starts and ends at word edges."""
    b = np.frombuffer(raw, np.uint8, end - at, at)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_SPACE[b]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1 - starts
    first = starts[0]
    place = np.arange(first, len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    sums = np.add.reduceat(_VALUES[b[first:]] * _POWERS[np.minimum(place, LONG_WORD - 1)], starts - first)
    hashes = mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(b[starts[i]:starts[i] + lengths[i]].tobytes().lower())
    return starts + at, hashes


def word_hashes(raws: list[bytes | None], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, ASCII lower-cased and cut at ASCII white space, one text after another, and
    the number of words before each text and after the last.

    Works on pieces of about ``piece`` bytes, cut between words, without an object for a word. Words beyond ``LONG_WORD`` bytes
    are hashed one by one, so no memory follows their length.
    """
    raw = b"\n".join(r or b"" for r in raws)
    places, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        hit = _SPACES.search(raw, at + piece)
        end = stop = hit.start() if hit else len(raw)
        if end - at > piece + LONG_WORD:  # its last word is a long one
            spaces = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, piece, at)])
            stop = at + int(spaces[-1]) + 1 if len(spaces) else at
        if stop > at:
            found = _short_words(raw, at, stop)
            places.append(found[0]), hashes.append(found[1])
        if stop < end:
            places.append(np.array([stop])), hashes.append(np.array([xxhash.xxh3_64_intdigest(raw[stop:end].lower())], np.uint64))
        at = end
    begins = np.cumsum([0] + [len(r or b"") + 1 for r in raws])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def gram_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values of ``words`` (short n: one pass per value)."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    b = np.uint64(base)
    for i in range(n):
        out = out * b + words[i:i + len(out)]
    return mix(out)


def ordered_parts(df: DataFrame, order: list[Column], weight: Column, by: Column | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over all earlier rows in ``order`` (of the same ``by``, if given).

    Rows are range-partitioned by ``order`` and kept as a table of the shared folder; each partition is summed, and what
    earlier partitions hold is added to the running sum inside. No key or partition is collected. ``order`` must start
    with ``by``. Only rows equal in every column of ``order`` cannot be split.
    """
    key = by if by is not None else F.lit(0)
    ranged = df.withColumns({"_by": key, "_w": weight.cast("long")}).repartitionByRange(*order)
    kept = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    # partitions follow the order; the sums have one row per partition and key that occurs in it
    parts = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("_by", "_part").agg(F.sum("_w").alias("_s")).select(
        F.col("_by").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(parts), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_by", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = kept.withColumn("_run", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = run.join(sums, F.col("_by").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_run") + F.col("_off")).cast("long").alias("before"))


def text_key(raw: bytes | None) -> int:
    """Signed 64-bit key of a raw text; rows with one doc_id are told apart by it."""
    return -1 if raw is None else np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64).item()


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("z", pa.binary())])
    zip_up = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        raws = binaries(batch.column("text"))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array(map(text_key, raws), pa.int64()),
            pa.array([None if r is None else zip_up.compress(r) for r in raws], pa.binary())], schema=schema)


def unzip(column) -> Iterator[bytes]:
    read = zstandard.ZstdDecompressor()
    for z in column.to_pylist():
        yield b"" if z is None else read.decompress(z)


ZIPPED = "doc_id bigint, tkey bigint, z binary"


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, z: texts in the form in which they should cross a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(zipped, ZIPPED)
