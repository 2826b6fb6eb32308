"""Token ids as files of interleaved static rANS blocks.

*Model.* One table of frequencies for the whole corpus, counted over all ids, scaled to sum to 2^SCALE_BITS with every
id that occurs keeping 1 at least. It is stored once beside the data.

*Blocks.* The ids of a file form one stream, cut into blocks of BLOCK ids that are coded by themselves. A block has
LANES states; id i belongs to lane i mod LANES, states are 64 bits wide and give off 32-bit words, so all lanes of many
blocks move together in vector operations. A block's words stand in the order in which the decoder wants them.

*File.* A folder ``blocks`` of Parquet files, one per range of doc_id, whose rows are blocks in order: number of the file
and of the block, ids of the file before the block (the checkpoint from which a decoder may start), the documents that
have ids in it with their counts, and the coded bytes: number of ids, number of words, CRC-32 of the ids, LANES final
states, words. Checksums are verified on every read. The table of frequencies lies beside it in ``table``.

Writing is range-partitioned by doc_id; a document's place in the corpus follows from the counts of earlier files, not
from a single ordered task. Reading deals blocks out over the cluster; a document that spans blocks is put together from
the checksums of its pieces, which combine without the ids.

Defined cases: null and empty texts have the end id only. Rows with one doc_id follow each other, ordered by text key.
Rows without a doc_id come first and keep none. A very long text is encoded whole by one task and lies in as many blocks
as its ids fill. An empty table gives no files and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurline.llm.common import batches_of, sliced, text_key
from murmurline.llm.tokenizer import byte_bpe
from murmurline.session import cut_lineage, scratch_path

END_ID = 2
SCALE_BITS = 22
BLOCK, LANES = 1 << 15, 32
#: Blocks that are coded side by side; the vectors have LANES times as many entries.
TOGETHER = 64
LOW = np.uint64(1 << 31)
#: Words whose ids a task remembers while it encodes (some 250 bytes each).
WORDS = 400_000
_BLOCK = struct.Struct("<III")


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2^bits, at least 1 for every id that occurs."""
    total, n = int(counts.sum()), int((counts > 0).sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    room = (1 << bits) - n
    if room < 0:
        raise ValueError(f"{n} ids do not fit 2^{bits} slots")
    share = counts * (room / total)
    freq = np.where(counts > 0, 1 + np.floor(share), 0).astype(np.int64)
    left = (1 << bits) - int(freq.sum())  # fewer than n: one each to the largest remainders
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)), counts == 0))
    freq[order[:left]] += 1
    return freq.astype(np.uint32)


class Coder:
    """Encoder and decoder of blocks under one table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)])[:-1].astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)  # a state from here on gives off a word first
        self.slots: np.ndarray | None = None

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """The coded blocks, TOGETHER at a time in one pass."""
        return [out for i in range(0, len(blocks), TOGETHER) for out in self._encode(blocks[i:i + TOGETHER])]

    def _encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        steps, shape = self._layout([len(b) for b in blocks])
        ids = np.zeros((len(blocks), steps * LANES), np.int64)
        for row, block in zip(ids, blocks):
            row[:len(block)] = block
        ids = ids.reshape(len(blocks), steps, LANES)
        state = np.full((len(blocks), LANES), LOW, np.uint64)
        words = np.zeros((len(blocks), steps, LANES), np.uint32)
        given = np.zeros((len(blocks), steps, LANES), bool)
        full = 32
        for at in range(steps - 1, -1, -1):
            sym = ids[:, at]
            freq, first = self.freq[sym], self.start[sym]
            out = state >= self.limit[sym]
            if at >= shape.min_steps:
                live = shape.live(at)
                out &= live
            given[:, at] = out
            words[:, at] = state  # the low half; read only where given
            state = np.where(out, state >> np.uint64(full), state)
            if at >= shape.min_steps:
                freq = np.where(live, freq, np.uint64(1))
            high, low = np.divmod(state, freq)
            moved = (high << self.bits) + low + first
            state = np.where(live, moved, state) if at >= shape.min_steps else moved
        coded = []
        for i, block in enumerate(blocks):
            own = words[i][given[i]]
            crc = zlib.crc32(block.astype("<u4").tobytes())
            coded.append(_BLOCK.pack(len(block), len(own), crc) + state[i].astype("<u8").tobytes() + own.astype("<u4").tobytes())
        return coded

    def decode(self, coded: list[bytes]) -> list[np.ndarray]:
        """The ids of coded blocks; a wrong checksum is an error."""
        return [out for i in range(0, len(coded), TOGETHER) for out in self._decode(coded[i:i + TOGETHER])]

    def _decode(self, coded: list[bytes]) -> list[np.ndarray]:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        heads = [_BLOCK.unpack_from(c) for c in coded]
        steps, shape = self._layout([h[0] for h in heads])
        state = np.array([np.frombuffer(c, "<u8", LANES, _BLOCK.size) for c in coded]).astype(np.uint64)
        stream = np.concatenate([np.frombuffer(c, "<u4", h[1], _BLOCK.size + 8 * LANES) for c, h in zip(coded, heads)] + [np.zeros(1, np.uint32)])
        at_word = np.concatenate([[0], np.cumsum([h[1] for h in heads])])[:-1]
        ids = np.zeros((len(coded), steps, LANES), np.uint32)
        for at in range(steps):
            slot = state & self.mask
            sym = self.slots[slot]
            moved = self.freq[sym] * (state >> self.bits) + slot - self.start[sym]
            wants = moved < LOW
            if at >= shape.min_steps:
                live = shape.live(at)
                moved = np.where(live, moved, state)
                wants &= live
                sym = np.where(live, sym, 0)
            ids[:, at] = sym
            place = at_word[:, None] + np.cumsum(wants, axis=1) - 1
            word = stream[np.where(wants, place, len(stream) - 1)].astype(np.uint64)
            state = np.where(wants, (moved << np.uint64(32)) | word, moved)
            at_word = at_word + wants.sum(axis=1)
        out = []
        for i, (n, _, crc) in enumerate(heads):
            own = ids[i].reshape(-1)[:n]
            if zlib.crc32(own.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's ids do not have its checksum")
            out.append(own)
        return out

    @staticmethod
    def _layout(sizes: list[int]):
        steps = max(1, -(-max(sizes) // LANES))
        return steps, _Shape(np.array(sizes))


class _Shape:
    """Which lanes hold an id at a step, for blocks of unequal sizes."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.min_steps = sizes, int(sizes.min()) // LANES

    def live(self, at: int) -> np.ndarray:
        return at * LANES + np.arange(LANES)[None, :] < self.sizes[:, None]


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the length of the second."""
    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    # appending a zero bit is linear over bits; square that map for 2, 4, 8, ... zeros
    matrix = [0xEDB88320, *(1 << i for i in range(31))]
    zeros = 8 * length
    while zeros:
        if zeros & 1:
            first = times(matrix, first)
        matrix = [times(matrix, row) for row in matrix]
        zeros >>= 1
    return first ^ second


def _tokens(path: str, end_id: int, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path, words), np.array([end_id], "<u4").tobytes()
        squeeze = zstandard.ZstdCompressor(level=1)

        def rows():
            for batch in sliced(batches):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    ids = np.frombuffer(bpe.encode(text) + end, "<u4")
                    # byte planes: the low bytes of all ids, then the next ones, squeeze better than mixed bytes
                    planes = ids.view(np.uint8).reshape(-1, 4).T
                    yield doc, text_key(text.encode()), len(ids), squeeze.compress(planes.tobytes())
        yield from batches_of(rows(), schema, 500)
    return tokens


def _unsqueeze(column) -> Iterator[np.ndarray]:
    read = zstandard.ZstdDecompressor()
    for z in column.to_pylist():
        planes = np.frombuffer(read.decompress(z), np.uint8).reshape(4, -1)
        yield np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        for ids in _unsqueeze(batch.column("ids")):
            own = np.bincount(ids)
            if len(own) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
            counts[:len(own)] += own
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "count"])


_BLOCK_ROWS = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()),
                         ("docs", pa.binary()), ("coded", pa.binary())])


def _encode(coder, block: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        code, file = coder.value.encode, TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids not written yet
        open_docs: list[list[int]] = []  # row of the file, whether it has no doc_id, doc_id and ids not written yet, of each document
        size = row = number = before = 0

        def flush(last: bool):
            """Writes the whole blocks of ``held``, and the rest of it if it is the last."""
            nonlocal held, size, number, before
            ids = np.concatenate(held)
            cut = len(ids) if last else len(ids) - len(ids) % block
            blocks = [ids[i:min(i + block, cut)] for i in range(0, cut, block)]
            held, size = [ids[cut:]], len(ids) - cut
            for own, coded in zip(blocks, code(blocks)):
                docs, left = [], len(own)
                while left:
                    first = open_docs[0]
                    take = min(left, first[3])
                    docs.append((*first[:3], take))
                    first[3] -= take
                    left -= take
                    if not first[3]:
                        open_docs.pop(0)
                yield file, number, before, len(own), np.array(docs, "<i8").tobytes(), coded
                number += 1
                before += len(own)

        def rows():
            nonlocal size, row
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), _unsqueeze(batch.column("ids"))):
                    held.append(ids)
                    open_docs.append([row, int(doc is None), doc or 0, len(ids)])
                    row += 1
                    size += len(ids)
                    if size >= block * TOGETHER:
                        yield from flush(False)
            if size:
                yield from flush(True)
        yield from batches_of(rows(), _BLOCK_ROWS, TOGETHER)
    return encode


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, block: int = BLOCK, words: int = WORDS) -> None:
    """Writes the ids of ``docs`` under the vocabulary ``path`` to the folders ``table`` and ``blocks`` below ``folder``.

    A task remembers the ids of up to ``words`` words, and of as many stretches between spaces.
    """
    spark = docs.sparkSession
    tokens = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokens(path, end_id, words), "doc_id bigint, tkey bigint, n bigint, ids binary"), "tokens")
    tokens.select("ids").mapInArrow(_histogram, "id int, count bigint").groupBy("id").agg(
        F.sum("count").alias("count")).write.parquet(f"{folder}/table")
    coder = spark.sparkContext.broadcast(coder_of(spark, folder))
    tokens.repartitionByRange("doc_id", "tkey").sortWithinPartitions("doc_id", "tkey").select("doc_id", "ids").mapInArrow(
        _encode(coder, block), "file int, block int, before bigint, n bigint, docs binary, coded binary").write.option(
        "compression", "uncompressed").parquet(f"{folder}/blocks")


def coder_of(spark: SparkSession, folder: str) -> Coder:
    """The coder of the stored table, which has an entry per id of the vocabulary at most."""
    table = spark.read.parquet(f"{folder}/table").toPandas()
    counts = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    counts[table["id"].to_numpy(np.int64)] = table["count"].to_numpy(np.int64)
    return Coder(scaled(counts))


def _pieces(coder):
    schema = pa.schema([("file", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int32()),
                        ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                decoded = coder.value.decode(batch.column("coded").to_pylist()) if batch.num_rows else []
                for file, block, before, docs, ids in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "before", "docs")), decoded):
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    for row, none, doc, n in np.frombuffer(docs, "<i8").reshape(-1, 4).tolist():
                        yield file, row, None if none else doc, block, before + at, n, zlib.crc32(raw[4 * at:4 * (at + n)])
                        at += n
        yield from batches_of(rows(), schema)
    return pieces


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for parts in batch.column("parts").to_pylist():
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc32_combine(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield batch.drop_columns(["parts"]).append_column("ids_crc32", pa.array(crcs, pa.int64()))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from decoded blocks."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    coder = spark.sparkContext.broadcast(coder_of(spark, folder))
    files = blocks.groupBy("file").agg(F.sum("n").alias("_n")).withColumn(
        "offset", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = blocks.select("file", "block", "before", "docs", "coded").mapInArrow(
        _pieces(coder), "file int, row bigint, doc_id bigint, block int, at bigint, n bigint, crc bigint")
    whole = pieces.groupBy("file", "row", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts")).mapInArrow(
        _joined, "file int, row bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return whole.join(files.select("file", "offset"), "file").select(
        "doc_id", (F.col("at") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def decode_ids(spark: SparkSession, folder: str) -> DataFrame:
    """file, block, ids of every block."""
    coder = spark.sparkContext.broadcast(coder_of(spark, folder))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype(np.int32) for x in coder.value.decode(batch.column("coded").to_pylist())] if batch.num_rows else []
            yield batch.drop_columns(["coded"]).append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return spark.read.parquet(f"{folder}/blocks").select("file", "block", "coded").mapInArrow(decode, "file int, block int, ids array<int>")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` to a folder of the shared scratch space and reads them back."""
    folder = scratch_path(docs.sparkSession, "rans")
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder)
