"""Benchmark decontamination: all windows of all test items are searched in all documents at once, after Wu and Manber.

The symbols are words. Windows of one length form a group with three tables over its words' numbers:

- *shift*: for a hash of two consecutive words (a block), how far the end of a window may move on; a block that no window
  holds lets it skip a whole window but one word;
- *buckets*: the windows whose last two words hash alike, ordered by a hash of their first two words;
- the windows themselves. At shift 0 the bucket and the hash of the first two words select windows, and all words are
  compared, so an occurrence is one of words and not of hashes.

A task searches many stretches of text side by side: each step looks up the shifts of all cursors at once. Words that no
item holds have number 0.

Items are dealt to blocks of at most ``block_words`` words (long items are cut into overlapping pieces), whose tables a
broadcast takes to the tasks: its size is checked and bounded, however large the benchmark grows. The first block's pass
gives a row for each document; further blocks give rows of hits only, which are joined to it.

Defined cases: texts are lower-cased in A-Z; a word is a run of digits, letters a-z and characters beyond ASCII. An item of
fewer words than a window is one window, an item without words (null, empty, blank) has none. Rows equal in item_id are
one item. Items without an item_id mark words but are not listed or counted. Each row of documents gives one row,
whatever its doc_id; null and empty texts have no words and no hits. An empty benchmark hits nothing. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import STEP_BYTES, batches_of, binaries, sliced, text_key
from murmurline.session import cut_lineage

#: Words of a window.
WINDOW = 10
#: Most words of the items whose tables one broadcast holds (some 100 bytes a word).
BLOCK_WORDS = 200_000
#: End positions that one cursor walks over, and most candidates compared in one step.
STRETCH, COMPARE = 256, 1 << 18

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)),
                    ("items", pa.list_(pa.string()))])
_ROWS = "doc_id bigint, tkey bigint, n_words bigint, spans array<struct<start: bigint, length: bigint>>, items array<string>"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def _hash2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Well-spread 32-bit hashes of pairs of word numbers."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


class Group:
    """The tables of windows of one length; ``windows`` are distinct rows of word numbers."""

    def __init__(self, windows: np.ndarray):
        n, self.length = windows.shape
        self.back = min(2, self.length) - 1  # a block is the word at a position and the one ``back`` before
        blocks = [_hash2(windows[:, j - self.back], windows[:, j]) for j in range(self.back, self.length)]
        self.bits = min(32, max(8, (4 * n * len(blocks)).bit_length()))
        self.shift = np.full(1 << self.bits, len(blocks), np.int16 if self.length < 1 << 15 else np.int64)
        for j, h in enumerate(blocks):
            np.minimum.at(self.shift, self._slot(h), len(blocks) - 1 - j)
        key = self._key(blocks[-1], blocks[0])
        self.order = np.argsort(key, kind="stable")
        self.keys, self.windows = key[self.order], windows[self.order]

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (suffix << np.uint64(32)) | prefix

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(32 - self.bits)

    def search(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences in texts that lie one after another, and the number of the window at each."""
        first, last = bounds[:-1] + self.length - 1, bounds[1:]
        stretches = np.maximum(0, -((first - last) // STRETCH))
        owner = np.repeat(np.arange(len(first)), stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = first[owner] + nth * STRETCH
        end = np.minimum(at + STRETCH, last[owner])
        ends, hashes = [], []
        while len(at):
            h = _hash2(text[at - self.back], text[at])
            skip = self.shift[self._slot(h)]
            stop = skip == 0
            ends.append(at[stop])
            hashes.append(h[stop])
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.concatenate(ends) - self.length + 1
        key = self._key(np.concatenate(hashes), _hash2(text[starts], text[starts + self.back]))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        found, which = [], []
        while len(starts):  # all windows of a bucket and prefix, one rank of all candidates after the other
            some = low < high
            starts, low, high = starts[some], low[some], high[some]
            for a in range(0, len(starts), COMPARE):
                s, w = starts[a:a + COMPARE], low[a:a + COMPARE]
                equal = np.ones(len(s), bool)
                for j in range(self.length):
                    equal &= text[s + j] == self.windows[w, j]
                found.append(s[equal])
                which.append(self.order[w[equal]])
            low = low + 1
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(found or empty), np.concatenate(which or empty)


class Block:
    """The windows of some items, ready to search."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW):
        texts = [p.split() for _, p in pieces]
        self.known = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.names = sorted({i for i, _ in pieces if i is not None})
        rank = {name: k for k, name in enumerate(self.names)} | {None: -1}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item, _), t in zip(pieces, texts):
            ids = np.array([self.known[w] for w in t], np.int32)
            by_length.setdefault(min(len(t), window), []).append((ids, rank[item]))
        self.groups = []
        for length, held in sorted(by_length.items()):
            rows = [np.lib.stride_tricks.sliding_window_view(ids, length) for ids, _ in held]
            owners = np.repeat([r for _, r in held], [len(r) for r in rows])
            windows, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([number.reshape(-1), owners], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            starts = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
            self.groups.append((Group(windows), starts, pairs[:, 1]))

    def search(self, raws: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Number of words, spans of hit words and names of items of each text."""
        texts = [words_of(raw) for raw in raws]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        find = self.known.get
        ids = np.fromiter((find(w, 0) for t in texts for w in t), np.int32, int(bounds[-1]))
        edges = np.zeros(len(ids) + 1, np.int64)
        owners: dict[int, list[np.ndarray]] = {}
        for group, starts, items in self.groups:
            at, which = group.search(ids, bounds)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + group.length, -1)
            hit = np.unique(np.stack([np.searchsorted(bounds, at, "right") - 1, which], 1), axis=0)
            for t, w in hit.tolist():
                owners.setdefault(t, []).append(items[starts[w]:starts[w + 1]])
        inside = (np.cumsum(edges[:-1]) > 0).astype(np.int8)
        for t, words in enumerate(texts):
            if t not in owners:
                yield len(words), [], []
                continue
            mine = inside[bounds[t]:bounds[t + 1]]
            turn = np.flatnonzero(np.diff(mine, prepend=0, append=0))
            spans = [(int(a), int(b - a)) for a, b in zip(turn[::2], turn[1::2])]
            yield len(words), spans, [self.names[i] for i in np.unique(np.concatenate(owners[t])).tolist()]


def _pieces(window: int, most: int):
    """Items as words joined by a space, cut into pieces of at most ``most`` words that share their border windows."""
    schema = pa.schema([("item_id", pa.string()), ("n", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in sliced(batches):
                for item, raw in zip(batch.column("item_id").to_pylist(), binaries(batch.column("text"))):
                    words = words_of(raw)
                    for at in range(0, max(1, len(words) - window + 1), most - window + 1):
                        part = words[at:at + most]
                        if part:
                            yield item, len(part), b" ".join(part).decode()
        return batches_of(rows(), schema)

    return pieces


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """Distinct pieces with a block number below the returned one; no block holds more than ``block_words`` words."""
    piece = max(2 * window, block_words // 16)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    kept = cut_lineage(items.mapInArrow(_pieces(window, piece), "item_id string, n bigint, piece string").distinct(), "pieces")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // block_words)
    while True:
        number = F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(1, blocks))).alias("block")
        dealt = kept.select("item_id", "piece", "n", number)
        most = dealt.groupBy("block").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0]
        if not most or most <= max(block_words, piece):
            return dealt, blocks
        blocks = 2 * blocks


def _scan(block, rows_without_hits: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = block.value
        for batch in sliced(batches, STEP_BYTES):
            raws = binaries(batch.column("text"))
            found = list(tables.search(raws))
            keep = [k for k, f in enumerate(found) if rows_without_hits or f[1]]
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in keep], pa.int64()), pa.array([text_key(raws[k]) for k in keep], pa.int64()),
                pa.array([found[k][0] for k in keep], pa.int64()),
                pa.array([[{"start": a, "length": n} for a, n in found[k][1]] for k in keep], _FOUND.field(3).type),
                pa.array([found[k][2] for k in keep], _FOUND.field(4).type)], schema=_FOUND)

    return scan


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans and items are lists of those of several blocks to rows with one list each."""
    for batch in batches:
        spans, items = [], []
        for row in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for a, n in sorted((s["start"], s["length"]) for part in row for s in part):
                if out and a <= out[-1][0] + out[-1][1]:
                    out[-1][1] = max(out[-1][1], a + n - out[-1][0])
                else:
                    out.append([a, n])
            spans.append([{"start": a, "length": n} for a, n in out])
        for row in batch.column("items").to_pylist():
            items.append(sorted({i for part in row for i in part}))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _FOUND.field(3).type), pa.array(items, _FOUND.field(4).type)],
                                         schema=_FOUND)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (start, length of maximal stretches of hit words) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    pieces, blocks = _blocks(benchmark, window, block_words)

    def scanned(number: int) -> DataFrame:
        held = [(r["item_id"], r["piece"].encode()) for r in pieces.where(F.col("block") == number).toLocalIterator()]
        tables = spark.sparkContext.broadcast(Block(held, window))
        return docs.select("doc_id", "text").mapInArrow(_scan(tables, number == 0), _ROWS)

    first = scanned(0)
    if blocks > 1:
        kept = cut_lineage(first, "first-block")
        hits = kept.where(F.size("spans") > 0)
        for number in range(1, blocks):
            hits = hits.unionByName(cut_lineage(scanned(number), "block-hits"))
        # rows equal in id and text have equal hits, and collect_set keeps one of each block's
        merged = hits.groupBy("doc_id", "tkey", "n_words").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
        merged = merged.mapInArrow(_merge, _ROWS).select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), F.col("spans").alias("s"),
                                                         F.col("items").alias("i"))
        first = kept.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left").select(
            "doc_id", "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))
    return first.select("doc_id", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query, from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return find(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                                        (F.size("spans") > 0).alias("contaminated"))


SQL = """WITH folded AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), text FROM benchmark),
worded AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM folded),
windows AS (
  SELECT DISTINCT id AS item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM worded WHERE kind = 'i' AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM worded, lengths WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT places.id, places.p, places.n, windows.item FROM places JOIN windows USING (n, g)),
hit_words AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY id),
hit_items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hits WHERE item IS NOT NULL)
  GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents JOIN worded ON kind = 'd' AND worded.id = CAST(doc_id AS VARCHAR)
LEFT JOIN hit_words ON hit_words.id = worded.id LEFT JOIN hit_items ON hit_items.id = worded.id"""
