"""Exact top-k inner-product search by tiles.

Vectors are turned into integers, packed into blocks of rows, and every block of queries meets every block of
candidates of the same length as one matrix product (a tile). A tile keeps the k best of each of its queries; the short
lists are merged in a tree with a fixed fan-in, so no task holds more than FAN_IN lists of a query. Tiles are spread by
(query block, candidate block): the work is queries x candidates whatever the order, and equal vectors, however many,
are ordinary rows.

Scores are exact: products are taken in 64-bit floats where no sum can reach 2^53, in Python integers beyond that.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part. Rows equal in id and
vector count once; rows with the query's id are its own and no candidates of it. A query meets candidates of its own
length only; one without any gives no row. Ties go to the smaller id. Scores are ranked exactly up to
38 digits; one beyond 64 bits is returned as the nearest 64-bit integer. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline.session import cut_lineage

SCALE = 256
TOP = 5
#: Rows of a packed block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Lists of a query that one step of the merge takes.
FAN_IN = 64

_BLOCKS = "dim int, ids binary, rows binary"
_LISTS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("tile", T.LongType()),
                       T.StructField("vec_id", T.LongType()), T.StructField("score", T.DecimalType(38, 0))])


def _integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component, or null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # kept as doubles: a floor beyond 64 bits has no long, and floats of that size are integers already
    whole = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    return F.when(vector.isNotNull() & finite, whole)


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int, ids: list, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()],
                                               "rows": [np.floor(np.array(rows, np.float64)).tobytes()]},
                                              schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= size:
                    yield out(len(v), *held.pop(len(v)))
        for dim, (ids, rows) in held.items():
            yield out(dim, ids, rows)

    return pack


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of q and c."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if reach < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in c]
    return np.array([[sum(a * b for a, b in zip(x, y)) for y in whole[1]] for x in whole[0]], dtype=object)


def _tile(k: int):
    most = 10 ** 38 - 1  # what the lists can hold

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qi, ci = (np.frombuffer(row[n], np.int64) for n in ("q_ids", "ids"))
                q, c = (np.frombuffer(row[n]).reshape(len(i), dim) for n, i in (("q_rows", qi), ("rows", ci)))
                order = np.argsort(ci, kind="stable")  # a stable choice then prefers the smaller id
                ci, c = ci[order], c[order]
                found: list[list] = [[], [], []]
                for at in range(0, len(qi), 128):
                    scores = _scores(q[at:at + 128], c)
                    for x, s in zip(qi[at:at + 128], scores):
                        mine = ci != x
                        ids, s = (ci, s) if mine.all() else (ci[mine], s[mine])
                        if len(ids) > k and s.dtype != object:
                            least = -np.partition(-s, k - 1)[k - 1]
                            near = np.flatnonzero(s >= least)
                            ids, s = ids[near], s[near]
                        best = sorted(zip((-int(v) for v in s), ids.tolist()))[:k]
                        found[0] += [int(x)] * len(best)
                        found[1] += [i for _, i in best]
                        found[2] += [Decimal(min(max(-v, -most), most)) for v, _ in best]
                yield pa.RecordBatch.from_pydict(
                    {"query_id": found[0], "tile": [row["block"]] * len(found[0]), "vec_id": found[1], "score": found[2]},
                    schema=pa.schema([("query_id", pa.int64()), ("tile", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38))]))

    return tile


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best entries per key; collects at most FAN_IN lists of k entries for each."""
    entry = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    merged = lists.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("_top"))
    return merged.select(*keys, F.posexplode("_top").alias("_i", "_e")).select(
        *keys, F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score"), (F.col("_i") + 1).cast("int").alias("rank"))


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, block: int = BLOCK, query_block: int = QUERY_BLOCK,
          fan_in: int = FAN_IN) -> DataFrame:
    """query_id, rank, vec_id, score from the columns vec_id and embedding; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    whole = vectors.where("vec_id IS NOT NULL").select("vec_id", _integers(F.col("embedding")).alias("v")).where("v IS NOT NULL").distinct()
    # packed once; a block number is a row number of the few packed rows of each partition
    kept = cut_lineage(whole.mapInArrow(_pack(block), _BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    queries = whole.where(is_query).mapInArrow(_pack(query_block), _BLOCKS)
    q = cut_lineage(queries.select("dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"),
                                   F.monotonically_increasing_id().alias("q_block")), "query-blocks")
    # every pair of a query block and a candidate block is one tile, dealt to tasks by its own hash
    pairs = q.select("dim", "q_block").join(kept.select("dim", "block"), "dim")
    tiles = pairs.repartition("q_block", "block").join(q, ["dim", "q_block"]).join(kept, ["dim", "block"])
    lists = tiles.select("dim", "q_ids", "q_rows", "ids", "rows", "block").mapInArrow(_tile(k), _LISTS)
    n = kept.count()
    # block numbers are spread over partitions; folding them into ever fewer groups merges FAN_IN lists or so at a time
    groups = n
    while groups > fan_in:
        groups = -(-groups // fan_in)
        lists = _best(lists.withColumn("tile", F.pmod(F.xxhash64("tile"), F.lit(groups))), ["query_id", "tile"], k).select(
            "query_id", "tile", "vec_id", "score")
    least, most = (F.lit(Decimal(x)).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    return _best(lists, ["query_id"], k).select("query_id", "rank", "vec_id", F.least(F.greatest("score", least), most).cast("long").alias("score"))


SQL = """WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
