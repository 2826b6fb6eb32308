"""Vector code compression: codebooks for the parts of vectors by exact integer Lloyd rounds over two trees.

A vector is cut into PARTS equal parts; each part position has a codebook of ENTRIES entries. Vectors are packed into
blocks of up to BLOCK rows, a power of two each. A block holds, for each part position, a tree over its points: halves by
the median of the widest component, down to LEAF points, with the box and the sum of the points of every node. Trees are
built once and kept in the shared folder; each round sends the codebooks (their size is fixed by ENTRIES and the length
of a vector) to the tasks.

A round walks down the tree of points and a tree of the codebook's entries at once. A pair of nodes goes when the least
distance of their boxes exceeds the greatest distance of another pair of the same point node, and a pair with an entry
also goes when another entry is nearer over the whole box (the difference of two distances is linear, so its extremes lie
at corners). A point node with one entry left is assigned as a whole and adds its cached sum; leaves with several entries
left compare integers point by point. Results do not depend on the bounds: they only save comparisons.

Sums of a task are merged in a tree of fixed fan-in, so no task and not the driver holds more than FAN_IN of them; the
driver sees codebooks only.

All values are integers: 64-bit where no distance or sum can leave them, Python's own beyond that.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part and give no row. Rows
equal in vec_id each give a row; the first entries are those of the least vec_ids (ties by components, rows without a
vec_id last). With fewer vectors than entries there are fewer entries. Vectors of different lengths have codebooks of
their own; where a length is no multiple of PARTS, part j starts at floor(j * length / PARTS). A sum of errors beyond 64
bits is given as the largest 64-bit integer. A missing label column counts as null. Other extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from math import floor, isinf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a packed block and of a leaf (powers of two).
BLOCK, LEAF = 4096, 16
#: Sums of tasks that one step merges.
FAN_IN = 64
#: Pairs of a leaf and an entry whose distances are held at once.
PAIRS = 1 << 13

_TOP = (1 << 63) - 1
_PACKED = pa.schema([("dim", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("labels", pa.list_(pa.string())),
                     ("kind", pa.string()), ("points", pa.binary()), ("place", pa.binary()), ("nodes", pa.binary())])
_PACKED_SQL = ("dim int, rows int, ids binary, null_ids binary, labels array<string>, kind string, points binary, place binary, nodes binary")

Books = dict[int, list]


def edges(dim: int, parts: int = PARTS) -> list[int]:
    return [j * dim // parts for j in range(parts + 1)]


def integer(x: float, scale: int = SCALE) -> int:
    y = x * scale
    return int(x) * scale if isinf(y) else floor(y)


def integers(rows: list[list[float]], dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, in 64 bits if they are small enough for exact distances, else as Python's own."""
    values = np.array(rows, np.float64).reshape(len(rows), dim)
    top = float(np.abs(values).max(initial=0)) * scale
    if top < 2.0 ** 24 and dim <= 4096:  # squares of differences below 2^50
        return np.floor(values * scale).astype(np.int64)
    return np.array([[integer(x, scale) for x in row] for row in values.tolist()], dtype=object).reshape(len(rows), dim)


def in_parts(whole: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(part, row, component); shorter parts are filled with zeros, which add nothing to distances."""
    cut = edges(whole.shape[1], parts)
    width = max(1, max(b - a for a, b in zip(cut, cut[1:])))
    out = np.zeros((parts, len(whole), width), whole.dtype)
    for j, (a, b) in enumerate(zip(cut, cut[1:])):
        out[j, :, :b - a] = whole[:, a:b]
    return out


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """(part, row): rows in the order in which halving by the median of the widest component leaves them."""
    parts, n, _ = points.shape
    place = np.broadcast_to(np.arange(n), (parts, n)).copy()
    size = n
    while size > leaf and size % 2 == 0:
        held = np.take_along_axis(points, place[:, :, None], 1).reshape(parts * (n // size), size, -1)
        widest = np.argmax(held.max(1) - held.min(1), 1)
        by = np.argsort(np.take_along_axis(held, widest[:, None, None], 2)[:, :, 0], 1, kind="stable")
        place = np.take_along_axis(place.reshape(-1, size), by, 1).reshape(parts, n)
        size //= 2
    return place


def node_levels(ordered: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(least, greatest, sum) of the points of every node, by level from the root; each (part, node, component)."""
    parts, n, width = ordered.shape
    size = min(n, leaf)
    held = ordered.reshape(parts, n // size, size, width)
    levels = [(held.min(2), held.max(2), held.sum(2))]
    while levels[-1][0].shape[1] > 1:
        low, high, total = (x.reshape(parts, x.shape[1] // 2, 2, width) for x in levels[-1])
        levels.append((low.min(2), high.max(2), total.sum(2)))
    return levels[::-1]


def entry_tree(book: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Entry numbers in tree order (part, slot) and the boxes of the levels; the last level holds the entries. The number
    of slots is a power of two: the last entries are repeated, and a repeated entry never wins against its first slot."""
    parts, n, _ = book.shape
    slots = 1 << (n - 1).bit_length()
    number = np.minimum(np.arange(slots), n - 1)
    wide = book[:, number]
    place = tree_order(wide, 1)
    ordered = np.take_along_axis(wide, place[:, :, None], 1)
    return number[place], [(low, high) for low, high, _ in node_levels(ordered, 1)]


def _small(a: np.ndarray) -> bool:
    return a.dtype != object


def assign(ordered: np.ndarray, levels: list, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each point (part, row in tree order), sums and counts by (part, entry), and how many distances of a
    point and an entry were computed. ``book`` is (part, entry, component)."""
    if _small(ordered) != _small(book):
        ordered, book = ordered.astype(object), book.astype(object)
        levels = [tuple(x.astype(object) for x in level) for level in levels]
    parts, n, width = ordered.shape
    entries = book.shape[1]
    number, boxes = entry_tree(book)
    codes = np.zeros((parts, n), np.int16)
    sums = np.zeros((parts, entries, width), ordered.dtype)
    counts = np.zeros((parts, entries), np.int64)
    part, node = np.arange(parts), np.zeros(parts, np.int64)  # point nodes of this level
    owner, slot = np.arange(parts), np.zeros(parts, np.int64)  # pairs: point node (its index) and entry node
    depth = 0  # of the entry nodes
    for level, (lows, highs, totals) in enumerate(levels):
        while True:
            low, high = lows[part, node], highs[part, node]
            elow, ehigh = boxes[depth][0][part[owner], slot], boxes[depth][1][part[owner], slot]
            gap = np.maximum(np.maximum(low[owner] - ehigh, elow - high[owner]), 0)
            far = np.maximum(ehigh - low[owner], high[owner] - elow)
            least, most = (gap * gap).sum(1), (far * far).sum(1)
            first = np.searchsorted(owner, np.arange(len(part)))
            bound = np.minimum.reduceat(most, first)
            keep = least <= bound[owner]
            owner, slot, most = owner[keep], slot[keep], most[keep]
            if depth < len(boxes) - 1:
                if level < len(levels) - 1:
                    break
                # the points' tree ends first: go on with the entries alone
                owner, slot = np.repeat(owner, 2), np.stack([2 * slot, 2 * slot + 1], 1).reshape(-1)
                depth += 1
                continue
            owner, slot = _not_dominated(part, low, high, owner, slot, most, number, boxes[-1][0])
            break
        only = np.bincount(owner, minlength=len(part)) == 1
        if depth == len(boxes) - 1 and only.any():
            mine = only[owner]
            p, v, e = part[owner[mine]], node[owner[mine]], None
            e = number[p, slot[mine]]
            size = n // lows.shape[1]
            np.add.at(sums, (p, e), totals[p, v])
            np.add.at(counts, (p, e), size)
            for a, b, c in zip(p.tolist(), v.tolist(), e.tolist()):
                codes[a, b * size:(b + 1) * size] = c
            left = np.flatnonzero(~only)
            owner, slot = np.searchsorted(left, owner[~mine]), slot[~mine]
            part, node = part[left], node[left]
        if not len(part) or level == len(levels) - 1:
            break
        # both trees go one level down; entries that are leaves stay
        part, node = np.repeat(part, 2), np.stack([2 * node, 2 * node + 1], 1).reshape(-1)
        starts = np.searchsorted(owner, np.arange(len(part) // 2 + 1))
        pair = np.concatenate([np.arange(a, b) for a, b in zip(starts[:-1], starts[1:]) for _ in (0, 1)])
        owner = np.repeat(np.arange(len(part)), np.repeat(np.diff(starts), 2))
        slot = slot[pair]
        if depth < len(boxes) - 1:
            owner, slot = np.repeat(owner, 2), np.stack([2 * slot, 2 * slot + 1], 1).reshape(-1)
            depth += 1
    computed = 0
    if len(part):
        computed = _leaves(ordered, book, part, node, owner, number[part[owner], slot], n // levels[-1][0].shape[1], codes, sums, counts)
    return codes, sums, counts, computed


def _not_dominated(part, low, high, owner, slot, most, number, centres) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node and an entry without those where the node's best entry is nearer everywhere in the box."""
    entry = number[part[owner], slot]
    order = np.lexsort((entry, most, owner))
    head = order[np.searchsorted(owner[order], np.arange(len(part)))]  # least greatest distance of each node
    rival = head[owner]
    a, b = centres[part[owner], slot], centres[part[owner], slot[rival]]
    # greatest value over the box of (distance to the rival) - (distance to the entry)
    slope = 2 * (a - b)
    worst = np.maximum(slope * low[owner], slope * high[owner]).sum(1) + (b * b - a * a).sum(1)
    gone = (worst < 0) | ((worst == 0) & (entry[rival] < entry))
    # a slot that repeats an entry goes, whatever the distances
    key = owner.astype(np.int64) * (number.shape[1] + 1) + entry
    repeated = np.ones(len(key), bool)
    repeated[np.unique(key, return_index=True)[1]] = False
    keep = ~(gone & (entry != entry[rival])) & ~repeated
    return owner[keep], slot[keep]


def _leaves(ordered, book, part, node, owner, entry, size, codes, sums, counts) -> int:
    """Integer distances of the points of uncertain leaves to the entries left; ties go to the lower entry."""
    order = np.lexsort((entry, owner))
    owner, entry = owner[order], entry[order]
    starts = np.searchsorted(owner, np.arange(len(part) + 1))
    at = 0
    while at < len(part):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + PAIRS, "right")) - 1)
        lo, hi = starts[at], starts[end]
        rows = node[at:end, None] * size + np.arange(size)
        points = ordered[part[at:end, None], rows]  # leaf, point, component
        own = owner[lo:hi] - at
        away = points[own] - book[part[owner[lo:hi]], entry[lo:hi]][:, None, :]
        away = (away * away).sum(2)
        first = starts[at:end] - lo
        best = np.minimum.reduceat(away, first, axis=0)
        rank = np.where(away == best[own], entry[lo:hi, None], np.int64(1 << 40))
        chosen = np.minimum.reduceat(rank, first, axis=0)
        where = np.broadcast_to(part[at:end, None], chosen.shape)
        codes[where, rows] = chosen
        np.add.at(sums, (where, chosen), points)
        np.add.at(counts, (where, chosen), 1)
        at = end
    return len(owner) * size


# ---- blocks ----------------------------------------------------------------------------------------------------

def _dump(a: np.ndarray) -> bytes:
    return a.astype("<i8").tobytes() if _small(a) else json.dumps([str(x) for x in a.reshape(-1)]).encode()


def _load(raw: bytes, kind: str, shape: tuple) -> np.ndarray:
    if kind == "i8":
        return np.frombuffer(raw, "<i8").reshape(shape)
    return np.array([int(x) for x in json.loads(raw)] or [], dtype=object).reshape(shape)


def _packed(held: list[tuple], dim: int, parts: int, scale: int) -> Iterator[dict]:
    """Blocks whose sizes are the powers of two that add up to the number of rows."""
    at = 0
    for bit in reversed(range(len(held).bit_length())):
        if not len(held) >> bit & 1:
            continue
        some = held[at:at + (1 << bit)]
        at += 1 << bit
        points = in_parts(integers([r[1] for r in some], dim, scale), parts)
        place = tree_order(points, LEAF)
        ordered = np.take_along_axis(points, place[:, :, None], 1)
        nodes = np.concatenate([np.stack(level) for level in node_levels(ordered, LEAF)], 2)
        yield {"dim": dim, "rows": len(some), "ids": np.array([r[0] or 0 for r in some], "<i8").tobytes(),
               "null_ids": np.packbits([r[0] is None for r in some]).tobytes(), "labels": [r[2] for r in some],
               "kind": "i8" if _small(points) else "text", "points": _dump(ordered), "place": place.astype("<i4").tobytes(), "nodes": _dump(nodes)}


def _pack(parts: int, scale: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            for row in _packed(held.pop(dim), dim, parts, scale):
                yield pa.RecordBatch.from_pylist([row], schema=_PACKED)

        for batch in batches:
            for i, v, label in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "label"))):
                held.setdefault(len(v), []).append((i, v, label))
                if len(held[len(v)]) >= block:
                    yield from out(len(v))
        for dim in list(held):
            yield from out(dim)

    return pack


def _open(row: dict, parts: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Ordered points, node levels and row places of a packed block."""
    dim, n = row["dim"], row["rows"]
    width = max(1, max(np.diff(edges(dim, parts))))
    ordered = _load(row["points"], row["kind"], (parts, n, width))
    leaves = n // min(n, LEAF)
    nodes = _load(row["nodes"], row["kind"], (3, parts, 2 * leaves - 1, width))
    cuts = np.cumsum([0] + [1 << k for k in range(leaves.bit_length())])
    levels = [tuple(nodes[:, :, a:b]) for a, b in zip(cuts, cuts[1:])]
    return ordered, levels, np.frombuffer(row["place"], "<i4").reshape(parts, n)


def _book(entries: list, parts: int) -> np.ndarray:
    """(part, entry, component) from entries given as whole vectors of Python integers."""
    values = np.array(entries, dtype=object).reshape(len(entries), -1)
    if all(abs(x) < 1 << 24 for x in values.reshape(-1)):
        values = values.astype(np.int64)
    return in_parts(values, parts)


# ---- rounds ----------------------------------------------------------------------------------------------------

_SUMS = pa.schema([("part", pa.int64()), ("sums", pa.string())])


def _added(total: dict, dim: int, sums, counts) -> None:
    """Adds (part, entry) sums and counts, as nested lists of Python integers, to those of a length."""
    if dim not in total:
        total[dim] = [sums, counts]
        return
    have = total[dim]
    have[0] = [[[x + y for x, y in zip(a, b)] for a, b in zip(p, q)] for p, q in zip(have[0], sums)]
    have[1] = [[x + y for x, y in zip(a, b)] for a, b in zip(have[1], counts)]


def _step(books: Books, parts: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ordered, levels, _ = _open(row, parts)
                _, sums, counts, _ = assign(ordered, levels, _book(books[row["dim"]], parts))
                _added(total, row["dim"], sums.tolist(), counts.tolist())
        if total:
            yield pa.RecordBatch.from_pylist([{"part": 0, "sums": json.dumps(total)}], schema=_SUMS)

    return step


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            for dim, (sums, counts) in json.loads(raw).items():
                _added(total, int(dim), sums, counts)
    if total:
        yield pa.RecordBatch.from_pylist([{"part": 0, "sums": json.dumps(total)}], schema=_SUMS)


def lloyd(blocks: DataFrame, books: Books, parts: int = PARTS, fan_in: int = FAN_IN) -> Books:
    """The codebooks after one round."""
    lists = blocks.select(*_PACKED.names).mapInArrow(_step(books, parts), "part bigint, sums string")
    left = blocks.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // fan_in)
        lists = lists.repartition(left).mapInArrow(_merge, "part bigint, sums string")
    out = dict(books)
    for row in lists.collect():
        for dim, (sums, counts) in json.loads(row["sums"]).items():
            cut = edges(int(dim), parts)
            new = [list(e) for e in books[int(dim)]]
            for j, (a, b) in enumerate(zip(cut, cut[1:])):
                for e, n in enumerate(counts[j]):
                    if n:
                        new[e][a:b] = [x // n for x in sums[j][e][:b - a]]
            out[int(dim)] = new
    return out


def _codes(books: Books, parts: int):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shas = {dim: digest(entries, parts) for dim, entries in books.items()}
        for batch in batches:
            for row in batch.to_pylist():
                ordered, levels, place = _open(row, parts)
                book = _book(books[row["dim"]], parts)
                found = assign(ordered, levels, book)[0]
                if _small(ordered) != _small(book):
                    ordered, book = ordered.astype(object), book.astype(object)
                away = ordered - book[np.arange(parts)[:, None], found]
                n = row["rows"]
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, away.dtype)
                for j in range(parts):
                    code[place[j], j] = found[j]
                    error[place[j]] += (away[j] * away[j]).sum(1)
                none = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=n)
                ids = [None if x else i for i, x in zip(np.frombuffer(row["ids"], "<i8").tolist(), none)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(row["labels"], pa.string()), pa.array([c.tobytes().hex() for c in code], pa.string()),
                    pa.array([min(int(x), _TOP) for x in error], pa.int64()), pa.array([shas[row["dim"]]] * n, pa.string())], schema=schema)

    return codes


def digest(entries: list, parts: int = PARTS) -> str:
    """Hex sha256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    cut = edges(len(entries[0]), parts)
    return hashlib.sha256(",".join(str(x) for a, b in zip(cut, cut[1:]) for e in entries for x in e[a:b]).encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    v: Column = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.where(v.isNotNull() & finite).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"), label.alias("label"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          block: int = BLOCK) -> tuple[DataFrame, Books]:
    """Packed blocks of all vectors that take part, and the codebooks by length of a vector."""
    if entries > 256:
        raise ValueError("a code holds one byte a part")
    kept = _kept(vectors)
    blocks = cut_lineage(kept.mapInArrow(_pack(parts, scale, block), _PACKED_SQL), "vector-blocks")
    books: Books = {}
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):
        first = kept.where(F.size("v") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
        books[dim] = [[integer(x, scale) for x in r["v"]] for r in first]
    for _ in range(rounds if books else 0):
        books = lloyd(blocks, books, parts)
    return blocks, books


def encode(blocks: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """vec_id, label (as string), code, error and codebooks_sha256 of every vector of the blocks."""
    return blocks.select(*_PACKED.names).mapInArrow(_codes(books, parts), "vec_id bigint, label string, code string, error bigint, codebooks_sha256 string")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 from the columns vec_id, embedding and label."""
    coded = cut_lineage(encode(*train(vectors, parts, entries, rounds, scale), parts), "codes")
    top = F.lit(_TOP).cast("decimal(38,0)")
    # a written table has a size the optimizer knows: few labels are broadcast, many are joined
    of_label = cut_lineage(coded.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error")), "label-errors")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(i: int) -> str:
    """One assignment and the entries after it, in SQL."""
    return f"""near{i} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away
    FROM points p JOIN book{i} b ON p.part = b.part) GROUP BY rid, part)"""


def _entries(i: int) -> str:
    return f"""means{i} AS (
  SELECT part, entry, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM (
    SELECT n.part, n.entry, unnest(range(1, len(p.v) + 1)) AS k, unnest(p.v) AS x FROM near{i} n JOIN points p ON n.rid = p.rid AND n.part = p.part)
  GROUP BY part, entry, k),
book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY k) AS v FROM means{i} GROUP BY part, entry) m
  ON b.part = m.part AND b.entry = m.entry)"""


SQL = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER (ORDER BY vec_id) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT rid, j AS part, v[j * len(v) // {PARTS} + 1:(j + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) r(j)),
book0 AS (SELECT part, rid - 1 AS entry, v FROM points WHERE rid <= {ENTRIES}),
{''.join(f'{_round(i)},{chr(10)}{_entries(i)},{chr(10)}' for i in range(ROUNDS))}{_round(ROUNDS)},
codes AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), sha"""
