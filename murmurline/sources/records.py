"""Records of quoted CSV files whose fields may hold line breaks, found by many tasks a file.

Spark's own reader for such files makes one split a file, since a line break alone does not tell whether a quoted field is
open. Here files are read as lines, in as many splits as any text, and the question is answered by a scan:

1. Whether a field is open after a line depends on the line and on whether one was open before it: a map of two states
   to two. A task composes the maps of its lines into one map a block (a file's split).
2. The maps of a file's blocks, a row each, are composed in order: a window over few and narrow rows gives the state at
   the start of every block.
3. The lines are read again, now with that state; a task puts lines together to records. The first record of a block
   that starts inside a field and the last one of a block that ends inside one are fragments, at most two a block;
   fragments of one record are joined by the block in which it starts.

A quote opens a field only where the field starts; elsewhere it is a character like any other. Inside a field two quotes
stand for one. What follows a closing quote up to the separator belongs to the field. Lines end with LF or CR LF.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurline.session import cut_lineage

#: Blocks whose states are sent to all tasks (24 bytes each); beyond, lines are shuffled to their block's state.
FEW_BLOCKS = 1_000_000
#: Lines and records of one Arrow batch that a kernel gives back.
RECORDS = 20_000

WHOLE, HEAD, MIDDLE, TAIL = range(4)

_MAPS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("to0", pa.int32()), ("to1", pa.int32())])
_PARTS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])


class LineStates:
    """Whether a field is open after a line, by whether one was open before."""

    def __init__(self, sep: str = ",", quote: str = '"'):
        s, q = re.escape(sep), re.escape(quote)
        inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        rest = f"(?!{q})[^{s}]*+"
        field = f"(?:{q}{inside}{q}{rest}|(?!{q})[^{s}]*+)"
        self.quote = quote
        #: complete fields up to the end of the line
        self.closed = re.compile(f"{field}(?:{s}{field})*+", re.S)
        #: the end of a field that is open at the start of the line
        self.close = re.compile(f"{inside}{q}{rest}", re.S)

    def after(self, line: str, state: int) -> int:
        at = 0
        if state:
            m = self.close.match(line)
            if not m:
                return 1
            if m.end() == len(line):
                return 0
            at = m.end() + 1
        return 0 if self.closed.fullmatch(line, at) else 1


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, start (of the block), id (grows along a block), line; damaged files as far as they can be read."""
    raw = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).text(paths)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The parts of a batch that come from one block."""
    keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
    at = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[at]:
            yield keys[at], batch.slice(at, k - at)
            at = k


def _quoted(lines, quote: str) -> list[int]:
    """Positions of the lines that hold a quote."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring(lines, quote), False)).to_pylist()


def _maps(states: LineStates):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out = lambda k, m: pa.RecordBatch.from_pylist([{"file": k[0], "start": k[1], "to0": m[0], "to1": m[1]}], schema=_MAPS)
        for batch in batches:
            for key, part in _blocks(batch):
                if held is None or held[0] != key:
                    if held is not None:
                        yield out(*held)
                    held = (key, [0, 1])
                lines, to = part.column("line"), held[1]
                for k in _quoted(lines, states.quote):
                    line = lines[k].as_py()
                    after = [states.after(line, s) for s in set(to)] if to[0] == to[1] else [states.after(line, 0), states.after(line, 1)]
                    to[:] = [after[0], after[0]] if len(after) == 1 else [after[s] for s in to]
        if held is not None:
            yield out(*held)

    return maps


def block_states(maps: DataFrame) -> DataFrame:
    """file, start, state (at the start of the block) and last (state at the end of the file)."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("to0") == F.col("to1")
    # the last block whose end does not depend on its start, and the blocks since then that turn the state
    reset = F.coalesce(F.last(F.when(fixed, F.struct("to0", "start")), ignorenulls=True).over(before), F.struct(F.lit(0).alias("to0"), F.lit(-1).cast("long").alias("start")))
    turns = F.coalesce(F.sum(F.when(~fixed & (F.col("to0") == 1), 1).otherwise(0)).over(before), F.lit(0))
    marked = maps.withColumn("_reset", reset).withColumn("_turns", turns)
    # turns up to the reset block are those before it
    at_reset = F.coalesce(F.last(F.when(fixed, F.col("_turns")), ignorenulls=True).over(before), F.lit(0))
    state = ((F.col("_reset.to0") + F.col("_turns") - at_reset) % 2).cast("int")
    known = marked.select("file", "start", "to0", "to1", state.alias("state"))
    end = F.when(F.col("state") == 0, F.col("to0")).otherwise(F.col("to1"))
    whole = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.select("file", "start", "state", F.last(end).over(whole).alias("last"))


def _cut(states: LineStates):
    """Lines with the state of their block to records and fragments."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state, open_lines, continued, first, last_id = None, 0, [], False, False, -1

        def flush():
            cols = list(zip(*rows)) or [()] * 5
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _PARTS)], schema=_PARTS)
            rows.clear()
            return out

        def put(record: str, kind: int):
            nonlocal first
            if kind == WHOLE and record in ("", "\r"):
                return
            rows.append((*key, kind, first and kind in (WHOLE, TAIL), record))
            first = False

        def end_block():
            if key is not None and state:
                put("\n".join(open_lines), MIDDLE if continued else TAIL)

        for batch in batches:
            for at, part in _blocks(batch):
                if at != key:
                    end_block()
                    key, state, last_id = at, part.column("state")[0].as_py() or 0, -1
                    open_lines, continued, first = [], bool(state), at[1] == 0
                ids = part.column("id")
                if ids[0].as_py() <= last_id:
                    raise ValueError("lines of a block came out of order")
                last_id = ids[len(ids) - 1].as_py()
                lines = part.column("line").to_pylist()
                quoted = _quoted(part.column("line"), states.quote)
                done = 0
                for k in [*quoted, len(lines)]:
                    if state:
                        open_lines += lines[done:k]
                    else:
                        for line in lines[done:k]:
                            put(line, WHOLE)
                    done = k
                    if k == len(lines):
                        break
                    line, was = lines[k], state
                    state = states.after(line, was)
                    done = k + 1
                    if was:
                        open_lines.append(line)
                        if not state:
                            put("\n".join(open_lines), HEAD if continued else WHOLE)
                            open_lines, continued = [], False
                    elif state:
                        open_lines, continued = [line], False
                    else:
                        put(line, WHOLE)
                    if len(rows) >= RECORDS:
                        yield flush()
                if len(rows) >= RECORDS:
                    yield flush()
        end_block()
        yield flush()

    return cut


def scan(spark: SparkSession, paths: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """file, start, state and last of every block of the files."""
    maps = _lines(spark, paths).mapInArrow(_maps(LineStates(sep, quote)), "file bigint, start bigint, to0 int, to1 int")
    return cut_lineage(block_states(maps), "block-states")


def records(spark: SparkSession, paths: str | list[str], header: bool = True, sep: str = ",", quote: str = '"',
            blocks: DataFrame | None = None, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """file (a hash of its path) and record, a row for each record of the files; headers and empty records left out."""
    states = LineStates(sep, quote)
    blocks = scan(spark, paths, sep, quote) if blocks is None else blocks
    inside = blocks.where("state = 1").select("file", "start", "state")
    lines = _lines(spark, paths)
    if inside.count() <= few_blocks:
        # a join that streams the lines keeps their order
        known = lines.join(F.broadcast(inside), ["file", "start"], "left")
    else:
        known = lines.join(inside, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "id")
    parts = known.select("file", "start", "id", "state", "line").mapInArrow(
        _cut(states), "file bigint, start bigint, kind int, header boolean, record string")
    whole = parts.where(F.col("kind") == WHOLE).select("file", "header", "record")
    broken = cut_lineage(parts.where(F.col("kind") != WHOLE), "fragments")
    # a fragment belongs to the record that the last TAIL before it starts
    before = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.when(F.col("kind") == TAIL, F.col("start")).otherwise(
        F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(before))
    owners = broken.select("file", "start", "kind").withColumn("origin", origin)
    pieces = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = (broken.join(owners, ["file", "start", "kind"]).groupBy("file", "origin")
              .agg(F.bool_or("header").alias("header"), F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record")))
    out = whole.unionByName(joined.select("file", "header", "record"))
    out = out.where(~F.col("header")) if header else out
    bare = F.regexp_replace("record", "\r$", "")
    return out.select("file", bare.alias("record")).where("record <> ''")
