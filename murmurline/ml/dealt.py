"""Linear models of many terms whose coefficients and gradients never pass the driver.

Coefficients are dealt over the cluster in slices. An evaluation is three steps of one job: slices go to the tasks that
hold rows, these add up losses and gradients of all models in one pass, and the sums go back to the slices, which also
keep the steps and gradient changes of limited-memory quasi-Newton steps. The driver gets inner products of those
vectors, a few hundred numbers a model and slice, and decides on the next direction and step from them.

Objective, standardised space, start, directions, line search and end are those of Spark's ``LogisticRegression``.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, AccumulatorParam, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from murmurline.session import remove, scratch_root

#: Entries of a packed block; entries that one task goes through in a pass; numbers (term, model) of a slice.
BLOCK, TASK_ENTRIES, SLICE = 1 << 19, 2_000_000, 1 << 18
#: Steps that the quasi-Newton direction remembers; evaluations after which the plan's history is cut.
MEMORY, CUT = 10, 10
#: Python's objects are bytes to Spark; kept as they are, they are neither packed nor copied in every pass.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER

_BLOCK = pa.schema([(n, pa.binary()) for n in ("at", "seen", "place", "values", "labels", "weights")])
_BLOCK_SQL = "at binary, seen binary, place binary, values binary, labels binary, weights binary"


def _to(key: int) -> int:
    """Keys are partition numbers."""
    return key


@dataclass
class Block:
    """Rows in compressed form: ``seen`` are the terms that occur, ``place`` each entry's position in them."""

    at: np.ndarray
    seen: np.ndarray
    place: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(self.weights)), np.flatnonzero(np.diff(self.at))
        if len(full):
            out[full] = np.add.reduceat(values, self.at[:-1][full])
        return out

    def by_term(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums over the rows of values times a number a row, by seen term."""
        return np.bincount(self.place, np.repeat(rows, np.diff(self.at)) * values, len(self.seen))


def _packed(models: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            seen, place = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            cat = lambda i, kind: np.concatenate([h[i] for h in held]).astype(kind).tobytes()
            at = np.cumsum(np.concatenate([[0], *[h[0] for h in held]])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                at.tobytes(), seen.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), cat(2, float), cat(3, float), cat(4, float))], schema=_BLOCK)

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                terms, values = b.column("terms"), b.column("values")
                held.append((np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), values.flatten().to_numpy(),
                             b.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, models),
                             b.column("weight").to_numpy(zero_copy_only=False)))
                n += len(held[-1][1]) + b.num_rows
                if n >= BLOCK:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
    return pack


def _blocks(rows: DataFrame, labels: list[Column], weight: Column | None, features: str) -> tuple[RDD, int]:
    """(task, block), dealt over tasks and kept; and the number of tasks."""
    vector = F.unwrap_udt(features)
    # a dense vector has no indices
    terms = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    flat = rows.select(F.when(F.size(vector["values"]) > 0, terms).otherwise(F.array().cast("array<int>")).alias("terms"), vector["values"].alias("values"),
                       F.array(*[x.cast("double") for x in labels]).alias("labels"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    entries = flat.select(F.sum(F.size("values"))).first()[0] or 0
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES)))
    models = len(labels)

    def deal(part: int, packed: Iterable) -> Iterator:
        for i, r in enumerate(packed):
            n = len(r.weights) // 8
            yield (part + i) % tasks, Block(np.frombuffer(r["at"], np.int64), np.frombuffer(r["seen"], np.int32), np.frombuffer(r["place"], np.int32),
                                            np.frombuffer(r["values"]), np.frombuffer(r["labels"]).reshape(n, models), np.frombuffer(r["weights"]))

    blocks = flat.mapInArrow(_packed(models), _BLOCK_SQL).rdd.mapPartitionsWithIndex(deal).partitionBy(tasks, _to)
    return blocks.persist(KEPT), tasks


class _Reports(AccumulatorParam):
    """Reports by slice. A task that runs again reports the same once more."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        a.update(b)
        return a


@dataclass
class Slice:
    """A stretch of the coefficients of all models, (model, term); the last term of the last slice is the intercept."""

    first: int
    scale: np.ndarray  # 1 / standard deviation; 0 where a term does not vary
    shift: np.ndarray  # mean / standard deviation
    free: np.ndarray  # 0 for the intercept, which has no penalty
    x: np.ndarray
    g: np.ndarray
    way: np.ndarray
    trial: np.ndarray
    slope: np.ndarray
    steps: list[list[np.ndarray]] = field(default_factory=list)
    turns: list[list[np.ndarray]] = field(default_factory=list)

    def obey(self, k: int, order: Order) -> None:
        if order.take:
            if order.take == "step":
                self.steps[k] = [self.trial[k] - self.x[k], *self.steps[k]][:MEMORY]
                self.turns[k] = [self.slope[k] - self.g[k], *self.turns[k]][:MEMORY]
            self.x[k], self.g[k] = self.trial[k], self.slope[k]
        if order.forget:
            self.steps[k], self.turns[k] = [], []
        if order.mix is not None:
            basis = [*self.steps[k], *self.turns[k], self.g[k]]
            self.way[k] = sum(c * b for c, b in zip(order.mix, basis, strict=True))
        self.trial[k] = self.x[k] + order.length * self.way[k]

    def report(self, k: int) -> dict:
        """Inner products of the step, gradient change and gradient that the trial would leave, with the kept ones and themselves."""
        new = np.stack([self.trial[k] - self.x[k], self.slope[k] - self.g[k], self.slope[k]])
        return {"square": float(((self.trial[k] * self.scale) ** 2 * self.free).sum()), "rise": float(self.way[k] @ self.slope[k]),
                "dots": np.stack([new @ b for b in [*self.steps[k], *self.turns[k], *new]], axis=1)}


@dataclass
class Order:
    """What a model's slices do before an evaluation: take the last trial, forget steps, turn, go ``length``."""

    take: str = ""
    forget: bool = False
    mix: np.ndarray | None = None
    length: float = 0.0


class _Failed(Exception):
    """A line search or a direction failed."""


def quasi_newton(iterations: int, tol: float) -> Generator[Order, tuple[float, float, np.ndarray], str]:
    """The driver's part of one model: sends orders, gets (value, slope along the way, inner products).

    Returns ``trial`` or ``x``, whichever the model ends with. Steps, line search and end are those of Spark's optimizer.
    """
    value, _, dots = yield Order()
    first, past, known, done, take, forget, failed = value, [math.inf], dots[2:, -1:], 0, "start", False, False
    while True:
        steps = (len(known) - 1) // 2
        over = (done >= iterations or len(past) >= 2 and abs(value - max(past)) <= tol * first
                or math.sqrt(known[-1, -1]) <= max(tol * abs(value), 1e-8))
        if over:
            return "trial" if take else "x"
        try:
            mix = _direction(known, steps)
            norm, falling = math.sqrt(max(mix @ known @ mix, 0.0)), float(known[-1] @ mix)
            if falling > 0 or not norm > 0:
                raise _Failed
            order = Order(take, forget, mix)
            take, forget = "", False
            length, value_there, dots = yield from _search(order, value, falling, 1.0 / norm if done == 0 else 1.0)
            if length * math.sqrt(known[-1, -1]) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                return "trial" if take else "x"
            failed, forget, known = True, True, known[-1:, -1:]
            continue
        known = _known(known, steps, dots)
        value, done, take, failed = value_there, done + 1, "step", False
        past = [*past, value][-20:]


def _known(known: np.ndarray, steps: int, dots: np.ndarray) -> np.ndarray:
    """Inner products of (steps, turns, gradient), newest first, after a step."""
    old = [*range(min(steps, MEMORY - 1))]
    names = [2 * steps, *old, 2 * steps + 1, *[steps + i for i in old], 2 * steps + 2]  # columns of dots
    out = np.zeros((len(names), len(names)))
    for a, i in enumerate(names):
        for b, j in enumerate(names):
            out[a, b] = dots[i - 2 * steps, j] if i >= 2 * steps else dots[j - 2 * steps, i] if j >= 2 * steps else known[i, j]
    return out


def _direction(known: np.ndarray, steps: int) -> np.ndarray:
    """Weights of (steps, turns, gradient) in the next direction."""
    mix = np.zeros(2 * steps + 1)
    mix[-1] = 1.0
    a = np.zeros(steps)
    for i in range(steps):
        a[i] = known[i] @ mix / known[i, steps + i]
        if math.isnan(a[i]):
            raise _Failed
        mix[steps + i] -= a[i]
    if steps:
        bend = known[0, steps]
        if bend < 0 or math.isnan(bend):
            raise _Failed
        mix *= bend / known[steps, steps]
    for i in reversed(range(steps)):
        mix[i] += a[i] - known[steps + i] @ mix / known[i, steps + i]
    return -mix


def _search(order: Order, value: float, falling: float, length: float):
    """Strong Wolfe line search by cubic interpolation: length, value there and inner products."""
    def phi(at: float):
        order.length = at
        there, rise, dots = yield order
        order.take, order.forget, order.mix = "", False, None
        return (at, rise, there), dots

    def zoom(low, high):
        for _ in range(10):
            at = _between(high, low) if low[0] > high[0] else _between(low, high)
            c, dots = yield from phi(at)
            if c[2] > value + 1e-4 * c[0] * falling or c[2] >= low[2]:
                high = c
            else:
                if abs(c[1]) <= 0.9 * abs(falling):
                    return c[0], c[2], dots
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    low = (0.0, falling, value)
    for i in range(10):
        c, dots = yield from phi(length)
        if math.isinf(c[2]) or math.isnan(c[2]):
            length /= 2
            continue
        if c[2] > value + 1e-4 * length * falling or (c[2] >= low[2] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[1]) <= 0.9 * abs(falling):
            return c[0], c[2], dots
        if c[1] >= 0:
            return (yield from zoom(c, low))
        low, length = c, length * 1.5
    raise _Failed


def _between(left, right) -> float:
    d1 = left[1] + right[1] - 3 * (left[2] - right[2]) / (left[0] - right[0])
    inner = d1 * d1 - left[1] * right[1]
    d2 = math.sqrt(inner) if inner >= 0 else math.nan
    wide = right[0] - left[0]
    at = right[0] - wide * (right[1] + d2 - d1) / (right[1] - left[1] + 2 * d2)
    return min(max(at, left[0] + 0.1 * wide), left[0] + 0.9 * wide) if not math.isnan(at) else at


def _drop(rdd: RDD) -> None:
    """Frees the shuffle files below a table that is kept."""
    rdd._jrdd.rdd().cleanShuffleDependencies(False)


def _delete(rows: DataFrame, path: str | None) -> None:
    """Deletes a checkpoint that nothing depends on any more."""
    if path:
        remove(rows.sparkSession, path)


def fit(rows: DataFrame, labels: list[Column], terms: int, penalty: float, iterations: int = 100, tol: float = 1e-6,
        weight: Column | None = None, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (model, term) and intercepts of one logistic model a label, all over the same rows.

    Labels are 0 or 1, and every label has both among rows of some weight. The penalty is Spark's ``regParam``.
    """
    sc, models = rows.sparkSession.sparkContext, len(labels)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(rows.sparkSession))
    blocks, tasks = _blocks(rows, labels, weight, features)
    slices = max(-(-(terms + 1) * models // SLICE), min(sc.defaultParallelism, terms // 1000 + 1))
    width = -(-(terms + 1) // slices)
    firsts = list(range(0, terms + 1, width))
    ends = [min(a + width, terms + 1) for a in firsts]

    def moments(part: Iterable) -> Iterator:
        """Sums by slice: of weights, their squares and positive ones, and by term of values and their squares."""
        by_term, whole = np.zeros((2, terms + 1)), np.zeros(2 + models)
        for _, b in part:
            by_term[0][b.seen] += b.by_term(b.weights, b.values)
            by_term[1][b.seen] += b.by_term(b.weights, b.values ** 2)
            whole += [b.weights.sum(), (b.weights ** 2).sum(), *(b.weights @ b.labels)]
        for s, (a, e) in enumerate(zip(firsts, ends)):
            yield s, (by_term[:, a:e], whole)

    def begin(part: Iterable) -> Iterator:
        sums: dict[int, list] = {}
        for s, (by_term, whole) in part:
            held = sums.setdefault(s, [0, 0])
            held[0], held[1] = held[0] + by_term, held[1] + whole
        for s, (by_term, whole) in sums.items():
            total = whole[0]
            mean = by_term[0] / total
            spare = by_term[1] - total * mean ** 2
            spare[spare <= 1e-12 * by_term[1]] = 0.0
            std = np.sqrt(spare / (total - whole[1] / total)) if total - whole[1] / total > 0 else np.zeros_like(spare)
            scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
            free, shift = np.ones_like(std), mean * scale
            x = np.zeros((models, len(std)))
            if ends[s] == terms + 1:
                scale[-1], shift[-1], free[-1] = 1.0, 0.0, 0.0
                x[:, -1] = np.log(whole[2:] / (total - whole[2:]))
            zero = lambda: np.zeros_like(x)
            yield s, (Slice(firsts[s], scale, shift, free, x, zero(), zero(), x.copy(), zero(), [[] for _ in range(models)], [[] for _ in range(models)]), total)

    state = blocks.mapPartitions(moments).partitionBy(len(firsts), _to).mapPartitions(begin, preservesPartitioning=True).persist(KEPT)
    runs = {k: quasi_newton(iterations, tol) for k in range(models)}
    orders, ends_with, round_, cut = {k: next(run) for k, run in runs.items()}, {}, 0, None
    while orders:
        found = sc.accumulator({}, _Reports())
        sums, after = _evaluated(sc, blocks, state, tasks, firsts, ends, orders, penalty, found)
        after.persist(KEPT)
        round_ += 1
        if round_ % CUT == 0:
            after.checkpoint()
        after._jrdd.count()  # unlike count(), no Python reads the slices once more for it
        _drop(sums)
        if round_ == 1:
            _drop(state)
            _drop(blocks)
        state.unpersist()
        state = after
        if round_ % CUT == 0:
            _delete(rows, cut)
            cut = state.getCheckpointFile()
        reports = found.value
        for k in list(orders):
            mine = [reports[s][k] for s in sorted(reports)]
            loss = mine[0]["loss"] + 0.5 * penalty * sum(r["square"] for r in mine)
            try:
                orders[k] = runs[k].send((loss, sum(r["rise"] for r in mine), sum(r["dots"] for r in mine)))
            except StopIteration as end:
                ends_with[k] = end.value
                del orders[k]

    def coefficients(part: Iterable) -> Iterator:
        for _, (at, _) in part:
            out = np.stack([(at.trial if ends_with[k] == "trial" else at.x)[k] for k in range(models)])
            yield at.first, out * at.scale, (out * at.shift).sum(1)

    got = sorted(state.mapPartitions(coefficients).collect(), key=lambda r: r[0])
    state.unpersist()
    blocks.unpersist()
    _delete(rows, cut)
    whole = np.concatenate([r[1] for r in got], axis=1)
    return whole[:, :-1], whole[:, -1] - sum(r[2] for r in got)


def _evaluated(sc: SparkContext, blocks: RDD, state: RDD, tasks: int, firsts: list[int], ends: list[int], orders: dict[int, Order],
               penalty: float, found) -> tuple[RDD, RDD]:
    """Summed gradients, and the slices after one evaluation of the models that have orders. Reports go to ``found``."""
    live, slices, size = sorted(orders), len(firsts), ends[-1]
    orders = {k: Order(o.take, o.forget, o.mix, o.length) for k, o in orders.items()}

    def send(part: Iterable) -> Iterator:
        for s, (at, _) in part:
            for k in live:
                at.obey(k, orders[k])
            trial = at.trial[live]
            message = (s, trial * at.scale, (trial * at.shift).sum(1))
            for t in range(tasks):
                yield t, message

    def add(part: Iterable) -> Iterator:
        coef, off, have, held = np.zeros((len(live), size)), np.zeros(len(live)), 0, []
        slope, whole = np.zeros((len(live), size)), np.zeros((2, len(live)))
        for t, got in part:
            if isinstance(got, Block):
                held.append(got)
            else:
                s, some, shifted = got
                coef[:, firsts[s]:ends[s]] = some
                off, have = off + shifted, have + 1
            if have == slices:  # slices come first
                for b in held:
                    for j, k in enumerate(live):
                        margin = b.by_row(coef[j][b.seen][b.place] * b.values) + (coef[j, -1] - off[j])
                        y = b.labels[:, k]
                        whole[0, j] += b.weights @ (np.logaddexp(0, margin) - y * margin)
                        wrong = b.weights * (0.5 * (1 + np.tanh(margin / 2)) - y)
                        slope[j][b.seen] += b.by_term(wrong, b.values)
                        whole[1, j] += wrong.sum()
                held = []
        slope[:, -1] = whole[1]
        if have:
            for s, (a, e) in enumerate(zip(firsts, ends)):
                yield s, (slope[:, a:e], whole)

    def take(part: Iterable) -> Iterator:
        kept, sums = {}, {}
        for s, got in part:
            if isinstance(got[0], Slice):
                kept[s] = got
            elif s in sums:
                sums[s] = (sums[s][0] + got[0], sums[s][1] + got[1])
            else:
                sums[s] = got
        for s, (at, total) in kept.items():
            slope, whole = sums[s]
            out = {}
            for j, k in enumerate(live):
                at.obey(k, orders[k])
                at.slope[k] = (slope[j] * at.scale - at.shift * whole[1, j]) / total + penalty * at.free * at.trial[k] * at.scale ** 2
                out[k] = at.report(k) | {"loss": whole[0, j] / total}
            found.add({s: out})
            yield s, (at, total)

    sent = state.mapPartitions(send).partitionBy(tasks, _to)
    sums = sc.union([sent, blocks]).mapPartitions(add).partitionBy(slices, _to)
    return sums, sc.union([state, sums]).mapPartitions(take, preservesPartitioning=True)
