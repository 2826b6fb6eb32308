"""N-gram Jaccard join: a size-aware split of the sets into light and heavy ones.

A document's set holds its distinct word shingles. Two sets of sizes s and t link at Jaccard 75 % if they share at least
``need(s, t) = ceil(75 (s + t) / 175)`` shingles.

*Light* sets (at most ``x`` shingles) enumerate, for every size t within reach, their subsets of ``need(s, t)``
shingles. Two light sets that share such a subset are linked; nothing is left to verify, and one list of n sets gives
at most 2n links.

*Heavy* sets are found by inverted lists. All shingles have one order, common ones last and the more common the later; a
set is entered under its first ``s - ceil(0.75 s) + 1`` shingles, of which a linked set shares one at least. Light sets
within reach of heavy ones are entered too. The lists are scanned in two rounds. First every set of a list meets the
list's hub, the set with the fewest uncommon shingles, which settles groups of near copies in one comparison for each
member. Then sets of one list that are not connected yet meet each other:

- in lists of uncommon shingles all of them; pairs that meet in too few lists to link are dropped;
- in lists of common shingles by what sets them apart from the hub, as near copies share nearly all the rest. Two sets link
  if they differ in at most ``q (s + t)`` shingles, ``q = (100 - percent) / (100 + percent)``. Let a set differ from its hub in d
  shingles, those it lacks and those the hub lacks. If d is small enough it links with the hub. Of two others, linked ones
  share ``(d + e - q (s + t)) / 2`` of their differences, one at least, since both link with the hub where ``d + e <= q (s + t)``.
  So differences are listed by hub and shingle, rare ones first and those of one set not at all, and sets meet where enough
  of both follow. Such lists are never held by one task: their hubs come from sums of parts, their rows from joins that
  adaptive execution splits, and a hub's set is repeated for every GROUP of its sets.

Candidates are compared exactly, on all their shingles.

The boundary x is chosen by cost: from the counts of sets by size, the subsets that light sets would enumerate
against the entries and comparisons that heavy ones need.

Shingles whose hash lies in the lower part of all hashes (``counted``) are counted over all documents, and prefixes are taken
from that part first. Common are those that many documents have; the bound is the least that leaves at most COMMON of
them, so the list that tasks receive has a fixed size. Shingles beyond the counted part come last in the order and are
treated as common ones, so a list of uncommon shingles is never longer than the bound. Whatever is counted, results are the
same: it only orders shingles. Texts with equal sets form a class found beforehand, and each task enters a class once.
Classes are named by 64 bits of a 128-bit digest of their set; should two different sets share a name, which the other
64 bits tell, all are named anew with another seed. Shingles are compared by 64-bit hashes.

Kernels look at SLICE texts at a time and give their rows back before the next ones, so a task's memory does not follow
the size of its batches; a very long text is a slice of its own, and all of its words count.

Defined cases: null and wordless texts have the empty set and link with nothing. A text below N words has one shingle,
all its words. Rows with one doc_id are one document in links and components. Rows without a doc_id are no document
of ``join``: they have a row with a null component and join no other texts; ``keep_one`` keeps them all. Extra columns are
ignored by ``join``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurline.llm.common import ZIPPED, binaries, compressed, gram_hashes, sliced, unzip, word_hashes, zipped
from murmurline.llm.components import components
from murmurline.session import cut_lineage, remove_scratch

N, PERCENT = 5, 75
#: Largest boundary that is considered, and most entries of the list of common shingles (12 bytes each).
MAX_LIGHT, COMMON = 12, 500_000
#: A list longer than this is common, as far as COMMON allows.
LONG_LIST = 8
#: Share of the hashes that are counted, in terms of the share that a prefix takes of a set.
SLACK = 2.0
#: Most document ids to broadcast, and sets that are compared with one copy of their hub.
FEW_IDS, GROUP = 100_000, 500
#: Texts that a kernel looks at together, and classes that a task remembers (8 bytes each).
SLICE, REMEMBERED = 500, 1 << 20
#: Texts whose whole sets a kernel gives back together.
FEW_TEXTS = 100
#: Cost of comparing two sets by shingle, against one entry of an inverted list.
COMPARE = 0.5

_BASE = 0x9E3779B97F4A7C15
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64())])
#: kind: the partner size of a light entry, or minus the shingles from this one on; nh: size, and common shingles of the prefix
_ENTRIES = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("c", pa.int64()), ("nh", pa.int64())])


def need(s: int, t: int, percent: int = PERCENT) -> int:
    """Least overlap at which sets of s and t members link."""
    return -(-percent * (s + t) // (100 + percent))


def reach(s: int, percent: int = PERCENT) -> range:
    """Sizes that a set of size s can link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix(s, percent: int = PERCENT):
    """Entries of a set of size s in the inverted lists."""
    return s - -(-percent * s // 100) + 1


def shingle_sets(raws: list[bytes | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, ASCII lower-cased."""
    words, ends = word_hashes(raws)
    grams = gram_hashes(words, n, _BASE)
    out = []
    for raw, at, end in zip(raws, ends.tolist(), ends[1:].tolist()):
        if end - at >= n:
            h = np.sort(grams[at:end - n + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif end > at:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.lower().split()), seed=end - at)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(raw: bytes | None, n: int = N) -> np.ndarray:
    return shingle_sets([raw], n)[0]


def _digest(hashes: np.ndarray, seed: int = 0) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), seed=seed), np.int64)
    return int(a), int(b)


def _sets(n: int, seed: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=SLICE):
            found = shingle_sets(binaries(batch.column("text")), n)
            keys = [_digest(h, seed) for h in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(map(len, found), pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], schema=_SETS)
    return sets


class _Once:
    """Whether a class comes for the first time in this task; one that has lost its place to another comes again, which
    only costs repeats."""

    def __init__(self, most: int = REMEMBERED):
        self.seen, self.used = np.zeros(most, np.int64), np.zeros(most, bool)

    def first(self, c: int) -> bool:
        at = c % len(self.seen)
        if self.used[at] and self.seen[at] == c:
            return False
        self.seen[at], self.used[at] = c, True
        return True


def counted(percent: int) -> np.uint64:
    """Shingles below this hash are counted: SLACK times as many as a prefix takes of a set."""
    return np.uint64(min(SLACK * (100 - percent) / 100, 0.999) * 2.0 ** 64)


def _counted_shingles(n: int, percent: int):
    def counted_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, limit = _Once(), counted(percent)
        for batch in sliced(batches, rows=SLICE):
            found = [np.zeros(0, np.uint64)]
            for h in shingle_sets(binaries(batch.column("text")), n):
                if len(h) and once.first(_digest(h)[0]):
                    found.append(h[:np.searchsorted(h, limit)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["g"])
    return counted_shingles


def light_keys(h: np.ndarray, x: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(key, partner size) of every subset that a light set shares with a linked light set."""
    s, out = len(h), []
    for t in reach(s, percent):
        if 1 <= t <= x and need(s, t, percent) <= min(s, t):
            k, pair = need(s, t, percent), (min(s, t) << 32) | (max(s, t) << 16) | 1
            for chosen in combinations(h.tolist(), k):
                key = xxhash.xxh3_64_intdigest(np.array(chosen, np.uint64).tobytes(), seed=pair)
                out.append((np.uint64(key).astype(np.int64).item(), t))
    return out


def _entries(n: int, percent: int, x: int, common, seed: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, (frequent, rank), limit = _Once(), common.value, counted(percent)
        for batch in sliced(batches, rows=SLICE):
            gs, kinds, cs, nhs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for h in shingle_sets(binaries(batch.column("text")), n):
                s = len(h)
                c = _digest(h, seed)[0]
                if not s or not once.first(c):
                    continue
                if s <= x:
                    for key, t in light_keys(h, x, percent):
                        gs.append(np.array([key])), kinds.append(np.array([t], np.int32))
                        cs.append(np.array([c])), nhs.append(np.array([s << 32]))
                if s > x or max(reach(s, percent)) > x:
                    p = prefix(s, percent)
                    at = np.searchsorted(frequent[:-1], h) if len(frequent) else np.zeros(s, np.int64)
                    late = frequent[at] == h if len(frequent) else np.zeros(s, bool)
                    low = np.searchsorted(h, limit)
                    rare = h[:low][~late[:low]][:p]
                    hot = np.concatenate([h[late][np.argsort(rank[at[late]])], h[low:]])[:p - len(rare)]
                    gs.append(np.concatenate([rare, hot]).view(np.int64)), kinds.append(-(s - np.arange(p, dtype=np.int32)))
                    cs.append(np.full(p, c)), nhs.append(np.full(p, s << 32 | len(hot)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (gs, kinds, cs, nhs)], schema=_ENTRIES)
    return entries


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT, max_light: int = MAX_LIGHT) -> int:
    """The boundary of least cost, given the number of sets by size up to ``max_light`` and their reach."""
    def light(s: int, x: int) -> int:
        return sum(comb(s, need(s, t, percent)) for t in reach(s, percent) if 1 <= t <= x)

    def heavy(s: int) -> float:
        return prefix(s, percent) * (1 + COMPARE * s)

    def cost(x: int) -> float:
        return sum(n * ((light(s, x) if s <= x else 0) + (heavy(s) if s > x or max(reach(s, percent)) > x else 0)) for s, n in sizes.items())

    return min(range(max_light + 1), key=cost)


def _common(docs: DataFrame, n: int, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the shingles that fill long lists, the longest ones, sorted, and their ranks by length."""
    counts = cut_lineage(docs.select("text").mapInArrow(_counted_shingles(n, percent), "g bigint").groupBy("g").count().where(
        F.col("count") > LONG_LIST), "long-lists")
    bound = LONG_LIST
    while counts.where(F.col("count") > bound).count() > most:
        bound *= 2
    held = counts.where(F.col("count") > bound).toArrow()
    g, length = held.column("g").to_numpy().view(np.uint64), held.column("count").to_numpy()
    rank = np.empty(len(g), np.int32)
    rank[np.lexsort((g, length))] = np.arange(len(g), dtype=np.int32)
    order = np.argsort(g)
    return g[order], rank[order]


def _members(n: int, seed: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c", pa.int64()), ("hs", pa.list_(pa.int64()))])
        for batch in sliced(batches, rows=SLICE, column="z"):
            for at in range(0, batch.num_rows, FEW_TEXTS):
                found = shingle_sets(list(unzip(batch.column("z").slice(at, FEW_TEXTS))), n)
                ends = np.cumsum([0] + [len(h) for h in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(h, seed)[0] for h in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))], schema=schema)
    return members


def _up(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y)


def _need(na: Column, nb: Column, percent: int) -> Column:
    return _up((na + nb) * percent, 100 + percent)


def _near(na: Column, nb: Column, percent: int) -> Column:
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _likely(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet in enough lists to link, from one row (ca, na, cb, nb, spare) for each list where they meet.

    Of the shingles two linked sets share, at most ``s - prefix(s)`` of the larger one's lie outside the lists, and
    ``spare`` in lists that are not looked at.
    """
    na, nb = F.col("na"), F.col("nb")
    least = _need(na, nb, percent) - (_up(F.greatest(na, nb) * percent, 100) - 1) - F.col("spare")
    pairs = met.where(_near(na, nb, percent)).groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(
        F.count("*").alias("lists"), F.first(least).alias("least"))
    return pairs.where("lists >= least").select("a", "b")


def _whole_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, n: int, seed: int) -> DataFrame:
    """c and hs, all its shingles, of the wanted classes (c)."""
    firsts = cut_lineage(classes.join(wanted, "c").select(F.col("first").alias("doc_id")), "ids")
    # few documents are picked out where they are read; many are joined, in compressed form
    texts = (docs.select("doc_id", "text").join(F.broadcast(firsts), "doc_id", "left_semi").mapInArrow(zipped, ZIPPED)
             if firsts.count() <= FEW_IDS else compressed(docs).join(firsts, "doc_id", "left_semi"))
    return cut_lineage(texts.select("z").mapInArrow(_members(n, seed), "c bigint, hs array<bigint>").dropDuplicates(["c"]), "sets")


def _apart_in_common(hot: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of sets with their hubs, and pairs (a, b) of sets not connected yet that may share their first shingle in a
    list of a common one, from rows (g, c, hub, label, hub_label)."""
    mixed = hot.where("label <> hub_label").select("g").distinct()
    grouped = cut_lineage(hot.join(mixed, "g").where("c <> hub").select("c", "hub", "label", "hub_label").distinct(), "of-hubs")
    copies = grouped.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_copies"))
    sets = _whole_sets(grouped.select("c").union(copies.select(F.col("hub").alias("c"))).distinct(), docs, classes, n, seed)
    hubs = sets.withColumnsRenamed({"c": "hub", "hs": "ys"}).join(copies, "hub").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    both = grouped.join(copies, "hub").withColumn("_copy", F.pmod(F.xxhash64("c"), "_copies").cast("int")).drop("_copies").join(sets, "c").join(
        hubs.drop("_copies"), ["hub", "_copy"])
    apart = cut_lineage(both.select("hub", "c", "label", "hub_label", F.size("hs").cast("long").alias("n"), F.size("ys").cast("long").alias("hub_n"),
                                    F.concat(F.array_except("hs", "ys"), F.array_except("ys", "hs")).alias("es")).withColumn(
        "d", F.size("es").cast("long")), "apart")
    remove_scratch(sets)
    links_hub = F.col("d") * (100 + percent) <= (F.col("n") + F.col("hub_n")) * (100 - percent)
    certain = apart.where(links_hub & F.expr("label <> hub_label")).select(F.col("c").alias("a"), F.col("hub").alias("b"))
    rows = apart.select("hub", "c", "label", "n", "d", (links_hub | F.expr("label = hub_label")).alias("near"), F.explode("es").alias("e"))
    shared = rows.groupBy("hub", "e").agg(F.count("*").alias("sets"), F.min("near").alias("all_near")).where("sets > 1")
    w = Window.partitionBy("hub", "c")
    # differences of one set only come first and share nothing, so those that follow a place are the shared ones from there on
    left = F.count("*").over(w) - F.row_number().over(w.orderBy("sets", "e")) + 1
    listed = rows.join(shared, ["hub", "e"]).select("*", left.alias("left")).where("NOT all_near").where(
        (F.col("d") - F.col("left")) * percent <= F.col("n") * (100 - percent))
    listed = cut_lineage(listed.select("hub", "e", "c", "label", "n", "d", "near", "left"), "apart-lists")
    a, b = (listed.select("hub", "e", *[F.col(k).alias(f"{k}{side}") for k in ("c", "label", "n", "d", "near", "left")]) for side in "ab")
    na, nb = F.col("na"), F.col("nb")
    enough = 2 * F.least("lefta", "leftb") >= F.col("da") + F.col("db") - na - nb + 2 * _need(na, nb, percent)
    met = a.join(b, ["hub", "e"]).where((F.col("ca") < F.col("cb")) & ~(F.col("neara") & F.col("nearb")) & (F.col("labela") != F.col("labelb"))
                                        & _near(na, nb, percent) & enough)
    return certain, met.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes that link, judged by all their shingles."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    sets = _whole_sets(wanted, docs, classes, n, seed)
    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("hs").alias("xs")), "a").join(
        sets.select(F.col("c").alias("b"), F.col("hs").alias("ys")), "b")
    # row by row in the JVM: many rows of two sets each never stand side by side in a batch
    linked = F.size(F.array_intersect("xs", "ys")).cast("long") * (100 + percent) >= (F.size("xs").cast("long") + F.size("ys")) * percent
    out = cut_lineage(joined.where(linked).select("a", "b"), "verified")
    remove_scratch(sets)
    return out


def links(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sets (doc_id, n, c) and links (a, b) between classes c of equal sets; enough links for every component.

    Links inside a group that is connected already are left out, so groups of copies do not expand into pairs.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    seed = 0
    while True:
        sets = cut_lineage(rows.mapInArrow(_sets(n, seed), "doc_id bigint, n bigint, c bigint, c2 bigint"), "set-sizes")
        classes = cut_lineage(sets.where("n > 0").groupBy("c").agg(
            F.min("doc_id").alias("first"), F.first("n").alias("n"), (F.min("c2") < F.max("c2")).alias("clash")), "classes")
        if not classes.where("clash").limit(1).count():
            break
        seed += 1
    sets, classes = sets.drop("c2"), classes.drop("clash")
    small = dict(classes.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect())
    x = choose_boundary(small, percent)
    common = spark.sparkContext.broadcast(_common(rows, n, percent, COMMON))
    entries = cut_lineage(rows.select("text").mapInArrow(_entries(n, percent, x, common, seed), "g bigint, kind int, c bigint, nh bigint"), "entries")
    first_common = f"n - ceil({percent} * n / 100) + 1 - h"  # place of the first common shingle in the prefix
    known = entries.selectExpr("g", "kind", "c", "cast(shiftright(nh, 32) as int) AS n", "cast(nh & 4294967295 as int) AS h").selectExpr(
        "*", f"kind < 0 AND n + kind >= {first_common} AS hot", f"if(kind < 0, h / (n - ceil({percent} * n / 100) + 1), 0.0) AS score")
    w = "PARTITION BY g, kind_of"
    ends = known.where("NOT hot").withColumn("kind_of", F.when(F.col("kind") < 0, 0).otherwise(1)).selectExpr(
        "g", "kind", "kind_of", "c", "n", "h", f"max(struct(score, c, n)) OVER ({w}) AS lead", f"min(c) OVER ({w}) AS c0", f"max(c) OVER ({w}) AS c1",
        f"min(struct(n, c)) OVER ({w}) AS low", f"max(struct(n, c)) OVER ({w}) AS high")
    lists = cut_lineage(ends.where("c0 <> c1").drop("c0", "c1"), "lists")
    # light lists: sizes are the two of the key; each set links with one set of the other size, or of its own
    low, high = F.col("low"), F.col("high")
    light = lists.where("kind_of = 1")
    one = light.where((low["n"] == high["n"]) & (F.col("kind") == F.col("n"))).select(F.col("c").alias("a"), F.col("lead.c").alias("b"))
    two = light.where(low["n"] != high["n"]).select(
        F.col("c").alias("a"), F.when(F.col("n") == low["n"], high["c"]).otherwise(low["c"]).alias("b"))
    certain = one.union(two).where("a <> b")
    # first round: against the hub of the list
    rare = cut_lineage(lists.where("kind_of = 0").select("g", "c", "n", "h", "lead").distinct(), "uncommon-lists")
    hot = known.where("hot").select("g", "c", "n", "score").distinct()
    hubs = cut_lineage(hot.groupBy("g").agg(F.max(F.struct("score", "c", "n")).alias("lead"), F.count("*").alias("sets")).where("sets > 1").drop("sets"), "hubs")
    hot = cut_lineage(hot.join(hubs, "g").select("g", "c", "n", "lead"), "common-lists")
    remove_scratch(entries)
    met = lambda df: df.where("lead.c <> c").select(F.col("c").alias("ca"), F.col("n").alias("na"), F.col("lead.c").alias("cb"),
                                                    F.col("lead.n").alias("nb"), F.lit(0).alias("spare"))
    first = cut_lineage(_likely(met(rare).unionByName(met(hot)), percent), "pairs")
    found = _verified(first, rows, classes, n, percent, seed)
    # second round: sets of a list that the first one left in different components
    label = cut_lineage(components(found).select(F.col("node").alias("c"), F.col("component").alias("label")), "labels")
    every = cut_lineage(rare.join(label, "c", "left").select("g", "c", "n", "h", F.coalesce("label", "c").alias("label")), "marked")
    mixed = every.groupBy("g").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("g")
    marked = cut_lineage(every.join(mixed, "g"), "marked")
    remove_scratch(every, rare)
    a, b = (marked.select("g", *[F.col(k).alias(f"{k}{side}") for k in ("c", "n", "h", "label")]) for side in "ab")
    apart = a.join(b, "g").where((F.col("ca") < F.col("cb")) & (F.col("labela") != F.col("labelb")) & _near(F.col("na"), F.col("nb"), percent))
    pairs = _likely(apart.select("ca", "na", "cb", "nb", F.least("ha", "hb").alias("spare")), percent)
    hub_label = label.select(F.col("c").alias("_hub"), F.col("label").alias("_hub_label"))
    named = hot.join(label, "c", "left").join(hub_label, F.col("lead.c") == F.col("_hub"), "left").select(
        "g", "c", F.col("lead.c").alias("hub"), F.coalesce("label", "c").alias("label"), F.coalesce("_hub_label", F.col("lead.c")).alias("hub_label"))
    to_hubs, met_apart = _apart_in_common(cut_lineage(named, "named"), rows, classes, n, percent, seed)
    # kept before known pairs leave: each pair stands in many lists
    second = cut_lineage(pairs.union(met_apart).distinct(), "pairs")
    remove_scratch(marked)
    rest = _verified(cut_lineage(second.join(first, ["a", "b"], "left_anti"), "pairs"), rows, classes, n, percent, seed)
    return sets, certain.union(found).union(to_hubs).union(rest)


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    sets, linked = links(docs, n, percent)
    owner = sets.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("owner"))
    edges = linked.join(owner.select(F.col("c").alias("a"), F.col("owner").alias("oa")), "a").join(
        owner.select(F.col("c").alias("b"), F.col("owner").alias("ob")), "b").select(F.col("oa").alias("a"), F.col("ob").alias("b"))
    # a doc_id with several rows joins their classes
    same = sets.where("n > 0").join(owner, "c").where("doc_id <> owner").select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))
    part = components(edges.union(same))
    return sets.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The document with the least doc_id of each group of near copies (rows of one doc_id all stay).

    Rows without a doc_id cannot be told apart by it: they all stay and stand for no other document.
    """
    named, unnamed = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    firsts = join(named, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    return named.join(firsts, "doc_id", "left_semi").select(*docs.columns).unionByName(unnamed)


def sql(source: str = "documents", n: int = N, percent: int = PERCENT) -> str:
    """The same in DuckDB SQL: named tables that end with ``joined`` (doc_id unique)."""
    return f"""RECURSIVE jw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {source}),
js AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {n} THEN [array_to_string(words, ' ')] ELSE
    list_distinct(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) END AS s FROM jw),
je AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM js),
jp AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM je a JOIN je b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
jr AS (SELECT doc_id AS node, doc_id AS c FROM js UNION SELECT jp.b, jr.c FROM jr JOIN jp ON jr.node = jp.a),
joined AS (
  SELECT js.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id
  FROM js JOIN (SELECT node, min(c) AS component_id FROM jr GROUP BY node) m ON js.doc_id = m.node)"""


SQL = f"""WITH {sql()}
SELECT doc_id, n_shingles, component_id FROM joined"""
