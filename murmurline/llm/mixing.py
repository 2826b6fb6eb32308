"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight in the mix and a schedule of that weight over training time (0 to 1). The mix takes a given
share of all words; a source gives at most ``MAX_EPOCHS`` times its size, and what it cannot give goes to the others by
weight. A source's documents stand in a fixed pseudo-random order and are read through again and again until its target
is met; the last document may be taken in part, so each source meets its target to the word. The demand for a source up
to time u is its target times the integral of its schedule; inverting it turns the words taken so far into a training
position. Rows come out range-sorted by position. ``mix`` has a row per document, with the positions of all passes that
take something of it; ``passes`` and ``take`` have a row per such pass, each at its own position.

Prefix sums run over range partitions ordered by (source, hash of the document), so a source with a third of all rows
is spread over as many tasks as its share needs. Sources are a table of their own: they are numbered and their targets
found by distributed aggregates, of which the driver sees three numbers a round.

Defined cases: a null text has size 0, takes 0 and has no position; the null source is a source, after all others.
Rows with the same doc_id are taken one by one (whole-row ties are interchangeable), rows without a doc_id too. A very
long text is counted whole; the last part of a source may cut it. An empty table gives an empty result. ``mix`` returns
the columns named by ``keep`` and its own; ``take`` the columns it is given, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import ordered_parts
from murmurline.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0


@dataclass(frozen=True)
class Schedule:
    """Weight 1 + slope * (2u - 1) at time u, as a share of the source's mean weight; slope in [-1, 1].

    The integral up to u is u + slope * (u * u - u), 1 at u = 1.
    """

    slope: float

    def demand(self, u: Column) -> Column:
        return u + F.lit(self.slope) * (u * u - u)


#: One schedule per source in turn: falling, flat and rising.
SCHEDULES = (Schedule(-0.5), Schedule(0.0), Schedule(0.5))


def _invert(share: Column, slope: Column) -> Column:
    """The time u in [0, 1] at which the demand u + a (u^2 - u) reaches ``share``."""
    b = 1 - slope
    # a u^2 + (1 - a) u = share, in the form that also holds at a = 0
    return 2 * share / (b + F.sqrt(F.greatest(b * b + 4 * slope * share, F.lit(0.0))))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII spaces; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   max_epochs: float = MAX_EPOCHS, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """source, source_size, weight, slope and target from the columns source and size.

    Targets are the fixed point of: sources above their cap stop there, the rest share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = ordered_parts(per, [F.col("source").isNull(), F.col("source")], F.lit(1)).withColumnRenamed("before", "_rank")
    turn = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                                       (F.col("_rank") % len(values) + 1).cast("int"))
    table = cut_lineage(rank.select(
        "source", "source_size", turn(weights).alias("weight"), turn([s.slope for s in schedules]).alias("slope")), "sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    free, weight, capped = share * total, None, -1
    full = F.lit(False)  # whether a source stops at its cap
    while True:
        found = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if found[0] == capped:
            break
        capped, free, weight = found[0], share * total - found[1], found[2]
        full = cap <= F.col("weight") * F.lit(free) / F.lit(weight) if weight else F.lit(True)
    asked = F.col("weight") * F.lit(free) / F.lit(weight) if weight else cap
    return table.withColumn("target", F.when(full, cap).otherwise(asked).cast("double"))


def _laid(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, schedules: tuple[Schedule, ...],
          keep: tuple[str, ...]) -> DataFrame:
    """Per document: ``keep``, size, before (words of its source's earlier documents), source_size, slope and target."""
    sizes = docs.select(*keep, "source", word_count(F.col("text")).alias("size"))
    keyed = sizes.withColumn("_md5", F.md5(F.col("doc_id").cast("string")))
    ordered = cut_lineage(ordered_parts(
        keyed.withColumn("_null", F.col("source").isNull()),
        [F.col("_null"), F.col("source"), F.col("_md5"), F.col("doc_id"), F.col("size")], F.col("size"),
        by=F.col("source")), "mixed")
    targets = source_targets(ordered, weights, share, max_epochs, schedules)
    t = targets.select(F.col("source").alias("_s"), "source_size", "slope", "target")
    return ordered.join(t, F.col("source").eqNullSafe(F.col("_s")))


def _position(words: Column) -> Column:
    """The training time at which a source's demand reaches ``words``."""
    return F.round(_invert(F.least(words / F.greatest("target", F.lit(1.0)), F.lit(1.0)), F.col("slope")), 9)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
        schedules: tuple[Schedule, ...] = SCHEDULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns ``keep``, size, source_size, target, taken and positions, range-sorted by the first of them.

    ``positions`` are the training times, 0 to 1, of the middle of the document in each pass that takes something of it.
    """
    joined = _laid(docs, weights, share, max_epochs, schedules, keep)
    asked = F.floor("target")
    passes = F.floor(asked / F.col("source_size"))
    rest = asked - passes * F.col("source_size")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        passes * F.col("size") + F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))).cast("long")
    out = joined.select(*keep, "size", "source_size", "target", "slope", "before", taken.alias("taken"))
    # every pass but the last takes the whole document
    times = F.ceil(F.try_divide("taken", "size")).cast("int")
    at = F.transform(F.sequence(F.lit(0), times - 1), lambda k: _position(k * F.col("source_size") + F.col("before") + F.col("size") / 2))
    positions = F.when(F.col("taken") > 0, at).otherwise(F.array().cast("array<double>"))
    out = out.select(*keep, "size", "source_size", "target", "taken", positions.alias("positions"))
    first = F.get("positions", F.lit(0))
    return out.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, F.col("doc_id"))


def schedule(docs: DataFrame) -> DataFrame:
    """The columns of the query: those of ``mix``, with the position of the first pass (null if nothing is taken) and of
    the second one (null if there is none; the default parameters take no third)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"),
                            F.get("positions", F.lit(1)).alias("second_position"))


def passes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
           schedules: tuple[Schedule, ...] = SCHEDULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document and pass over it: the columns ``keep``, size, pass (from 0), words and position, in no order.

    ``words`` is what the pass takes, the whole size or, in the last pass over a source, its first words; passes that
    take nothing have no row. ``position`` is that of the middle of the document in this pass.
    """
    joined = _laid(docs, weights, share, max_epochs, schedules, keep).where("size > 0")
    asked = F.floor("target")
    full = F.floor(F.try_divide(asked, F.col("source_size")))
    last = F.least(F.greatest(asked - full * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size")).cast("long")
    rows = joined.withColumns({"_full": full.cast("int"), "_last": last}).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_full"))))
    words = F.when(F.col("pass") < F.col("_full"), F.col("size")).otherwise(F.col("_last"))
    read = F.col("pass") * F.col("source_size") + F.col("before") + F.col("size") / 2
    return rows.select(*keep, "size", "pass", words.alias("words"), _position(read).alias("position")).where("words > 0")


def _without_null(column: str) -> list[Column]:
    """_id and _none, never null, which tell the values of a column and null apart."""
    return [F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_id"), F.isnull(column).alias("_none")]


def take(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: every pass over a document is a row, and a last part holds its first words joined by spaces.

    Rows are range-sorted by the position of their pass, which is not a column of the result. Rows equal in doc_id,
    source and text are interchangeable. A column ``n_chars`` is set to the characters of the row.
    """
    # the given columns travel as one, so that none can clash with those of the join
    packed = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.xxhash64("text", "source").alias("key"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    taken = passes(packed, keep=("doc_id", "key"), **parameters).select(
        *_without_null("doc_id"), "key", F.col("words").cast("int").alias("words"), (F.col("words") == F.col("size")).alias("whole"), "position")
    # plain keys, the same ones twice, so that texts are dealt once for both steps
    by = ["_id", "_none", "key"]
    once = packed.select("*", *_without_null("doc_id")).dropDuplicates(by)
    rows = once.join(taken, by)
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    cut = rows.select("row", "doc_id", "position", F.when(F.col("whole"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("words")), " ")).alias("text"))
    ordered = cut.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    kept = {"text": F.col("text"), "n_chars": F.length("text")}
    return ordered.select(*[(kept[f.name] if f.name in kept else F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


# Rounds of the targets in SQL: after as many rounds as there are weights groups and sources the fixed point is reached.
SQL_ROUNDS = 24


def sql(source: str = "documents") -> str:
    """The same in DuckDB SQL, for the default parameters (a source stops within SQL_ROUNDS rounds)."""
    n = len(WEIGHTS)
    at = lambda x: f"round(CAST(2 * {x} / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * {x}, 0))) AS DOUBLE), 9)"
    pick = lambda values: f"[{', '.join(str(float(v)) for v in values)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1 AS INTEGER)]"
    rounds = "".join(f""", r{i} AS (
  SELECT s.*, 2.0 * s.source_size <= s.weight * g.free / g.w AS is_full
  FROM r{i - 1} s, (SELECT {SHARE} * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (WHERE is_full), 0) AS free,
                      nullif(sum(weight) FILTER (WHERE NOT is_full), 0) AS w FROM r{i - 1}) g)""".replace("s.*,", "s.* EXCLUDE (is_full),")
                     for i in range(1, SQL_ROUNDS + 1))
    return f"""sizes AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM {source}), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source), r0 AS (
  SELECT source, source_size, {pick(WEIGHTS)} AS weight, {pick([s.slope for s in SCHEDULES])} AS slope, false AS is_full FROM per){rounds},
targets AS (
  SELECT s.source, s.source_size, s.slope, CAST(CASE WHEN s.is_full THEN 2.0 * s.source_size ELSE s.weight * g.free / g.w END AS DOUBLE) AS target
  FROM r{SQL_ROUNDS} s, (SELECT {SHARE} * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (WHERE is_full), 0) AS free,
    nullif(sum(weight) FILTER (WHERE NOT is_full), 0) AS w FROM r{SQL_ROUNDS}) g), laid AS (
  SELECT d.*, t.source_size, t.slope, t.target, floor(t.target) AS asked,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source), shared AS (
  SELECT *, floor(asked / source_size) AS passes, least((before + size / 2) / greatest(target, 1.0), 1.0) AS share,
    least((source_size + before + size / 2) / greatest(target, 1.0), 1.0) AS share2 FROM laid), mixed AS (
  SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    passes * size + least(greatest(asked - passes * source_size - before, 0), size) END AS BIGINT) AS taken,
    CASE WHEN taken > 0 THEN {at("share")} END AS position, CASE WHEN taken > size THEN {at("share2")} END AS second_position
  FROM shared)"""


SQL = f"WITH {sql()}\nSELECT doc_id, size, source_size, target, taken, position, second_position FROM mixed"
