"""Exact positions and samples without a single-task window.

A window over a whole table runs in one task. Here rows are range-partitioned by
everything that orders them, ties included, so equal values of one column do not
share a task; what earlier partitions hold is added to a sum inside each one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurline.session import cut_lineage

_SLOT_BITS = 10


def range_parts(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_part``, a number that grows with (by, order), written once.

    Spark samples the bounds, of any sortable types; they only spread the work.
    Rows equal in all of ``by`` and ``order`` stay together.
    """
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ordered")


def in_order(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), sums: tuple[str, ...] = (),
             previous: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<c>_before``, the sum of c over all earlier rows, and ``<c>_previous``, c in the row before (null in the first).

    Order and sums are those of the rows with the same ``by``. Only partition
    totals, a row per partition and key in it, meet in one window.
    """
    kept = range_parts(df, order, by)
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = kept.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums],
                         *([F.lag(F.struct(*previous)).over(w).alias("_back"), F.row_number().over(w).alias("_row")] if previous else []))
    last = [F.max_by(F.struct(*previous), "_row").alias("_last")] if previous else []
    parts = (inside if previous else kept).groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums], *last)
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    before = parts.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_part").alias("_p"),
                          *[F.coalesce(F.sum(f"_s_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{c}") for c in sums],
                          *([F.lag("_last").over(over).alias("_from")] if previous else []))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    joined = inside.join(before, same)
    back = F.when(F.col("_row") == 1, F.col("_from")).otherwise(F.col("_back")) if previous else None
    return joined.select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums],
                         *[back[c].alias(f"{c}_previous") for c in previous])


def global_position(df: DataFrame, order: str, ties: tuple[str, ...] = (), descending: bool = False,
                    out: str = "position") -> DataFrame:
    """1-based position of every row by a column, then ``ties``, then all columns.

    Only rows that are equal in every column share a place in the order; they
    are numbered among themselves.
    """
    first = F.col(order).desc() if descending else F.col(order)
    rest = F.xxhash64(*df.columns)
    placed = in_order(df.withColumn("_one", F.lit(1).cast("long")), [first, *[F.col(t) for t in ties], rest], sums=("_one",))
    return placed.select(*df.columns, (F.col("_one_before") + 1).alias(out))


def sorted_vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """Column number of each distinct term in byte order, from 1."""
    return global_position(terms.select(term).distinct(), term, out="column")


def percentile_rank(df: DataFrame, order: str, ties: tuple[str, ...], out: str = "percentile") -> DataFrame:
    """(position - 1) / rows in ascending order of ``order``."""
    placed = cut_lineage(global_position(df, order, ties, out="_position"), "ranked")
    n = placed.count()
    return placed.withColumn(out, (F.col("_position") - 1) / F.lit(float(max(n, 1)))).drop("_position")


#: Bits of a sort key.
HASH_BITS = 60


def stable_hash(key: Column, seed: int = 0) -> Column:
    """Sort key that is the same in every run and every engine: the first 60 bits of the MD5 of ``key|seed``."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def next_batch(pool: DataFrame, size: int, key: str = "_id", order: str = "random_number") -> tuple[DataFrame, DataFrame]:
    """First ``size`` rows by hash order, and the pool without them.

    The batch is a top-k (no full sort). The remainder is an anti join on the
    key whose small side is the batch; it is left to the optimizer.
    """
    batch = pool.orderBy(order, key).limit(size)
    return batch, pool.join(batch.select(key), key, "left_anti")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows in hash order of the key (T4)."""
    return df.orderBy(stable_hash(F.col(key), seed), key).limit(n)


def sample_fraction(df: DataFrame, stratum: str, key: str, fraction: float, order: Column | None = None,
                    seed: int = 0) -> DataFrame:
    """Exactly floor(n x fraction) rows of every stratum, without replacement.

    Rows of a stratum spread over 1,024 slots of their hash. Slot counts tell
    which slots are taken whole, which one in part and which not at all, so a
    stratum that holds a third of the table is ranked in 1,024 pieces and rows
    of unused slots are dropped before the ranking shuffle.
    """
    order = stable_hash(F.col(key), seed) if order is None else order
    slotted = df.withColumn("_hash", order).withColumn("_slot", F.expr(f"shiftright(_hash, {HASH_BITS - _SLOT_BITS})"))
    counts = slotted.groupBy(stratum, "_slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(stratum).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    quota = F.floor(F.sum("n").over(whole) * F.lit(fraction)) - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    take = (counts.withColumn("_quota", quota).where("_quota > 0").select(stratum, "_slot", "_quota"))
    inside = Window.partitionBy(stratum, "_slot").orderBy("_hash", key)
    return (slotted.join(take, [stratum, "_slot"])
                   .withColumn("_rank", F.row_number().over(inside))
                   .where("_rank <= _quota").drop("_rank", "_quota", "_hash", "_slot"))


def hash_split(df: DataFrame, key: str, test_percent: int, seed: int = 0) -> DataFrame:
    """Reproducible split: column ``test`` is true for about ``test_percent`` %."""
    return df.withColumn("test", F.pmod(stable_hash(F.col(key), seed), F.lit(100)) < test_percent)


def hash_folds(df: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(stable_hash(F.col(key), seed), F.lit(folds)).cast("int"))


def top_terms(weights: DataFrame, by: str, k: int, largest: bool = True) -> DataFrame:
    """k terms with the largest or smallest weight (T5)."""
    return weights.orderBy(F.col(by).desc() if largest else F.col(by), "term").limit(k)


def frequent_terms(counts: DataFrame, k: int = 200_000, count: str = "n") -> DataFrame:
    """Vocabulary cap: the k most frequent terms."""
    return counts.orderBy(F.col(count).desc(), "term").limit(k)


def largest_shifts(a: DataFrame, b: DataFrame, k: int, value: str = "percentile") -> DataFrame:
    """Terms of two models whose percentile differs most."""
    joined = a.select("term", F.col(value).alias("a")).join(b.select("term", F.col(value).alias("b")), "term")
    return (joined.withColumn("diff", F.col("a") - F.col("b"))
                  .orderBy(F.abs("diff").desc(), "term").limit(k))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``, as a combining aggregate.

    ``min`` of a struct is combined on the map side, so copies of one key never
    travel together.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")
