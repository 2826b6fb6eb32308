"""C: trees, medoids, silhouettes, bootstrap and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurline.operators import bootstrap, clustering, distance, series
from murmurline.plans import bindings as B
from murmurline.plans.bindings import r6, sql, sql6
from murmurline.plans.queries.statistics import _PI2, day_arrays
from murmurline.plans.registry import query


def day_edges(spark, sf):
    return distance.distances(day_arrays(spark, sf), distance.euclidean)


def _tree_sql(distances: str, name: str = "st") -> str:
    """st (g, step, item, cl, lc, rc, h): the cluster of each item after each step, named by its least item, and the two
    clusters that joined, at the mean of all distances between them."""
    return f""", {name}_ed AS ({distances}),
  {name} AS (SELECT g, 0 AS step, i AS item, i AS cl, 0 AS lc, 0 AS rc, 0.0::DOUBLE AS h FROM (SELECT DISTINCT g, i FROM {name}_ed)
    UNION ALL SELECT s.g, s.step + 1, s.item, CASE WHEN s.cl = m.rc THEN m.lc ELSE s.cl END, m.lc, m.rc, m.h FROM {name} s JOIN (
      SELECT g, arg_min(lc, (h, lc, rc)) AS lc, arg_min(rc, (h, lc, rc)) AS rc, min(h) AS h FROM (
        SELECT a.g, a.cl AS lc, b.cl AS rc, avg(e.d) AS h FROM {name} a JOIN {name} b ON a.g = b.g AND a.cl < b.cl
        JOIN {name}_ed e ON e.g = a.g AND e.i = a.item AND e.j = b.item GROUP BY ALL) GROUP BY g) m ON m.g = s.g)"""


_BOTH = "SELECT g, i, j, d FROM {0} UNION ALL SELECT g, j, i, d FROM {0}"
_DAY_TREE = B.DAYS_SQL.replace("tweets AS (", "RECURSIVE tweets AS (", 1) + """, eu AS (SELECT a.series_id AS g, a.seg AS i, b.seg AS j,
    sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM days a JOIN days b ON a.series_id = b.series_id AND a.pos = b.pos AND a.seg < b.seg
    GROUP BY ALL)""" + _tree_sql(_BOTH.format("eu"))


@query("c1_average_linkage", sql(_DAY_TREE, f"""SELECT s.g AS group_id, CAST(s.step AS INTEGER) AS step,
  string_agg(CAST(s.item AS VARCHAR), ',' ORDER BY s.item) FILTER (WHERE p.cl = s.lc) AS "left",
  string_agg(CAST(s.item AS VARCHAR), ',' ORDER BY s.item) FILTER (WHERE p.cl = s.rc) AS "right", {sql6('any_value(s.h)')} AS height
  FROM st s JOIN st p ON p.g = s.g AND p.step = s.step - 1 AND p.item = s.item GROUP BY s.g, s.step"""))
def c1(spark, sf):
    """Items of the joined clusters as lists in text, in order."""
    names = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return clustering.average_linkage(day_edges(spark, sf)).select(
        "group_id", "step", names(F.col("left")).alias("left"), names(F.col("right")).alias("right"), r6("height").alias("height"))


@query("c2_cut_tree", sql(_DAY_TREE, """SELECT s.g AS group_id, s.item, CAST(dense_rank() OVER (PARTITION BY s.g, k ORDER BY s.cl) AS INTEGER) AS cluster, k
  FROM st s JOIN (SELECT g, max(step) AS n FROM st GROUP BY g) m ON m.g = s.g CROSS JOIN (SELECT unnest([2, 4]) AS k) WHERE s.step = m.n - (k - 1)"""))
def c2(spark, sf):
    merges = clustering.average_linkage(day_edges(spark, sf))
    two, four = clustering.cut_tree(merges, 2), clustering.cut_tree(merges, 4)
    return two.withColumn("k", F.lit(2)).unionByName(four.withColumn("k", F.lit(4)))


@query("c3_k_medoids")
def c3(spark, sf):
    edges = day_edges(spark, sf)
    return clustering.k_medoids(edges, 2).withColumn("k", F.lit(2)).unionByName(
        clustering.k_medoids(edges, 4).withColumn("k", F.lit(4)))


_SIL_SQL = B.DAYS_SQL + """, ed AS (SELECT a.series_id AS g, a.seg AS i, b.seg AS j, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d
   FROM days a JOIN days b ON a.series_id = b.series_id AND a.pos = b.pos AND a.seg <> b.seg GROUP BY ALL),
  mn AS (SELECT g, i, (i - 1) % 7 // 5 AS own, (j - 1) % 7 // 5 AS c, avg(d) AS m FROM ed GROUP BY ALL),
  ab AS (SELECT g, i, own, max(m) FILTER (WHERE own = c) AS a, min(m) FILTER (WHERE own <> c) AS b FROM mn GROUP BY ALL)"""


@query("c4_silhouette", sql(_SIL_SQL, f"""SELECT g AS group_id, i AS item, CAST(own AS INTEGER) AS cluster,
  {sql6("(b - a) / greatest(a, b)")} AS sil_width FROM ab"""))
def c4(spark, sf):
    """Silhouette of the weekday/weekend split of the days of each series."""
    edges = day_edges(spark, sf)
    labels = clustering.both_directions(edges).select("group_id", "item").distinct().withColumn(
        "cluster", F.floor(((F.col("item") - 1) % 7) / 5).cast("int"))
    out = clustering.silhouettes(edges, labels)
    return out.select("group_id", "item", "cluster", r6("sil_width").alias("sil_width"))


@query("c4_silhouette_of_medoids")
def c4_medoids(spark, sf):
    edges = day_edges(spark, sf)
    out = clustering.silhouettes(edges, clustering.k_medoids(edges, 2))
    return out.withColumn("sil_width", r6("sil_width"))


@query("c5_bootstrap_resample", sql(B.HOURLY_SQL, """SELECT h.series_id, p.pct, CAST(floor(sum(len) * p.pct / 100) AS BIGINT) AS drawn,
  true AS consistent FROM hourly h CROSS JOIN (SELECT unnest([25, 50, 100]) AS pct) p GROUP BY h.series_id, p.pct"""))
def c5(spark, sf):
    """Every resample has the asked size, and no hour counts more hits than posts."""
    drawn = bootstrap.draw(B.alc_summary(spark, sf), [25, 50, 100], samples=1, seed=11)
    return drawn.groupBy("series_id", "pct").agg(
        F.sum("len").alias("drawn"), F.bool_and((F.col("sum") <= F.col("len")) & (F.col("sum") >= 0)).alias("consistent"))


@query("c6_stability_sweep")
def c6(spark, sf):
    """The reference sweep: 90 fractions (0.11 to 1.00), 100 paired resamples each."""
    out = bootstrap.stability(
        B.alc_summary(spark, sf).where(F.col("series_id").isin(B.MONTH_A, B.MONTH_B)),
        {"phase": distance.packed_phase(1), "euclidean": distance.packed_euclidean},
        {B.MONTH_A: (1, series.SLICES["june"]), B.MONTH_B: (2, series.SLICES["sept"])},
        percents=list(range(11, 101)), samples=100, threshold=0.0, seed=5)
    return out.select("dend", "pct", "n", *[r6(c).alias(c) for c in ("mean", "var", "ci_low", "ci_high", "q_low", "q_high")])


_PHASE_EDGES = f"""ph AS (SELECT a.series_id AS g, a.seg AS i, b.seg AS j,
    abs(atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im)) / {_PI2} AS d FROM ft a JOIN ft b ON a.series_id = b.series_id AND a.seg < b.seg)"""


def _levels_sql(name: str) -> str:
    return f"""SELECT a.g, a.item AS i, b.item AS j, min(a.step) AS step, min(a.h) AS h FROM {name} a JOIN {name} b
    ON a.g = b.g AND a.step = b.step AND a.cl = b.cl AND a.item < b.item GROUP BY ALL"""


@query("c7_tree_correlation", sql(_DAY_TREE + f""", ft AS (SELECT series_id, seg, sum(x * cos({_PI2} * pos / 24)) AS re,
    -sum(x * sin({_PI2} * pos / 24)) AS im FROM days GROUP BY ALL), """ + _PHASE_EDGES + _tree_sql(_BOTH.format("ph"), "sp") + f""",
  la AS ({_levels_sql("st")}), lb AS ({_levels_sql("sp")}),
  rk AS (SELECT la.g, la.h AS ha, lb.h AS hb, rank() OVER (PARTITION BY la.g ORDER BY la.step) + (count(*) OVER (PARTITION BY la.g, la.step) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY la.g ORDER BY lb.step) + (count(*) OVER (PARTITION BY la.g, lb.step) - 1) / 2 AS rb
    FROM la JOIN lb ON la.g = lb.g AND la.i = lb.i AND la.j = lb.j)""",
  f"SELECT g AS group_id, {sql6('corr(ra, rb)')} AS baker, {sql6('corr(ha, hb)')} AS cophenetic FROM rk GROUP BY g"))
def c7(spark, sf):
    """Trees of the same days by shape and by phase."""
    arrays = day_arrays(spark, sf)
    trees = [clustering.average_linkage(distance.distances(arrays, m)) for m in (distance.euclidean, distance.phase_distance(1))]
    out = clustering.tree_correlation(*trees)
    return out.select("group_id", r6("baker").alias("baker"), r6("cophenetic").alias("cophenetic"))


@query("c8_chained_clustering")
def c8(spark, sf):
    """Normalised weeks of two topics, an odd week of the second left out, clustered together."""
    from murmurline.plans import jobs
    share = B.alc_share(spark, sf).select("series_id", "t", "x")
    both = share.where(F.col("series_id").isin(B.MONTH_A, B.MONTH_B))
    out = jobs.cluster_segments(both, 168, {B.MONTH_A: 1, B.MONTH_B: 2}, per_series=4, leave_out=[7], normalise=True)
    return out.withColumn("height", r6("height"))
