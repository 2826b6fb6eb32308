import math
import random

from pyspark.sql import functions as F

from murmurline.operators import ranking, series, spectral, summary


def hourly(spark, rows):
    return spark.createDataFrame(rows, "series_id string, day int, hour int, sum long, len long")


def test_grid_has_every_hour(spark):
    s = hourly(spark, [("a", 1, 5, 1, 2), ("a", 30, 23, 3, 4), ("b", 2, 0, 5, 6), ("b", 31, 1, 7, 8)])
    got = series.hour_grid(s, keep_outside=False).collect()
    assert len(got) == 1440 and len({(r["series_id"], r["t"]) for r in got}) == 1440
    values = {(r["series_id"], r["t"]): (r["x"], r["total"]) for r in got}
    assert values[("a", 6)] == (1, 2) and values[("a", 720)] == (3, 4) and values[("b", 25)] == (5, 6)
    assert sum(v[0] for v in values.values()) == 9
    outside = series.hour_grid(s).where("t > 720").collect()
    assert [(r["series_id"], r["t"], r["x"]) for r in outside] == [("b", 722, 7.0)]


def test_carry_forward(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 7.0)], "series_id string, t int, x double")
    got = [r["x"] for r in series.carry_forward(df, ("x",)).orderBy("t").collect()]
    assert got == [None, 5.0, 5.0, 7.0]
    kept = series.carry_forward(df.withColumn("total", F.col("x")), compat=True).orderBy("t").collect()
    assert [(r["t"], r["x"]) for r in kept] == [(1, 5.0), (2, 5.0), (3, 7.0)]


def test_partials_merge_to_one_pass(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 30), rnd.randint(0, 23), rnd.randint(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, d int, h int, f int").withColumn(
        "local_time", F.expr("make_timestamp_ntz(2024, 1, d, h, 0, 0)"))
    whole = summary.hourly_summary(df, {"f": F.col("f")})
    parts = summary.hourly_summary(df, {"f": F.col("f")}, by=("half",)) if "half" in df.columns else summary.hourly_summary(
        df.withColumn("half", F.col("id") % 2), {"f": F.col("f")}, by=("half",)).drop("half")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, summary.merge_summaries(parts).collect()))


def test_phase_shift_of_a_daily_sine(spark):
    a = [("s", t + 1, math.sin(2 * math.pi * t / 24)) for t in range(24)]
    b = [("s", t + 1, math.sin(2 * math.pi * (t - 3) / 24)) for t in range(24)]
    frames = [spark.createDataFrame(r, "series_id string, t int, x double") for r in (a, b)]
    got = spectral.phase_shift(*frames, [1]).first()["shift"]
    assert abs(got - 0.125) < 1e-9


def test_parseval(spark):
    rnd = random.Random(2)
    xs = [rnd.random() for _ in range(24)]
    df = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(xs)], "series_id string, t int, x double")
    power = spectral.periodogram(df, list(range(24))).agg(F.sum("power")).first()[0]
    assert abs(power / 24 - sum(x * x for x in xs)) < 1e-9


def test_positions_and_samples(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id")).withColumn("s", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    placed = ranking.global_position(df, "v").collect()
    assert [r["position"] for r in sorted(placed, key=lambda r: r["v"])] == list(range(1, 1001))
    sampled = ranking.sample_fraction(df, "s", "id", 0.1).collect()
    assert sum(r["s"] == "hot" for r in sampled) == 70 and sum(r["s"] == "cold" for r in sampled) == 30
    hot = sorted((r for r in df.withColumn("h", ranking.stable_hash(F.col("id"))).collect() if r["s"] == "hot"), key=lambda r: r["h"])
    assert {r["id"] for r in hot[:70]} == {r["id"] for r in sampled if r["s"] == "hot"}


def test_batch_leaves_the_pool(spark):
    pool = spark.range(50).select(F.col("id").alias("_id"), F.xxhash64("id").alias("random_number"))
    batch, rest = ranking.next_batch(pool, 10)
    a, b = {r["_id"] for r in batch.collect()}, {r["_id"] for r in rest.collect()}
    assert len(a) == 10 and len(b) == 40 and not a & b
