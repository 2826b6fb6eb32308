"""Codes and codebooks against plain Lloyd rounds over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from murmurline.llm import dual_tree_codes as D

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                    T.StructField("label", T.IntegerType())])


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def integer(x):
    return math.floor(x * 4096) if math.isfinite(x * 4096) else int(x) * 4096


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, sha) of vectors of one length."""
    kept = sorted((r for r in rows if takes_part(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    whole = [[integer(x) for x in r[1]] for r in kept]
    n = len(whole[0])
    cut = [j * n // parts for j in range(parts + 1)]
    codes, errors, books = [[0] * parts for _ in kept], [0] * len(kept), []
    for j in range(parts):
        points = [tuple(v[cut[j]:cut[j + 1]]) for v in whole]
        book = points[:entries]
        for r in range(rounds + 1):
            away = [[sum((a - b) ** 2 for a, b in zip(p, e)) for e in book] for p in points]
            near = [a.index(min(a)) for a in away]
            if r < rounds:
                for e in range(len(book)):
                    mine = [p for p, k in zip(points, near) if k == e]
                    if mine:
                        book[e] = tuple(sum(c) // len(mine) for c in zip(*mine))
        books += [str(x) for e in book for x in e]
        for i, k in enumerate(near):
            codes[i][j] = k
            errors[i] += away[i][k]
    of_label = {}
    for r, e in zip(kept, errors):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    top, sha = (1 << 63) - 1, hashlib.sha256(",".join(books).encode()).hexdigest()
    return [(r[0], bytes(c).hex(), min(e, top), min(of_label[r[2]], top), sha) for r, c, e in zip(kept, codes, errors)]


def made(spark, rows, n=3):
    return spark.createDataFrame(rows, ROW).repartition(n)


def same(spark, rows, expected=None, **kw):
    got = sorted((tuple(r) for r in D.compress(made(spark, rows), **kw).collect()), key=str)
    assert got == sorted(expected if expected is not None else brute(rows), key=str)


def vectors(seed, n, dim, spread=0.05, groups=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("seed,n,dim,spread", [(1, 300, 16, 0.02), (2, 90, 64, 1.0), (3, 200, 11, 0.3), (4, 7, 16, 0.1), (5, 40, 5, 0.5)])
def test_codes_equal_brute_force(spark, seed, n, dim, spread):
    rng = random.Random(seed)
    rows = [(i, v, rng.choice([None, 1, 2])) for i, v in zip(rng.sample(range(-500, 5000), n), vectors(seed, n, dim, spread))]
    odd = [(6000, None, 1), (6001, [None] + [0.0] * (dim - 1), 1), (6002, [float("nan")] * dim, 2), (6003, [float("inf")] * dim, None)]
    same(spark, rows + odd)


def test_ties_and_copies(spark):
    """Points on a grid: many equal distances, equal entries and entries that no part uses."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(3) / 4096 for _ in range(16)], i % 3) for i in range(150)]
    rows += [(1000 + i, rows[0][1], None) for i in range(60)]  # a third of the rows is one vector
    same(spark, rows)


def test_components_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e300, 1e6, -3.7, 0.25, 1.7e308]) * rng.random() for _ in range(8)], 1) for i in range(40)]
    same(spark, rows)


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, v, 1) for v in vectors(1, 5, 8)] + [(3, v, 2) for v in vectors(2, 30, 8)]
    same(spark, rows)
    same(spark, rows + rows, brute(rows + rows))


def test_lengths_have_their_own_books(spark):
    a, b = [(i, v, 1) for i, v in enumerate(vectors(1, 40, 8))], [(i + 100, v, 2) for i, v in enumerate(vectors(2, 30, 16))]
    same(spark, a + b, brute(a) + brute(b))


def test_nothing(spark):
    same(spark, [])
    same(spark, [(1, None, 2)], [])


def test_clashing_columns(spark):
    from pyspark.sql import functions as F
    rows = [(i, v, 1) for i, v in enumerate(vectors(1, 20, 8))]
    df = made(spark, rows)
    for name in ("code", "error", "v", "dim", "_label", "label_error", "codebooks_sha256"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, D.compress(df).collect())) == sorted(brute(rows))
    assert all(r["label_error"] == sum(x[2] for x in brute(rows)) for r in D.compress(df.drop("label")).collect())


def test_sums_merge_in_a_tree(spark, monkeypatch):
    rows = [(i, v, 1) for i, v in enumerate(vectors(1, 60, 8))]
    blocks, books = D.train(made(spark, rows, 7), rounds=0, block=4)
    assert D.lloyd(blocks, books, fan_in=2) == D.lloyd(blocks, books)


def test_bounds_save_comparisons():
    """Well-separated groups: whole nodes are assigned, and results equal those of all comparisons."""
    points = D.in_parts(D.integers(vectors(3, 512, 16, 0.001, 16), 16))
    place = D.tree_order(points, D.LEAF)
    ordered = np.take_along_axis(points, place[:, :, None], 1)
    book = points[:, :16]
    codes, sums, counts, computed = D.assign(ordered, D.node_levels(ordered, D.LEAF), book)
    away = ((ordered[:, :, None] - book[:, None]) ** 2).sum(3)
    assert (away.argmin(2) == codes).all() and counts.sum() == 8 * 512
    assert all((sums[p, e] == ordered[p][codes[p] == e].sum(0)).all() for p in range(8) for e in range(16))
    assert computed < away.size / 4
