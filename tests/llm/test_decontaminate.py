"""Hits against a plain search of every window."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm_samples import ODD, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurline.llm import decontaminate as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, names = words_of(text), set(), set()
        for item, body in items:
            b = words_of(body)
            k = min(len(b), window)
            for p in range(len(b) - k + 1) if b else ():
                for i in range(len(w) - k + 1):
                    if w[i:i + k] == b[p:p + k]:
                        hit |= set(range(i, i + k))
                        if item is not None:
                            names.add(str(item))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def sample(seed):
    rng = random.Random(seed)
    bits = [[f"{s}{rng.randrange(6)}" for _ in range(rng.randrange(1, 25))] for s in "abcdefgh"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(w.upper() if rng.random() < 0.1 else w for _ in range(rng.randrange(n)) for w in rng.choice(bits))
    items = [(rng.randrange(200), text(4)) for _ in range(25)] + [(7, None), (None, "é " * 12), (12, "a1 b2"), (3, ""), (9, words(14)), (100, words(14))]
    return [text(9) for _ in range(60)] + ODD + ["é " * 15, words(12), "x a1 b2 y", items[0][1]], items


@pytest.mark.parametrize("seed,block", [(1, 200_000), (2, 200_000), (3, 60)])
def test_hits_equal_brute_force(spark, docs, seed, block, monkeypatch):
    monkeypatch.setattr(W.find, "__defaults__", (10, block))
    texts, items = sample(seed)
    df, bench = docs(texts, extra=["n_words", "spans", "tkey"]), spark.createDataFrame(items + items[:5], ITEM).withColumn("n", F.lit("x"))
    got = [tuple(r)[1:] for r in sorted(W.report(df, bench).collect(), key=lambda r: r["doc_id"])]
    assert got == brute(texts, items)


def test_short_windows(spark, docs):
    texts, items = sample(4)
    got = {r["doc_id"]: sum(s["length"] for s in r["spans"]) for r in W.find(docs(texts), spark.createDataFrame(items, ITEM), window=3).collect()}
    assert [got[i] for i in range(len(texts))] == [r[1] for r in brute(texts, items, 3)]


def test_repeated_and_missing_ids(spark, docs):
    bench = spark.createDataFrame([(1, words(40)), (2, words(40, 20))], ITEM)
    df = docs([words(30), words(30), words(30), None, "clean"], ids=[5, 5, None, None, 5])
    for block in (200_000, 25):
        got = sorted(((r["doc_id"], r["n_words"], len(r["items"])) for r in W.find(df, bench, block_words=block).collect()), key=str)
        assert got == sorted([(5, 30, 2), (5, 30, 2), (None, 30, 2), (None, 0, 0), (5, 1, 0)], key=str)


def test_spans_are_maximal(spark, docs):
    bench = spark.createDataFrame([(1, words(12)), (2, words(10, 50))], ITEM)
    df = docs([f"a {words(12)} b {words(10, 50)} {words(10, 50)}"])
    for block in (200_000, 12):
        assert [tuple(s) for s in W.find(df, bench, block_words=block).first()["spans"]] == [(1, 12), (14, 20)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEM)
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in W.report(docs(["a b", None]), none).collect()] == [(0, 0, False)] * 2
    assert W.report(docs([]), spark.createDataFrame([(1, "a")], ITEM)).count() == 0


def test_shifts_skip_positions():
    """A text without words of the items is crossed in leaps of a window but one word."""
    group = W.Group(np.arange(1, 31, dtype=np.int32).reshape(3, 10))
    looked = []
    plain = W._hash2
    try:
        W._hash2 = lambda x, y: (looked.append(len(x)), plain(x, y))[1]
        at, _ = group.search(np.zeros(2560, np.int32), np.array([0, 2560]))
    finally:
        W._hash2 = plain
    assert not len(at) and sum(looked) < 2560 / 8
