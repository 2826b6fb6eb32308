"""The pipeline, stage by stage, against brute force on each stage's own input."""

import random
import re

import corpus_pipeline
from llm_samples import ODD
from test_dedup import brute_components
from test_tokens import library_ids

from murmurline.llm import mixing, quality_rules
from murmurline.session import scratch_path

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(n))


def cut(ids, texts, length=50):
    """Texts without words of windows that also start under a smaller id."""
    words, first = [SPLIT.findall(t or "") for t in texts], {}
    for i, w in zip(ids, words):
        for p in range(len(w) - length + 1):
            first[tuple(w[p:p + length])] = min(first.get(tuple(w[p:p + length]), i), i)
    out = {}
    for i, w, t in zip(ids, words, texts):
        gone = {k for p in range(len(w) - length + 1) if first[tuple(w[p:p + length])] < i for k in range(p, p + length)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def test_every_stage(spark, docs):
    rng = random.Random(8)
    shared, base = prose(rng, 70), prose(rng, 120)
    texts = [prose(rng, rng.randrange(5, 150)) for _ in range(25)] + [base, base, base + " tail", "# " * 30]
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(3)] + ODD
    folder = scratch_path(spark, "tables")
    docs(texts).write.parquet(f"{folder}/documents.parquet")
    frame, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch_path(spark, name)
        stage(spark, frame, folder).write.parquet(out)
        seen.append((name, frame, spark.read.parquet(out)))
        frame = seen[-1][2]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    (_, start, good), (_, _, single), (_, _, unique), (_, _, mixed), (_, _, tokens) = seen
    assert all(df.columns == start.columns for _, _, df in seen[:-1])
    assert set(rows(good)) == {r["doc_id"] for r in quality_rules.quality_rules(start).collect() if r["kept"]}
    before = rows(good)
    assert set(rows(single)) == {c for _, c in brute_components(list(before), list(before.values())).values()}
    before = rows(single)
    assert rows(unique) == cut(list(before), list(before.values())) and rows(unique) != before
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(unique).collect()}
    got = {}
    for r in mixed.collect():
        assert rows(unique)[r["doc_id"]] == r["text"] or rows(unique)[r["doc_id"]].split()[:len(r["text"].split())] == r["text"].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(SPLIT.findall(r["text"]))
    assert got == {i: n for i, n in taken.items() if n}
    text_of = sorted((r["doc_id"], library_ids(r["text"])) for r in mixed.collect())
    assert sorted((r["doc_id"], list(r["ids"])) for r in tokens.collect()) == text_of
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens.collect())


def test_mix_deals_texts_once(spark, docs):
    """Rows of one text become one and meet their passes in the same places; no second shuffle by key."""
    df = docs([prose(random.Random(i), 20) for i in range(20)] * 2, ids=[None, *range(19)] * 2)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.take(df)._jdf.queryExecution().executedPlan().toString()
        rows = mixing.take(df).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sum("Exchange hashpartitioning" in line and "key#" in line for line in plan.splitlines()) == 2  # texts, passes
    wanted = {r["doc_id"]: 0 for r in rows}
    for r in mixing.mix(df).collect():
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + r["taken"]
    for r in rows:
        wanted[r["doc_id"]] -= len(SPLIT.findall(r["text"]))
    assert not any(wanted.values())


def written(spark, df):
    folder = scratch_path(spark, "tables")
    df.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_run_whole_with_odd_rows(spark, docs):
    """Missing and repeated ids, missing texts and sources, and columns with names that the stages use."""
    rng = random.Random(12)
    base = prose(rng, 90)
    texts = [base, base, base + " tail", prose(rng, 60), prose(rng, 60), None, "", prose(rng, 70) + " " + base, prose(rng, 40)]
    ids = [1, None, 2, 3, 3, 4, None, 5, None]
    names = ["starts", "every", "row", "key", "_key", "_words", "words", "kept", "n_words", "component_id", "size", "position"]
    folder = written(spark, docs(texts, ids, sources=["a", None, "a", "b", "b", "b", None, "a", None], extra=names))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {1, None, 3, 5} and all(r["n_tokens"] == len(r["ids"]) > 0 for r in rows)
    lengths = {r["doc_id"]: r["n_chars"] for r in rows if r["doc_id"] == 1}
    assert lengths == {1: len(base)}


def test_run_on_nothing(spark, docs):
    assert corpus_pipeline.run(spark, written(spark, docs([]))).count() == 0
