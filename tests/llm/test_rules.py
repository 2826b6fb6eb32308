import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_samples import ODD, words
from pyspark.sql import functions as F

from murmurline.llm import langid as L
from murmurline.llm import license_scan as S
from murmurline.llm import mixing as M
from murmurline.llm import quality_rules as Q
from murmurline.llm import topk as K

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPLIT = re.compile("[^\x20\x09-\x0D]+")


def in_duckdb(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return con.execute(sql).fetchall()


# ---- license scan -------------------------------------------------------------------------------------------------

def brute_base(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found, hits = WORD.findall(text), []
    for phrase, label in S.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(found)) if found[i:i + len(p)] == p]
    at = sorted(i for i, _ in hits)
    return len(found), len(hits), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in hits}))


def test_base_phrases(docs):
    rng = random.Random(1)
    bits = ["under", "the", "MIT", "license", "Apache", "version", "2", "2.0", "cc", "BY", "nc", "é", "x", ",", "\n", "-", "under the mit license",
            "apache license, version 2", "cc-by-nc", "licensed under", "GPL-3.0"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "  ", "-", "", "_"]) for _ in range(rng.randrange(30))) for _ in range(300)] + ODD
    got = {r["doc_id"]: r for r in S.scan(docs(texts, extra=["score"])).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text), text
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_rules_and_suppression():
    assert len(S.rules()) > 300 and len({r.name for r in S.rules()}) == len(S.rules())
    assert all(r.keyword in S.rules()[i].name or r.base for i, r in enumerate(S.rules()) if "/special/" in r.name)
    labels = lambda t: {d.rule.label for d in S.suppress(S.detect(t.lower()))}
    assert labels("SPDX-License-Identifier: GPL-3.0") == {"gpl-3.0"}
    assert labels("Licensed under the Creative Commons Attribution NonCommercial 4.0 license") >= {"cc-by-nc"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == {"mit"}
    assert labels("we admit the license to kill") == set()
    one = S.detect("released under the mit license")
    assert len(one) > 1 and [d.rule.label for d in S.suppress(one)].count("mit") <= 2


def test_suppression_equals_its_definition():
    rng = random.Random(2)
    for _ in range(200):
        found = [S.Detection(a, a + rng.randrange(1, 9), rng.choice(S.rules())) for a in (rng.randrange(30) for _ in range(12))]
        taken, want = [], []
        for i, d in sorted(enumerate(found), key=lambda x: (-x[1].rule.priority, x[1].start - x[1].end, x[1].start, x[0])):
            inside = any(a <= d.start and d.end <= b for a, b in taken)
            if d.rule.base or not inside:
                want.append(d)
            taken.append((d.start, d.end)) if not inside else None
        assert sorted(map(id, S.suppress(found))) == sorted(map(id, want))


# ---- quality rules ------------------------------------------------------------------------------------------------

def test_counts_equal_brute_force(docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c#", "*", "\n", "x|y", "dd\n", "<>", "…", "é"], k=rng.randrange(60))) for _ in range(150)] + ODD
    got = {r["doc_id"]: r for r in Q.quality_rules(docs(texts, extra=["n_words", "kept"])).collect()}
    for i, text in enumerate(texts):
        w = SPLIT.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)), text
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r["base_failed"] or not r["kept"])


def test_keep_good_is_the_verdict(docs):
    prose = "the cat and the dog went to a house in the wood where it was " + " ".join(f"w{chr(97 + i)}" for i in range(20))
    df = docs([prose, "x", None, "# " * 50, prose + " end"], extra=["kept"])
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in Q.quality_rules(df).where("kept").collect()} == {0, 4}


def test_filters_on_every_column_end(docs):
    """A filter after the operator is not written out with all measures."""
    texts = ["the cat and the dog went to a house in the wood where it was " + " ".join(f"w{chr(97 + k)}" for k in range(i)) for i in range(30)]
    rows = Q.quality_rules(docs(texts))
    whole = rows.collect()
    for c in rows.columns:
        value = whole[7][c]
        assert sorted(map(str, rows.where(F.col(c) == F.lit(value)).collect())) == sorted(str(r) for r in whole if r[c] == value)
    assert rows.where("kept").select("n_words").count() == sum(r["kept"] for r in whole)


def test_numbers_are_words_with_digits(docs):
    key = "the key of this machine is 0a1b2c3d4e5f60718293a4b5 and that is it"
    got = Q.quality_rules(docs([key, "1 2 3 4 5 6 7 8 9 10 11 of the", "a1b2 c3 d4 e5 f6 g7 h8 i9 j1 k2 the"])).collect()
    assert {r["doc_id"]: r["failed_rules"] for r in got} == {0: "", 1: "word_length,few_numbers", 2: "few_numbers"}


def test_stop_words_are_a_parameter(docs):
    polish = "to jest dom w którym mieszka kot a pies śpi na dachu gdy pada deszcz lub śnieg i nikt go nie widzi ani nie słyszy bo jest cicho tam gdzie stoi"
    texts = [polish.replace("to ", "tu "), "x" + " zz" * 3]
    one, two, three = (Q.quality_rules(docs(texts), **kw).orderBy("doc_id").first()["failed_rules"] for kw in ({}, {"stop_words": ()}, {"stop_words": ("jest", "nie")}))
    assert (one, two, three) == ("some_stop_words", "", "")


def test_quality_of_nothing(docs):
    assert Q.quality_rules(docs([])).count() == 0


# ---- top k --------------------------------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_k_equals_brute_force(spark, scale):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(size=6) * scale).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)] + rows[:5] + [(999, None), (1000, [1.0, None]), (1001, [float("nan")] * 6), (1050, [2.0]), (1100, [3.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in K.top_k(
        vectors(spark, rows), F.col("vec_id") % 50 == 0, block=64, query_block=3, fan_in=2).collect())
    good = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, k + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, i) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    assert K.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


# ---- mixing -------------------------------------------------------------------------------------------------------

def test_mix_equals_sql_and_meets_targets(docs):
    rng = random.Random(5)
    texts = [words(rng.randrange(1, 400)) for _ in range(80)] + [None, "", " "]
    sources = [rng.choice(["a", "b", "c", "d", "é", None, "Z"] + ["a"] * 6) for _ in texts]
    df = docs(texts, sources=sources, extra=["target"])
    got = M.schedule(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(in_duckdb(M.SQL, documents=df), key=str)
    by = {}
    for r, s in ((r, sources[r["doc_id"]]) for r in got):
        by.setdefault(s, [0, r["target"]])[0] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert (r["second_position"] is None) == (r["taken"] <= r["size"])
        assert r["taken"] == 0 or 0 <= r["position"] < (r["second_position"] or 2)
    assert all(abs(taken - target) < 1 for taken, target in by.values())
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(len(SPLIT.findall(t or "")) for t in texts)) < 1e-6


def test_mixed_documents_hold_the_taken_words(docs):
    df = docs([words(30), words(50, 100), words(20, 200), words(20, 200), None], ids=[1, 2, 3, 3, 4], sources=["a", "b", "c", "c", "c"])
    rows = M.take(df)
    assert rows.columns == df.columns
    taken = Counter()
    for r in rows.collect():
        taken[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in M.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    assert taken == +want


def test_every_pass_stands_at_its_own_position(docs):
    rng = random.Random(9)
    texts = [f"d{i} " + words(rng.randrange(1, 60)) for i in range(60)] + [None, "", "é x"]
    sources = [rng.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    df, slopes, want = docs(texts, sources=sources), {}, []
    for k, s in enumerate(sorted(set(sources), key=lambda s: (s is None, s or ""))):
        slopes[s] = M.SCHEDULES[k % 3].slope
    target = {sources[r["doc_id"]]: r["target"] for r in M.mix(df).collect()}
    found = [SPLIT.findall(t or "") for t in texts]
    for s, a in slopes.items():
        mine = sorted((i for i in range(len(texts)) if sources[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        left, read = int(target[s]), 0
        while left > 0:
            for i in mine:
                n = min(len(found[i]), left)
                share = min((read + len(found[i]) / 2) / max(target[s], 1.0), 1.0)
                if n:
                    u = round(2 * share / ((1 - a) + ((1 - a) ** 2 + 4 * a * share) ** 0.5), 9)
                    want.append((u, i, texts[i] if n == len(found[i]) else " ".join(found[i][:n])))
                left, read = left - n, read + len(found[i])
    assert len(want) > len({i for _, i, _ in want}) > 30
    got = [(r["doc_id"], r["text"]) for r in M.take(df).collect()]
    assert got == [(i, t) for _, i, t in sorted(want)]
    at = {(r["doc_id"], r["words"], r["position"]) for r in M.passes(df).collect()}
    assert at == {(i, len(SPLIT.findall(t)), u) for u, i, t in want}
    assert {(r["doc_id"], u) for r in M.mix(df).collect() for u in r["positions"]} == {(i, u) for u, i, _ in want}


def test_take_with_clashing_names(docs):
    names = ["_words", "_key", "words", "whole", "position", "row", "key", "size", "_doc", "x.y"]
    df = docs([words(30), words(50, 100), None], sources=["a", "b", "b"], ids=[1, None, 2], extra=names)
    rows = M.take(df)
    assert rows.schema == df.schema and all(r[n] == "clash" for r in rows.collect() for n in names)
    assert {r["doc_id"] for r in rows.collect()} == {1, None}
    assert M.take(docs([])).count() == 0


def test_mix_of_nothing(docs):
    assert M.mix(docs([])).count() == 0
    assert [r["taken"] for r in M.mix(docs([None, ""])).collect()] == [0, 0]


# ---- language -----------------------------------------------------------------------------------------------------

def test_held_out_accuracy(docs):
    rng = random.Random(6)
    stems = {"en": "the and ing tion of", "fr": "le la eau ment é", "de": "der und ung sch ü", "es": "el los ción ar ñ"}
    texts, langs = [], []
    for i in range(400):
        lang = rng.choice(list(stems))
        texts.append(" ".join("".join(rng.choices(stems[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))))
        langs.append(lang)
    texts, langs = texts + [None, "", "12 34!", "the"], langs + ["en", None, "fr", None]
    got = {r["doc_id"]: r for r in L.identify(docs(texts, langs=langs, extra=["score"])).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert len(held) > 40 and sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.95
    assert [got[400 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_cases(docs):
    assert {r["lang_pred"] for r in L.identify(docs(["abc", "def"], langs=[None, None])).collect()} == {"und"}
    assert {r["lang_pred"] for r in L.identify(docs(["abc"] * 20, langs=["xx"] * 20)).collect()} == {"xx"}
    assert L.identify(docs([])).count() == 0


@pytest.mark.parametrize("k", [2, 4, 5, 6, 30])
def test_codewords_differ(k):
    code = L.codewords(k)
    assert len({tuple(r) for r in code}) == k and all(abs(c.sum()) < k for c in code.T)


def plain_columns(raw):
    """Columns of the n-grams of a text, gram by gram."""
    out = []
    for at in range(0, len(raw), 1 << 20):
        b = b" " + raw[at:at + (1 << 20)] + b" "
        out += [x * 256 + y for x, y in zip(b, b[1:])]
        out += [((x << 16 | y << 8 | z) * 0x9E3779B1 % 2 ** 32 >> 16) + 65536 for x, y, z in zip(b, b[1:], b[2:])]
        out += [(((x << 24 | y << 16 | z << 8 | w) * 0x85EBCA6B % 2 ** 32) >> 16) + 131072 for x, y, z, w in zip(b, b[1:], b[2:], b[3:])]
    return out


def test_languages_equal_plain_python(docs):
    """Counts, odds, weights of bits and the nearest codeword, from dictionaries, for every text."""
    import math
    import zlib
    rng = random.Random(16)
    stems = {"en": "the and ing tion of", "fr": "le la eau ment é", "de": "der und ung sch ü"}
    texts, langs = [], []
    for _ in range(90):
        lang = rng.choice(list(stems))
        mixed = stems[lang] + " " + stems[rng.choice(list(stems))]
        texts.append(" ".join("".join(rng.choices(mixed.split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 9))))
        langs.append(lang)
    texts, langs = texts + ["the und le " * 110_000, texts[0], texts[0]], langs + ["en", langs[0], None]
    got = {r["doc_id"]: r for r in L.identify(docs(texts, langs=langs)).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 and langs[i]]
    assert {i for i in got if got[i]["held_out"]} == {i for i in range(len(texts)) if not zlib.crc32(str(i).encode()) % 5}
    columns = [Counter(plain_columns(t.lower().encode())) for t in texts]
    names, size = sorted(set(langs[i] for i in train)), 3 * 65536
    counts = {n: Counter() for n in names}
    for i in train:
        counts[langs[i]].update(columns[i])
    total = {n: sum(c.values()) for n, c in counts.items()}
    share = lambda n, c: (counts[n][c] + 0.5) / (total[n] + 0.5 * size)
    code = L.codewords(3).tolist()
    bits = range(len(code[0]))

    def margins(i):
        out = []
        for b in bits:
            plus, minus = ([n for n, row in zip(names, code) if row[b] == s] for s in (1, -1))
            out.append(sum(k * (math.log(sum(share(n, c) for n in plus) / len(plus)) - math.log(sum(share(n, c) for n in minus) / len(minus)))
                           for c, k in columns[i].items()) / sum(columns[i].values()))
        return out

    found = [margins(i) for i in range(len(texts))]
    weights = []
    for b in bits:
        wrong = (sum((found[i][b] > 0) != (code[names.index(langs[i])][b] > 0) for i in train) + 1) / (len(train) + 2)
        weights.append(min(6.0, max(0.05, math.log((1 - wrong) / wrong))))
    for i, m in enumerate(found):
        loss = [sum(w / sum(weights) * math.log1p(math.exp(-3.0 * s * x)) for w, s, x in zip(weights, row, m)) for row in code]
        shares = [math.exp(-3.0 * (v - min(loss))) for v in loss]
        best = sorted((-s / sum(shares), k) for k, s in enumerate(shares))
        assert got[i]["lang_pred"] == names[best[0][1]] and got[i]["score"] == pytest.approx(-best[0][0], abs=1e-4)
        assert got[i]["second_score"] == pytest.approx(-best[1][0], abs=1e-4) and got[i]["ambiguous"] == (got[i]["score"] - got[i]["second_score"] < 0.2)
