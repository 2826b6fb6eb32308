"""Runs against all lags of a text compared word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_samples import ODD, words

from murmurline.llm import periodic_runs as P

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def brute(w, least=6, powers=4):
    n, out = len(w), {}
    for p in range(1, n // powers + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > a and i - a + p >= max(least, powers * p):
                out.setdefault((a, i - a + p), p)
            i += 1
    return sorted((a, length, p) for (a, length), p in out.items())


def rewritten(w, doc_id):
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(w)
    if r or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    w = rewritten(SPLIT.findall(text or ""), doc_id)
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rng):
    w = []
    for _ in range(rng.randrange(0, 7)):
        unit = [f"x{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(1, 14))]
        w += (unit * rng.randrange(1, 9))[:rng.randrange(1, 60)]
    return w


@pytest.mark.parametrize("least,powers", [(6, 4), (6, 3), (2, 3), (12, 5)])
def test_runs_of_many_texts_at_once(least, powers):
    rng = random.Random(least)
    for _ in range(300):
        texts = [periodic(rng) for _ in range(rng.randrange(1, 6))]
        bounds = np.cumsum([0] + [len(w) for w in texts])
        want = [(int(b) + s, n, q) for b, w in zip(bounds, texts) for s, n, q in brute(w, least, powers)]
        assert P.find_runs(P.numbers([x.encode() for w in texts for x in w]), bounds, least, powers) == sorted(want)


def test_runs_within_runs():
    """A run of short periods inside the period of a longer one, and Fibonacci words without fourth powers."""
    inner = ["a"] * 7 + ["b", "c"]
    w = inner * 5
    got = P.find_runs(P.numbers([x.encode() for x in w]), np.array([0, len(w)]))
    assert got == brute(w) and len(got) == 6
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    assert P.find_runs(P.numbers([x.encode() for x in b]), np.array([0, len(b)])) == brute(b) == []


def test_digests_equal_brute_force(docs):
    rng = random.Random(3)
    texts = [" ".join(periodic(rng)) for _ in range(150)] + ODD + ["a " * 900, ("b " * 300 + "c ") * 6, "é ü\n" * 40]
    ids = rng.sample(range(100_000), len(texts))
    ids[4], ids[7] = ids[9], None
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 5
    got = sorted((tuple(r) for r in P.digests(docs(texts, ids, extra=["start", "runs", "n_words"])).collect()), key=str)
    assert got == sorted(map(row, ids, texts), key=str)


def test_small_steps_change_nothing(docs):
    rng = random.Random(5)
    df = docs([" ".join(periodic(rng)) for _ in range(40)] + [words(30) + " " + "z " * 50])
    whole, parts = (sorted(map(str, P.periodic_runs(df, step=s).collect())) for s in (1 << 20, 40))
    assert whole == parts


def test_collapsed_text(docs):
    r = P.periodic_runs(docs(["k " + "buy now " * 5 + "end"], ids=[1])).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 10, 2)] and r["collapsed"] == "k buy now end" and r["n_words"] == 12


def test_nothing(docs):
    assert P.digests(docs([])).count() == 0
