import hashlib
import random
import re

import pytest
from llm_samples import ODD, words

from murmurline.llm import jaccard_join as J
from murmurline.llm import substring_dedup as S

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def sets_of(texts):
    out = []
    for t in texts:
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(ids, texts):
    sets, up = sets_of(texts), {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(ids[a]), find(ids[b])))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def near_copies(seed):
    """Groups of near copies of many sizes, short texts, a passage shared by all, chains of edits."""
    rng = random.Random(seed)
    passage, texts = words(60, stem="shared"), []
    for group in range(12):
        base = [f"g{group}x{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 7, 9, 12, 16, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(base) + (" " + passage if rng.random() < 0.3 else ""))
            for _ in range(rng.randrange(1, 3)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(1000)}"
    return texts + [passage, passage.upper(), passage + " tail"] + [words(rng.randrange(1, 14), rng.randrange(3), "t") for _ in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_every_link(docs, seed):
    texts = near_copies(seed) + ODD
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts, ids, extra=["component_id"])).collect()}
    assert got == brute_components(ids, texts)


def test_light_lists_and_boundary(docs, monkeypatch):
    """All light: short sets link by subsets alone."""
    monkeypatch.setattr(J, "choose_boundary", lambda sizes, percent: 12)
    texts = [words(n + 4, s, "t") for n in range(1, 12) for s in range(3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts)


def test_common_shingles_only_order_the_lists(docs, monkeypatch):
    monkeypatch.setattr(J, "LONG_LIST", 1)
    base = [f"b{i}" for i in range(120)]
    rng = random.Random(11)
    texts = near_copies(5) + [" ".join(f"e{rng.random()}" if rng.random() < share else w for w in base) for share in [0.0] + [0.01, 0.03, 0.05] * 12]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts)


@pytest.mark.parametrize("seed,deletes", [(1, False), (2, True)])
def test_copies_just_too_far_apart_do_not_all_meet(docs, monkeypatch, seed, deletes):
    """Most copies of one text have one edit too many to link: pairs to compare grow with the copies, not with their square."""
    rng, compared = random.Random(seed), []
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(150):
        at = set(rng.sample(range(120), rng.choice([1, 4, 5, 6])))
        texts.append(" ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base) if not (deletes and k in at and k % 2)))
    texts += [" ".join(base[:60]) + f" {words(rng.randrange(5, 60), 1000 * i, 'own')}" for i in range(30)] + near_copies(seed)
    plain = J._verified
    monkeypatch.setattr(J, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), plain(pairs, *rest))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts)
    assert sum(compared) < 5 * len(texts)


@pytest.mark.parametrize("group", [1, 500])
def test_hubs_of_other_shapes(docs, monkeypatch, group):
    """Chains of edits, sets inside each other, passages that several groups share, all in common lists."""
    monkeypatch.setattr(J, "LONG_LIST", 1)
    monkeypatch.setattr(J, "GROUP", group)
    rng = random.Random(group)
    a, b = ([f"{stem}{i}" for i in range(90)] for stem in "ab")
    texts = [" ".join(base[i:i + n]) for base in (a, b) for i in range(0, 60, 7) for n in (12, 20, 27, 30)]
    texts += [" ".join(a[:i] + b[:90 - i]) for i in range(0, 90, 6)]
    for base in (a, b):
        for _ in range(25):
            base = base[:]
            base[rng.randrange(90)] = f"c{rng.randrange(6)}"
            texts.append(" ".join(base))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts)


def test_boundary_follows_the_cost():
    assert J.choose_boundary({}) == 0
    assert J.choose_boundary({1: 1000}) >= 1
    assert J.choose_boundary({12: 1000}) < 12


def test_names_of_classes_that_clash(docs, monkeypatch):
    """Two sets with one 64-bit name are told apart and named anew."""
    plain = J._digest
    monkeypatch.setattr(J, "_digest", lambda h, seed=0: (len(h), plain(h)[1]) if seed == 0 else plain(h, seed))
    texts = [words(30), words(30, 100), words(30), words(31), "x"]
    got = {r["doc_id"]: r["component_id"] for r in J.join(docs(texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4}


def test_small_slices_and_few_remembered_classes(docs, monkeypatch):
    monkeypatch.setattr(J, "SLICE", 3)
    monkeypatch.setattr(J._Once.__init__, "__defaults__", (2,))
    texts = near_copies(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(docs(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts)


def test_join_with_missing_and_repeated_ids(docs):
    one = words(30)
    rows = J.join(docs([one, one + " tail", words(40, 100), one, None, words(41, 99)], ids=[4, None, 9, 4, None, 9])).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == sorted(
        [(4, 26, 4), (4, 26, 4), (None, 27, None), (9, 36, 9), (9, 37, 9), (None, 0, None)], key=str)


def test_keep_one_keeps_columns(docs):
    df = docs([words(50), words(50), words(50) + " z", None, "y"])
    kept = J.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]


def test_keep_one_keeps_rows_without_id(docs):
    one, two = words(30), words(40, 100)
    df = docs([one, one, two, None, one + " tail", two], ids=[None, 5, None, None, 7, 6])
    assert sorted(((r["doc_id"], r["text"]) for r in J.keep_one(df).collect()), key=str) == sorted(
        [(None, one), (None, two), (None, None), (5, one), (6, two)], key=str)


def test_join_of_nothing(docs):
    assert J.join(docs([])).count() == 0
    assert J.join(docs([None])).first()["component_id"] == 0


def brute_dedup(ids, texts, length):
    words_of = [SPLIT.findall(t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words_of):
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words_of):
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < i:
                gone |= set(range(p, p + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram,seed", [(50, 25, 1), (8, 4, 2), (5, 1, 3), (6, 6, 4)])
def test_dedup_equals_brute_force(docs, length, gram, seed):
    rng = random.Random(seed)
    bits = [[f"{stem}{rng.randrange(30)}" for _ in range(rng.randrange(3, 3 * length))] for stem in "abcdefgh"]
    texts = [" ".join(w for _ in range(rng.randrange(1, 6)) for w in rng.choice(bits)) for _ in range(60)] + ODD
    ids = rng.sample(range(1000), len(texts))
    ids[3] = ids[5]  # two rows of one doc_id
    got = sorted(tuple(r) for r in S.substring_dedup(docs(texts, ids, extra=["n_words"]), length, gram).collect())
    assert got == brute_dedup(ids, texts, length)


def test_drop_repeats_changes_texts(docs):
    df = docs([words(60), "a b " + words(60) + " c\nd", "e\nf", None])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.drop_repeats(df).collect()}
    assert S.drop_repeats(df).columns == df.columns
    assert got == {0: (words(60), len(words(60))), 1: ("a b c d", 7), 2: ("e\nf", 3), 3: (None, None)}


def test_drop_repeats_with_clashing_names(docs):
    names = ["starts", "every", "row", "id", "key", "_id", "_key", "tkey", "a.b"]
    df = docs([words(60), "a " + words(60), None, words(60), words(70)], ids=[3, 1, 2, None, None], extra=names)
    rows = S.drop_repeats(df)
    assert rows.schema == df.schema and all(r[n] == "clash" for r in rows.collect() for n in names)
    assert sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=str) == sorted(
        [(1, "a " + words(60)), (2, None), (3, ""), (None, words(60)), (None, words(70))], key=str)


def test_hot_windows_are_looked_up(docs, monkeypatch):
    rng = random.Random(6)
    shared = words(55, stem="hot")
    texts = [f"{words(rng.randrange(30), 100 * i)} {shared} {words(9, 100 * i + 50)}" for i in range(40)] + [words(60), words(60)] + ODD
    ids = rng.sample(range(1000), len(texts))
    for hot in (1, 25, 1000):  # none, the shared passage, all
        monkeypatch.setattr(S, "HOT", hot)
        assert sorted(tuple(r) for r in S.substring_dedup(docs(texts, ids)).collect()) == brute_dedup(ids, texts, 50)


def test_dedup_of_nothing(docs):
    assert S.substring_dedup(docs([])).count() == 0
    assert S.drop_repeats(docs([])).count() == 0


def test_word_hashes_tell_words_apart_whatever_the_pieces():
    from murmurline.llm.common import word_hashes

    long = b"x" * 300
    raws = [b"Ab ab\tAB\x0bba", None, b"", b" \n ", b"a" + long + b" " + long + b"A " + long.upper(), "\u00c9 \u00e9 a\u00a0b".encode(), b"ab", b"q" * 5000]
    words = [w for r in raws for w in (r or b"").lower().split()]
    whole, ends = word_hashes(raws)
    assert ends.tolist() == [sum(len((r or b"").split()) for r in raws[:i]) for i in range(len(raws) + 1)]
    assert len(set(whole.tolist())) == len(set(words)) == len(set(zip(words, whole.tolist())))
    for piece in (1, 2, 7, 64, 257, 1000):
        again, at = word_hashes(raws, piece)
        assert again.tolist() == whole.tolist() and at.tolist() == ends.tolist()
    assert word_hashes([])[0].tolist() == [] and word_hashes([])[1].tolist() == [0]
