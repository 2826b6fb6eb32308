import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_samples import ODD, words

from murmurline.llm import bpe as B
from murmurline.llm import rans as R
from murmurline.llm import token_counts as C
from murmurline.llm.tokenizer import byte_bpe

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABETS = [list("abc"), list("the ing on's"), list(" \n\t a"), [chr(i) for i in range(32, 1000)] + [" "] * 200, list("aaa!!!===---''"),
             list("éèüöñ çÉÜ1²½"), ["<|endoftext|>", "<|startoftext|>", " ", "x", "　", "\x1c", "\x85", "́", "e", "Σ", "İ"],
             list("'r've'll'd!s "), ["字", "語", " ", "が", "😀"]]


def random_texts(n, seed, most=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(most))) for _ in range(n)]


def library_ids(text):
    return byte_bpe(BYTE).library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    bpe = byte_bpe(BYTE)
    for text in random_texts(1500, 1):
        ids = np.array(library_ids(text), "<u4").tobytes()
        assert bpe.encode(text) == ids
        for leaf in (7, 40):
            assert B.encode_text(bpe, text, leaf) == ids
        assert bpe.decode(ids).decode() == bpe.library.decode(library_ids(text), skip_special_tokens=False)


def test_round_trip_rows(docs):
    texts = random_texts(60, 2) + ODD + ["ab" * 3000, "x " * 40 + "y" * 5000 + " z<|endoftext|>" + "=" * 4000 + " end"] * 2
    got = sorted(tuple(r) for r in B.round_trip(docs(texts, [i // 2 for i in range(len(texts))], extra=["ids"]), BYTE, leaf=64, part=512).collect())
    want = []
    for i, text in enumerate(texts):
        ids = library_ids(text)
        back = byte_bpe(BYTE).library.decode(ids, skip_special_tokens=False)
        want.append((i // 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert B.round_trip(docs([]), BYTE).count() == 0


def test_token_files_with_odd_ids(docs):
    """No doc_id, the least one, repeated ones, and columns with names of the files."""
    texts, ids = ["one", "two words", None, "three", "three", "y " * 40_000], [None, -(1 << 63), None, 7, 7, (1 << 63) - 1]
    df = docs(texts, ids, extra=["start", "n_tokens", "ids", "file", "row", "tkey"])
    got = R.round_trip(df, BYTE, 2).collect()
    key = lambda r: (r[0], r[1], r[2])
    want = [(i, len(library_ids(t)) + 1, zlib.crc32(np.array(library_ids(t) + [2], "<u4").tobytes())) for t, i in zip(texts, ids)]
    assert sorted((key((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got), key=str) == sorted(want, key=str)
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, -(1 << 63), 7, 7, (1 << 63) - 1]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


def test_with_ids_keeps_columns(docs):
    df = docs(["hello world", None], extra=["ids"])
    out = B.with_ids(df, BYTE)
    assert out.columns == df.columns
    assert [r["ids"] for r in out.orderBy("doc_id").collect()] == [library_ids("hello world"), []]


def test_transducer_equals_library():
    t = C.Transducer(WORD)
    for text in random_texts(1500, 3):
        want = len(t.library.encode(text, add_special_tokens=False).ids)
        for size in (5, 64, 10 ** 6):
            assert t.total([t.chunk(c) for c in C.chunks(text, size)]) == want, text


def test_token_count_rows(docs):
    t = C.transducer(WORD)
    texts = random_texts(40, 4, 3000) + ODD + ["long" * 900] * 2
    got = sorted(tuple(r) for r in C.count_tokens(docs(texts, [i // 2 for i in range(len(texts))]), WORD, size=50, part=400).collect())
    counts = [len(t.library.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert got == sorted((i // 2, len((x or "").encode()), n, n > 2048) for i, (x, n) in enumerate(zip(texts, counts)))
    assert C.count_tokens(docs([]), WORD).count() == 0


@pytest.mark.parametrize("n", [1, 5, 31, 32, 33, 1000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum((rng.pareto(0.8, n) * 10).astype(np.int64), 50_256)
    coder = R.Coder(R.scaled(np.bincount(ids, minlength=50_257)))
    blocks = [ids[i:i + 4096] for i in range(0, n, 4096)]
    coded = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(coder.decode(coded), blocks, strict=True))
    broken = bytearray(coded[0])
    broken[8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode([bytes(broken)])


def test_frequencies_sum_up():
    for counts in ([1], [0, 5, 1, 10 ** 12], [1] * 50_000, [3] * 7):
        freq = R.scaled(np.array(counts))
        assert freq.sum() == 1 << R.SCALE_BITS and ((freq > 0) == (np.array(counts) > 0)).all()
    assert R.scaled(np.zeros(3, np.int64)).sum() == 0


def test_checksums_combine():
    a, b = b"left part", b"right part" * 50
    assert R.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert R.crc32_combine(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_token_files(docs, spark):
    texts = random_texts(60, 5) + ODD
    ids = random.Random(1).sample(range(500), len(texts))
    folder = R.scratch_path(spark, "rans-test")
    R.write(docs(texts, ids), BYTE, folder, block=64)
    got = sorted(tuple(r) for r in R.read(spark, folder).collect())
    want, start = [], 0
    for i, text in sorted(zip(ids, texts)):
        own = np.array([*library_ids(text), 2], "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == want
    stream = [x for r in sorted(R.decode_ids(spark, folder).collect()) for x in r["ids"]]
    assert len(stream) == start
    assert R.round_trip(docs([]), BYTE).count() == 0


def test_long_text_is_cut_anywhere():
    bpe = byte_bpe(BYTE)
    text = words(3, stem="") + "thequickbrownfox" * 500
    assert B.encode_text(bpe, text, 16) == np.array(library_ids(text), "<u4").tobytes()
