"""BPE encoding and decoding by tree concatenation.

Text that the pre-tokenizer does not split is one piece, and a piece has no bound. A long piece is encoded in halves,
down to leaves of LEAF characters; two encoded halves are joined by re-encoding a window of tokens around the seam,
which doubles until its outermost tokens on both sides are those the halves have there. That is exact: a sequence of
tokens is the encoding of its text if and only if every two neighbours are the encoding of theirs, and each neighbouring
pair then lies within a half or within the window.

Pieces of more than PART characters are not left to one task: their leaves of PART characters become rows that are
dealt out over the cluster, encoded in parallel, and joined per document, where only windows are encoded again.

Decoding joins the bytes of the tokens; bytes that are no UTF-8 become replacement characters, as in the library.

Defined cases: null and empty texts have no tokens (digests of the empty string). Rows are encoded one by one, also if
they repeat. Special tokens in a text are recognised as the library does by default. Extra columns are ignored by
``round_trip``; ``with_ids`` keeps the columns it is given and replaces one called ``ids``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import batches_of, text_key
from murmurline.llm.tokenizer import ByteBpe, byte_bpe
from murmurline.session import cut_lineage

#: Characters (of the byte alphabet) of a leaf inside a task, and of one that becomes a row.
LEAF, PART = 512, 1 << 16

_DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
_PARTS = pa.schema([*_DIGESTS, ("tkey", pa.int64()), ("seq", pa.int32()), ("kind", pa.int32()), ("part", pa.string())])
_PLAIN, _LEAF, _NEXT, _SPECIAL = range(4)


def merge_only(bpe: ByteBpe, piece: str) -> list[int]:
    return [t.id for t in bpe.merges.tokenize(piece)]


def concatenate(bpe: ByteBpe, left: list[int], right: list[int], agree: int = 1) -> list[int]:
    """The encoding of two neighbouring stretches of one piece, from their encodings."""
    m = 2 * agree
    while left and right:
        a, b = left[-m:], right[:m]
        window = merge_only(bpe, "".join(bpe.tokens[i] for i in a + b))
        starts = m >= len(left) or window[:agree] == a[:agree]
        ends = m >= len(right) or window[-agree:] == b[-agree:]
        if starts and ends:
            return left[:-m] + window + right[m:] if m < len(left) else window + right[m:]
        m *= 2
    return left or right


def encode_piece(bpe: ByteBpe, piece: str, leaf: int = LEAF) -> list[int]:
    """Ids of one unsplit piece, given in the byte alphabet."""
    level = [merge_only(bpe, piece[i:i + leaf]) for i in range(0, len(piece), leaf)]
    return join_level(bpe, level)


def join_level(bpe: ByteBpe, level: list[list[int]]) -> list[int]:
    while len(level) > 1:
        level = [concatenate(bpe, *level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else []


def _segments(bpe: ByteBpe, text: str) -> Iterator[tuple[str, int | None]]:
    """Stretches without special tokens, and the special tokens between them."""
    at = 0
    for m in bpe.special.finditer(text):
        if m.start() > at:
            yield text[at:m.start()], None
        yield m.group(), bpe.specials[m.group()]
        at = m.end()
    if at < len(text):
        yield text[at:], None


def _pieces(bpe: ByteBpe, text: str) -> list[str]:
    return [p for p, _ in bpe.library.pre_tokenizer.pre_tokenize_str(text)]


def _has_long(text: str, leaf: int) -> bool:
    """Whether some stretch without a space, or of spaces, may be longer than a leaf."""
    return len(text) * 4 > leaf and (len(max(text.split(" "), key=len)) * 4 > leaf or " " * (leaf // 4) in text)


def encode_text(bpe: ByteBpe, text: str, leaf: int = LEAF) -> bytes:
    """Ids of a whole text as little-endian 32-bit integers."""
    if not _has_long(text, leaf):
        return bpe.encode(text)
    out: list[int] = []
    for part, special in _segments(bpe, text):
        if special is not None:
            out.append(special)
        else:
            for piece in _pieces(bpe, part):
                out += encode_piece(bpe, piece, leaf)
    return np.array(out, "<u4").tobytes()


def _parts_of(bpe: ByteBpe, text: str, part: int) -> list[tuple[int, str]] | None:
    """(kind, stretch) in order if the text has a piece longer than ``part``, else None."""
    if len(text) * 4 <= part or not _has_long(text, part):
        return None
    out, plain, long = [], [], False
    for stretch, special in _segments(bpe, text):
        if special is not None:
            out += [(_PLAIN, " ".join(plain))] * bool(plain) + [(_SPECIAL, str(special))]
            plain = []
            continue
        for piece in _pieces(bpe, stretch):
            if len(piece) <= part:
                plain.append(piece)  # no character of the alphabet is a space
                if len(plain) >= part // 8:
                    out.append((_PLAIN, " ".join(plain)))
                    plain = []
                continue
            long = True
            out += [(_PLAIN, " ".join(plain))] * bool(plain)
            plain = []
            out += [(_LEAF if i == 0 else _NEXT, piece[i:i + part]) for i in range(0, len(piece), part)]
    out += [(_PLAIN, " ".join(plain))] * bool(plain)
    return out if long else None


def _digest(bpe: ByteBpe, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def _first_pass(path: str, leaf: int, part: int):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    parts = _parts_of(bpe, text, part)
                    if parts is None:
                        yield doc, *_digest(bpe, encode_text(bpe, text, leaf)), None, None, None, None
                    else:
                        key = text_key(text.encode())
                        for seq, (kind, stretch) in enumerate(parts):
                            yield doc, None, None, None, key, seq, kind, stretch
        yield from batches_of(rows(), _PARTS, 500)
    return first


def _encode_parts(path: str, leaf: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            found = []
            for kind, stretch in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist()):
                if kind == _SPECIAL:
                    ids = [int(stretch)]
                elif kind == _PLAIN:
                    ids = [i for piece in stretch.split(" ") for i in encode_piece(bpe, piece, leaf)]
                else:
                    ids = encode_piece(bpe, stretch, leaf)
                found.append(np.array(ids, "<u4").tobytes())
            yield batch.drop_columns(["part"]).append_column("ids", pa.array(found, pa.binary()))
    return encode


def _join_parts(path: str):
    def join(group: pa.Table) -> pa.Table:
        bpe = byte_bpe(path)
        rows = sorted(zip(group.column("seq").to_pylist(), group.column("kind").to_pylist(), group.column("ids").to_pylist()))
        out, level = [], []
        for _, kind, ids in [*rows, (None, _PLAIN, b"")]:
            if kind != _NEXT and level:
                out.append(np.array(join_level(bpe, level), "<u4").tobytes())
                level = []
            if kind in (_LEAF, _NEXT):
                level.append(np.frombuffer(ids, "<u4").tolist())
            else:
                out.append(ids)
        copies = group.column("copies")[0].as_py()
        digest = (group.column("doc_id")[0].as_py(), *_digest(bpe, b"".join(out)))
        return pa.table([pa.array([v] * copies, kind) for v, (_, kind) in zip(digest, _DIGESTS)], names=[n for n, _ in _DIGESTS])
    return join


def round_trip(docs: DataFrame, path: str, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; ``path`` names the vocabulary file."""
    digests = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _first_pass(path, leaf, part), f"{digests}, tkey bigint, seq int, kind int, part string"), "encoded")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    parts = rows.where("seq IS NOT NULL").groupBy("doc_id", "tkey", "seq", "kind").agg(
        F.first("part").alias("part"), F.count("*").alias("copies"))
    encoded = parts.repartition("doc_id", "tkey", "seq").mapInArrow(
        _encode_parts(path, leaf), "doc_id bigint, tkey bigint, seq int, kind int, copies bigint, ids binary")
    joined = encoded.groupBy("doc_id", "tkey").applyInArrow(_join_parts(path), digests)
    return rows.where("seq IS NULL").select(*names).union(joined.select(*names))


def _ids_of(path: str, leaf: int):
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                lists = [np.frombuffer(encode_text(bpe, t or "", leaf), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
                yield batch.append_column("ids", pa.array(lists, pa.list_(pa.int32())))
    return ids


def with_ids(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """``docs`` with the column ``ids``, the token ids of ``text``."""
    kept = docs.select(*[c for c in docs.columns if c.lower() != "ids"])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_ids_of(path, leaf), f"{ddl}, ids array<int>")
