"""Token counts by a compiled finite-state transducer.

The tokenizer (lower-casing BPE with word ends) is compiled into a deterministic transducer that only counts. Its state
holds what the rest of a piece can still depend on: the positions at which the token now being read may have begun (the
text since then begins a token of the vocabulary), with the token before each. Reading a symbol gives the last token at
the new position - the one open text that is a token and that the token before it tolerates as a neighbour - and the
transition is annotated with the tokens it adds. Transitions are compiled when first met and kept, for single symbols and for whole
pieces, so frequent pieces are one step.

A text is cut into chunks of CHUNK characters. What a chunk does depends on the piece it begins inside of, so a chunk is
a map from incoming states to outgoing ones. White space resets the transducer: the map of a chunk is the text before
its first reset, the count between its first and last, and the text after its last. Two maps compose into one by
counting the text at their seam; the composition is associative, and a document's maps compose in a tree.
Texts longer than PART characters are dealt out chunk by chunk, so that their maps are made in parallel.

Defined cases: null and empty texts have 0 bytes and tokens. Special tokens in a text count 1, as in the library.
Rows count one by one, also if they repeat. Extra columns are ignored by ``count_tokens``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmurline.llm.common import CACHE_ENTRIES, Remembered, batches_of, text_key
from murmurline.llm.tokenizer import byte_alphabet
from murmurline.session import cut_lineage

CHUNK, PART = 1 << 14, 1 << 18
#: States and transitions kept before compiling starts afresh.
STATES = 400_000
LIMIT = 2048

#: Characters whose classes and lower case are the same in every Unicode version and library.
_KNOWN = re.compile("[\x00-ɏ]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
#: The pre-tokenizer's pattern over lower-cased text of those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_RESET = re.compile(r"[ \t-\r]")


class Map(NamedTuple):
    """What a chunk does: text before its first reset, tokens up to its last, text after it; ``head`` is None if it has no reset."""

    head: str | None
    count: int
    tail: str


class Transducer:
    """Counts the tokens of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in config["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        model = config["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.bytes = {ord(c): chr(b) for b, c in self.letters.items()}
        #: every proper beginning of a token: text that a token may still go on from
        self.begins = {"".join(x[:i]) for x in map(self._symbols, self.vocab) for i in range(1, len(x))}
        self._restart()
        self.fits: dict[tuple[str, str], bool] = {}
        self.pieces = Remembered(self.piece)

    def tolerates(self, left: str, right: str) -> bool:
        """Whether two tokens stay two when their text is encoded: no merge across the seam comes before their own."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= CACHE_ENTRIES:
                self.fits.clear()
            known = self.fits[left, right] = self._merged(left, right) == [left, right]
        return known

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merged(self, left: str, right: str) -> list[str]:
        parts = self._symbols(left) + self._symbols(right)
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _restart(self) -> None:
        #: a state lists the positions at which the token now being read may have begun, the newest last: the token
        #: before the position, the tokens up to it (against the newest position), and the text since
        start = (("", 0, ""),)
        self.states: dict[tuple, int] = {start: 0}
        self.open: list[tuple] = [start]
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.lasts: dict[tuple[int, str], int] = {}

    def _last(self, state: int, symbol: str) -> tuple[str, int]:
        """The last token after ``symbol``, and the tokens it adds."""
        for before, count, text in reversed(self.open[state]):
            token = text + symbol
            if token in self.vocab and (not before or self.tolerates(before, token)):
                return token, count + 1
        raise ValueError(f"no token ends in {symbol!r}")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Next state and tokens added by one symbol inside a piece."""
        token, added = self._last(state, symbol)
        going_on = [(before, count - added, text + symbol) for before, count, text in self.open[state] if text + symbol in self.begins]
        key = (*going_on, (token, 0, ""))
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.open)
            self.open.append(key)
        self.steps[state, symbol] = number, added
        return number, added

    def finish(self, state: int, symbol: str) -> int:
        """Tokens added by the last symbol of a piece."""
        added = self.lasts[state, symbol] = self._last(state, symbol + self.end)[1]
        return added

    def piece(self, text: str) -> int:
        """Tokens of one piece of the pre-tokenizer, by the transducer."""
        if len(self.open) >= STATES:
            self._restart()
        symbols = text.encode().decode("latin-1").translate(self.letters)
        state, total, steps = 0, 0, self.steps
        for symbol in symbols[:-1]:
            state, added = steps.get((state, symbol)) or self.step(state, symbol)
            total += added
        last = state, symbols[-1]
        return total + (self.lasts[last] if last in self.lasts else self.finish(*last))

    def stretch(self, text: str) -> int:
        """Tokens of a text between resets."""
        if not text:
            return 0
        if "<" in text and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.stretch, parts))
        if _KNOWN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            lower = text.lower()
            if _KNOWN.fullmatch(lower):
                return sum(map(self.pieces.__getitem__, _SPLIT.findall(lower)))
        normal = self.library.normalizer.normalize_str(text)
        pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return sum(self.pieces[p.translate(self.bytes).encode("latin-1").decode()] for p in pieces)

    def chunk(self, text: str) -> Map:
        """The map of a chunk."""
        first = _RESET.search(text)
        if first is None:
            return Map(None, 0, text)
        last = max(text.rfind(c) for c in " \t\n\x0b\x0c\r")
        return Map(text[:first.start()], self.stretch(text[first.start():last]), text[last + 1:])

    def compose(self, a: Map, b: Map) -> Map:
        """The map of two neighbouring chunks."""
        if b.head is None:
            return Map(a.head, a.count, a.tail + b.tail)
        if a.head is None:
            return Map(a.tail + b.head, b.count, b.tail)
        return Map(a.head, a.count + self.stretch(a.tail + b.head) + b.count, b.tail)

    def total(self, maps: list[Map]) -> int:
        """Tokens of a whole text: its maps composed in a tree, then applied to the empty state."""
        if not maps:
            return 0
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        (m,) = maps
        return m.count + self.stretch(m.head or "") + self.stretch(m.tail)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One per process and vocabulary."""
    return Transducer(path)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    return [text[i:i + size] for i in range(0, len(text), size)]


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("tkey", pa.int64()),
                   ("seq", pa.int32()), ("chunk", pa.string())])


def _first_pass(path: str, size: int, part: int):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    raw = text.encode()
                    if len(text) <= part:
                        yield doc, len(raw), t.total([t.chunk(c) for c in chunks(text, size)]), None, None, None
                    else:
                        key = text_key(raw)
                        for seq, chunk in enumerate(chunks(text, part)):
                            yield doc, len(raw), None, key, seq, chunk
        yield from batches_of(rows(), _ROWS, 500)
    return first


def _maps(path: str, size: int):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            found = []
            for text in batch.column("chunk").to_pylist():
                own = [t.chunk(c) for c in chunks(text, size)]
                while len(own) > 1:
                    own = [t.compose(*own[i:i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
                found.append(own[0])
            out = batch.drop_columns(["chunk"])
            for name, kind, values in (("head", pa.string(), [m.head for m in found]), ("count", pa.int64(), [m.count for m in found]),
                                       ("tail", pa.string(), [m.tail for m in found])):
                out = out.append_column(name, pa.array(values, kind))
            yield out
    return maps


def _total(path: str):
    def total(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["seq", "head", "count", "tail"]).to_pylist(), key=lambda r: r["seq"])
        n = transducer(path).total([Map(r["head"], r["count"], r["tail"]) for r in rows])
        first = group.slice(0, 1).to_pylist()[0]
        return pa.table({k: pa.array([v] * first["copies"], pa.int64()) for k, v in (
            ("doc_id", first["doc_id"]), ("n_bytes", first["n_bytes"]), ("n_tokens", n))})
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, size: int = CHUNK, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document; ``path`` names the vocabulary file."""
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _first_pass(path, size, part), "doc_id bigint, n_bytes bigint, n_tokens bigint, tkey bigint, seq int, chunk string"), "counted")
    parts = rows.where("seq IS NOT NULL").groupBy("doc_id", "tkey", "seq").agg(
        F.first("n_bytes").alias("n_bytes"), F.first("chunk").alias("chunk"), F.count("*").alias("copies"))
    mapped = parts.repartition("doc_id", "tkey", "seq").mapInArrow(
        _maps(path, size), "doc_id bigint, tkey bigint, seq int, n_bytes bigint, copies bigint, head string, count bigint, tail string")
    long = mapped.groupBy("doc_id", "tkey").applyInArrow(_total(path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    whole = rows.where("seq IS NULL").select("doc_id", "n_bytes", "n_tokens").union(long)
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
