"""A public byte-level BPE vocabulary in a task: cached encoding by the library, and decoding."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.models import BPE

from murmurline.llm.common import CACHE_ENTRIES, Remembered

#: A space with white space on both sides; elsewhere a space starts a new piece of the pre-tokenizer.
_CROWDED = re.compile(r"\s \s")
#: Characters whose classes are the same in every Unicode version and library: up to the end of Latin Extended-B.
_KNOWN = re.compile("[\x00-\u024F]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024F", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
#: The pre-tokenizer's pattern over those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class ByteBpe:
    """Ids as the library gives them; equal stretches between spaces, and equal pieces in them, are encoded once.

    A space starts a new piece whenever one of its neighbours is not white space, so a text falls apart there. Texts
    with a space inside a longer run of white space, and texts with a special token, go to the library as a whole.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        # the merges alone, for text that is one piece already; it comes here once, so the library need not remember it
        model = config["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.tokens = {i: t for t, i in config["model"]["vocab"].items()}
        alphabet = byte_alphabet()
        self.raw = [b""] * (1 + max([*self.tokens, *self.specials.values()]))
        for i, token in self.tokens.items():
            self.raw[i] = bytes(alphabet[c] for c in token)
        for token, i in self.specials.items():
            self.raw[i] = token.encode()
        self.letters = {b: c for c, b in alphabet.items()}
        #: pieces, and stretches up to the next space: one that starts the text, or one after a space
        self.words = Remembered(self.word, entries)
        self.first, self.rest = Remembered(self.stretch, 1000), Remembered(lambda piece: self.stretch(" " + piece), entries)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        inner = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(inner)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch without special tokens."""
        if _KNOWN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))
        return self.whole(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        if _CROWDED.search(text) or self.special.search(text):
            return self.whole(text)
        pieces = text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for, special tokens included."""
        joined = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: Latin-1 letters and marks stand for themselves,
    the other bytes get the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_bpe(path: str, entries: int = CACHE_ENTRIES) -> ByteBpe:
    """One per process, vocabulary and size of its word caches."""
    return ByteBpe(path, entries)
