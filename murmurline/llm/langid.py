"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier tells the languages with a 1 from those with a
0: a linear model on n-grams of bytes, the log odds of smoothed n-gram frequencies, in which each language weighs the
same. Frequencies are counted over all training texts, as one sum per language. A text's margin on a bit is the mean
log odds of its n-grams; decoding takes the codeword of least loss, each bit weighted by how well its classifier does on
training texts (a bounded sample of PER_LANGUAGE texts per language, chosen by hash).

Codes: up to five languages get every split in two (2^(k-1) - 1 bits); more get a random code of CODE_FACTOR * log2(k)
bits whose least distance is the best of a fixed number of seeded draws.

The model has one column per bit and a fixed number of rows, whatever the corpus; only its counts grow. Whole texts are
scored in steps of bounded size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no ambiguity. Rows without a language
are not trained on; without any training row every text is ``und``. With one language, every text with a letter is that
language with score 1. Equal rows get equal answers. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import STEP_BYTES, batches_of

#: Columns for pairs of bytes, and hashed ones for triples and quadruples.
PAIRS, HASHED = 1 << 16, 1 << 16
SMOOTHING = 0.5
PER_LANGUAGE = 2000
CODE_FACTOR = 10
#: A text is ambiguous if its two best codewords are closer than this in score.
AMBIGUOUS = 0.2
#: Turns differences of weighted loss into scores.
SHARPNESS = 3.0

_LETTER = re.compile(r"[^\W\d_]")
_SIZE = PAIRS + 2 * HASHED


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(raw: bytes) -> np.ndarray:
    """Columns of the n-grams of a text, one per position and order."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    pairs = b[:-1] << np.uint32(8) | b[1:]
    out = [pairs.astype(np.int32)]
    if len(b) > 2:
        triples = pairs[:-1] << np.uint32(8) | b[2:]
        out.append((triples * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32) + PAIRS)
        if len(b) > 3:
            fours = triples[:-1] << np.uint32(8) | b[3:]
            out.append((fours * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int32) + PAIRS + HASHED)
    return np.concatenate(out)


def steps(raw: bytes) -> Iterator[bytes]:
    """A text in steps of STEP_BYTES; n-grams across a cut are not counted, in training as in prediction."""
    for i in range(0, len(raw), STEP_BYTES):
        yield raw[i:i + STEP_BYTES]


def codewords(k: int, factor: int = CODE_FACTOR, draws: int = 200, seed: int = 1) -> np.ndarray:
    """A row of +1 and -1 per language."""
    if k <= 5:
        bits = [[1] + [1 if column >> i & 1 else -1 for i in range(k - 1)] for column in range(2 ** (k - 1) - 1)]
        return np.array(bits, np.int8).T.reshape(k, -1)
    n, best, found = max(8, int(np.ceil(factor * np.log2(k)))), -1, None
    rng = np.random.default_rng(seed)
    for _ in range(draws):
        code = np.where(rng.random((k, n)) < 0.5, 1, -1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < k]  # a column must split
        gram = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(gram, -n)
        least = (code.shape[1] - gram.max()) // 2
        if least > best:
            best, found = least, code
    return found


@dataclass
class Model:
    """Languages, their codewords, one column of log odds per bit, and the bits' weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for part in steps(raw):
            columns = features(part)
            total += self.odds[columns].sum(axis=0, dtype=np.float64)
            n += len(columns)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """The nearest codeword, its score and the next one's."""
        if len(self.languages) == 1:
            return 0, 1.0, 0.0
        loss = np.logaddexp(0, -SHARPNESS * self.code * margins[None, :]) @ self.weights
        share = np.exp(-SHARPNESS * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        return int(order[0]), float(share[order[0]]), float(share[order[1]])


def _lower(text: str) -> bytes:
    return text.lower().encode()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if lang not in held:
                if len(held) >= 64:  # many languages in one task: hand over what is there
                    yield from _handed(held)
                    held = {}
                held[lang] = np.zeros(_SIZE, np.int64)
            for part in steps(_lower(text)):
                columns = features(part)
                if len(columns) > _SIZE // 8:
                    held[lang] += np.bincount(columns, minlength=_SIZE)
                else:
                    np.add.at(held[lang], columns, 1)
    yield from _handed(held)


def _handed(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                                          pa.array(counts[used])], names=["lang", "column", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the columns text and lang; null if there is no row with both."""
    train = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    table = train.select("text", "lang").mapInArrow(_counts, "lang string, column int, n bigint").groupBy("lang", "column").agg(
        F.sum("n").alias("n")).toPandas()  # at most languages x columns of the model
    if not len(table):
        return None
    languages = sorted(table["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), _SIZE))
    counts[table["lang"].map(place).to_numpy(), table["column"].to_numpy()] = table["n"].to_numpy()
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * _SIZE)
    code = codewords(len(languages))
    odds = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
                     for b in range(code.shape[1])], axis=1).astype(np.float32) if code.shape[1] else np.zeros((_SIZE, 0), np.float32)
    model = Model(languages, code, odds, np.ones(code.shape[1]))
    if code.shape[1]:
        model.weights = _weights(train, model, place, per_language)
    return model


def _weights(train: DataFrame, model: Model, place: dict[str, int], per_language: int) -> np.ndarray:
    """Weights of the bits from their errors on at most ``per_language`` training texts per language, chosen by hash."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, wrong, seen = shared.value, np.zeros(shared.value.code.shape[1]), 0
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                wrong += np.sign(m.margins(_lower(text))) != m.code[place[lang]]
                seen += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wrong)), pa.int32()), pa.array(wrong), pa.array([float(seen)] * len(wrong))],
                                         names=["bit", "wrong", "seen"])

    size = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, per_language / n))])
    # a fixed share of each language's texts, by a hash of the id; the same rows whenever a task is run again
    unit = F.pmod(F.xxhash64("doc_id", F.lit("weights")), F.lit(1_000_000)) / 1_000_000
    rows = train.where(unit < share[F.col("lang")]).select("text", "lang").mapInArrow(errors, "bit int, wrong double, seen double")
    found = {r["bit"]: (r["wrong"], r["seen"]) for r in rows.groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("seen").alias("seen")).collect()}
    wrong = np.array([(found.get(b, (0, 0))[0] + 1) / (found.get(b, (0, 0))[1] + 2) for b in range(model.code.shape[1])])
    weights = np.clip(np.log((1 - wrong) / wrong), 0.05, 6.0)
    return weights / weights.sum()


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, second_score, ambiguous of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("second_score", pa.float64()),
                        ("ambiguous", pa.bool_())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if m is None or text is None or not _LETTER.search(text):
                        yield doc, "und", 0.0, 0.0, False
                        continue
                    best, score, second = m.decode(m.margins(_lower(text)))
                    yield doc, m.languages[best], score, second, score - second < AMBIGUOUS
        yield from batches_of(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predicted, "doc_id bigint, lang_pred string, score double, second_score double, ambiguous boolean")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second_score, ambiguous; learns from the rows that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), per_language)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second_score", "ambiguous")
