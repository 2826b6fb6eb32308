"""Periodic runs of words in a text, found by seeds on diagonals and extended both ways.

A *run* is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``max(least, powers * q)`` words that no neighbouring word extends with period q.

A run of period q holds ``length - q`` positions whose word equals the one q later. Periods are taken in octaves
``Q <= q < 2 Q``; every run of an octave then holds equal k-grams q apart for the least k of ``max(least - q, (powers - 1) * q)``
over periods from Q on, the minimum overlap that the definition guarantees. With ``k >= q`` and at least two periods inside, no k-gram of a run comes
again sooner than after q words (a shorter distance would be a period of the run, too), so it is enough to look at
consecutive occurrences of a k-gram: one pair a position, not all pairs. Pairs are the seeds of the diagonal (lag) they
lie on. A seed is extended word by word in both directions, unless the table of the furthest covered position of its lag
shows that an earlier extension has been there.

Grams of an octave are made of two grams of the octave before, and only positions whose shorter gram comes twice are
looked at again, so texts without long repeats leave after the first octave. Seeds come from 64-bit hashes; every
extension compares words.

One pass over the texts: no shuffle, no groups across rows. A task handles texts in steps of about STEP_BYTES; a longer
text is a step of its own and takes some 100 bytes a word.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text. Equal rows, rows with one
doc_id and rows without a doc_id each give a row of their own. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import STEP_BYTES, binaries, gram_hashes, mix, sliced

#: Fewest words of a run, and fewest repeats of its period.
LEAST, POWERS = 6, 4

_BASE = 0x9E3779B97F4A7C15
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ROWS = f"doc_id bigint, n_words bigint, runs array<{_RUN}>, best {_RUN}, collapsed string"
_SCHEMA_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_SCHEMA_RUN)), ("best", _SCHEMA_RUN),
                     ("collapsed", pa.string())])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic tail in one of ten documents: those whose crc32 of the decimal doc_id ends in 0."""
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known = {w: i for i, w in enumerate(set(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _ahead(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """First position from ``at`` on whose word differs from the one ``lag`` later, or that has none before ``end``."""
    step = 64
    while at + lag < end:
        m = min(step, end - lag - at)
        differ = words[at:at + m] != words[at + lag:at + lag + m]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + m, step * 2
    return at


def _back(words: np.ndarray, at: int, lag: int, begin: int) -> int:
    """Least position down from ``at`` such that all words from there to ``at`` equal those ``lag`` later."""
    step = 64
    while at > begin:
        m = min(step, at - begin)
        differ = (words[at - m:at] != words[at - m + lag:at + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = at - m, step * 2
    return at


def overlap(octave: int, least: int = LEAST, powers: int = POWERS) -> int:
    """Positions that a run with a period of this octave or a later one has at least in common with itself one period on."""
    return min(max(least - q, (powers - 1) * q) for q in range(octave, max(octave, least) + 1))


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in texts that lie one after another: text t has the words
    ``bounds[t]:bounds[t + 1]``. Starts count from the first word of all."""
    if powers < 3 or least < 2:
        raise ValueError("a run has at least two words and three periods")
    found: list[tuple[int, int, int]] = []
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words))  # where a word lies in the input, as texts without repeats are left out on the way
    octave, k = 1, overlap(1, least, powers)
    grams = np.zeros(len(words), np.uint64)
    grams[:max(0, len(words) - k + 1)] = gram_hashes(mix(words.astype(np.uint64) + np.uint64(1)), k, _BASE)
    live = place
    while len(live):
        begin = np.searchsorted(text, np.arange(len(bounds)))  # texts left out are empty here
        live = live[live + k <= begin[text[live] + 1]]
        key = mix(grams[live] ^ mix(text[live].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key, live = key[order], live[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        left, lag = live[same], live[same + 1] - live[same]
        mine = (lag >= octave) & (lag < 2 * octave)
        left, lag = left[mine], lag[mine]
        order = np.lexsort((left, lag))
        left, lag = left[order], lag[order]
        # of seeds side by side on a diagonal the first extends over the others
        head = np.ones(len(left), bool)
        head[1:] = (np.diff(left) != 1) | (np.diff(lag) != 0)
        covered: dict[int, int] = {}
        for at, q in zip(left[head].tolist(), lag[head].tolist()):
            if at < covered.get(q, 0):
                continue
            t = text[at]
            a, b = _back(words, at, q, int(begin[t])), _ahead(words, at, q, int(begin[t + 1]))
            covered[q] = b
            if b - a + q >= max(least, powers * q):
                found.append((int(place[a]), b - a + q, q))
        repeated = np.zeros(len(words), bool)
        repeated[live[same]] = repeated[live[same + 1]] = True
        # texts without a repeat leave; the others close up
        stay = np.zeros(len(bounds), bool)
        stay[text[repeated]] = True
        keep = stay[text]
        if not keep.any():
            break
        if not keep.all():
            words, text, place, grams, repeated = (x[keep] for x in (words, text, place, grams, repeated))
        octave *= 2
        longer = overlap(octave, least, powers)
        if longer > k:  # at most twice as long: the pair of grams at its two ends names the longer gram
            n = max(0, len(grams) - (longer - k))
            grams[:n] = mix(grams[:n] * np.uint64(_BASE) + grams[longer - k:][:n])
            k = longer
        live = np.flatnonzero(repeated)
    return sorted(found)


def _rows(raws: list[bytes | None], ids: list[int | None], plant: bool, least: int, powers: int) -> pa.RecordBatch:
    texts = [raw.split() if raw else [] for raw in raws]
    if plant:
        texts = [planted(w, i) for w, i in zip(texts, ids)]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(numbers([w for words in texts for w in words]), bounds, least, powers):
        t = int(np.searchsorted(bounds, start, "right")) - 1
        runs[t].append((start - int(bounds[t]), length, period))
    best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else None for r in runs]
    named = lambda r: dict(zip(("start", "length", "period"), r))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array([[named(r) for r in sorted(rs, key=lambda r: (r[0], r[2]))] for rs in runs], _SCHEMA.field(2).type),
        pa.array([r and named(r) for r in best], _SCHEMA_RUN),
        pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())], schema=_SCHEMA)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS, plant: bool = False, step: int = STEP_BYTES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best (greatest length / period, then least start, then least period)
    and collapsed (the words of no run and those of the first period of each, joined by one space) of each row.

    With ``plant``, one document of ten is given a periodic tail first, see ``planted``.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, step):
            yield _rows(binaries(part.column("text")), part.column("doc_id").cast(pa.int64()).to_pylist(), plant, least, powers)

    return docs.select("doc_id", "text").mapInArrow(rows, _ROWS)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts, the best run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs, plant=True).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SQL = """WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sums AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)),
    4294967295), 4294967295) AS h FROM words),
tails AS (
  SELECT doc_id, w, n, h, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM sums WHERE h % 10 = 0 AND n > 0),
texts AS (
  SELECT doc_id, w, n FROM sums WHERE h % 10 <> 0 OR n = 0 UNION ALL
  SELECT doc_id, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END), n FROM tails),
-- a run of period q holds at least five places i whose words equal those at i + q, as six words or three periods follow
grams AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(n - 4)) AS i FROM texts WHERE n > 5)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS r FROM runs)
  WHERE r = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
short AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts WHERE doc_id IN (SELECT doc_id FROM runs)) t
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id AND gone.i = t.i) GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN short USING (doc_id)"""
