"""License scan: ordered signature rules, keyword prefilter, and suppression of overlapping detections.

A rule is a regular expression for a place that names a license, with its label, priority, confidence and a keyword that
every match holds. Rules come in order: the base phrases first, then, per license, the signatures made from the table of
names by the forms in which licenses are named (identifier lines, notices, titles, badges, addresses), then families
without version. A text is searched once for all keywords together; only rules whose keyword occurs are run.

Detections are intervals. Taken by priority, then length, then place, one is dropped if it lies inside an interval that
has been kept before it; of equal intervals the rule that stands first wins. Base detections are never dropped.

Defined cases: null and empty texts have no words, detections or labels, and score 0. Words and phrases are those of the
whole text; letters other than A-Z keep their case. Rows are scanned one by one, also if they repeat. Extra columns are
ignored by ``scan``; ``detections`` gives one row per kept interval.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.llm.common import batches_of

# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Identifier and the names under which a license is known.
LICENSES = {
    "mit": ["mit", "expat"],
    "mit-0": ["mit no attribution", "mit-0"],
    "apache-1.1": ["apache 1.1", "apache software license 1.1"],
    "apache-2": ["apache 2", "apache 2.0", "apache-2.0", "apache license 2.0", "apache license version 2.0"],
    "bsd-2-clause": ["bsd 2-clause", "2-clause bsd", "simplified bsd", "freebsd"],
    "bsd-3-clause": ["bsd 3-clause", "3-clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd 4-clause", "4-clause bsd", "original bsd"],
    "0bsd": ["0bsd", "zero-clause bsd"],
    "isc": ["isc"],
    "zlib": ["zlib", "zlib/libpng"],
    "bsl-1.0": ["boost software license 1.0", "boost software license", "bsl-1.0"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl"],
    "cc0-1.0": ["cc0", "cc0 1.0", "cc0-1.0"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-3.0": ["cc by 3.0", "creative commons attribution 3.0"],
    "cc-by-4.0": ["cc by 4.0", "creative commons attribution 4.0"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc-by-sa-3.0": ["cc by sa 3.0", "creative commons attribution sharealike 3.0"],
    "cc-by-sa-4.0": ["cc by sa 4.0", "creative commons attribution sharealike 4.0"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "gpl-2.0": ["gpl 2", "gpl 2.0", "gpl v2", "gplv2", "gnu general public license version 2", "gnu gpl v2"],
    "gpl-3.0": ["gpl 3", "gpl 3.0", "gpl v3", "gplv3", "gnu general public license version 3", "gnu gpl v3"],
    "lgpl-2.1": ["lgpl 2.1", "lgpl v2.1", "lgplv2.1", "gnu lesser general public license version 2.1"],
    "lgpl-3.0": ["lgpl 3", "lgpl 3.0", "lgpl v3", "lgplv3", "gnu lesser general public license version 3"],
    "agpl-3.0": ["agpl 3", "agpl 3.0", "agpl v3", "agplv3", "gnu affero general public license version 3"],
    "mpl-1.1": ["mpl 1.1", "mozilla public license 1.1", "mozilla public license version 1.1"],
    "mpl-2.0": ["mpl 2.0", "mpl-2.0", "mozilla public license 2.0", "mozilla public license version 2.0"],
    "epl-1.0": ["epl 1.0", "eclipse public license 1.0"],
    "epl-2.0": ["epl 2.0", "eclipse public license 2.0"],
    "cddl-1.0": ["cddl", "cddl 1.0", "common development and distribution license"],
    "eupl-1.2": ["eupl", "eupl 1.2", "european union public licence"],
    "artistic-2.0": ["artistic license 2.0", "artistic 2.0"],
    "ofl-1.1": ["sil open font license", "ofl 1.1", "ofl-1.1"],
    "odbl-1.0": ["odbl", "open database license"],
    "psf-2.0": ["python software foundation license", "psf license"],
    "postgresql": ["postgresql"],
    "openssl": ["openssl"],
    "ms-pl": ["ms-pl", "microsoft public license"],
    "upl-1.0": ["universal permissive license", "upl-1.0"],
    "bsl-1.1": ["business source license 1.1", "busl-1.1"],
    "sspl-1.0": ["server side public license", "sspl"],
    "elastic-2.0": ["elastic license 2.0", "elastic license"],
}

# The forms; {name} is the name, {l} stands for license or licence. Order is priority, first the strongest.
FORMS = (
    ("identifier", r"spdx[\W_]*license[\W_]*identifier\W{{1,4}}{name}", 90, 0.99),
    ("released", r"(?:released|licensed|distributed|available|provided|published)\W+(?:\w+\W+)?under\W+(?:the\W+)?(?:terms\W+of\W+)?(?:the\W+)?{name}(?:\W+{l})?", 80, 0.95),
    ("under", r"under\W+(?:the\W+)?{name}\W+{l}", 75, 0.9),
    ("field", r"{l}\W{{1,3}}{name}", 70, 0.85),
    ("title", r"{name}\W+{l}", 60, 0.7),
)

# Texts and families known by their own words; label, keyword, pattern, priority, confidence.
SPECIAL = (
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy", 95, 0.98),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", 95, 0.95),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms", 95, 0.95),
    ("apache-2", "apache.org/licenses/license-2.0", r"apache\.org/licenses/license-2\.0", 92, 0.98),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses(?:/[al]?gpl[\w.\-]*)?", 50, 0.8),
    ("gpl", "general public license", r"(?:gnu\W+)?(?:lesser\W+|affero\W+)?general public license", 40, 0.7),
    ("mpl-2.0", "mozilla.org/mpl/2.0", r"mozilla\.org/mpl/2\.0", 92, 0.98),
    ("cc0-1.0", "creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0", 92, 0.98),
    ("creative-commons", "creativecommons.org/licenses", r"creativecommons\.org/licenses/[a-z\-]+(?:/\d\.\d)?", 50, 0.8),
    ("creative-commons", "creative commons", r"creative commons", 30, 0.5),
    ("unlicense", "free and unencumbered software", r"free and unencumbered software released into the public domain", 95, 0.98),
    ("public-domain", "public domain", r"(?:in|into|to)\W+the\W+public\W+domain", 40, 0.6),
    ("all-rights-reserved", "all rights reserved", r"all\W+rights\W+reserved", 35, 0.5),
    ("proprietary", "proprietary", r"proprietary\W+(?:and\W+confidential|{l}|software)".replace("{l}", "licen[cs]e"), 35, 0.6),
    ("copyright", "copyright", r"copyright\W+(?:\(c\)\W*|©\W*)?\d{4}", 20, 0.3),
)

#: Words, and what stands between them, after A-Z are lower-cased.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(f"{WORD}+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float
    base: bool = False


def _bounded(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<!{WORD})(?:{pattern})(?!{WORD})")


def _name(name: str) -> str:
    """A name as a pattern: its words with any marks or none but white space between them."""
    return r"[\s\-_./]+".join(re.escape(w) for w in re.split(r"[ \-/]", name))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The ordered rules: base phrases, then licenses by forms, then special texts."""
    out = [Rule(f"base/{label}", label, max(phrase.split(), key=len), _bounded(f"{GAP}+".join(phrase.split())), 100, 1.0, True)
           for phrase, label in BASE]
    for label, names in LICENSES.items():
        for name in sorted(names, key=len, reverse=True):
            keyword = max(re.split(r"[ \-/]", name), key=len)
            for form, pattern, priority, confidence in FORMS:
                out.append(Rule(f"{label}/{form}/{name}", label, keyword, _bounded(pattern.format(name=_name(name), l="licen[cs]e")),
                                priority, confidence))
    out += [Rule(f"{label}/special/{keyword}", label, keyword, _bounded(pattern), priority, confidence)
            for label, keyword, pattern, priority, confidence in SPECIAL]
    return tuple(out)


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    """The keywords in one automaton, each with the numbers of its rules."""
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for word, numbers in by.items():
        automaton.add_word(word, tuple(numbers))
    automaton.make_automaton()
    return automaton


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def detect(text: str) -> list[Detection]:
    """All detections in a lower-cased text, before suppression, by rule."""
    wanted: set[int] = set()
    for _, numbers in _prefilter().iter(text):
        wanted.update(numbers)
    all_rules = rules()
    # every form but the base phrases and special texts names the license as such
    names_one = "licen" in text or "under" in text
    out = []
    for i in sorted(wanted):
        r = all_rules[i]
        if names_one or r.base or "/special/" in r.name:
            out += [Detection(m.start(), m.end(), r) for m in r.pattern.finditer(text)]
    return out


def suppress(found: list[Detection]) -> list[Detection]:
    """The detections that stay: by priority, length, place and rule order, none inside one that was kept before it."""
    kept: list[Detection] = []
    order = sorted(enumerate(found), key=lambda x: (-x[1].rule.priority, x[1].start - x[1].end, x[1].start, x[0]))
    starts: list[int] = []  # kept intervals without those inside another, so that both ends rise
    ends: list[int] = []
    for _, d in order:
        at = bisect_right(starts, d.start)
        inside = at > 0 and ends[at - 1] >= d.end
        if d.rule.base or not inside:
            kept.append(d)
        if not inside:
            first, last = bisect_left(starts, d.start), bisect_right(ends, d.end)
            starts[first:max(first, last)], ends[first:max(first, last)] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule.name))


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                   ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                   ("n_detections", pa.int64())])


def scan_text(text: str | None) -> tuple:
    """What ``scan`` returns for a text, without its id."""
    text = (text or "").translate(_LOWER)
    n_words = len(_WORD.findall(text))
    kept = suppress(detect(text))
    base = sorted(d.start for d in kept if d.rule.base)
    ends = [sum(1 for _ in _WORD.finditer(text, 0, at)) for at in ((base[0], base[-1]) if base else ())]
    miss = 1.0
    for rule in {d.rule for d in kept}:
        miss *= 1 - rule.confidence
    return (n_words, len(base), ends[0] if base else None, ends[-1] if base else None,
            ",".join(sorted({d.rule.label for d in kept if d.rule.base})), ",".join(sorted({d.rule.label for d in kept})),
            round(1 - miss, 9), len(kept))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches_of(((doc, *scan_text(text)) for batch in batches for doc, text in zip(
        batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())), _ROWS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, n_detections bigint")


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, rule, label, priority, confidence of each kept interval (characters of the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()),
                        ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((doc, d.start, d.end, d.rule.name, d.rule.label, d.rule.priority, d.rule.confidence)
                               for batch in batches for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                               for d in suppress(detect((text or "").translate(_LOWER)))), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        found, "doc_id bigint, start bigint, end bigint, rule string, label string, priority int, confidence double")
