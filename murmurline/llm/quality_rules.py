"""Quality rules: a threshold table compiled into one projection of built-in functions.

``measure`` adds the measures of a text as columns; ``judge`` adds one verdict per rule of a table. There are no user
functions and no shuffle: every row is judged from its own whole text, so a hot source or a group of copies costs no
more than its rows.

Defined cases: a null or empty text has no words, so all counts are 0, ratios are null and pass, and the document fails
the length rule. Equal rows get equal verdicts. An empty table stays empty. A very long text is measured whole, by one
row's expressions, whose arrays hold all of its words. Columns of the input that have the name of a new column are
replaced (``measure``) or left out (``quality_rules``); ``keep_good`` keeps them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 5

# Frequent function words of the four languages.
STOP_WORDS = ("the of and to in is that it was for on are as with be by this from at or an "
              "der die das und ist von zu den mit ein eine nicht im auf für dem des sich als auch "
              "le la les de et un une du est que des en dans qui pour par sur pas au avec "
              "el los las del y que una por con para se al lo como es su no más o").split()
_SPELLINGS = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; a missing end is open, a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (F.col(self.measure) >= F.lit(self.low))
        if self.high is not None:
            inside = inside & (F.col(self.measure) <= F.lit(self.high))
        return F.coalesce(inside, F.lit(True))

    def sql(self) -> str:
        ends = ([f"{self.measure} >= {self.low!r}"] if self.low is not None else []) + (
            [f"{self.measure} <= {self.high!r}"] if self.high is not None else [])
        return f"coalesce({' AND '.join(ends) or 'true'}, true)"


#: The threshold table; the first two rules are the base, on which ``base_failed`` rests.
BASE_RULES = (
    Rule("enough_words", "n_words", low=10),
    Rule("few_repeats", "repeat_pct", high=20.0),
)
RULES = (
    Rule("not_endless", "n_words", high=10_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("few_symbols", "symbol_ratio", high=0.1),
    Rule("some_stop_words", "stop_ratio_long", low=0.02),
    Rule("few_repeated_lines", "dup_line_ratio", high=0.6),
    Rule("few_bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("few_cut_lines", "ellipsis_line_ratio", high=0.3),
    Rule("few_numbers", "number_ratio", high=0.6),
)


def measure(df: DataFrame, text: str = "text", stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the counts and ratios of each whole text. ``stop_words`` are the spellings that count as stop words, by default
    those of the languages above; with none the share of stop words is unknown and its rule passes.

    A repeated word lies in a 5-word window that occurs twice or more in its text. Windows of one text are compared by
    64-bit hashes; texts whose windows all differ, the usual case, are told by one distinct count and skip the sort.
    """
    spellings = list(_SPELLINGS if stop_words is None else stop_words)
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n, last = REPEAT_WINDOW, F.size("_hashes") - (REPEAT_WINDOW - 1)
    keys = F.when(last > 0, F.transform(
        F.arrays_zip(*[F.slice("_hashes", k + 1, last) for k in range(n)]), lambda five: F.xxhash64(five),
    )).otherwise(F.array().cast("array<bigint>"))
    covered = F.aggregate(
        F.col("_hits"), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["sum"] + (p + n - F.greatest(p, a["end"]))).cast("bigint").alias("sum"), (p + n).alias("end")),
        lambda a: a["sum"])
    out = df.withColumns({"_words": words, "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        # words that hold a digit, from the first digit on: a key or an address of many runs of digits is one word
        "n_numbers": F.regexp_count(body, F.lit(r"[0-9][^\x20\x09-\x0D]*")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
        "n_cut": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_stop": F.size(F.filter("_words", lambda w: w.isin(spellings))).cast("long") if spellings else F.lit(0).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    out = out.withColumn("_keys", keys)
    # sorted (hash, position): equal neighbours are windows that repeat
    ranked = F.array_sort(F.transform("_keys", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_ranked", F.when(F.size(F.array_distinct("_keys")) < F.size("_keys"), ranked).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))
    hits = F.array_sort(F.filter(
        F.transform("_ranked", lambda x, j: F.when(
            (F.get(F.col("_ranked"), j - 1)["h"] == x["h"]) | (F.get(F.col("_ranked"), j + 1)["h"] == x["h"]), x["i"])),
        lambda p: p.isNotNull()))
    out = out.withColumn("_hits", hits).withColumn("n_repeat_words", covered)
    words_d, lines_d = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return out.withColumns({
        "repeat_pct": F.col("n_repeat_words") * 100 / words_d,
        "mean_word_chars": F.col("word_chars") / words_d,
        "symbol_ratio": F.col("n_symbols") / words_d,
        "stop_ratio_long": F.when(F.lit(bool(spellings)) & (F.col("n_words") >= 25), F.col("n_stop") / words_d),
        "number_ratio": F.col("n_numbers") / words_d,
        "dup_line_ratio": F.col("n_dup_lines") / lines_d,
        "bullet_line_ratio": F.col("n_bullets") / lines_d,
        "ellipsis_line_ratio": F.col("n_cut") / lines_d,
    }).drop("_words", "_lines", "_hashes", "_keys", "_ranked", "_hits")


def judge(df: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names in table order, comma-joined) and ``kept``."""
    table = [*base, *rules]
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in table]), lambda x: x.isNotNull())
    base_failed = ~_all([r.passes() for r in base])
    return df.withColumns({"base_failed": base_failed, "failed_rules": F.array_join(failed, ","),
                           "kept": ~base_failed & _all([r.passes() for r in rules])})


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _settled(df: DataFrame) -> DataFrame:
    """``df`` in a form into which the optimizer cannot move a later filter, which would write every measure out again.

    A row number is not deterministic to the optimizer, so nothing that stands in one struct with it is moved or repeated;
    and the measures are no part of a condition, so what they have in common is computed once.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id().alias("_place_of_row")).alias("_m")
    return df.select(whole).select(*[F.col("_m")[c].alias(c) for c in df.columns])


def quality_rules(docs: DataFrame, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules of each document."""
    return _settled(judge(measure(docs.select("doc_id", "text"), stop_words=stop_words)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"))


def keep_good(docs: DataFrame, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged = judge(measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text")), stop_words=stop_words))
    return _settled(judged.select("_doc", "kept")).where("kept").select("_doc.*")


def _measures_sql(source: str) -> str:
    ws, n = r"[\x20\x09-\x0D]", REPEAT_WINDOW
    spell = ", ".join(f"'{w}'" for w in _SPELLINGS)
    return f"""split_up AS (
  SELECT *, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {source}), windows AS (
  SELECT *, list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i+{n}-1], ' ')) AS grams
  FROM split_up), repeated AS (
  SELECT *, list_filter(range(1, len(grams) + 1), lambda i: list_contains(twice, grams[i])) AS starts
  FROM (SELECT *, map_keys(map_from_entries(list_filter(map_entries(list_histogram(grams)), lambda e: e.value > 1))) AS twice
        FROM windows)), counted AS (
  SELECT *, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(words, lambda w: regexp_matches(w, '[0-9]'))) AS BIGINT) AS n_numbers, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{ws}*[-*•]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){ws}*$'))) AS n_cut,
    len(list_filter(words, lambda w: w IN ({spell}))) AS n_stop,
    CAST(len(list_distinct(flatten(list_transform(starts, lambda i: range(i, i + {n}))))) AS BIGINT) AS n_repeat_words
  FROM repeated), ratios AS (
  SELECT *, n_repeat_words * 100 / nullif(n_words, 0) AS repeat_pct, word_chars / nullif(n_words, 0) AS mean_word_chars,
    n_symbols / nullif(n_words, 0) AS symbol_ratio, n_numbers / nullif(n_words, 0) AS number_ratio,
    CASE WHEN n_words >= 25 THEN n_stop / n_words END AS stop_ratio_long,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_bullets / nullif(n_lines, 0) AS bullet_line_ratio,
    n_cut / nullif(n_lines, 0) AS ellipsis_line_ratio
  FROM counted)"""


def measures_sql(source: str = "documents") -> str:
    """The same measures and verdicts in DuckDB SQL: a chain of named tables that ends with ``judged``."""
    table = [*BASE_RULES, *RULES]
    names = ", ".join(f"CASE WHEN NOT {r.sql()} THEN '{r.name}' END" for r in table)
    base, rest = (" AND ".join(r.sql() for r in rules) for rules in (BASE_RULES, RULES))
    return _measures_sql(source) + f""", judged AS (
  SELECT *, NOT ({base}) AS base_failed, ({base}) AND ({rest}) AS kept,
    array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM ratios)"""


SQL = f"""WITH {measures_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules FROM judged"""
