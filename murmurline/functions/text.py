"""Text expressions (X1-X15, X18). Everything here builds JVM-side columns.

Java patterns carry ``(?U)`` where white space, digits or word characters are
meant in the Unicode sense.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.functions.vocabulary import ALCOHOL_KEYWORDS, SAMPLING_KEYWORDS, SHISHA_TERMS, STOP_PLACEHOLDERS

_SPACES = r"(?U)\s+"


def _alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def words(text: Column) -> Column:
    """White-space separated words, no empty entries."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def squeeze_whitespace(text: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def has_keyword(text: Column, keywords: Iterable[str] = ALCOHOL_KEYWORDS, lower: bool = True) -> Column:
    """Any whole word equal to a keyword (X1; with ``lower=False`` X2)."""
    source = F.lower(text) if lower else text
    return F.arrays_overlap(F.split(source, _SPACES), F.array(*[F.lit(k) for k in dict.fromkeys(keywords)]))


def starts_with_keyword(text: Column, keywords: Iterable[str] = SAMPLING_KEYWORDS) -> Column:
    """Keyword at the very start of the text, as a prefix."""
    return text.rlike(f"^(?:{_alternation(keywords)})")


def mentions_shisha(text: Column, terms: Iterable[str] = SHISHA_TERMS) -> Column:
    """Any term as a substring of the lower-cased text."""
    return F.lower(text).rlike(_alternation(terms))


def plain_ascii(text: Column) -> Column:
    """Text as the tobacco classifiers see it.

    Punctuation other than ``# @ ' ( ) "`` becomes a blank before mentions are
    replaced, so an underscore ends a mention; then everything outside
    printable ASCII becomes a blank and white space collapses.
    """
    out = F.regexp_replace(text, r"[!$%&*+,\-./:;<=>?\[\\\]^_`{|}~]", " ")
    out = F.regexp_replace(out, r"@[A-Za-z0-9]+", "-MENTION-")
    out = F.regexp_replace(out, r"[^\x21-\x7E]+", " ")
    return F.trim(out)


def normalise_tweet(text: Column) -> Column:
    """Lower case, URL and mention placeholders, plain hash words, no outer quotes."""
    out = F.regexp_replace(F.lower(text), r"(?U)(?:www\.|https?://)\S+", "URL")
    out = F.regexp_replace(out, r"(?U)@\S+", "AT_USER")
    out = F.regexp_replace(out, _SPACES, " ")
    out = F.regexp_replace(out, r"(?U)#(\S+)", "$1")
    return F.btrim(out, F.lit("'\""))


def cap_repeats(text: Column) -> Column:
    """Runs of two or more equal characters to exactly two."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1$1")


def feature_words(text: Column, stop_words: Iterable[str] | Column | None = None) -> Column:
    """Word features of a normalised tweet.

    Repeats are capped, outer ``' " ? , .`` stripped and only plain alphanumeric
    words that start with a letter stay. ``stop_words`` is empty by default; a
    Column of an array may be given instead of a list.
    """
    capped = F.transform(words(text), lambda w: F.btrim(cap_repeats(w), F.lit("'\"?,.")))
    plain = F.filter(capped, lambda w: w.rlike("^[a-zA-Z][a-zA-Z0-9]*$"))
    if stop_words is not None:
        stops = stop_words if isinstance(stop_words, Column) else F.array(*[F.lit(s) for s in stop_words])
        plain = F.filter(plain, lambda w: ~F.array_contains(stops, w))
    return F.transform(plain, F.lower)


def load_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One stop word per line, plus the placeholders."""
    listed = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    extra = spark.createDataFrame([(w,) for w in STOP_PLACEHOLDERS], "word string")
    return listed.unionByName(extra)


# Set between tokens of one word. White space to every pattern below, but never
# part of a squeezed text, so the blanks of the text itself stay recognisable.
_FENCE = "\u2003"

# Squeezed text has no white space but blanks and, later, fences.
_GAP = f"[ {_FENCE}]"
_INK = f"[^ {_FENCE}]"

# The patterns of the tweet tokenizer, in matching order.
_PUNCT = "['“\".?!,:;]"
_ENTITY = "&(?:amp|lt|gt|quot);"
# The first look-ahead only tells early where no link can start.
_URL = (r"\b(?=[a-z0-9\-]*+[.:])(?:https?://|www\.|[a-z0-9.\-]+?\.(?:com|co\.uk|org|net|info|ca)(?=\W))"
        rf"[^ {_FENCE}\t\r\n<>]*?"
        rf"(?=(?:(?:{_PUNCT}|{_ENTITY})+?)?(?:\.\.+|[<>]|{_GAP}|$))")
_TIME = r"\d+:\d+"
_DECIMAL = r"\d+\.\d+"
_GROUPED_NUMBER = r"(?:\d+,)+?\d{3}(?=[^,]|$)"
_AFTER_ABBREVIATION = rf"(?={_GAP}|[“\"?!,:;]|{_ENTITY})"
_ABBREVIATION = (rf"(?:[A-Za-z]\.){{2,}}{_AFTER_ABBREVIATION}"
                 rf"|(?:[A-Za-z]\.)+[A-Za-z]{_AFTER_ABBREVIATION}")
_SEPARATOR = "--+|―"
_DECORATION = "[♫]+"
# Where it fails at one character of a word it fails at the next, so it is tried after a gap or a match only.
_INNER_APOSTROPHE = rf"(?:\G|(?<={_GAP})){_INK}[^ {_FENCE}']*+'{_INK}++"
# A word of letters and digits holds nothing to protect: fenced as a whole, which leaves it one token.
_PLAIN_WORD = rf"(?<!{_INK})[\p{{L}}\p{{N}}]++(?!{_INK})"
_PROTECTED = "(?U)(?:" + "|".join([
    _PLAIN_WORD, _URL, _ENTITY, _TIME, _DECIMAL, _GROUPED_NUMBER, _PUNCT + "+", _ABBREVIATION, _SEPARATOR, _DECORATION,
    _INNER_APOSTROPHE]) + ")"
_EDGE = r"['\"“”‘’<>«»{}()\[\]]"
_EDGE_LEFT = rf"( |^)({_EDGE}+)([a-zA-Z0-9])"
_EDGE_RIGHT = rf"([a-zA-Z0-9])({_EDGE}+)({_GAP}|$)"
_POSSESSIVE = rf"(?<={_INK})'s(?!{_INK})"


def _fenced(text: Column) -> Column:
    """Squeezed text with fences between the tokens of a word, possessive endings apart.

    Edge punctuation and every protected stretch are fenced off; none of them
    can contain a blank.
    """
    s = squeeze_whitespace(text)
    s = F.regexp_replace(s, _EDGE_LEFT, f"$1$2{_FENCE}$3")
    s = F.regexp_replace(s, _EDGE_RIGHT, f"$1{_FENCE}$2$3")
    s = F.regexp_replace(s, _PROTECTED, f"{_FENCE}$0{_FENCE}")
    return F.regexp_replace(s, _POSSESSIVE, f"{_FENCE}$0")


def tweet_tokens(text: Column) -> Column:
    """Tweet tokens (X11)."""
    return F.filter(F.split(_fenced(text), f"{_GAP}+"), lambda w: w != "")


def _bind(value: Column, body) -> Column:
    """``body`` over a value that is evaluated once, not once per use."""
    return F.transform(F.array(value), body)[0]


def running_sums(xs: Column, block: int = 8) -> Column:
    """Sums of all leading stretches of an int array.

    Blocks are summed first; each entry then adds its block's offset and at
    most ``block`` values. Offsets are sums over blocks, found the same way
    once more, so long arrays stay cheap.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, v: a + v)

    def one_by_one(xs: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), 2, F.size(xs))

    def by_blocks(xs: Column, block: int, over) -> Column:
        def inside(v: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(v, b * block + 1, block)))
            return _bind(over(sums), lambda ends: F.flatten(F.transform(blocks, lambda b: _bind(
                F.slice(v, b * block + 1, block), lambda part: F.transform(
                    part, lambda x, i: F.element_at(ends, b + 1) - total(F.slice(part, i + 2, block)))))))

        return _bind(xs, lambda v: F.when(F.size(v) > 0, inside(v)).otherwise(F.array().cast("array<int>")))

    return by_blocks(xs, block, lambda sums: by_blocks(sums, 4 * block, one_by_one))


def aligned_tokens(text: Column) -> Column:
    """Array of (tok, start) structs, start counted from 0 in the squeezed text.

    Tokens keep every non-blank character in order, so a token starts where the
    previous one ended, or one blank later when it opens a word. That blank goes
    in front of the token; text and its pieces then have the same length.
    """
    joined = F.regexp_replace(_fenced(text), f"{_FENCE}* {_FENCE}*", f"{_FENCE} ")
    pieces = F.filter(F.split(joined, _FENCE), lambda p: p != "")

    def placed(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, F.length))
        return F.zip_with(pieces, ends, lambda p, end: _bind(F.ltrim(p), lambda tok: F.struct(
            tok.alias("tok"), (end - F.length(tok)).alias("start"))))

    return _bind(pieces, placed)


def pick_tokens(aligned: Column, indices: Column) -> Column:
    """Sub-list of an aligned token array by zero-based positions."""
    return F.transform(indices, lambda i: F.element_at(aligned, i + 1))


# Happy and sad faces.
_HAPPY = r"\^_\^|[:=](?:|o|O|-)[D)\]]"
_SAD = r"[:=](?:|o|O|-)[(\[]"


def emoticon_mood(text: Column) -> Column:
    """BOTH_HS, HAPPY, SAD or NA."""
    happy, sad = text.rlike(_HAPPY), text.rlike(_SAD)
    return (F.when(happy & sad, F.lit("BOTH_HS")).when(happy, F.lit("HAPPY"))
             .when(sad, F.lit("SAD")).otherwise(F.lit("NA")))


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams; empty array for shorter token lists."""
    return ngrams_up_to(tokens, n, n)


def ngrams_up_to(tokens: Column, n: int = 3, least: int = 1) -> Column:
    """All n-grams of ``least`` to ``n`` tokens; the token list is evaluated once."""

    def of_length(t: Column, k: int) -> Column:
        if k == 1:
            return t
        return F.when(F.size(t) >= k, F.transform(
            F.sequence(F.lit(0), F.size(t) - k),
            lambda i: F.array_join(F.slice(t, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))

    return _bind(tokens, lambda t: F.concat(*[of_length(t, k) for k in range(least, n + 1)]))


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores (X16 default)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes."""
    return F.encode(text, "UTF-8")
