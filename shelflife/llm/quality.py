"""Line-first cleaning with DataFrame functions only.

Lines that fail a punctuation, navigation or boilerplate rule go; a document
that loses too much of its text with them is rejected. A null text has no lines
and fails the base rules, as do texts under `MIN_WORDS` words. Every row is judged by
itself, repeated ones alike. Other columns pass through, but one named `quality` is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST = 0.5
MAX_MARKS = 0.12
WINDOW = 8

_SPACES = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: A sentence ends somewhere in the line.
_SENTENCE_END = r"""[.!?…。][\"')\]»”]*([\x20\x09-\x0D]|$)"""
_MARKS = r"[\p{P}\p{S}]"
#: Separators between the entries of a menu or a path.
_SEPARATORS = r"[|›»•>]"
_BOILERPLATE = (
    r"(?i)all rights reserved|copyright|©|\blicensed under\b|\breleased under the\b"
    r"|\bcookies?\b|privacy policy|terms of (use|service)|\bsubscribe\b|\bsign (up|in)\b"
    r"|\blog in\b|click here|read more|javascript"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: as a lambda variable it isn't
    copied into the places that use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that are found twice or more."""

    def covered(hashes: Column) -> Column:
        def positions(pairs: Column) -> Column:
            def twice(pair: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(pairs, j)["h"] == pair["h"], F.lit(False))
                return same(i + 1) | F.when(i > 0, same(i - 1)).otherwise(False)

            return F.sort_array(F.transform(F.filter(pairs, twice), lambda p: p["i"]))

        def total(at: Column) -> Column:
            step = lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))
            return F.aggregate(
                F.transform(at, step), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")
            )

        pairs = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            let(pairs, lambda p: let(positions(p), total)),
        ).otherwise(F.lit(0).cast("long"))

    def windows(each: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(each) - window)
        return F.transform(first, lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(window)]))

    hashes = lambda each: let(windows(each), covered)
    return F.when(
        F.size(words) >= window, let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    ).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate, for a line with a word."""
    chars = F.length(line)
    sentence = F.regexp_like(line, F.lit(_SENTENCE_END))
    crowded = F.regexp_count(line, F.lit(_MARKS)) > MAX_MARKS * chars
    menu = F.regexp_count(line, F.lit(_SEPARATORS)) >= 3
    return ~sentence | crowded | menu | F.regexp_like(line, F.lit(_BOILERPLATE))


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """docs and a struct `quality`: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, clean_text (the lines that passed, joined by
    newlines), lost (share of word characters in removed lines) and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # No characters but words: an empty array instead of one empty word.
    word_list = lambda t: F.filter(F.split(t, _SPACE_RUN), lambda w: w != "")
    has_word = lambda line: F.length(_without(line, _SPACES)) > 0
    lines = F.filter(F.split(text, "\n"), has_word)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(each: Column) -> Column:
        kept = F.filter(each, lambda line: ~line_fails(line))
        return let(
            kept,
            lambda k: F.struct(
                (F.size(each) - F.size(F.array_distinct(each))).cast("long").alias("n_dup_lines"),
                F.array_join(k, "\n").alias("clean_text"),
            ),
        )

    counted = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), "text").select(
        "_doc", "text", let(word_list(text), of_words).alias("_w"), let(lines, of_lines).alias("_l")
    )
    word_chars = _length(_without(text, _SPACES))
    left = _length(_without(F.col("_l.clean_text"), _SPACES))
    n_words, repeats = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    lost = F.when(word_chars > 0, 1 - left / word_chars).otherwise(F.lit(0.0))
    quality = F.struct(
        n_words.alias("n_words"),
        word_chars.alias("word_chars"),
        (_length(text) - _length(_without(text, _SYMBOLS))).alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("_l.clean_text").alias("clean_text"),
        lost.alias("lost"),
        (~failed & (lost <= max_lost)).alias("kept"),
    )
    kept = [F.col(f"_doc.`{c}`") for c in docs.columns if c != "quality"]
    return counted.select(*kept, quality.alias("quality"))
