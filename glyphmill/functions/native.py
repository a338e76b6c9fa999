"""Counts as Catalyst expressions. Those of words hold for text whose letters are all
Latin (`latin_only`); graphemes and white space hold for any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.patterns import FAST_WORD as WORD

#: What the word pattern or the simple segment count can't judge: letters of other
#: scripts, marks, emoji and what joins them, runs of underscores.
DIFFICULT = r"[[^\p{IsLatin}\P{L}]\p{M}\p{Nl}\p{Cf}\p{Co}\p{Cs}\x{200D}\x{FE0F}\x{20E3}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]|__"
SPACE_CLASS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def latin_only(text: Column) -> Column:
    return ~text.rlike(DIFFICULT)


def words(text: Column) -> Column:
    return matches(text, WORD)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def graphemes(text: Column) -> Column:
    return matches(text, r"\X")


def between_words(text: Column) -> Column:
    return F.regexp_replace(text, WORD, "")


def punctuation(text: Column) -> Column:
    return matches(between_words(text), r"\p{P}")


def symbols(text: Column) -> Column:
    return matches(between_words(text), r"\p{S}")


def whitespace(text: Column) -> dict[str, Column]:
    """spaces, tabs, newlines and other, by code point."""
    every = matches(text, SPACE_CLASS)
    named = {"spaces": matches(text, " "), "tabs": matches(text, r"\t"), "newlines": matches(text, r"[\n\r\x{2028}\x{2029}]")}
    return named | {"other": every - named["spaces"] - named["tabs"] - named["newlines"]}


def preview(text: Column, width: int = 160) -> Column:
    """The first code points of a text on one line."""
    return F.left(collapsed(text), F.lit(width))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE_CLASS}+", " "), "^ | $", "")


def latin_sample(text: Column) -> Column:
    """A text with all but Latin letters blanked, on one line."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{IsLatin}]+", " "), "^ | $", "")


def plural(n: Column, one: str = "word") -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(one + "s"))
