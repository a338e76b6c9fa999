"""Measures of a chunk in one pass, as numbers."""

from __future__ import annotations

import unicodedata
from collections import Counter

import regex

from glyphmill.functions.patterns import DIFFICULT, FAST_WORD
from glyphmill.functions.segment import SPACE
from glyphmill.functions.tokens import NEWLINES, NonWords, Whitespace, count_graphemes, segments, word_list

#: Names of what measure() gives, in order.
MEASURES = ("words", "word_chars", "emoji", "symbols", "punctuation", "spaces", "tabs", "newlines", "other", "non_word_chars")
_remove, _find, _hard = regex.compile(FAST_WORD).subn, regex.compile(FAST_WORD).findall, regex.compile(DIFFICULT).search


class _Kinds(dict):
    """Place in MEASURES of what a character between words counts as; -1 if as nothing."""

    def __missing__(self, c: str) -> int:
        kind = unicodedata.category(c)[0]
        if c in SPACE:
            found = 5 if c == " " else 6 if c == "\t" else 7 if c in NEWLINES else 8
        else:
            found = {"S": 3, "P": 4}.get(kind, -1)
        self[c] = found
        return found


_kinds = _Kinds()


def simple(text: str) -> bool:
    """Whether the word pattern and counts of characters give what the kernel would."""
    return "__" not in text if text.isascii() else _hard(text) is None


def tokens(text: str, easy: bool) -> list[str]:
    return _find(text) if easy else word_list(text)


def measure(text: str, easy: bool, whitespace: bool) -> list[int]:
    """MEASURES of a text; easy is whether it is simple()."""
    out = [0] * len(MEASURES)
    if easy:
        bare, out[0] = _remove("", text)
        out[1] = len(text) - len(bare)
        for c, n in Counter(bare).items():
            at = _kinds[c]
            if at >= 0:
                out[at] += n
                if at < 5 or whitespace:
                    out[9] += n
        if whitespace:
            out[9] -= text.count("\r\n")  # one grapheme
        return out
    found, blanks = NonWords(), Whitespace()
    for part, is_word in segments(text):
        if is_word:
            out[0] += 1
            out[1] += count_graphemes(part)
        elif found.add(part, whitespace):
            out[9] += count_graphemes(part)
    blanks.add(text)
    out[2:9] = len(found.emoji), len(found.symbols), len(found.punctuation), blanks.spaces, blanks.tabs, blanks.newlines, blanks.other
    return out
