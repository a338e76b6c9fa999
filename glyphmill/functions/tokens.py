"""Words, graphemes and what lies between words, by Unicode's default boundaries."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

from glyphmill.functions.segment import SPACE

#: Segments between default word boundaries, with sequences that one character is drawn
#: by (keycaps, emoji with joiners, flags) and runs of blanks kept together.
_KEYCAP = r"[0-9#*]️?⃣"
_EMOJI = r"(?:\p{Extended_Pictographic}|\p{Emoji_Presentation})[️\p{Emoji_Modifier}]*\p{M}*(?:‍(?:\p{Extended_Pictographic}|\p{Emoji_Presentation})[️\p{Emoji_Modifier}]*\p{M}*)*"
_FLAG = r"\p{Regional_Indicator}{2}"
SPECIAL = regex.compile(f"{_KEYCAP}|{_FLAG}|(?![0-9#*]){_EMOJI}")
BOUNDARY = regex.compile(r"(?w)\b")
WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{Nd}]|__")
KEYCAP = regex.compile(_KEYCAP)
PRESENTED = regex.compile(r"\p{Emoji_Presentation}")
PICTOGRAPH = regex.compile(r"\p{Extended_Pictographic}|\p{Emoji_Presentation}")
SYMBOL, PUNCTUATION = regex.compile(r"\p{S}"), regex.compile(r"\p{P}")
GRAPHEME = regex.compile(r"\X")
SPACES = regex.compile(f"[{SPACE}]")
NEWLINES = frozenset("\n\r  ")


def plain_segments(text: str):
    at = 0
    for m in BOUNDARY.finditer(text):
        if m.start() > at:
            yield from quote_apart(text[at : m.start()])
            at = m.start()
    if at < len(text):
        yield from quote_apart(text[at:])


def quote_apart(part: str):
    """A segment; an apostrophe before a vowel, which the engine keeps with it, apart: it joins
    letters on both sides only."""
    if part[0] in "'’" and len(part) > 1 and part[1].isalpha():
        yield part[0]
        part = part[1:]
    yield part


def segments(text: str):
    """(segment, is a word) of a text, in order."""
    if text.isascii():
        for part in plain_segments(text):
            yield part, WORDLIKE.search(part) is not None
        return
    at = 0
    for m in SPECIAL.finditer(text):
        for part in plain_segments(text[at : m.start()]):
            yield part, WORDLIKE.search(part) is not None
        yield m.group(), False
        at = m.end()
    for part in plain_segments(text[at:]):
        yield part, WORDLIKE.search(part) is not None


def word_list(text: str) -> list[str]:
    return [s for s, word in segments(text) if word]


def count_words(text: str) -> int:
    return len(word_list(text))


def count_graphemes(text: str) -> int:
    return len(text) if text.isascii() and "\r" not in text else sum(1 for _ in GRAPHEME.finditer(text))


def category(segment: str) -> str | None:
    """emoji, symbols, punctuation or None of a segment that is no word."""
    if KEYCAP.search(segment) or PRESENTED.search(segment) or "️" in segment and PICTOGRAPH.search(segment):
        return "emoji"
    return "symbols" if SYMBOL.search(segment) else "punctuation" if PUNCTUATION.search(segment) else None


@dataclass
class Whitespace:
    spaces: int = 0
    tabs: int = 0
    newlines: int = 0
    other: int = 0

    def total(self) -> int:
        return self.spaces + self.tabs + self.newlines + self.other

    def add(self, text: str) -> int:
        before = self.total()
        for c in SPACES.findall(text):
            if c == " ":
                self.spaces += 1
            elif c == "\t":
                self.tabs += 1
            elif c in NEWLINES:
                self.newlines += 1
            else:
                self.other += 1
        return self.total() - before


@dataclass
class NonWords:
    """Segments that aren't words by category; white space by code point."""

    emoji: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    punctuation: list[str] = field(default_factory=list)
    whitespace: Whitespace | None = None

    def add(self, segment: str, whitespace: bool) -> bool:
        """Adds a segment; whether it counts as anything."""
        blanks = 0
        if whitespace:
            own = self.whitespace or Whitespace()
            blanks = own.add(segment)
            if blanks:
                self.whitespace = own
        kind = category(segment)
        if kind:
            getattr(self, kind).append(segment)
        return bool(kind or blanks)

    def merge(self, other: NonWords) -> None:
        self.emoji += other.emoji
        self.symbols += other.symbols
        self.punctuation += other.punctuation
        if other.whitespace:
            w = self.whitespace = self.whitespace or Whitespace()
            for name in ("spaces", "tabs", "newlines", "other"):
                setattr(w, name, getattr(w, name) + getattr(other.whitespace, name))

    def counts(self) -> dict[str, int]:
        out = {"emoji": len(self.emoji), "symbols": len(self.symbols), "punctuation": len(self.punctuation)}
        return out | ({"whitespace": self.whitespace.total()} if self.whitespace else {})

    def total(self) -> int:
        return sum(self.counts().values())

    def as_dict(self) -> dict:
        out: dict = {"emoji": self.emoji, "symbols": self.symbols, "punctuation": self.punctuation, "counts": self.counts()}
        if self.whitespace:
            out["whitespace"] = vars(self.whitespace).copy()
        return out
