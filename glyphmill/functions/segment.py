"""Division of a text into chunks of one locale, by script and hint rules.

The state of the scan changes only where characters of another kind begin, so it
advances by runs of characters of one kind, found by a single expression.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import regex

from glyphmill.functions.options import DEFAULT_HAN, DEFAULT_LATIN, Context, CountOptions, resolve_context

#: White space as ECMAScript has it.
SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
STOPS = ",.!?;:，、。！？；：．｡､"
HARD = frozenset("\r\n" + STOPS)
BREAK = regex.compile(f"[{SPACE}{STOPS}]")
LAST_BREAK = regex.compile(f"(?r)[{SPACE}{STOPS}]")
#: Scripts that fix a locale, in the order of their tests.
SCRIPTS = (("ja", "hiragana-katakana", r"\p{Script=Hiragana}\p{Script=Katakana}"), ("ko", "hangul", r"\p{Script=Hangul}"), ("ar", "arabic", r"\p{Script=Arabic}"), ("ru", "cyrillic", r"\p{Script=Cyrillic}"), ("hi", "devanagari", r"\p{Script=Devanagari}"), ("th", "thai", r"\p{Script=Thai}"))
_ALL = "".join(s for *_, s in SCRIPTS)
NOT_LATIN = _ALL + r"\p{Script=Han}"
LATIN, OTHER = regex.compile(r"\p{Script=Latin}"), regex.compile(f"[{NOT_LATIN}]")
RUNS = regex.compile(
    "|".join(f"(?P<s{i}>[{s}]+)" for i, (*_, s) in enumerate(SCRIPTS))
    + r"|(?P<han>\p{Script=Han}+)|(?P<latin>\p{Script=Latin}" + f"[^{NOT_LATIN}\r\n{STOPS}]*)"
    + f"|(?P<hard>[\r\n{STOPS}]+)|(?P<other>[^{_ALL}\\p{{Script=Han}}\\p{{Script=Latin}}\r\n{STOPS}]+)",
    regex.DOTALL,
)
KINDS = {name: n for name, n in RUNS.groupindex.items()}


@dataclass
class Chunk:
    locale: str
    text: str
    source: str | None = None
    reason: str | None = None


@functools.lru_cache(maxsize=64)
def context_of(options: CountOptions) -> Context:
    return resolve_context(options)


@functools.lru_cache(maxsize=256)
def _letters(chars: str):
    return regex.compile(f"[{regex.escape(chars, literal_spaces=True)}]").finditer


def hinted(text: str, context: Context) -> list[tuple[int, int, str]]:
    """(start, end, tag) of the stretches of Latin letters that hint rules give a tag."""
    memo = _memo(context)
    tags = {c: t for c in set(text) if (t := memo[c])}
    if not tags:
        return []
    out: list[tuple[int, int, str]] = []
    for m in _letters("".join(sorted(tags)))(text):
        i, tag = m.start(), tags[m.group()]
        if out and out[-1][1] == i and out[-1][2] == tag:
            out[-1] = (out[-1][0], i + 1, tag)
        else:
            out.append((i, i + 1, tag))
    return out


class _Tags(dict):
    """A character's tag by the rules; None if it is no Latin letter or no rule has it."""

    def __init__(self, context: Context):
        super().__init__()
        self.context = context

    def __missing__(self, char: str) -> str | None:
        tag = self.context.rule_tag(char) if LATIN.match(char) else None
        self[char] = found = tag if tag != DEFAULT_LATIN else None
        return found


@functools.lru_cache(maxsize=64)
def _memo(context: Context) -> _Tags:
    return _Tags(context)


def scan(text: str, context: Context) -> list[Chunk]:
    """Chunks before adjacent ones of a locale are united. The current chunk is the text
    from `begin` on, so nothing is copied until it ends."""
    out: list[Chunk] = []
    locale, begin, scripted, bounded = DEFAULT_LATIN, 0, False, False
    trace: tuple[str | None, str | None] = (None, None)
    marks = hinted(text, context)
    if not marks and not context.latin_hint and (text.isascii() or not OTHER.search(text)):
        # no letter here votes for anything but undetermined Latin
        return [Chunk(locale, text, *(("fallback", "latin-fallback") if LATIN.search(text) else trace))] if text else []
    upto = 0

    def vote(at: int, found: str, how: tuple[str | None, str | None]) -> None:
        """Characters from `at` on vote for `found`."""
        nonlocal locale, begin, scripted, trace
        if begin == at or not scripted:
            locale, trace = found, how
        elif found != locale:
            cut = at
            if locale == DEFAULT_LATIN and found in context.latin_locales:
                # the word that the character is part of takes its locale
                last = LAST_BREAK.search(text, begin, at)
                cut = last.end() if last else begin
            if cut > begin:
                out.append(Chunk(locale, text[begin:cut], *trace))
            locale, begin, trace = found, cut, how
        scripted = True

    def plain(at: int) -> None:
        """A Latin letter without a hint, and what follows without one."""
        nonlocal bounded
        if not bounded and locale in context.latin_locales and locale != DEFAULT_LATIN:
            vote(at, locale, ("hint", "latin-locale-carry"))
        elif context.latin_hint:
            vote(at, context.latin_hint, ("hint", "explicit-latin-hint"))
        else:
            vote(at, DEFAULT_LATIN, ("fallback", "latin-fallback"))
        bounded = False

    for m in RUNS.finditer(text):
        kind, start = m.lastgroup, m.start()
        if kind == "other":
            continue
        if kind == "hard":
            bounded = True
        elif kind == "latin":
            # a Latin letter and what follows it, up to a boundary or another script
            end = m.end()
            if upto == len(marks) or marks[upto][0] > start:
                plain(start)  # later ones follow a hinted letter, whose locale they take
            while upto < len(marks) and marks[upto][0] < end:
                vote(marks[upto][0], marks[upto][2], ("hint", "latin-hint-rule"))
                bounded = False
                upto += 1
        elif kind == "han":
            if not bounded and locale.startswith("ja"):
                vote(start, locale, ("script", "japanese-han-carry"))
            elif context.han_hint:
                vote(start, context.han_hint, ("hint", "explicit-han-hint"))
            else:
                after = bounded and locale.startswith("ja")
                vote(start, DEFAULT_HAN, ("fallback", "han-fallback-after-boundary" if after else "han-fallback"))
            bounded = False
        else:
            tag, reason, _ = SCRIPTS[int(kind[1:])]
            vote(start, tag, ("script", reason))
            bounded = False
    if text:
        out.append(Chunk(locale, text[begin:], *trace))
    return out


def unite(chunks: list[Chunk]) -> list[Chunk]:
    """Adjacent chunks of a locale as one, with the first one's trace."""
    out: list[Chunk] = []
    for c in chunks:
        if out and out[-1].locale == c.locale:
            out[-1] = Chunk(c.locale, out[-1].text + c.text, out[-1].source, out[-1].reason)
        else:
            out.append(c)
    return out


def segment(text: str, options: CountOptions = CountOptions()) -> list[Chunk]:
    """Chunks of a text; their texts joined are the text."""
    return unite(scan(text, context_of(options)))
