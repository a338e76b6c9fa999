"""Counts of one text in the five modes, and merging of such results."""

from __future__ import annotations

from dataclasses import dataclass, field

from glyphmill.functions.options import CountOptions, resolve_mode
from glyphmill.functions.segment import Chunk, segment
from glyphmill.functions.tokens import NonWords, count_graphemes, segments


@dataclass
class Item:
    locale: str
    text: str | None = None
    words: int | None = None
    chars: int | None = None
    segments: list[str] | None = None
    non_words: NonWords | None = None


@dataclass
class Result:
    total: int
    mode: str
    items: list[Item]
    counts: dict[str, int] | None = None
    non_words: NonWords | None = None


@dataclass
class Analysis:
    chunk: Chunk
    words: list[str] = field(default_factory=list)
    word_chars: int = 0
    other_chars: int = 0
    non_words: NonWords | None = None


def analyse(chunk: Chunk, options: CountOptions, chars: bool) -> Analysis:
    out = Analysis(chunk, non_words=NonWords() if options.non_words else None)
    for part, is_word in segments(chunk.text):
        if is_word:
            out.words.append(part)
            if chars:
                out.word_chars += count_graphemes(part)
        elif out.non_words is not None and out.non_words.add(part, options.include_whitespace) and chars:
            out.other_chars += count_graphemes(part)
    return out


def shape(chunks: list[Chunk], options: CountOptions = CountOptions()) -> Result:
    """The result of chunks in the options' mode."""
    mode = resolve_mode(options.mode)
    chars = mode in ("char", "char-collector")
    parts = [analyse(c, options, chars) for c in chunks]
    words = sum(p.word_chars if chars else len(p.words) for p in parts)
    others = sum((p.other_chars if chars else p.non_words.total()) for p in parts if p.non_words is not None)
    counts = {"words": words, "nonWords": others, "total": words + others} if options.non_words else None
    result = Result(words + others, mode, [], counts)
    if mode in ("char", "chunk", "segments"):
        for p in parts:
            item = Item(p.chunk.locale, p.chunk.text, non_words=p.non_words)
            if chars:
                item.chars = p.word_chars + p.other_chars
            else:
                item.words = len(p.words)
                item.segments = p.words if mode == "segments" else None
            result.items.append(item)
        return result
    by: dict[str, Item] = {}
    if mode == "collector" and options.non_words:
        result.non_words = NonWords()
    for p in parts:
        item = by.setdefault(p.chunk.locale, Item(p.chunk.locale))
        if chars:
            item.chars = (item.chars or 0) + p.word_chars + p.other_chars
            if p.non_words is not None:
                item.non_words = item.non_words or NonWords()
                item.non_words.merge(p.non_words)
        else:
            item.words = (item.words or 0) + len(p.words)
            item.segments = (item.segments or []) + p.words
            if p.non_words is not None:
                result.non_words.merge(p.non_words)
    result.items = list(by.values())
    return result


def count(text: str, options: CountOptions = CountOptions()) -> Result:
    return shape(segment(text, options), options)


def merge(results: list[Result]) -> Result:
    """Results in order as one; collectors by locale in order of first appearance."""
    if not results:
        return count("")
    if len({r.mode for r in results}) > 1:
        raise ValueError("Cannot merge different breakdown modes.")
    mode = results[0].mode
    out = Result(sum(r.total for r in results), mode, [])
    known = [r.counts for r in results if r.counts]
    if known:
        out.counts = {k: sum(c[k] for c in known) for k in ("words", "nonWords", "total")}
    if mode not in ("collector", "char-collector"):
        out.items = [i for r in results for i in r.items]
        return out
    by: dict[str, Item] = {}
    for r in results:
        if r.non_words is not None:
            out.non_words = out.non_words or NonWords()
            out.non_words.merge(r.non_words)
        for i in r.items:
            own = by.setdefault(i.locale, Item(i.locale))
            if i.words is not None:
                own.words = (own.words or 0) + i.words
                if i.segments is not None:
                    own.segments = (own.segments or []) + i.segments
            if i.chars is not None:
                own.chars = (own.chars or 0) + i.chars
            if i.non_words is not None:
                own.non_words = own.non_words or NonWords()
                own.non_words.merge(i.non_words)
    out.items = list(by.values())
    return out


def total_of(result: Result, parts: tuple[str, ...]) -> int:
    """Sum of the chosen parts."""
    kept = [result.non_words] if result.mode == "collector" else [i.non_words for i in result.items]
    out = 0
    for part in parts:
        if part == "words":
            out += result.counts["words"] if result.counts else result.total
        else:
            out += sum(n.counts().get(part, 0) for n in kept if n is not None)
    return out


def base_output(result: Result) -> Result:
    """The result as if non-words, collected for total_of() alone, hadn't been."""
    if not result.counts:
        return result
    items = []
    for i in result.items:
        chars = None if i.chars is None else max(0, i.chars - (i.non_words.total() if i.non_words else 0))
        items.append(Item(i.locale, i.text, i.words, chars, i.segments))
    return Result(result.counts["words"], result.mode, items)


def without_segments(result: Result) -> Result:
    """A collector's result without its words, for outputs that don't show them."""
    if result.mode != "collector":
        return result
    items = [Item(i.locale, i.text, i.words, i.chars, None, i.non_words) for i in result.items]
    return Result(result.total, result.mode, items, result.counts, result.non_words)


def as_dict(result: Result) -> dict:
    """The result as its JSON form has it: what wasn't collected is absent."""
    items = []
    for i in result.items:
        d = {k: v for k, v in (("locale", i.locale), ("text", i.text), ("words", i.words), ("chars", i.chars), ("segments", i.segments)) if v is not None}
        if i.non_words is not None:
            d["nonWords"] = i.non_words.as_dict()
        items.append(d)
    breakdown: dict = {"mode": result.mode, "items": items}
    if result.non_words is not None:
        breakdown["nonWords"] = result.non_words.as_dict()
    out: dict = {"total": result.total}
    if result.counts:
        out["counts"] = result.counts
    return out | {"breakdown": breakdown}
