"""Options of a count: modes, hints, hint rules, parts of a total. Driver-side only."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace

import regex

DEFAULT_LATIN, DEFAULT_HAN = "und-Latn", "und-Hani"
LONGEST_PATTERN = 256
MODES = ("chunk", "segments", "collector", "char", "char-collector")

#: Characters that hint at a language, first match wins.
LATIN_RULES = (
    ("de", "äöüÄÖÜß"),
    ("es", "ñÑ¿¡"),
    ("pt", "ãõÃÕ"),
    ("fr", "œŒæÆ"),
    ("pl", "ąćęłńśźżĄĆĘŁŃŚŹŻ"),
    ("tr", "ıİğĞşŞ"),
    ("ro", "ăĂâÂîÎșȘțȚ"),
    ("hu", "őŐűŰ"),
    ("is", "ðÐþÞ"),
)

_SINGLE = {"chunk": ("chunk", "chunks"), "segments": ("segments", "segment", "seg"), "collector": ("collector", "collect", "colle"), "char": ("char", "chars", "character", "characters")}
_ALIASES = {a: mode for mode, names in _SINGLE.items() for a in names}
_COLLECTORS = (*_SINGLE["collector"], "col")


def normalize_mode(value: str | None) -> str | None:
    """A mode by any of its names; a name of char and one of collector, in either order and
    joined by -, _, space or nothing, are char-collector. None if it is no mode."""
    name = (value or "").strip().lower()
    if name in _ALIASES or name == "char-collector":
        return _ALIASES.get(name, name)
    words = [w for w in re.split(r"[-_\s]+", name) if w]
    chars, collectors = set(_SINGLE["char"]), set(_COLLECTORS)
    if len(words) > 1 and set(words) <= chars | collectors and set(words) & chars and set(words) & collectors:
        return "char-collector"
    joined = "".join(words)
    if any(joined in (a + b, b + a) for a in chars for b in collectors):
        return "char-collector"
    return _ALIASES.get(joined)


def resolve_mode(value: str | None, otherwise: str = "chunk") -> str:
    return normalize_mode(value) or otherwise


@dataclass(frozen=True)
class HintRule:
    """A tag for Latin letters that match a pattern; higher priorities come first."""

    tag: str
    pattern: object
    priority: float | None = None


@dataclass(frozen=True)
class CountOptions:
    mode: str = "chunk"
    latin_language_hint: str | None = None
    latin_tag_hint: str | None = None
    latin_locale_hint: str | None = None
    latin_hint_rules: tuple[HintRule, ...] = ()
    use_default_latin_hints: bool = True
    han_language_hint: str | None = None
    han_tag_hint: str | None = None
    non_words: bool = False
    include_whitespace: bool = False

    def with_mode(self, mode: str) -> CountOptions:
        return replace(self, mode=mode)


@dataclass(frozen=True)
class Context:
    """What a segmentation needs of the options, compiled."""

    latin_hint: str | None
    han_hint: str | None
    rules: tuple[tuple[str, object], ...]
    latin_locales: frozenset[str] = field(default_factory=frozenset)

    def rule_tag(self, char: str) -> str | None:
        for tag, pattern in self.rules:
            if pattern.search(char):
                return tag
        return None


def first_given(*values: str | None) -> str | None:
    return next((v.strip() for v in values if v and v.strip()), None)


def compile_rule(rule: HintRule, label: str) -> tuple[str, object, float]:
    tag = rule.tag.strip() if isinstance(rule.tag, str) else ""
    if not tag:
        raise ValueError(f"{label}: tag must be a non-empty string.")
    source = rule.pattern if isinstance(rule.pattern, str) else getattr(rule.pattern, "pattern", "")
    if not source:
        raise ValueError(f"{label}: pattern must not be empty.")
    if len(source.encode("utf-16-le")) // 2 > LONGEST_PATTERN:
        raise ValueError(f"{label}: pattern must be at most {LONGEST_PATTERN} characters.")
    try:
        compiled = rule.pattern if not isinstance(rule.pattern, str) else regex.compile(source)
    except regex.error as error:
        raise ValueError(f"{label}: invalid Unicode regex pattern ({error}).") from None
    priority = 0.0 if rule.priority is None else rule.priority
    if isinstance(priority, bool) or not isinstance(priority, (int, float)) or not math.isfinite(priority):
        raise ValueError(f"{label}: priority must be a finite number when provided.")
    return tag, compiled, float(priority)


def resolve_context(options: CountOptions = CountOptions()) -> Context:
    compiled = [compile_rule(r, f"Invalid custom Latin hint rule at index {i}") for i, r in enumerate(options.latin_hint_rules)]
    if options.use_default_latin_hints:
        compiled += [(tag, regex.compile(f"[{chars}]"), 0.0) for tag, chars in LATIN_RULES]
    compiled.sort(key=lambda r: -r[2])
    latin = first_given(options.latin_tag_hint, options.latin_language_hint, options.latin_locale_hint)
    tags = {DEFAULT_LATIN, *(r[0] for r in compiled), *([latin] if latin else [])}
    return Context(latin, first_given(options.han_tag_hint, options.han_language_hint), tuple((t, p) for t, p, _ in compiled), frozenset(tags))


def load_rules(path: str) -> tuple[HintRule, ...]:
    """Hint rules of a JSON file: an array of {tag, pattern, priority?}."""
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
        except ValueError as error:
            raise ValueError(f"Failed to parse Latin hints file {path}: {error}") from None
    if not isinstance(data, list):
        raise ValueError(f"Latin hints file {path} must hold an array of rules.")
    out = []
    for i, item in enumerate(data):
        if not isinstance(item, dict):
            raise ValueError(f"{path}#{i}: a rule must be an object.")
        rule = HintRule(item.get("tag"), item.get("pattern"), item.get("priority"))
        compile_rule(rule, f"{path}#{i}")
        out.append(rule)
    return tuple(out)


PARTS = ("words", "emoji", "symbols", "punctuation", "whitespace")
_PART_NAMES = {p: p for p in PARTS} | {"word": "words", "emojis": "emoji", "symbol": "symbols", "punction": "punctuation"}


def parse_total_of(value: str) -> tuple[str, ...]:
    """Parts named in a comma list, each once, in order."""
    names = [v.strip().lower() for v in value.split(",")]
    names = [n for n in names if n]
    if not names:
        raise ValueError(f"total-of needs at least one of: {', '.join(PARTS)}.")
    unknown = [n for n in names if n not in _PART_NAMES]
    if unknown:
        raise ValueError(f"Invalid total-of part: {unknown[0]}. Known parts: {', '.join(PARTS)}.")
    return tuple(dict.fromkeys(_PART_NAMES[n] for n in names))


def needs_non_words(parts: tuple[str, ...]) -> bool:
    return any(p != "words" for p in parts)


def needs_whitespace(parts: tuple[str, ...]) -> bool:
    return "whitespace" in parts
