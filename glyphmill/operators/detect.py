"""Refining ambiguous chunks by language identification under a policy.

Chunks of undetermined Latin or Han are windows. A window must be long enough and read
like prose before the engine sees it; what the engine says must be sure enough, or be
borne out by a second look at the normalised text, before the window takes its tag.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.counting import Result, shape
from glyphmill.functions.language import Guess, identify, tag_of
from glyphmill.functions.options import DEFAULT_HAN, DEFAULT_LATIN, CountOptions, resolve_context
from glyphmill.functions.segment import SPACE, Chunk, segment, unite
from glyphmill.operators.frames import through_arrow

GATES = ("default", "strict", "loose", "off")
LATIN_CHARS = {"default": 24, "off": 24, "strict": 30, "loose": 20}
HAN_CHARS = {"default": 12, "off": 12, "strict": 16, "loose": 4}
SURE = {DEFAULT_LATIN: 0.75, DEFAULT_HAN: 0.90}
BORNE_OUT = 0.70
LATIN, HAN, CJ = regex.compile(r"\p{Script=Latin}"), regex.compile(r"\p{Script=Han}"), regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]")
RUN = regex.compile(r"\p{Script=Latin}+")
BLANKS = regex.compile(f"[{SPACE}]+")
#: What a window's normal form leaves out, by route.
DROPPED = {DEFAULT_LATIN: regex.compile(r"[^\p{Script=Latin}]+"), DEFAULT_HAN: regex.compile(r"[^\p{Script=Han}]+")}
TECHNICAL = (
    regex.compile(r"^[>#$]"),
    regex.compile(r"(?i)(?:^|\s)--[a-z0-9][a-z0-9-]*"),
    regex.compile(r"`[^`]+`"),
    regex.compile(r"(?i)(?:^|[\s\"'`])(?:\.{0,2}/)?[A-Za-z0-9_./-]+\.[a-z0-9]{1,6}(?=$|[\s\"'`])"),
)
FIELD = regex.compile(r"^[-*0-9.)\s]*[\p{L}\p{N}_.-]+:\s+\S")


def least_chars(route: str, gate: str = "default") -> int:
    return (LATIN_CHARS if route == DEFAULT_LATIN else HAN_CHARS)[gate]


@dataclass(frozen=True)
class Sample:
    """A window's text, what the engine reads, and its normal form."""

    focus: str
    text: str
    normal: str
    borrowed: bool = False


def normalize(text: str, route: str) -> str:
    return DROPPED[route].sub(" ", text).strip(" ")


def sample_of(chunks: list[Chunk], at: int) -> Sample:
    """The sample of the window at a chunk; Han windows borrow adjacent Japanese."""
    focus, route = chunks[at].text, chunks[at].locale
    text = focus
    if route == DEFAULT_HAN:
        if at and chunks[at - 1].locale == "ja":
            text = chunks[at - 1].text + text
        if at + 1 < len(chunks) and chunks[at + 1].locale == "ja":
            text += chunks[at + 1].text
    return Sample(focus, text, normalize(text, route), text != focus)


def eligibility(sample: Sample, route: str, gate: str = "default") -> tuple[int, int, bool]:
    """(characters of the route's script, the least that is needed, whether that is met)."""
    if route == DEFAULT_LATIN:
        n = sum(map(len, RUN.findall(sample.text)))
    elif gate == "loose":
        n = len(HAN.findall(sample.focus))
    else:
        n = len(CJ.findall(sample.text))
    return n, least_chars(route, gate), n >= least_chars(route, gate)


DOTTED = regex.compile(r"\.[A-Za-z0-9]")


def technical(line: str, words: int) -> bool:
    """Whether a line is a prompt, a flag, code or a path, or a short field. What each of the
    expressions can't do without is looked for first."""
    prompt, flag, code, path = TECHNICAL
    if prompt.match(line) or "--" in line and flag.search(line) or "`" in line and code.search(line) or DOTTED.search(line) and path.search(line):
        return True
    return words <= 8 and ":" in line and FIELD.search(line) is not None


def content_gate(sample: Sample, route: str, gate: str = "default") -> bool:
    """Whether a Latin sample reads like prose; Han samples and gate off always pass."""
    if route != DEFAULT_LATIN or gate == "off":
        return True
    if (sample.normal.count(" ") + 1 if sample.normal else 0) < (5 if gate == "strict" else 4):
        return False
    prose = tech = 0
    block: list[tuple[int, bool]] = []

    def close() -> int:
        words = sum(n for n, _ in block)
        enough = words >= 4 and (any(s for _, s in block) or words >= (5 if len(block) <= 1 else 8))
        block.clear()
        return words if enough else 0

    for raw in sample.text.replace("\r\n", "\n").split("\n"):
        line = raw.strip(SPACE)
        if line in ("", "---", "```"):
            prose += close()
            continue
        words = len(RUN.findall(line))
        if not words:
            continue
        if technical(line, words):
            prose += close()
            tech += words
        else:
            block.append((words, bool(regex.search(r"[.!?]", line))))
    prose += close()
    return prose >= {"default": 4, "strict": 5, "loose": 3}[gate] and prose + (2 if gate == "loose" else 0) >= tech


def sure(guess: Guess, route: str) -> bool:
    return guess.reliable and guess.confidence >= SURE[route]


def borne_out(raw: tuple[str, Guess] | None, normal: tuple[str, Guess] | None) -> tuple[bool, float, str | None]:
    """(accepted, confidence, reason if not) of two looks at a Latin window."""
    if not raw or not normal or raw[0] != normal[0]:
        return False, 0.0, "mismatch"
    top = max(raw[1].confidence, normal[1].confidence)
    if top < BORNE_OUT:
        return False, top, "belowThreshold"
    if not (raw[1].reliable or normal[1].reliable):
        return False, top, "unreliable"
    return True, top, None


@dataclass
class Decision:
    """What became of a window."""

    index: int
    chunk: int
    route: str
    sample: Sample
    script_chars: int
    eligible: bool
    gate_passed: bool
    raw: Guess | None
    normal: Guess | None
    accepted: bool
    path: str
    final_tag: str
    reason: str | None
    #: Locales of the chunks that a fallback becomes.
    final_locales: tuple[str, ...] = ()


def decide(chunks: list[Chunk], gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> list[Decision]:
    out = []
    for at, c in enumerate(chunks):
        if c.locale not in SURE:
            continue
        route, sample = c.locale, sample_of(chunks, at)
        n, _, enough = eligibility(sample, route, gate)
        passed = content_gate(sample, route, gate)
        d = Decision(len(out), at, route, sample, n, enough, passed, None, None, False, "fallback", route, None)
        out.append(d)
        if not enough:
            d.reason = "notEligible"
            continue
        d.raw = engine(sample.text)
        if sample.normal and sample.normal != sample.text:
            # our engine reads the Latin words alone where there is no kana and Han
            same = engine is identify and route == DEFAULT_LATIN and not CJ.search(sample.text)
            d.normal = d.raw if same else engine(sample.normal)
        looks = [(t, g) for g in (d.raw, d.normal) if (t := tag_of(g, route))]
        if not looks:
            d.reason = "noCandidate"
            continue
        best = max(looks, key=lambda x: x[1].confidence)
        if passed and sure(best[1], route):
            d.accepted, d.path, d.final_tag = True, "reliable", best[0]
            continue
        why = None
        if passed and route == DEFAULT_LATIN and len(looks) == 2:
            fine, _, why = borne_out(*looks)
            if fine:
                d.accepted, d.path, d.final_tag = True, "corroborated", looks[0][0]
                continue
        d.reason = "corroborationUnreliable" if why == "unreliable" else "qualityGate" if not passed else "belowThreshold"
    return out


def deferred(options: CountOptions) -> CountOptions:
    """Options without Latin hints, which wait until windows are decided."""
    return replace(options, latin_language_hint=None, latin_tag_hint=None, latin_locale_hint=None, latin_hint_rules=(), use_default_latin_hints=False)


def detect(text: str, options: CountOptions = CountOptions(), gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> tuple[list[Chunk], list[Decision]]:
    """(chunks, decisions): accepted windows take their tag, hint rules apply within them,
    and what stays undetermined Latin is divided by the original options."""
    if gate not in GATES:
        raise ValueError(f"Unknown content gate: {gate}.")
    resolve_context(options)
    before = segment(text, deferred(options))
    decisions = decide(before, gate, engine)
    taken = {d.chunk: d for d in decisions if d.accepted}
    asked = {d.chunk: d for d in decisions}
    rules_only = replace(options, latin_language_hint=None, latin_tag_hint=None, latin_locale_hint=None)
    out: list[Chunk] = []
    for at, c in enumerate(before):
        d = taken.get(at)
        if d and d.route == DEFAULT_LATIN:
            out += [replace(p, locale=d.final_tag) if p.locale == DEFAULT_LATIN else p for p in segment(c.text, rules_only)]
        elif d:
            out.append(replace(c, locale=d.final_tag))
        elif c.locale == DEFAULT_LATIN:
            pieces = segment(c.text, options)
            locales = tuple(dict.fromkeys(p.locale for p in pieces))
            asked[at].final_locales = locales
            out += pieces
        else:
            out.append(c)
    return unite(out), decisions


def count_traced(text: str, options: CountOptions = CountOptions(), gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> tuple[Result, list[Decision]]:
    """(counts over detected chunks, the decisions behind them)."""
    chunks_, decisions = detect(text, options, gate, engine)
    return shape(chunks_, options), decisions


def counters(decisions: list[Decision]) -> dict[str, int]:
    """Windows by route, acceptances by path and fallbacks by reason, of one text."""
    out: dict[str, int] = {"windows": len(decisions)}
    for d in decisions:
        for name in (f"route.{d.route}", f"accepted.{d.path}" if d.accepted else f"fallback.{d.reason}"):
            out[name] = out.get(name, 0) + 1
    return out


def evidence(d: Decision, verbose: bool = False) -> dict:
    """A decision as a debug event: previews, or whole texts if verbose."""
    look = lambda g: None if g is None else vars(g).copy()
    out = {"windowIndex": d.index, "routeTag": d.route, "scriptChars": d.script_chars, "eligible": d.eligible, "gatePassed": d.gate_passed, "qualityGate": d.gate_passed, "raw": look(d.raw), "normalized": look(d.normal), "accepted": d.accepted, "path": d.path, "finalTag": d.final_locales[0] if len(d.final_locales) == 1 else d.final_tag, "fallbackReason": d.reason}
    if len(d.final_locales) > 1:
        out["finalLocales"] = list(d.final_locales)
    for name, text in (("text", d.sample.text), ("normalized", d.sample.normal)):
        if verbose:
            out[f"{name}Text"] = text
        else:
            short = BLANKS.sub(" ", text).strip(SPACE)
            out[f"{name}Preview"], out[f"{name}PreviewTruncated"] = short[:160], len(short) > 160
    return out


def count(text: str, options: CountOptions = CountOptions(), gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> Result:
    """Counts over detected chunks."""
    return shape(detect(text, options, gate, engine)[0], options)


def resolve(df: DataFrame, text: str = "text", options: CountOptions = CountOptions(), gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> DataFrame:
    """A row for each window of each document with its evidence and decision."""
    if gate not in GATES:
        raise ValueError(f"Unknown content gate: {gate}.")
    resolve_context(options)
    before = deferred(options)

    def rows(value: str):
        for d in decide(segment(value, before), gate, engine):
            look = d.raw or d.normal
            yield d.index, d.chunk, d.route, d.script_chars, d.eligible, d.gate_passed, look.lang if look else None, str(look.confidence) if look else None, look.reliable if look else None, d.accepted, d.path, d.final_tag, d.reason, BLANKS.sub(" ", d.sample.text).strip(SPACE)[:160]

    fields = "window_index int, chunk_index int, route_tag string, script_chars int, eligible boolean, gate_passed boolean, lang string, confidence_text string, reliable boolean, accepted boolean, path string, final_tag string, fallback_reason string, preview string"
    out = through_arrow(df, text, fields, rows)
    return out.withColumn("confidence", F.col("confidence_text").cast("double")).drop("confidence_text")


def chunks(df: DataFrame, text: str = "text", options: CountOptions = CountOptions(), gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> DataFrame:
    """A row for each detected chunk: df's other columns, chunk_index, locale, text."""
    rows = lambda value: ((i, c.locale, c.text) for i, c in enumerate(detect(value, options, gate, engine)[0]))
    return through_arrow(df, text, "chunk_index int, locale string, chunk_text string", rows).withColumnRenamed("chunk_text", "text")


def summary(decisions: DataFrame) -> DataFrame:
    """Counters of windows by route, acceptances by path and fallbacks by reason."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    reasons = ("notEligible", "noCandidate", "corroborationUnreliable", "qualityGate", "belowThreshold")
    return decisions.agg(
        F.count("*").alias("windows"), n(F.col("route_tag") == DEFAULT_LATIN, "latin_windows"), n(F.col("route_tag") == DEFAULT_HAN, "han_windows"), n(F.col("accepted"), "accepted"),
        n(F.col("path") == "reliable", "reliable"), n(F.col("path") == "corroborated", "corroborated"), *(n(F.col("fallback_reason") == r, r) for r in reasons),
    )


def inspect(text: str, options: CountOptions = CountOptions(), detector: str = "model", view: str = "pipeline", gate: str = "default", engine: Callable[[str], Guess | None] = identify) -> dict:
    """Evidence for one text: chunks with their reasons, windows and decisions; with view
    engine, what the engine says of the first window, without policy."""
    if detector not in ("script", "model"):
        raise ValueError(f"Unknown detector: {detector}.")
    if view == "engine" and detector == "script":
        raise ValueError("The engine view needs the model detector.")
    head = {"detector": detector, "view": view, "input": {"textLength": len(text.encode("utf-16-le")) // 2, "preview": BLANKS.sub(" ", text).strip(SPACE)[:160]}}
    traced = lambda cs: [{"index": i, "locale": c.locale, "text": c.text, "source": c.source, "reason": c.reason} for i, c in enumerate(cs)]
    if detector == "script":
        return head | {"chunks": traced(segment(text, options)), "decision": "deterministic"}
    before = segment(text, deferred(options))
    after, decisions = detect(text, options, gate, engine)
    as_guess = lambda g: None if g is None else vars(g).copy()
    if view == "engine":
        first = next((i for i, c in enumerate(before) if c.locale in SURE), None)
        if first is None:
            return head | {"note": "No ambiguous window."}
        s = sample_of(before, first)
        raw, normal = engine(s.text), engine(s.normal) if s.normal and s.normal != s.text else None
        route = before[first].locale
        return head | {"sample": {"text": s.text, "normalized": s.normal}, "raw": as_guess(raw), "normalized": as_guess(normal), "tag": tag_of(raw, route)}
    windows = [{"index": d.index, "chunk": d.chunk, **{k: v for k, v in evidence(d).items() if k != "windowIndex"}} for d in decisions]
    return head | {"chunks": traced(before), "windows": windows, "resolvedChunks": [{"locale": c.locale, "text": c.text} for c in after]}
