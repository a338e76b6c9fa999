"""Operator 8: secret scans through a trigram inverted index.

Method. Each rule's regular expression is parsed and turned into a Boolean query over
trigrams that every match must hold: finite strings give AND over their trigrams,
alternatives give OR, and parts that match too many strings give nothing. For each
block of texts an inverted index of the trigrams that occur in some query is built
(one vectorised pass over the block's bytes, A-Z folded to a-z), the postings of each
query are intersected and united, and only the candidates left are run through the
expression, over the whole text. A rule without a mandatory trigram scans every text.

The index is local to a block of rows, as it serves one scan: nothing is exchanged,
and its size follows the block, not the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import slices, text_buffers, tidy_map

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Strings that a part of an expression may match at most, to be listed one by one.
LISTED = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags))

    def spans(self, text: str):
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()

    def __reduce__(self):
        return Rule, (self.kind, self.pattern, self.flags, self.group, self.least, self.base)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24, True),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("login", r"\b[a-z][a-z0-9+.-]*://[^\s/:@]{1,256}:[^\s/:@]{3,256}@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).


def all_of(parts) -> object:
    found = set()
    for p in parts:
        if p is True:
            continue
        found |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not found else found.pop() if len(found) == 1 else ("and", frozenset(found))


def any_of(parts) -> object:
    found = set()
    for p in parts:
        if p is True:
            return True
        found |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return True if not found else found.pop() if len(found) == 1 else ("or", frozenset(found))


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def strings_query(strings: set[str]) -> object:
    """What holds for any text with one of the strings; trigrams are of UTF-8 bytes."""
    options = []
    for s in strings:
        b = fold(s).encode()
        options.append(all_of(b[i : i + 3] for i in range(len(b) - 2)))
    return any_of(options)


def analyse(items, ignore: bool) -> tuple[set[str] | None, object]:
    """(all strings a parsed sequence can match, or None if too many; its query)."""
    exact, query, whole = {""}, [], True
    for op, arg in items:
        strings, extra = one(op, arg, ignore)
        if strings is not None and len(exact) * len(strings) <= LISTED:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        query += [strings_query(exact), extra]
        exact, whole = strings if strings is not None else {""}, False
    return (exact if whole else None), all_of([*query, strings_query(exact)])


def one(op, arg, ignore: bool) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        c = chr(arg)
        if ignore and not c.isascii():
            return None, True
        return {c}, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value))
            elif kind is sre.RANGE and value[1] - value[0] < LISTED:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 and (not ignore or all(map(str.isascii, chars))) else (None, True)
    if op is sre.BRANCH:
        found = [analyse(x, ignore) for x in arg[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return (strings if strings is not None and len(strings) <= LISTED else None), any_of(q for _, q in found)
    if op is sre.SUBPATTERN:
        return analyse(arg[3], ignore)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) or op is getattr(sre, "POSSESSIVE_REPEAT", None):
        least, most, inner = arg
        strings, query = analyse(inner, ignore)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, True
        if least == most == 1:
            return strings, query
        return None, query if least else True
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(rule: Rule) -> object:
    """The Boolean trigram query of a rule; True if it has no mandatory trigram."""
    flags = rule.compiled.flags
    if flags & re.I and not flags & re.A:
        return True  # characters outside A-Z may fold to letters
    return analyse(sre_parse.parse(rule.pattern, rule.flags), bool(flags & re.I))[1]


def grams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(grams, query[1]))


class Scanner:
    """The rules' queries and the table of trigrams that they need."""

    def __init__(self, rules):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        names = sorted(set().union(*map(grams, self.queries)))
        self.number = {g: i + 1 for i, g in enumerate(names)}
        self.wanted = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
        for g, i in self.number.items():
            self.wanted[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.folded = np.arange(256, dtype=np.uint32)
        self.folded[65:91] += 32

    def index(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Inverted index of a block: number of trigram -> ascending rows with it."""
        base, step, found = int(offsets[0]), 1 << 20, []
        end = int(offsets[-1])
        for at in range(base, end - 2, step):
            x = self.folded[data[at : min(end, at + step + 2)]]
            code = self.wanted[(x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]]
            p = np.flatnonzero(code)
            row = np.searchsorted(offsets, p + at, side="right") - 1
            inside = p + at + 2 < offsets[row + 1]
            found.append((row[inside] << 16) | code[p[inside]])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        gram, row = pairs & 0xFFFF, pairs >> 16
        return {int(g): row[gram == g] for g in np.unique(gram)}

    def candidates(self, query, index, every: np.ndarray) -> np.ndarray:
        """Rows that satisfy a query, ascending."""
        if query is True:
            return every
        if isinstance(query, bytes):
            return index.get(self.number[query], every[:0])
        parts = [self.candidates(q, index, every) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out

    def scan(self, column) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text of an Arrow column, by start, then rule."""
        data, offsets = text_buffers(column)
        index = self.index(data, offsets)
        every = np.arange(len(column))
        found: list[list] = [[] for _ in every]
        texts = column.to_pylist()
        for n, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for row in self.candidates(query, index, every).tolist():
                if texts[row]:
                    found[row] += [(a, n, b) for a, b in rule.spans(texts[row])]
        return [[(a, b, self.rules[n].kind) for a, n, b in sorted(x)] for x in found]


SPANS = "array<struct<kind: string, start: long, end: long>>"


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with all matches of all rules, by start, then the rules' order;
    offsets in code points, ends exclusive.

    Null and empty texts have no spans; texts of any length are scanned whole; repeated
    rows and null doc_ids stay as they come; other columns are ignored, so their names
    can't clash; an empty table gives no rows.
    """

    def run(batches):
        scanner = Scanner(rules)
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in scanner.scan(batch.column(1))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy_map(run), f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_<kind> of each base rule, base_sha256, spans as text)."""
    base = [r.kind for r in rules if r.base]
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in base]
    return find_secrets(docs, rules).select(
        "doc_id",
        *counts,
        F.sha2(F.encode(listed(F.filter("spans", lambda s: s["kind"].isin(base))), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
