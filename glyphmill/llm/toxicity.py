r"""Operator 1: toxicity by maximum-scoring segments of token log-odds.

Method. Tokens are words (\w+) without regard to case. A token's score is its log-odds
of occurring in a toxic document against the base rate, under Dirichlet priors that
form a chain: a word's prior is the estimate of its eight-letter beginning, whose prior
is that of seven letters, and so on to the base rate, so inflected and compound forms
of an offensive stem share its evidence. Rates are taken at a lower confidence bound. Tokens without evidence of their own are one
pooled category with a small negative score. All maximal-scoring segments of a text
are found by the linear-time algorithm of Ruzzo and Tompa over its positive tokens and
the gaps between them: each candidate keeps a pointer to the nearest one before it that
starts lower, so none is passed twice. Segment scores are calibrated by extreme-value statistics: with
lambda from the score distribution of clean texts and K from their maxima, a segment
of score S among n tokens has E = K n exp(-lambda S); a logistic curve over the best
and the summed excess turns that into a score from 0 to 1.

Bounded fit. The model is fitted on at most `rows` labelled documents of at most `size`
bytes together, the first by a keyed hash of doc_id; two thirds of them (by crc32) count,
one third calibrates. Within that sample nothing is left out: features are counted and
estimated on the executors, by word beginning, and only those that can score reach the
driver, as do histograms and three numbers a document for the calibration. Scoring is
one pass over all documents, without exchange. Labels, lang, source and doc_id are no
inputs of a score. The negative score of pooled tokens is a chosen scale (a tenth of the
log share of pooled tokens, at least 0.1), not an estimate: it sets how far apart scored
tokens of one passage may be.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.common import cut, slices, tidy_group, tidy_map

#: Labelled documents that the model is fitted on, and their bytes, at most.
ROWS, SIZE = 24_000, 512 << 20
#: Steps of a score's unit in the histogram of clean tokens' scores.
STEPS_A_UNIT = 64
#: Lengths of word beginnings in the chain of priors, the prior's weight in documents,
#: and the standard deviations by which a token's rate is taken lower than estimated.
STEMS, PRIOR, DOUBT = (4, 5, 6, 7, 8), 2.0, 1.64
#: Scores below this are pooled with the tokens without evidence.
LEAST = 1.0
#: A passage is significant if clean texts of its length hold such a one this rarely.
SIGNIFICANT = 0.05
REMEMBERED = 500_000
#: Groups of word beginnings that are estimated apart.
GROUPS = 256
WORD = re.compile(r"\w+")


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4; null has -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1)).cast("int")


def chain(word: str) -> list[str]:
    """A word's features from the most general: beginnings marked by *, then the word."""
    return [*(word[:n] + "*" for n in STEMS if n < len(word)), word]


def segments(positive: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score) of a sequence whose tokens
    at `positive` have `scores` and whose others have -gap each. Linear time: `lower` leads
    from a candidate to the nearest one before it whose sum before is lower (-1: none)."""
    first: list[int] = []
    final: list[int] = []
    before: list[float] = []
    after: list[float] = []
    lower: list[int] = []
    out: list[tuple[int, int, float]] = []
    total, last = 0.0, -1
    for i, s in zip(positive, scores):
        left = total - gap * (i - last - 1)
        total, last = left + s, i
        begin, n = i, len(first) - 1
        while True:
            while n >= 0 and before[n] >= left:
                n = lower[n]
            if n < 0:
                # no earlier candidate starts below: all of them are final
                out += [(p, q, y - x) for p, q, x, y in zip(first, final, before, after)]
                for kept in (first, final, before, after, lower):
                    kept.clear()
                break
            if after[n] >= total:
                break
            begin, left = first[n], before[n]
            for kept in (first, final, before, after):
                del kept[n:]
            n = lower[n]
            del lower[len(first) :]
        first.append(begin)
        final.append(i)
        before.append(left)
        after.append(total)
        lower.append(n)
    return out + [(p, q, y - x) for p, q, x, y in zip(first, final, before, after)]


@dataclass
class Model:
    """Token scores, calibration and curve. Its size is bounded by that of the sample."""

    scores: dict[str, float] = field(default_factory=dict)
    gap: float = 0.1
    decay: float = 1.0
    rate: float = 1.0
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def token(self, word: str) -> float:
        """A word's score: that of the most specific feature with evidence; 0 if pooled."""
        for feature in reversed(chain(word.lower())):
            s = self.scores.get(feature)
            if s is not None:
                return s if s >= LEAST else 0.0
        return 0.0

    def excess(self, score: float, n: int) -> float:
        """-log E of a segment among n tokens."""
        return self.decay * score - math.log(self.rate * max(n, 1))

    def features(self, found, n: int) -> tuple[float, float]:
        """Best excess, and the sum of positive excesses, both tamed."""
        each = [self.excess(s, n) for _, _, s in found]
        best = max(each, default=-math.log(self.rate * max(n, 1)))
        total = sum(x for x in each if x > 0)
        return math.copysign(math.log1p(abs(best)), best), math.log1p(total)

    def score(self, found, n: int) -> float:
        a, b = self.features(found, n)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


class Memory(dict):
    """Scores of words as written, in a memory of fixed size."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        s = self.model.token(word)
        if len(word) <= 64:
            self[word] = s
        return s


def find(text: str, memory: Memory) -> tuple[list[tuple[int, int, float]], int]:
    """(segments, tokens) of a text."""
    scores = list(map(memory.__getitem__, WORD.findall(text)))
    at = [i for i, s in enumerate(scores) if s]
    return (segments(at, [scores[i] for i in at], memory.model.gap) if at else []), len(scores)


def count_features(batches):
    """Documents of each label by feature, for each task; small counts flow on as rows."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows():
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()), pa.array([counts[1][f] for f in names], pa.int64())], names=["feature", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: set[str] = set()
            for word in set(WORD.findall(text or "")):
                own.update(chain(word.lower()))
            counts[label].update(own)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield rows()
    yield rows()


def estimate(features: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Log-odds against the base rate by the chain of priors; features: (clean, toxic)."""
    out = {}
    for f in features:
        stem = f[:-1] if f.endswith("*") else f
        above = [g for n in STEMS if n < len(stem) and (g := stem[:n] + "*") in features]
        rate, steps = base, [*above, f]
        for g, own in zip(above, steps[1:]):
            # what the beginning has besides its more specific form counts once
            clean, toxic = (max(0, x - y) for x, y in zip(features[g], features[own]))
            rate = (toxic + PRIOR * rate) / (clean + toxic + PRIOR)
        clean, toxic = features[f]
        rate = (toxic + PRIOR * rate) / (clean + toxic + PRIOR)
        rate -= DOUBT * math.sqrt(rate * (1 - rate) / (clean + toxic + PRIOR))
        rate = min(max(rate, base / 2), 1 - 1e-6)
        out[f] = math.log(rate / (1 - rate)) - math.log(base / (1 - base))
    return out


def useful(scores: dict[str, float]) -> dict[str, float]:
    """Scores that a word can get: those of LEAST or more, and those of forms under such a
    beginning, which speak against themselves."""
    marked = {f[:-1] for f, s in scores.items() if s >= LEAST and f.endswith("*")}
    return {f: s for f, s in scores.items() if s >= LEAST or any(f[:n] in marked for n in STEMS)}


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return w


def decay_of(values: np.ndarray, counts: np.ndarray, tokens: int, gap: float, highest: float) -> float:
    """Karlin and Altschul's lambda of clean text: positive scores with their counts among
    `tokens`; half a token of the highest score counts as unseen."""
    weights = np.append(counts, 0.5) / (tokens + 1)
    values = np.append(values, max(highest, LEAST))
    rest = max(1 - weights.sum(), 1e-9)
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if (weights * np.exp(np.minimum(mid * values, 300))).sum() + rest * math.exp(-mid * gap) > 1:
            high = mid
        else:
            low = mid
    return low


def curve_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes of a score over (best, total) rows."""
    if 0 < y.sum() < len(y):
        return tuple(map(float, logistic(np.column_stack([np.ones(len(y)), x]), y)))
    share = (y.sum() + 0.5) / (len(y) + 1)
    return (math.log(share / (1 - share)), 0.0, 0.0)


def calibrate(model: Model, seen: DataFrame) -> Model:
    """Fits decay, rate and curve to rows (label, n, found, counts): a document's label,
    tokens, segment scores and histogram of positive token scores."""
    clean = seen.filter("label = 0")
    hist = clean.select(F.explode("counts").alias("step", "k")).groupBy("step").agg(F.sum("k").alias("k")).orderBy("step").collect()
    tokens = clean.agg(F.sum("n")).first()[0] or 0
    highest = max(model.scores.values(), default=1.0)
    model.decay = decay_of(np.array([r.step / STEPS_A_UNIT for r in hist]), np.array([r.k for r in hist], float), tokens, model.gap, highest)
    length = F.greatest("n", F.lit(1))
    top = F.coalesce(F.array_max("found"), F.lit(0.0))
    n, below = clean.agg(F.count("*"), F.sum(length * F.exp(-F.lit(model.decay) * top))).first()
    model.rate = max(n, 1) / max(below or 0.0, 1e-9)

    def features(batches):
        for batch in batches:
            rows = [model.features([(0, 0, s) for s in found], n) for found, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in rows], pa.float64()), pa.array([b for _, b in rows], pa.float64())], names=["label", "best", "total"])

    rows = seen.select("label", "n", "found").mapInArrow(tidy_map(features), "label int, best double, total double").orderBy("label", "best", "total").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in ("best", "total")])
    model.curve = curve_of(x, rows.column("label").to_numpy().astype(float))
    return model


def sampled(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> DataFrame:
    """(text, toxic, part) of at most `rows` labelled rows of at most `size` bytes, cut."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.least(F.greatest(F.col("toxic").cast("int"), F.lit(0)), F.lit(1)).alias("toxic"))
    known = known.filter(remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = cut(texts.join(F.broadcast(chosen), "doc_id").withColumns({"order": F.xxhash64("doc_id"), "bytes": F.octet_length("text"), "h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}))
    # ids may repeat: the rows that the ids gave are bounded, too
    order = F.struct("order", "doc_id", "h", "row").alias("o")
    first = found.select(order, "bytes", "row").orderBy("o").limit(rows)
    upto = F.sum("bytes").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("upto", upto).filter(F.col("upto") <= size).select(F.col("row").alias("kept_row"))
    return cut(found.join(F.broadcast(kept), F.col("row") == F.col("kept_row")).select("text", "toxic", remainder(F.col("doc_id")).alias("part")))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = SIZE) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), from rows whose crc32
    remainder isn't 2. Rows with a null label, doc_id or text don't count; of several
    labels of a document the highest does. Without labels of both kinds, all documents
    get the base rate."""
    sample = sampled(docs, labels, rows, size)
    base = {r.toxic: r.n for r in sample.filter("part != 3").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if base.get(0) and base.get(1):
        model = weigh(sample.filter("part != 3"), base[1] / (base[0] + base[1]))

    def look(batches):
        memory = Memory(model)
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.map_(pa.int32(), pa.int64()))
        for batch in slices(batches):
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = find(text, memory)
                tokens = Counter(round(s * STEPS_A_UNIT) for s in map(memory.__getitem__, WORD.findall(text)) if s) if found else {}
                out.append((label, n, [float(s) for _, _, s in found], list(tokens.items())))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["label", "n", "found", "counts"])

    held = sample.filter("part = 3").select("text", "toxic").mapInArrow(tidy_map(look), "label int, n long, found array<double>, counts map<int, long>")
    return calibrate(model, cut(held))


def weigh(sample: DataFrame, base: float) -> Model:
    """Token scores from the counting part of the sample. A word and its beginnings share
    their first letters, so each group of these is estimated by itself."""
    raw = sample.select("text", "toxic").mapInArrow(tidy_map(count_features), "feature string, clean long, toxic long")
    counts = raw.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    group = F.pmod(F.xxhash64(F.substring("feature", 1, STEMS[0])), F.lit(GROUPS)).alias("group")

    def score_group(table: pa.Table) -> pa.Table:
        names = table.column("feature").to_pylist()
        clean, toxic = table.column("clean").to_pylist(), table.column("toxic").to_pylist()
        kept = useful(estimate({f: (c, t) for f, c, t in zip(names, clean, toxic)}, base))
        words = [(c + t, kept.get(f, 0) < LEAST) for f, c, t in zip(names, clean, toxic) if not f.endswith("*")]
        rows = [(f, s, 0, 0) for f, s in kept.items()] + [(None, 0.0, sum(n for n, _ in words), sum(n for n, pooled in words if pooled))]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("feature", "score", "words", "pooled"), zip(*rows), (pa.string(), pa.float64(), pa.int64(), pa.int64()))})

    found = cut(counts.select("feature", "clean", "toxic", group).groupBy("group").applyInArrow(tidy_group(score_group), "feature string, score double, words long, pooled long"))
    words, pooled = found.agg(F.sum("words"), F.sum("pooled")).first()
    scores = {r.feature: r.score for r in found.filter("feature is not null").select("feature", "score").collect()}
    return Model(scores=scores, gap=max(0.1, -math.log(max((pooled or 0) / (words or 1), 1e-3)) * 0.1))


PASSAGES = "array<struct<start: long, end: long, score: double, expected: double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every document; passages are the significant segments
    in order, with code-point offsets (end exclusive), score and E.

    Null and empty texts have no passages and a score as any text without a token; texts
    of any length are read whole; repeated rows and null doc_ids stay as they come; other
    columns are ignored, so their names can't clash; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        memory = Memory(own)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in slices(batches):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                found, n = find(text or "", memory)
                scores.append(own.score(found, n))
                marked = [(a, b, s, math.exp(-own.excess(s, n))) for a, b, s in found]
                marked = sorted(x for x in marked if x[3] <= SIGNIFICANT)
                if marked:
                    at = [m.span() for m in WORD.finditer(text)]
                    passages.append([{"start": at[a][0], "end": at[b][1], "score": s, "expected": e} for a, b, s, e in marked])
                else:
                    passages.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy_map(run), f"doc_id long, score double, passages {PASSAGES}")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs' rows, with all their columns (of any names), whose text scores below the
    threshold. Cases as in score()."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        own = held.value
        memory = Memory(own)
        for batch in slices(batches):
            scores = [own.score(*find(t or "", memory)) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    safe = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names by place: they may hold dots
    return safe.mapInArrow(tidy_map(run), safe.schema).toDF(*docs.columns)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages)."""
    return score(docs, fit(docs, labels, rows)).select(
        "doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
