import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import toxicity
from glyphmill.llm.toxicity import fit, sampled, score, scored, segments


def brute_segments(scores):
    """Maximal-scoring segments by their recursive definition."""
    def find(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) <= 1e-9 and j - i < best[1] - best[0]):
                    best = (i, j, total)
        return [] if best is None else find(a, best[0]) + [best] + find(best[1] + 1, b)
    return find(0, len(scores))


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(300):
        n, gap = rng.randint(0, 18), rng.choice([0.3, 1.1, 2.7])
        scores = [rng.uniform(0.5, 3) if rng.random() < 0.4 else -gap for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = segments(at, [scores[i] for i in at], gap)
        want = brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want))


def test_segments_of_ties():
    assert segments([0, 2, 4], [1.0, 1.0, 1.0], 1.0) == [(0, 0, 1.0), (2, 2, 1.0), (4, 4, 1.0)]
    assert segments([0, 1, 2], [1.0, 1.0, 1.0], 0.5) == [(0, 2, 3.0)]
    assert segments([], [], 0.5) == []


def test_segments_take_linear_time():
    def seconds(n):
        # one strong token, then weak ones that each stay a candidate of their own
        at = [0, *range(1000, 1000 + 3 * n, 3)]
        began = time.process_time()
        assert len(segments(at, [5000.0] + [1.0] * n, 1.0)) == n + 1
        return time.process_time() - began

    seconds(1000)
    assert min(seconds(80_000) for _ in range(3)) < 8 * min(seconds(20_000) for _ in range(3))
    # a chain in which all merge in the end
    n = 50_000
    began = time.process_time()
    assert len(segments(list(range(0, 2 * n, 2)), [1.5] * n, 1.0)) == 1
    assert time.process_time() - began < 5


def brute_model(rows, labels):
    """(scores, gap, decay, rate, seen) by plain loops over the sample."""
    base_docs = [(t, y) for i, t, *_ in rows if (y := labels.get(i)) is not None and t is not None and zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    held = [(t, y) for i, t, *_ in rows if (y := labels.get(i)) is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 3]
    forms = lambda w: [w[:n] + "*" for n in (4, 5, 6, 7, 8) if n < len(w)] + [w]
    counts = (Counter(), Counter())
    for t, y in base_docs:
        counts[y].update({f for w in re.findall(r"\w+", t.lower()) for f in forms(w)})
    base = sum(y for _, y in base_docs) / len(base_docs)
    every = set(counts[0]) | set(counts[1])

    def above(f):
        stem = f.rstrip("*")
        return [stem[:n] + "*" for n in (4, 5, 6, 7, 8) if n < len(stem)]

    def posterior(clean, toxic, prior):
        return (toxic + 2 * prior) / (clean + toxic + 2)

    def rate_of(f):
        steps, rate = [*above(f), f], base
        for g, own in zip(steps, steps[1:]):
            rate = posterior(max(0, counts[0][g] - counts[0][own]), max(0, counts[1][g] - counts[1][own]), rate)
        n = counts[0][f] + counts[1][f]
        rate = posterior(counts[0][f], counts[1][f], rate)
        rate -= 1.64 * math.sqrt(rate * (1 - rate) / (n + 2))
        return min(max(rate, base / 2), 1 - 1e-6)

    logit = lambda p: math.log(p / (1 - p))
    scores = {f: logit(rate_of(f)) - logit(base) for f in every}
    strong = {f.rstrip("*") for f in every if f.endswith("*") and scores[f] >= 1}
    kept = {f: s for f, s in scores.items() if s >= 1 or any(f[:n] in strong for n in (4, 5, 6, 7, 8))}
    words = [f for f in every if not f.endswith("*")]
    size = lambda fs: sum(counts[0][f] + counts[1][f] for f in fs)
    gap = max(0.1, -math.log(max(size(f for f in words if kept.get(f, 0) < 1) / size(words), 1e-3)) * 0.1)

    def token(w):
        s = next((kept[f] for f in reversed(forms(w)) if f in kept), 0.0)
        return s if s >= 1 else 0.0

    def look(t):
        tokens = [token(w) for w in re.findall(r"\w+", t.lower())]
        return [s for *_, s in brute_segments([s or -gap for s in tokens])], tokens

    seen = [(y, *look(t)) for t, y in held]
    clean = [s for y, _, ts in seen if not y for s in ts]
    pos = [round(s * 64) / 64 for s in clean if s]
    total = lambda lam: sum(math.exp(min(lam * s, 300)) for s in pos) + 0.5 * math.exp(min(lam * max(kept.values()), 300)) + (len(clean) + 1 - len(pos) - 0.5) * math.exp(-lam * gap) - (len(clean) + 1)
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if total(mid) > 0 else (mid, high)
    tops = [(max(f, default=0.0), max(len(ts), 1)) for y, f, ts in seen if not y]
    return kept, gap, low, len(tops) / sum(n * math.exp(-low * s) for s, n in tops), seen, look


def test_fit_and_score_equal_brute_force(spark):
    docs, labels = corpus(260)
    docs = [(i, " ".join(t.split()[:30]), x) for i, t, x in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, x int").repartition(3)
    model = fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores, gap, decay, rate, seen, look = brute_model(docs, dict(labels))
    assert model.scores == pytest.approx(scores) and model.gap == pytest.approx(gap)
    assert model.decay == pytest.approx(decay, rel=1e-6) and model.rate == pytest.approx(rate, rel=1e-6)

    def features(found, n):
        each = [decay * s - math.log(rate * max(n, 1)) for s in found]
        best = max(each, default=-math.log(rate * max(n, 1)))
        return math.copysign(math.log1p(abs(best)), best), math.log1p(sum(x for x in each if x > 0))

    x = np.array([features(f, len(ts)) for _, f, ts in seen])
    curve = toxicity.curve_of(x, np.array([float(y) for y, *_ in seen]))
    assert model.curve == pytest.approx(curve, rel=1e-4)
    texts = {i: t for i, t, _ in docs}
    for r in score(df, model).collect():
        found, tokens = look(texts[r.doc_id])
        z = sum(c * v for c, v in zip(curve, (1.0, *features(found, len(tokens)))))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-4)


def test_sample_is_bounded_though_ids_repeat(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs + docs + docs, "doc_id long, text string, x int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert sampled(df, lab, 20, 1 << 30).count() == 20
    size = sum(len(r.text.encode()) for r in sampled(df, lab, 20, 3000).collect())
    assert 1500 < size <= 3000


def test_very_long_words_count_whole(spark):
    long = "zorch" + "q" * 100
    docs = [(i, f"{long}{'x' if i % 5 == 0 else 'y'} plain words here", 1) for i in range(400)]
    labels = [(i, int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, x int")
    got = {r.doc_id: r.predicted for r in scored(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i] == y for i, y in labels)


def corpus(n=900):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Zorch", "zorching", "quxxer", "QUXXERLY"]))
        docs.append((i, " ".join(words), i))
        if i % 2:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(None, None, 1), (5001, "", 1), (5002, "zorch " * 50_000, 1), (1, docs[1][1], 1)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = scored(df, lab).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r.doc_id: r for r in rows}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert got[5001].predicted == 0 and got[5002].predicted == 1 and got[5002].n_passages >= 1


def test_passages_are_spans_of_the_text(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, x int")
    model = fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {i: t for i, t, _ in docs}
    found = [texts[r.doc_id][p.start : p.end].lower() for r in score(df, model).collect() for p in r.passages]
    assert found and all(x.startswith(("zorch", "quxxer")) for x in found)


def test_clean_rows_keep_their_columns(spark):
    docs, labels = corpus(300)
    model = fit(spark.createDataFrame(docs, "doc_id long, text string, x int"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    df = spark.createDataFrame([("m", "zorch zorching quxxer", None), (None, "plain words", 1.5), ("n", None, 2.5)], "`meta.k` string, text string, score double")
    out = toxicity.keep_clean(df, model)
    assert out.schema == df.schema and sorted(map(str, out.collect())) == sorted(map(str, df.filter("text is null or text like 'plain%'").collect()))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in scored(df, none).collect()} <= {0, 1}
    assert scored(df.limit(0), none).count() == 0
