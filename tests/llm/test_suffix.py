import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import anchors as anchors_module
from glyphmill.llm import suffix
from glyphmill.llm.anchors import anchors
from glyphmill.llm.suffix import RANGE, REQUEST, common_prefixes, digests, longest_previous_factors, merged, pack, remove_repeats, unpack

SCHEMA = "doc_id long, text string, kept int"


def brute(rows, length=50):
    first: dict[bytes, int] = {}
    data = [((1 << 63) if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), r in zip(data, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé€", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts += [p[a : a + rng.randint(30, 200)], " ".join(rng.choices(words, k=rng.randint(0, 9)))]
        text = " ".join(parts)
        if rng.random() < 0.2 and rows:
            text = rows[rng.randint(0, len(rows) - 1)][1][rng.randint(0, 30) :]
        rows.append((rng.randint(0, 10**6) * 1000 + i, text, 1))
    return rows


@pytest.mark.parametrize("repeated", [False, True])
def test_equals_brute_force(spark, repeated):
    rows = corpus(int(repeated))
    rows += [(10**12, None, 1), (10**12 + 1, "", 1), (10**12 + 2, "a" * 49, 1), (10**12 + 3, "a" * 400, 1), (10**12 + 4, "b" + "a" * 60 + "b" * 70, 1), (10**12 + 5, "ab" * 200, 1), (10**12 + 6, "ba" * 30, 1)]
    rows += [(10**12 + 10 + i, rows[3][1], 1) for i in range(30)]
    if repeated:
        rows += [(None, rows[0][1], 1), (None, rows[0][1], 1), (rows[4][0], rows[5][1], 1), (rows[4][0], rows[4][1], 1), (rows[7][0], "other " * 20, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in digests(df).collect()), key=str)
    assert got == brute(rows)


def test_long_texts_and_spans(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=900_000))
    rows = [(1, long, 1), (2, "x" + long[200_000:700_000] + "y", 1), (3, long[:10] + "z" * 80, 1), (4, "z" * 80, 1)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 500_001)] and got[2].kept == b"xy"
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[4].n_removed == 80 and got[4].kept == b""


def test_every_window_has_one_anchor(monkeypatch):
    monkeypatch.setattr(anchors_module, "CHUNK", 300)
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c", k=rng.choice([0, 10, 49, 50, 51, 200, 2000]))).encode() for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    row, start, end, at, h1, h2 = anchors(data, offsets, 50, 16)
    names = {}
    for r, t in enumerate(texts):
        own = [(s, e, a, h) for s, e, a, h in zip(start[row == r], end[row == r], at[row == r], h1[row == r])]
        covered = sorted(p for s, e, _, _ in own for p in range(s, e - 49))
        assert covered == list(range(max(0, len(t) - 49)))
        for s, e, a, h in own:
            for p in range(s, e - 49):
                assert names.setdefault(t[p : p + 50], (a - p, h)) == (a - p, h)


def test_packing_and_merging():
    x = np.zeros(5, REQUEST)
    x["doc"], x["start"], x["end"], x["role"] = [9, -4, 9, 3, 1 << 62], [5, 7, 1, 2, 3], [9, 8, 4, 5, 6], [1, 2, 3, 1, 1]
    got = unpack([pack(x)], REQUEST)
    assert sorted(got.tolist()) == sorted(x.tolist())
    y = np.zeros(4, RANGE)
    y["doc"], y["start"], y["end"] = [1, 1, 1, 2], [0, 5, 9, 5], [5, 8, 10, 6]
    assert merged(y)[["doc", "start", "end"]].tolist() == [(1, 0, 8), (1, 9, 10), (2, 5, 6)]


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    rng = random.Random(seed)
    length, steps = 20, [0, 8, 12]
    pool = ["".join(rng.choices("ab", k=length)).encode() for _ in range(6)]
    suffixes = []
    for _ in range(250):
        w = bytearray(rng.choice(pool))
        if rng.random() < 0.6:
            w[rng.randrange(length) :] = bytes(length)
            w = w[:length]
        suffixes.append((rng.randrange(2), rng.randrange(1, 40 if seed else 3), bytes(w).ljust(length, b"c")))
    part, doc = np.array([p for p, *_ in suffixes]), np.array([d for _, d, _ in suffixes])
    keys = [np.array([int.from_bytes(w[s : s + 8], "big") for *_, w in suffixes], np.uint64) for s in steps]
    order = np.lexsort([doc, *reversed(keys), part])
    got = np.empty(len(order), np.int64)
    shared = common_prefixes(keys, steps, length, order, part)
    got[order] = longest_previous_factors(doc[order], shared)

    def common(a, b):
        return next((i for i in range(length) if a[i] != b[i]), length)

    for n, (p, d, w) in enumerate(suffixes):
        assert got[n] == max((common(w, v) for q, e, v in suffixes if q == p and e < d), default=0)
    whole = np.empty(len(order), np.int64)
    whole[order] = longest_previous_factors(doc[order], shared, length)
    assert ((whole >= length) == (got >= length)).all() and (got >= length).any() and ((got > 0) & (got < length)).any()


def test_empty(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contexts_travel_once_and_divided_where_many(monkeypatch):
    rng = np.random.default_rng(5)
    head = bytes(rng.integers(97, 123, 400, np.uint8))
    texts = [head + bytes(rng.integers(97, 123, 300, np.uint8)) for _ in range(9)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    row, start, end, _, h1, h2 = anchors(data, offsets, 50, suffix.GRAM)
    x = np.zeros(len(row), suffix.ANCHOR)
    x["doc"], x["start"], x["end"], x["h1"], x["h2"] = row, start, end, h1 >> np.uint64(32), h2
    found = []
    for many in (suffix.MANY, 2):
        monkeypatch.setattr(suffix, "MANY", many)
        gone, asked = suffix.judge(x)
        ids = np.unique(asked["doc"]).tolist()
        blobs = [pack(asked[asked["doc"] == d]) for d in ids]
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int64()), pa.array([texts[d].decode() for d in ids]), pa.array(blobs, pa.binary())], names=list("abcd"))
        rows = pa.Table.from_batches(list(suffix.fetch([batch], 50, 1)))
        y, body = suffix.unpack_contexts(rows.column("head").to_pylist(), rows.column("body").to_pylist())
        assert int(y["windows"].sum()) == int((asked["end"] - asked["start"]).astype(int).sum()) - 49 * len(asked)
        found.append((len(asked), len(y), merged(np.concatenate([gone, suffix.previous_factors(y, body, 50)])).tolist()))
    assert found[0][0] == found[0][1] < found[1][1]  # whole contexts were sent in halves
    for _, _, gone in found:
        assert [g[:3] for g in gone] == [(d, 0, 0) for d in range(1, 9)] and all(400 <= g[3] <= 405 for g in gone)
    assert found[0][2] == found[1][2]
