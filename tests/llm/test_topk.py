import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from glyphmill.llm import topk
from glyphmill.llm.topk import Scorer, search

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    known = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in known:
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for m, j, c in known if m != n)[:k]
            out += [(i, r + 1, b[3], -b[0]) for r, b in enumerate(best)]
    return sorted(out, key=str)


def run(spark, rows, k=20, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in search(df, F.col("vec_id") % 20 == 0, k, **sizes).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors(n, d, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, scale, (n, d)) * np.linspace(2, 0.3, d)
    x[n // 2 : n // 2 + n // 4] = np.round(x[: n // 4] * 8) / 8  # ties
    x[-n // 8 :] = x[0]
    return [(int(i), [float(np.float32(v)) for v in row], 1) for i, row in enumerate(x)]


def test_equals_brute_force(spark):
    rows = vectors(400, 12, 1)
    rows += [(20, None, 1), (40, [1.0, None], 1), (60, [float("nan")] * 12, 1), (None, rows[0][1], 1), (80, rows[80][1], 1), (80, [1.0, 2.0], 1), (1001, [], 1), (1020, [float("inf")], 1)]
    assert run(spark, rows, shard=150, block=7, first=16, chunk=64) == brute(rows, 20)
    assert run(spark, rows) == brute(rows, 20)


def test_pruning_drops_rows_and_no_result():
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    x = np.floor(64 * np.array(table.column("embedding").to_pylist(), float)).astype(np.int64)
    shard = np.zeros(len(x), topk.record(x.shape[1], False))
    shard["row"], shard["id"], shard["known"], shard["x"] = np.arange(len(x)), table.column("vec_id").to_numpy(), 1, x
    scorer = Scorer(shard, 20, first=64, chunk=256)
    asked = shard[shard["id"] % 20 == 0]
    i, j, v = scorer.best(asked)
    assert scorer.pruned > 0 and scorer.postings < 0.95 * len(asked) * x.size
    for n, q in enumerate(asked):
        s = x @ q["x"].astype(np.int64)
        want = [m for m in np.lexsort((shard["id"], -s)) if m != q["row"]][:20]
        assert j[i == n].tolist() == want and v[i == n].tolist() == s[want].tolist()


def test_sums_below_zero():
    rng = np.random.default_rng(2)
    shard = np.zeros(300, topk.record(6, False))
    shard["row"], shard["id"], shard["known"], shard["x"] = np.arange(300), np.arange(300), 1, rng.integers(1, 90, (300, 6))
    asked = shard[:9].copy()
    asked["x"] = -asked["x"]
    i, j, v = Scorer(shard, 5, first=8, chunk=32).best(asked)
    for n, q in enumerate(asked):
        s = shard["x"].astype(np.int64) @ q["x"].astype(np.int64)
        assert j[i == n].tolist() == [m for m in np.lexsort((shard["id"], -s)) if m != n][:5]


def test_large_values_are_exact(spark):
    for scale in (300.0, 1e5, 2e6):
        rows = vectors(64, 5, 3, scale)
        assert run(spark, rows, 3) == brute(rows, 3)


def test_few_rows(spark):
    assert run(spark, []) == []
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, -0.25], 1), (2, None, 1)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows[:1]) == []
