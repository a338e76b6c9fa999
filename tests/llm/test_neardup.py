import math

import numpy as np
import pytest

from glyphmill.llm import graph
from glyphmill.llm.graph import components
from glyphmill.llm.neardup import Block, links, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


def brute(rows, t=0.98):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if good(v) and lab is not None else None for _, v, lab, _ in rows]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in near[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((r[0], len(near[i]), c, r[0] == c))
    return sorted(out, key=str)


def data(seed=1, n=500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(3, 1, d)
    for i in range(n // 3, n):
        x[i] = x[rng.integers(0, i)] + rng.normal(scale=0.3, size=d) * (rng.random() < 0.7)
    return [(int(i), [float(np.float32(v)) for v in row], None if i % 50 == 7 else int(0 if i % 3 else i % 4), 0) for i, row in enumerate(x)]


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_brute_force(spark, block):
    rows = data()
    rows += [(9000, None, 0, 0), (9001, [0.0] * 16, 0, 0), (9002, [float("nan")] * 16, 0, 0), (9003, [None] * 16, 0, 0), (3, rows[3][1], rows[3][2], 0), (None, rows[5][1], rows[5][2], 0), (9004, [1.0, 2.0], 0, 0), (9005, [2.0, 4.0], 0, 0), (9006, [], 0, 0)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, strip=8).collect()), key=str)
    assert got == brute(rows)


def test_double_precision_input(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    x = [*base, *(base + rng.normal(scale=1e-9, size=base.shape))]
    rows = [(i, [float(c) for c in v], 1, 0) for i, v in enumerate(x)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()), key=str)
    assert got == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 24))
    a = Block(np.arange(200), np.ones(200, np.int64), x)
    exact = a.u @ a.u.T
    got = np.zeros_like(exact, bool)
    for t in (0.2, 0.5, 0.9):
        got[:] = False
        for p, q in links(a, a, t, True):
            got[p, q] = True
        assert (got == np.triu(exact >= t, 1)).all()


def test_components_in_rounds(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(i, i + 1) for i in range(2000, 2300)] + [(5000, i) for i in range(4000, 4100)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {r.node: r.component for r in components(df).collect()}
    n, m = graph.lowest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in zip(n.tolist(), m.tolist()) if k not in loops or k in want} == want
    assert {r.node: r.component for r in components(df, one_task=50).collect()} == want


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
