import re
from collections import defaultdict

import numpy as np
import pytest

from glyphmill.llm import mixing
from glyphmill.llm.mixing import draw, plan, split, with_shards


def brute_targets(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


def test_split_keeps_quotas():
    q = np.array([1000, 0, 7, 333])
    out = split(q, 13, 5)
    assert (out.sum(0) == q).all() and (out >= 0).all()
    assert np.ptp(out.sum(1)) <= 4
    assert (out == split(q, 13, 5)).all()


@pytest.mark.parametrize("few", [True, False])
def test_plan(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1 << 20 if few else 0)
    sizes = {"shards": 5, "block_words": 300, "strata": 100 if few else 3}
    rng = np.random.default_rng(3)
    names = ["a", "b", "É", "z", None, "€", "", "empty"]
    rows = []
    for i in range(1200):
        s = names[0] if i % 3 == 0 else names[int(rng.integers(7))]
        rows.append((i, None if i % 97 == 0 else "w\t é　x " * int(rng.integers(0, 12)), s, 1))
    rows += [(5000, "", "empty", 1), (None, "one two", "a", 1), (7, "again", "b", 1), (7, "again", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = plan(df, **sizes).collect()
    totals, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and r.copies <= 2 and len(r.shards) == r.copies and all(0 <= x < 5 for x in r.shards)
        taken[r.source] += r.taken
    for s in totals:
        assert abs(taken[s] - target[s]) <= 36
    again = plan(df.repartition(3), **sizes).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = draw(df, **sizes, part=1000)
    assert mixed.columns == df.columns
    want = sorted(str(r.doc_id) for r in got for _ in range(r.copies))
    assert sorted(str(r.doc_id) for r in mixed.collect()) == want


@pytest.mark.parametrize("strata", [2, 7, 1000])
def test_quotas_of_sources_and_shards_are_exact(spark, strata):
    quotas = [0, 1, 5000, 3, 77, 1, 0, 12, 900, 1]
    df = spark.createDataFrame([(i, q, "x") for i, q in enumerate(quotas)], "nth long, quota long, other string")
    rows = {r.nth: r for r in with_shards(df, 13, 5, strata).collect()}
    drawn = np.diff([[0, *rows[i].ends] for i in range(len(quotas))], axis=1)
    assert (drawn >= 0).all() and drawn.sum(1).tolist() == quotas and np.ptp(drawn.sum(0)) <= 4
    assert abs(drawn[2] - 5000 / 13).max() < 40
    assert {r.nth: r.ends for r in with_shards(df.repartition(3), 13, 5, strata).collect()} == {i: r.ends for i, r in rows.items()}


def test_too_many_blocks_are_refused(spark):
    df = spark.createDataFrame([(0, 10**9)], "nth long, quota long")
    with pytest.raises(ValueError, match="block_words"):
        with_shards(df, 4, 1)


def test_each_block_is_in_one_shard(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 7 AS int)) AS text", "concat('s', cast(id % 3 AS string)) AS source")
    _, sources, _ = mixing.quotas(df, (5, 2, 1), 1.5, 2.0, 7, 100)
    blocks = {r.source: r.blocks for r in sources.collect()}
    assert all(b > 30 for b in blocks.values())
    place = {r.doc_id: r.place for r in df.select("doc_id", mixing.place_of(df.doc_id, 7).alias("place")).collect()}
    shard, seen = {}, set()
    for r in plan(df, shards=6, block_words=100).collect():
        for epoch, x in enumerate(r.shards):
            slot = (r.source, epoch, int(place[r.doc_id] / 2**52 * blocks[r.source]))
            assert shard.setdefault(slot, x) == x
            seen.add(x)
    assert seen == set(range(6))
    for s in blocks:
        order = [shard[k] for k in sorted(k for k in shard if k[0] == s)]
        assert order == sorted(order)  # ranges of the permuted blocks


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i, "a b", "s", i) for i in range(20)], "doc_id long, text string, source string, `meta.k` long")
    out = draw(df, shards=2)
    assert out.columns == df.columns and all(r["meta.k"] == r.doc_id for r in out.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert plan(df).count() == 0 and draw(df).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], df.schema)
    assert {(r.target, r.taken) for r in plan(none).collect()} == {(0.0, 0)}
