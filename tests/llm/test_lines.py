import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from glyphmill.llm import lines as lines_module
from glyphmill.llm.common import tidy_group
from glyphmill.llm.graph import lowest
from glyphmill.llm.jaccard import Share
from glyphmill.llm.lines import WIDE_PREFIX, dedup_lines, digests, near_in_lists

SCHEMA = "doc_id long, text string, doc int"


def bag(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", low))


def brute(rows, least=1):
    order = sorted(range(len(rows)), key=lambda i: (1 << 63) - 1 if rows[i][0] is None else rows[i][0])
    seen, out = [], {}
    for i in order:
        text = rows[i][1]
        kept, gone = [], 0
        for line in (text.split("\n") if text is not None else []):
            b = bag(line)
            near = len(b) >= least and any(100 * len(b & o) >= 80 * len(b | o) for o in seen)
            if len(b) >= least:
                seen.append(b)
            if near:
                gone += 1
            else:
                kept.append(line)
        out[i] = (rows[i][0], None if text is None else "\n".join(kept), len(text.split("\n")) if text is not None else 0, gone)
    return sorted(out.values(), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcÉß", k=rng.randint(1, 4))) for _ in range(250)]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 9)):
            w = (rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(0, 30)))).split(" ")
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
            out.append(" ".join(w))
        rows.append((i * 7 % 1000, "\n".join(out), 1))
    return rows


@pytest.mark.parametrize("block", [3, 2048])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCK", block)
    rows = corpus(block)
    rows += [(2000 + i, rows[9][1], 1) for i in range(30)]
    rows += [(None, rows[10][1] + "\nnew words in a line that is here only", 1), (3000, None, 1), (3001, "", 1), (3002, "\n\n \t\n", 1), (3003, "w " * 50_000 + "\n" + "w x y z v " * 3 + "\nX y z V w", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = dedup_lines(df.repartition(3))
    assert out.columns == ["doc_id", "text", "doc", "lines_", "removed_"]
    got = sorted(((r.doc_id, r.text, r.lines_, r.removed_) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_repeated_ids_lose_no_line(spark):
    a, b = "one two three four five six", "eight nine ten eleven twelve"
    rows = [(5, a + "\n" + b, 1), (5, b + "\nother words that are not in there", 1), (5, a + "\n" + b, 1)]
    out = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    every = "\n".join(r.text for r in out)
    assert a in every and b in every and every.count("other words") == 1 and len(out) == 3


@pytest.mark.parametrize("longest,blocked,paired", [(512, 1 << 26, 20), (10, 1 << 26, 20), (10, 50, 500), (512, 1 << 26, 500)])
def test_lists_lose_no_pair(longest, blocked, paired, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCKED", blocked)
    rng = np.random.default_rng(1)
    share = Share(80, 100)
    sets = []
    for i in range(260):
        if i and rng.random() < 0.5:
            s = sets[rng.integers(0, i)].copy()
            s = np.delete(s, rng.integers(0, len(s)))
        else:
            s = rng.choice(np.arange(1, 60) if i % 2 else np.arange(1, 4000), rng.integers(6, 40) if i % 2 else rng.integers(90, 230), replace=False)
        sets.append(np.unique(np.append(s, 0)))
    maps = [int(np.bitwise_xor.reduce(np.uint64(1) << (s.astype(np.uint64) * np.uint64(37) & np.uint64(63)))) for s in sets]
    upper = [int(np.bitwise_xor.reduce(np.uint64(1) << (s[s % 3 == 0].astype(np.uint64) * np.uint64(37) & np.uint64(63)), initial=np.uint64(0))) for s in sets]
    x = np.zeros(len(sets), WIDE_PREFIX)
    x["h"], x["node"], x["n"], x["map"] = 5, np.arange(len(sets)), [len(s) for s in sets], maps
    x["half"] = np.where(x["n"] > lines_module.WIDE, np.array(upper, np.uint64), 0)
    edges, pairs = near_in_lists(x, share, longest, paired)
    p, q = lowest(np.concatenate([edges["a"], pairs["a"]]), np.concatenate([edges["b"], pairs["b"]]))
    group = dict(zip(p.tolist(), q.tolist()))
    found = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and not np.array_equal(sets[i], sets[j]):
                found += 1
                assert group.get(i) == group.get(j) is not None
    assert found > 50


@pytest.mark.parametrize("least", [1, 5])
def test_shortest_lines_that_take_part(spark, least):
    rows = [(i, "\n".join(" ".join(f"w{(i * k + k) % 11}" for k in range(1, n)) for n in range(1, 9)), 1) for i in range(40)]
    got = sorted(((r.doc_id, r.text, r.lines_, r.removed_) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), least=least).collect()), key=str)
    assert got == brute(rows, least)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7, "m", None), (2, "A b\nc", "y", 8, "n", None)], "doc_id long, text string, lines_ string, removed_ int, `meta.k` string, doc void")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "lines__", "removed__"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "x", 7, "m", None, 1, 0), (2, "c", "y", 8, "n", None, 2, 1)]


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_lines_of_the_query_take_part(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(9)]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(4)), 1) for i in range(60)]
    rows += [(100, "All rights reserved.\nspam spam spam spam spam spam\n人は空白を使わない\n", 1), (101, "\nall rights Reserved.\n人は空白を使わない\nspam spam", 1), (102, None, 1)]
    rows += [(103, "one two three four", 1), (104, "four one two three five", 1), (105, "one two three", 1)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n, gone, hashlib.sha256((text or "").encode()).hexdigest()) for i, text, n, gone in brute(rows, least=1)}
    assert got[101][1] == 3 and got[104][1] == 1 and got[105][1] == 0


@pytest.mark.parametrize("most", range(1, 16))
def test_parts_of_maps_lose_no_pair(most, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCKED", 0)
    rng = np.random.default_rng(most)
    width = -(-64 // (most + 1))
    spread = [[min(63, s + int(rng.integers(0, width))) for s in range(0, 64, width)][:most] for _ in range(20)]
    spread += [[64 * i // k + int(rng.integers(0, 64 // k)) for i in range(k)] for k in range(1, most + 1)]
    one = rng.integers(0, 1 << 63, len(spread), dtype=np.uint64)
    two = np.array([int(x) ^ sum(1 << b for b in set(bits)) for x, bits in zip(one, spread)], np.uint64)
    k = len(one)
    found = {(int(i), int(j)) for p, q in lines_module.parity_pairs(np.concatenate([one, two]), np.zeros(2 * k, np.uint64), np.arange(k), np.arange(k, 2 * k), most, False, False) for i, j in zip(p, q)}
    assert {(i, k + i) for i in range(k)} <= found


def crowded(lists, k):
    """Lists of k short lines that are near each other, the same ones in each."""
    x = np.zeros(lists * k, WIDE_PREFIX)
    x["h"], x["node"] = np.repeat(np.arange(lists), k), np.tile(np.arange(k), lists)
    x["n"] = 40
    return x


def test_near_lists_are_folded_as_they_come():
    x = crowded(60, 400)  # 4.8 million near pairs
    tracemalloc.start()
    edges, pairs = near_in_lists(x, Share(80, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 0 and len(edges) == 399 and set(edges["b"].tolist()) == {0}
    assert peak < 150_000_000


def test_pieces_of_pairs_count_together():
    x = crowded(50, 20)
    x["n"] = 170
    whole = near_in_lists(x, Share(80, 100))[1]
    pieces = list(lines_module.near_pieces(x, Share(80, 100), folded=300, counted=100))
    assert len(pieces) > 5 and len(whole) == 190 and set(whole["n"].tolist()) == {50}
    assert np.array_equal(lines_module.added(np.concatenate([p for _, p in pieces])), whole)


def test_blocks_are_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCK_WORDS", 500)
    most = 4 * 500 + 400 * 8

    def watched(run):
        def verify(table):
            words = sum(len(v.as_buffer()) for v in table.column("words")) // 8
            assert words <= most, words
            return run(table)

        return tidy_group(verify if run.__name__ == "verify" else run)

    monkeypatch.setattr(lines_module, "tidy_group", watched)
    rng = random.Random(8)
    line = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(w for w in line if rng.random() < 0.97), 1) for i in range(40)]
    got = sorted(((r.doc_id, r.text, r.lines_, r.removed_) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
