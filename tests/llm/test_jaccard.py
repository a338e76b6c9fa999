import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import jaccard
from glyphmill.llm.jaccard import Index, Share, similar

SCHEMA = "doc_id long, text string, n_similar int"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                near[i].append(j)
                near[j].append(i)
    comp, todo = [None] * n, []
    for s in range(n):
        if comp[s] is None:
            comp[s], todo = s, [s]
            while todo:
                for j in near[todo.pop()]:
                    if comp[j] is None:
                        comp[j] = s
                        todo.append(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), len(near[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉß", k=rng.randint(1, 5))) for _ in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(4)]
    texts = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = texts[int(i * rng.random() ** 2)].split(" ")
            for _ in range(rng.randint(0, 4)):
                k = rng.randint(0, len(w))
                w[k : k + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 30, 60, 200]))
            if rng.random() < 0.6:
                w[len(w) // 2 : len(w) // 2] = rng.choice(passages)
        texts.append(" ".join(w))
    return [(i, t, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("paired,block,bits", [(32, 2048, 1 << 28), (2, 7, 16)])
def test_equals_brute_force(spark, paired, block, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard, "SMALL_TILE", 50 * block)
    rows = corpus(paired)
    base = " ".join(f"w{i}" for i in range(80))
    rows += [(3000 + i, base + f" x{i}", 1) for i in range(40)] + [(4000 + i, rows[5][1], 1) for i in range(50)]
    rows += [(None, rows[5][1].upper().replace("É", "É"), 1), (5000, None, 1), (5001, "", 1), (5002, " \t\n", 1), (5003, "one Two", 1), (5004, "ONE\ttwo", 1), (7, "again", 1), (7, base, 1), (5005, "z " * 60_000, 1), (5006, "z " * 6, 1)]
    got = sorted((tuple(r) for r in similar(spark.createDataFrame(rows, SCHEMA).repartition(3), paired=paired, filter_bits=bits).collect()), key=str)
    assert got == brute(rows)


def test_search_probes_long_lists():
    rng = np.random.default_rng(1)
    common = np.arange(1000, 1030, dtype=np.uint64)
    sets = []
    for _ in range(300):
        sets.append(np.unique(np.concatenate([common, rng.integers(0, 400, rng.integers(0, 12)).astype(np.uint64)])))
    sets.sort(key=len)
    index, share = Index(sets), Share(80, 100)
    for x in sets[::7]:
        want = [i for i, y in enumerate(sets) if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))]
        assert index.search(x, share, 0, len(sets)).tolist() == want


def test_filter_holds_all_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAGE", 256)
    df = spark.range(0, 3000, 7).selectExpr("id AS low_doc").union(spark.createDataFrame([(None,)], "low_doc long")).repartition(5)
    bits = np.unpackbits(jaccard.id_filter(df, 1 << 14), bitorder="little")
    want = np.unique(jaccard.number(pa.array([*range(0, 3000, 7), None], pa.int64()), 1 << 14))
    assert np.flatnonzero(bits).tolist() == want.tolist()


def test_empty(spark):
    assert similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives_keep_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text + " x", "b"), (9, "quite another text of seven words", "c"), (9, "quite another text of seven words", "c"), (None, text, "d"), (None, "alone here and without any id", "e"), (11, None, "f"), (12, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_doc string")
    got = jaccard.representatives(df)
    assert got.columns == df.columns
    assert sorted((r.kept_doc for r in got.collect())) == ["b", "c", "e", "f", "g"]


def test_one_row_of_each_group_stays_though_ids_repeat(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(4, text, "a"), (4, text + " y", "b"), (4, other, "c"), (None, text + " z", "d"), (None, other, "e"), (None, "alone " * 9, "f"), (3, "alone " * 9, "g"), (None, None, "h"), (None, None, "h")]
    got = sorted(r["k.x"] for r in jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, `k.x` string")).collect())
    assert len(got) == 5 and got[0] in "ab" and got[1:] == ["c", "g", "h", "h"]


def test_lists_of_near_copies_travel_as_lists(spark):
    base = [" ".join(f"w{g}x{i}" for i in range(200)) for g in range(6)]
    rows = [(20 * g + k, f"{base[g]} c{k} d{k}") for g in range(6) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    share, nothing = Share(80, 100), spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))
    x = jaccard.read_blobs(pa.chunked_array([[r.blob for r in jaccard.prefixes(docs, 5, share, nothing, 7).collect()]], pa.binary()), jaccard.PREFIX)
    members, length, edges = jaccard.listed(x, share)
    blobs = [b for _, b in jaccard.run_blobs(members, length, 7)]
    assert not len(edges) and len(members) > 0.9 * len(x)
    assert sum(map(len, blobs)) < x.nbytes  # counted pairs for each of 7 buckets take more than twice that
    pairs = jaccard.paired_runs(*jaccard.read_runs(pa.array(blobs, pa.binary())), share)
    assert len(pairs) == 6 * 190
    assert len(jaccard.shared_enough(pairs, share)) == 6 * 190
    sets = {}
    for r in x:
        sets.setdefault(int(r["node"]), set()).add(int(r["h"]))
    assert all(p["n"] == len(sets[int(p["a"])] & sets[int(p["b"])]) for p in pairs)


def test_sets_travel_in_the_shorter_form():
    words = [" ".join(f"word{i % 50}" for i in range(k, k + 400)) for k in range(9)] + ["z " * 500_000, "one two", "Ünï " * 3, " ".join(str(i * 7919) for i in range(40))]
    column = pa.array(words, pa.large_string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), column], names=["doc_id", "text"])
    want = list(jaccard.shingle_sets(*jaccard.text_buffers(column), 5))
    rows = pa.Table.from_batches(list(jaccard.set_rows([batch], 5)))
    got = jaccard.unpacked(rows.column("packed"), 5)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert all(len(b) <= 8 + 8 * n for b, n in zip(rows.column("packed").to_pylist(), rows.column("n").to_pylist()))
    prose = jaccard.packed(want[0], words[0].encode())
    assert len(prose) < want[0].nbytes


def test_texts_stay_where_they_are_when_few_rows_go_or_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i}" if i % 3 else f"quite another text {i} of seven words") for i in range(60)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    most = spark.createDataFrame([(i, f"{text} x{i}") for i in range(20)] + [(20, None)], "doc_id long, text string")
    for df, want in ((few, [1, *range(0, 60, 3)]), (most, [0, 20])):
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for sent in (jaccard.SENT, 0):
                got = jaccard.representatives(df, sent=sent)
                assert sorted(r.doc_id for r in got.collect()) == sorted(want)
                plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().sparkPlan().toString()
                assert ("BroadcastHashJoin" in plan) == bool(sent)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_counts_travel_short():
    rng = np.random.default_rng(3)
    x = np.zeros(5000, jaccard.COUNTS)
    x["h"] = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False))
    x["n"] = rng.integers(2, 9, 5000)
    blob = jaccard.pack_counts(x)
    assert len(blob) < 0.72 * x.nbytes
    assert np.array_equal(jaccard.unpack_counts([blob, jaccard.pack_counts(x[:1])]), np.concatenate([x, x[:1]]))
