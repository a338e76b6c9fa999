"""Operator 2: suffix-array removal of repeated strings, keeping the first copy.

What it computes. A byte goes if a string of LENGTH bytes that covers it also starts in
a document with a smaller id. In terms of the corpus's suffix array, with documents as
positions: a suffix's longest previous factor (LPF) is the longer of its common prefixes
with the previous and the next suffix in order that start in a smaller document; it goes
where that reaches LENGTH.

How it is distributed. Only suffixes that agree in LENGTH bytes matter to one another,
so the array is built in parts that never divide such a run, to a depth of LENGTH bytes
(equal ones by document). Every window of LENGTH bytes has a content-defined anchor (see
anchors.py), and equal windows have equal ones:
1. Each task reduces its texts to anchors: hashes of the anchor's gram and of its
   context (the union of its windows). Copies collapse first: of contexts that agree in
   96 bits of hash only that of the smallest document leaves the task; the others are
   known to go. So a passage that a third of all documents hold costs a record for each
   task, not for each document. This is by hash; their bytes aren't compared.
2. Records meet by gram. Of contexts that agree in those 96 bits all but the smallest
   document's go, whole. A gram in one document only is done. What is left are contexts
   that differ while their grams agree, as at the ends of a repeat.
3. For those the bytes are fetched, compressed, and keyed by the gram; if it has MANY
   of them, by it and 13 bytes beside it (left for windows that reach there, else
   right). Each part is put in suffix order, common
   prefixes of neighbours follow from their bytes, and previous and next smaller
   documents, found by jumping along pointers, give the LPF array.
4. The removed ranges of a document are united and cut from its text.
Texts are exchanged once (the exchange is reused); all else is a fraction of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.anchors import anchors
from glyphmill.llm.common import buckets, col, cut, mix, slices, text_buffers, tidy_group, tidy_map

#: Length of a repeat, of an anchor's gram, and of what keys a part beside the gram.
LENGTH, GRAM, BESIDE = 50, 24, 13
#: Anchors that a task holds before they flow on.
HELD = 1_200_000
#: A null doc_id counts as larger than all others.
NO_ID = (1 << 63) - 1

RANGE = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("end", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("end", "<u4"), ("role", "u1")])
CONTEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("windows", "<u4"), ("role", "u1")])
SOURCE, TARGET, DIVIDED = 1, 2, 4
#: Contexts of a gram, as requested, from which they are divided by the bytes beside it.
MANY = 4096
ROWS = "kind long, bucket long, head binary, body binary"


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "bucket", "head", "body"])


def runs_of(bucket: np.ndarray):
    """(order, [(bucket, from, to)]) that sorts by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])) if len(b) else np.zeros(1, np.int64)
    return order, [(int(b[s]), s, e) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]


def by_document(records: np.ndarray, n: int, kind: int) -> list[tuple]:
    """Blobs of records with a doc, by document bucket, compressed by column."""
    bucket = (mix(records["doc"].view(np.uint64) + records["tag"]) % np.uint64(n)).astype(np.int64)
    order, runs = runs_of(bucket)
    records = records[order]
    return [(kind, b, pack(records[s:e]), b"") for b, s, e in runs]


def pack(records: np.ndarray) -> bytes:
    """Records as zstd-compressed columns, doc and start as differences."""
    records = records[np.lexsort((records["start"], records["tag"], records["doc"]))]
    columns = []
    for name in records.dtype.names:
        c = records[name]
        if name in ("doc", "start"):
            c = np.diff(c, prepend=c[:1] * 0)
        columns.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes())
    raw = b"".join(columns)
    return len(records).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blobs, dtype: np.dtype) -> np.ndarray:
    """The records of pack()ed blobs."""
    out = [np.empty(0, dtype)]
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = np.frombuffer(pa.decompress(blob[8:], n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
        records, at = np.empty(n, dtype), 0
        for name in dtype.names:
            kind = dtype[name]
            c = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n)
            records[name] = np.cumsum(c, dtype=kind) if name in ("doc", "start") else c
            at += n * kind.itemsize
        out.append(records)
    return np.concatenate(out)


ANCHOR = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("end", "<u4"), ("h1", "<u4"), ("h2", "<u8")])


def pack_anchors(x: np.ndarray) -> tuple[bytes, bytes]:
    """(compressed places, hashes as they are, which don't compress)."""
    x = x[np.lexsort((x["start"], x["tag"], x["doc"]))]
    place = np.empty(len(x), RANGE)
    for name in RANGE.names:
        place[name] = x[name]
    place["end"] -= place["start"]
    return pack(place), x["h1"].tobytes() + x["h2"].tobytes()


def unpack_anchors(heads, bodies) -> np.ndarray:
    out = [np.empty(0, ANCHOR)]
    for head, body in zip(heads, bodies):
        place = unpack([head], RANGE)
        x = np.empty(len(place), ANCHOR)
        for name in RANGE.names:
            x[name] = place[name]
        x["end"] += x["start"]
        x["h1"] = np.frombuffer(body, "<u4", len(x))
        x["h2"] = np.frombuffer(body, "<u8", len(x), 4 * len(x))
        out.append(x)
    return np.concatenate(out)


def ranges(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), RANGE)
    for name in RANGE.names:
        out[name] = x[name]
    return out


def gather(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Step 1: rows of anchors (kind 0, by gram) and of removed ranges (kind 1)."""

    def run(batches):
        held, size = [], 0

        def flow():
            x = np.concatenate([np.empty(0, ANCHOR), *(h[0] for h in held)])
            owner = np.concatenate([np.empty(0, np.int64), *(h[1] for h in held)])
            order = np.argsort(x["h2"])
            x, owner = x[order], owner[order]
            new = np.concatenate(([True], (x["h2"][1:] != x["h2"][:-1]) | (x["h1"][1:] != x["h1"][:-1]))) if len(x) else np.empty(0, bool)
            first = np.flatnonzero(new)
            lowest = np.repeat(np.minimum.reduceat(x["doc"], first), np.diff(np.append(first, len(x)))) if len(x) else x["doc"]
            later = x["doc"] > lowest
            rows = by_document(merged(ranges(x[later])), n, 1)
            x, owner = x[~later], owner[~later]
            order, runs = runs_of(owner)
            x = x[order]
            rows += [(0, b, *pack_anchors(x[s:e])) for b, s, e in runs]
            return rows_batch(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            tags = batch.column(1).to_numpy().view(np.uint64)
            data, offsets = text_buffers(batch.column(2))
            for at in range(0, len(ids), 2000):
                part = offsets[at : at + 2001]
                row, start, end, _, h1, h2 = anchors(data, part, length, GRAM)
                x = np.empty(len(row), ANCHOR)
                x["doc"], x["tag"], x["start"], x["end"] = ids[row + at], tags[row + at], start, end
                x["h1"], x["h2"] = h1 >> np.uint64(32), h2
                held.append((x, (h1 % np.uint64(n)).astype(np.int64)))
                size += len(x)
                if size > HELD:
                    yield flow()
                    held.clear()
                    size = 0
        if held:
            yield flow()

    return docs.mapInArrow(tidy_map(run), ROWS)


def merged(x: np.ndarray) -> np.ndarray:
    """Ranges united where they touch, for each document."""
    if not len(x):
        return x
    x = x[np.lexsort((x["start"], x["tag"], x["doc"]))]
    new = np.concatenate(([True], (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])))
    base = (np.cumsum(new) - 1).astype(np.int64) << 33
    start, end = base + x["start"], base + x["end"]
    upto = np.maximum.accumulate(end)
    head = np.flatnonzero(np.concatenate(([True], start[1:] > upto[:-1])))
    out = x[head]
    out["end"] = (upto[np.append(head[1:], len(x)) - 1] - base[head]).astype(np.uint32)
    return out


def judge(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 2 for the anchors of a bucket: (removed ranges, requests for bytes)."""
    if not len(x):
        return np.empty(0, RANGE), np.empty(0, REQUEST)
    x = x[np.argsort(x["h1"].astype(np.uint64) << np.uint64(32) | x["h2"] >> np.uint64(32))]
    group = np.concatenate(([True], x["h1"][1:] != x["h1"][:-1]))
    variant = group | np.concatenate(([True], x["h2"][1:] != x["h2"][:-1]))
    doc = x["doc"]
    at_v, at_g = np.flatnonzero(variant), np.flatnonzero(group)
    low_v = np.minimum.reduceat(doc, at_v)
    v = np.cumsum(variant) - 1
    g = np.cumsum(group) - 1
    low_g = np.minimum.reduceat(doc, at_g)
    later = doc > low_v[v]
    target = ~later & (low_v[v] > low_g[g])
    asked = np.zeros(len(at_g), bool)
    asked[g[target]] = True
    # one source for each variant of a group with a target: any record of its lowest document
    lows = np.flatnonzero(~later & asked[g])
    _, first = np.unique(v[lows], return_index=True)
    source = np.zeros(len(x), bool)
    source[lows[first]] = True
    need = target | source
    out = np.empty(int(need.sum()), REQUEST)
    for name in RANGE.names:
        out[name] = x[name][need]
    asking = np.bincount(g[need], minlength=len(at_g))[g[need]]
    out["role"] = (source[need] * SOURCE + target[need] * TARGET + (asking >= MANY) * DIVIDED).astype(np.uint8)
    return ranges(x[later]), out


def pack_contexts(x: np.ndarray, body: np.ndarray) -> tuple[bytes, bytes]:
    """CONTEXT records by column and their bytes, both compressed, each after its length."""
    raw = b"".join(np.ascontiguousarray(x[name]).view(np.uint8).reshape(len(x), -1).T.tobytes() for name in CONTEXT.names)
    short = [len(c).to_bytes(8, "little") + pa.compress(c, codec="zstd", asbytes=True) for c in (raw, body.tobytes())]
    return short[0], short[1]


def unpack_contexts(heads, bodies) -> tuple[np.ndarray, np.ndarray]:
    x, body = [np.empty(0, CONTEXT)], [np.empty(0, np.uint8)]
    for head, text in zip(heads, bodies):
        raw, text = (np.frombuffer(pa.decompress(c[8:], int.from_bytes(c[:8], "little"), codec="zstd", asbytes=True), np.uint8) for c in (head, text))
        n, at = len(raw) // CONTEXT.itemsize, 0
        own = np.empty(n, CONTEXT)
        for name in CONTEXT.names:
            size = CONTEXT[name].itemsize
            own[name] = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(CONTEXT[name]).reshape(n)
            at += n * size
        x.append(own)
        body.append(text)
    return np.concatenate(x), np.concatenate(body)


def fetch(batches, length: int, n: int):
    """Step 3a: documents with their requests -> contexts by the part they belong to."""
    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        data, offsets = text_buffers(batch.column(2))
        heads, bodies = [], []
        for row, blob in enumerate(batch.column(3).to_pylist()):
            r = unpack([blob], REQUEST)
            s, e = r["start"].astype(np.int64) + offsets[row], r["end"].astype(np.int64) + offsets[row]
            size = e - s
            edge = np.concatenate(([0], np.cumsum(size)))
            place = np.arange(edge[-1]) + np.repeat(s - edge[:-1], size)
            heads.append((np.full(len(r), ids[row]), np.full(len(r), tags[row]), r["start"], r["role"], size))
            bodies.append(data[place])
        if not heads:
            continue
        doc, tag, start, role, size = (np.concatenate(c) for c in zip(*heads))
        body = np.concatenate(bodies)
        edge = np.concatenate(([0], np.cumsum(size)))
        # all windows of a context share its anchor, so this finds one anchor for each
        row, a, b, at, h1, _ = anchors(body, edge, length, GRAM)
        rows, chunk = [], []
        divided = (role[row] & DIVIDED) > 0
        for left in (None, True, False):
            low = np.maximum(a, at - BESIDE + 1) if left is False else a
            high = np.minimum(b - length, at - BESIDE) if left else b - length
            some = (high >= low) & (divided != (left is None))
            r, low, high, where = row[some], low[some], high[some], at[some]
            key = h1[some] * np.uint64(4) + np.uint64(2 if left is None else left)
            if left is not None:
                side = edge[r] + (where - BESIDE if left else where + GRAM)
                for i in range(BESIDE):
                    key = (key ^ body[side + i]) * np.uint64(0x100000001B3)
            x = np.empty(len(r), CONTEXT)
            x["key"], x["doc"], x["tag"], x["role"] = mix(key), doc[r], tag[r], role[r]
            x["start"], x["windows"] = start[r] + low, high - low + 1
            chunk.append((x, edge[r] + low))
        x = np.concatenate([c[0] for c in chunk])
        s = np.concatenate([c[1] for c in chunk])
        order, runs = runs_of((x["key"] % np.uint64(n)).astype(np.int64))
        x, s = x[order], s[order]
        size = x["windows"].astype(np.int64) + length - 1
        for bucket, i, j in runs:
            edges = np.concatenate(([0], np.cumsum(size[i:j])))
            place = np.arange(edges[-1]) + np.repeat(s[i:j] - edges[:-1], size[i:j])
            rows.append((0, bucket, *pack_contexts(x[i:j], body[place])))
        yield rows_batch(rows)


def common_prefixes(keys: list[np.ndarray], steps: list[int], length: int, order: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Bytes, `length` at most, that each suffix in order shares with the one before it; 0 at
    the first of a part. keys hold the 8 bytes at each of `steps` as big-endian integers."""
    out = np.full(len(order), length, np.int64)
    for k, at in zip(reversed(keys), reversed(steps)):
        x = k[order[1:]] ^ k[order[:-1]]
        differ = np.flatnonzero(x)
        out[differ + 1] = at + (x[differ].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
    out[1:][part[order[1:]] != part[order[:-1]]] = 0
    out[:1] = 0
    return out


def smaller_before(doc: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each place, bytes shared with the previous smaller: the nearest place before it
    with a smaller document (0 if none, or if fewer than `least`). A pointer to the place
    before is replaced by that one's own pointer until it leads to a smaller document,
    all at once; `shared` (with the place before) is carried along as a minimum."""
    to, low = np.arange(len(doc)) - 1, shared.copy()
    going = np.flatnonzero(to >= 0)
    while True:
        going = going[(low[going] >= least) & (low[going] > 0)]
        going = going[doc[to[going]] >= doc[going]]
        if not len(going):
            break
        via = to[going]
        low[going], to[going] = np.minimum(low[going], low[via]), to[via]
        going = going[to[going] >= 0]
    low[(to < 0) | (low < least)] = 0
    reached = np.flatnonzero(low)
    low[reached[doc[to[reached]] >= doc[reached]]] = 0
    return low


def longest_previous_factors(doc: np.ndarray, shared: np.ndarray, least: int = 0) -> np.ndarray:
    """LPF of each place of a suffix order, from the previous and the next smaller document;
    values below `least` may come out as 0."""
    after = np.append(shared[1:], 0)[::-1].copy()
    return np.maximum(smaller_before(doc, shared, least), smaller_before(doc[::-1], after, least)[::-1])


def previous_factors(x: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """Step 3b: removed ranges of the contexts of a bucket, from their suffix array."""
    if not len(x):
        return np.empty(0, RANGE)
    size = x["windows"].astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    # parts where no target follows another document can't remove anything
    order = np.argsort(x["key"], kind="stable")
    x, begin = x[order], begin[order]
    first = np.flatnonzero(np.concatenate(([True], x["key"][1:] != x["key"][:-1])))
    part = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    is_target = (x["role"] & TARGET) > 0
    least = np.minimum.reduceat(x["doc"], first)
    most = np.maximum.reduceat(np.where(is_target, x["doc"], -NO_ID - 1), first)
    alive = (least < most)[part]
    x, begin, part = x[alive], begin[alive], part[alive]
    if not len(x):
        return np.empty(0, RANGE)
    w = x["windows"].astype(np.int64)
    owner = np.repeat(np.arange(len(x)), w)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
    at = begin[owner] + nth
    # the first `length` bytes of each suffix as big-endian integers, last ones overlapping
    wide = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = wide[:-8].copy()
    for i in range(1, 8):
        eight <<= np.uint64(8)
        eight |= wide[i : len(wide) - 8 + i]
    steps = [*range(0, length - 8, 8), length - 8]
    keys = [eight[at + s] for s in steps]
    doc, own = x["doc"][owner], part[owner]
    suffixes = np.lexsort([doc, *reversed(keys), own])
    shared = common_prefixes(keys, steps, length, suffixes, own)
    factors = longest_previous_factors(doc[suffixes], shared, length)
    gone = np.zeros(len(suffixes), bool)
    gone[suffixes] = (factors >= length) & ((x["role"] & TARGET) > 0)[owner[suffixes]]
    # neighbouring windows of a context make one range
    head = gone & ~np.concatenate(([False], gone[:-1] & (owner[1:] == owner[:-1])))
    tail = gone & ~np.concatenate((gone[1:] & (owner[1:] == owner[:-1]), [False]))
    i, j = np.flatnonzero(head), np.flatnonzero(tail)
    out = np.empty(len(i), RANGE)
    out["doc"], out["tag"] = x["doc"][owner[i]], x["tag"][owner[i]]
    out["start"] = x["start"][owner[i]] + nth[i]
    out["end"] = x["start"][owner[j]] + nth[j] + length
    return out


def per_document(rows: DataFrame, dtype: np.dtype, unite: bool, name: str) -> DataFrame:
    """Blobs by document bucket -> one row (doc, tag, blob) for each document."""

    def run(table: pa.Table) -> pa.Table:
        x = unpack(table.column("head").to_pylist(), dtype)
        x = merged(x) if unite else x[np.lexsort((x["start"], x["tag"], x["doc"]))]
        first = np.flatnonzero(np.concatenate(([True], (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1])))) if len(x) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(x)).tolist()
        blobs = [pack(x[a:b]) for a, b in zip(first.tolist(), ends)]
        return pa.table({"doc_r": x["doc"][first], "tag_r": x["tag"][first].view(np.int64), name: pa.array(blobs, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(tidy_group(run), f"doc_r long, tag_r long, {name} binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: (doc_id, n_bytes, n_removed, n_spans, kept, spans): kept holds the
    bytes left, spans the removed ranges (byte offsets, end exclusive).

    A byte of the UTF-8 text goes if a `length`-byte string that covers it also occurs in
    a document with a smaller doc_id, judged on the input. Null texts are empty; texts
    below `length` bytes stay; texts of any length are handled whole. A null doc_id
    counts as larger than all others (2**63 - 1 can't be told from it). Rows with equal
    doc_ids don't affect one another.
    Other columns are ignored; an empty table gives no rows.
    """
    assert length >= GRAM + 2 * BESIDE, "a window must hold the gram and what keys its part"
    docs = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    # where ids repeat, a hash of the text tells their rows apart
    unique = docs.groupBy("doc").count().filter("count > 1").isEmpty()
    tag = F.lit(0).cast("long") if unique else F.xxhash64("text")
    docs = docs.withColumn("tag", tag)
    n = buckets(docs, factor=1.4, each=16 << 20)

    def reduce_anchors(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        own = table.filter(pa.array(kind == 0))
        gone, asked = judge(unpack_anchors(own.column("head").to_pylist(), own.column("body").to_pylist()))
        rows = by_document(gone, n, 1) + by_document(asked, n, 2)
        rows += [(1, r["bucket"], r["head"], b"") for r in table.filter(pa.array(kind == 1)).select(["bucket", "head"]).to_pylist()]
        return pa.Table.from_batches([rows_batch(rows)])

    def reduce_contexts(table: pa.Table) -> pa.Table:
        x, body = unpack_contexts(table.column("head").to_pylist(), table.column("body").to_pylist())
        return pa.Table.from_batches([rows_batch(by_document(merged(previous_factors(x, body, length)), n, 1))])

    judged = cut(gather(docs.select("doc", "tag", "text"), length, n).groupBy("bucket").applyInArrow(tidy_group(reduce_anchors), ROWS))
    keyed = docs.select("doc", "tag", "text")  # the same columns for both joins: one exchange

    def with_blobs(right: DataFrame, how: str) -> DataFrame:
        on = keyed.doc == right.doc_r
        return keyed.join(right.hint("shuffle_hash"), on if unique else on & (keyed.tag == right.tag_r), how)

    asked = with_blobs(per_document(judged.filter("kind = 2"), REQUEST, False, "asked"), "inner").select("doc", "tag", "text", "asked")
    contexts = asked.mapInArrow(tidy_map(lambda batches: fetch(batches, length, n)), ROWS)
    late = contexts.groupBy("bucket").applyInArrow(tidy_group(reduce_contexts), ROWS)
    gone = per_document(judged.filter("kind = 1").union(late), RANGE, True, "gone")

    def cutting(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column(1))
            rows = []
            for i, blob in enumerate(batch.column(2).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if blob is None:
                    rows.append((b - a, 0, 0, data[a:b].tobytes(), []))
                    continue
                r = unpack([blob], RANGE)
                start, end = r["start"].astype(np.int64), r["end"].astype(np.int64)
                edges = np.concatenate(([0], np.stack([start, end], 1).ravel(), [b - a])).reshape(-1, 2)
                kept = b"".join(data[a + s : a + e].tobytes() for s, e in edges.tolist())
                rows.append((b - a, int((end - start).sum()), len(r), kept, [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())]))
            cols = list(zip(*rows)) or [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    out = with_blobs(gone, "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "gone")
    return out.mapInArrow(tidy_map(cutting), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeats()."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
