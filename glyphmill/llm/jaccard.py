"""Operator 9: n-gram Jaccard self-join by T-occurrence search (DivideSkip).

Method. A document is the set of its word shingles (64-bit hashes), ordered rarest
first. Two sets of sizes n and m reach Jaccard t only if they share T = ceil(t/(1+t) *
(n + m)) shingles, so each must show one among its first n - ceil(t n) + 1. These
prefixes give candidates; the search itself is T-occurrence: with the inverted lists
of a block of documents, a query's longest lists are set aside, the others are merged
(by a merge sort of lists that ascend, which gives what a heap would), documents found
often enough there are probed for in the long lists by binary search,
and those that reach the required overlap are kept. Overlaps are exact counts.

How it scales.
- Equal sets are one class from the start: thousands of copies cost one entry a task.
- Prefix records go through fixed-width blobs by shingle, not through rows. Shingles of
  high document frequency (counted over all documents) come last in every set, so a
  passage that many documents share is in hardly any prefix. The table of them has at
  most HOT entries; it sets an order, which any set of frequent shingles does exactly.
- A shingle's list of up to PAIRED sets gives pairs, which must then share as many
  prefix shingles as a link needs; a longer list, whose sets are ordered by size, only
  links neighbours, so no large group is ever expanded into its pairs. Lists travel as
  lists, to where those of the same lowest set meet, and pairs as counts from there: a
  group of k near copies costs 12 bytes a record, not 28 bytes for each of k / 2 pairs.
- Components of these candidates are the clusters within which the search runs, in
  tiles of bounded blocks of size-compatible documents. A tile returns link counts and
  a spanning forest.
- Texts are read three times, which costs less than storing their sets once. Members of
  clusters are sent as compressed texts (or as hashes, where these are shorter), to be
  divided again within the tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import blob_batch, buckets, col, cut, mix, numbered, read_blobs, slices, split_blobs, text_buffers, tidy_group, tidy_map, unused
from glyphmill.llm.graph import components, lowest
from glyphmill.llm.shingles import shingle_sets

#: Entries of the table of frequent shingles, and how frequent they are at least.
HOT, OFTEN = 1 << 20, 16
#: Longest list of a prefix shingle that is paired, and pairs that are expanded at once.
PAIRED, EXPANDED = 32, 1 << 20
#: Shingles held before counts or prefixes flow on; documents and shingles of a block.
HELD, BLOCK_DOCS, BLOCK_SHINGLES = 1_000_000, 2048, 1_000_000
#: Shingles of a tile's block up to which it shares a task call with other tiles.
SMALL_TILE = 200_000
#: Most bits of the filter that spares the third reading most documents, a document's bits
#: in it, and bits of a part of it that a task sends as one blob.
FILTER_BITS, EACH, PAGE = 1 << 28, 16, 1 << 20

#: Ids of kept or of dropped rows that are broadcast at most (some 60 MB as a hash table).
SENT = 1 << 20
#: In place of a text's length, that hashes follow.
RAW = b"\xff" * 8

COUNTS = np.dtype([("h", "<u8"), ("n", "<u4")])
PREFIX = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<u4")])
PAIRS = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<u4"), ("nb", "<u4"), ("n", "<u4")])
EDGES = np.dtype([("a", "<i8"), ("b", "<i8")])
MEMBER = np.dtype([("node", "<i8"), ("n", "<u4")])


class Share:
    """A Jaccard threshold num/den and the exact bounds that follow from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n):
        """Least size of a partner of a set of size n, and least overlap with one."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """Least overlap of sets of sizes n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n):
        return n - self.least(n) + 1

    def fits(self, small, large):
        return self.den * small >= self.num * large


def key_of(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set of hashes, as signed integers."""
    with np.errstate(over="ignore"):
        a = mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mix(x + np.uint64(0x2545F4914F6CDD1D)), initial=np.uint64(len(x)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def ordered(x: np.ndarray, hot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set in the global order: frequent shingles last, by count, others by hash."""
    if not len(hot):
        return x
    at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
    is_hot = hot[at] == x
    if not is_hot.any():
        return x
    late = x[is_hot]
    return np.concatenate([x[~is_hot], late[np.argsort(often[at[is_hot]], kind="stable")]])


def number(ids, size: int) -> np.ndarray:
    """Places of ids (an Arrow column of longs, null allowed) in a filter of `size` bits."""
    x = ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64)
    return (mix(x + np.uint64(77)) % np.uint64(size)).astype(np.int64)


def pack_counts(x: np.ndarray) -> bytes:
    """COUNTS records of ascending hashes, as zstd-compressed planes of bytes, hashes as
    differences: where most documents have copies, nearly all shingles are counted."""
    columns = (np.diff(x["h"], prepend=np.uint64(0)), x["n"].copy())
    raw = b"".join(c.view(np.uint8).reshape(len(x), -1).T.tobytes() for c in columns)
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(blobs) -> np.ndarray:
    out = [np.empty(0, COUNTS)]
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = np.frombuffer(pa.decompress(blob[8:], n * COUNTS.itemsize, codec="zstd", asbytes=True), np.uint8)
        x = np.empty(n, COUNTS)
        x["h"] = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(n), dtype=np.uint64)
        x["n"] = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").reshape(n)
        out.append(x)
    return np.concatenate(out)


def signatures(docs: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """One reading: rows (doc_id, n, s1, s2), and blobs of shingle counts by bucket."""

    def run(batches):
        seen: dict[tuple, None] = {}
        held, size = [], 0

        def flow():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            out = np.empty(int(more.sum()), COUNTS)
            out["h"], out["n"] = h[more], n[more]
            rows = [(b, pack_counts(np.frombuffer(x, COUNTS))) for b, x in split_blobs(out, (out["h"] % np.uint64(n_buckets)).astype(np.int64))]
            k = len(rows)
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n", "s1", "s2", "bucket", "blob"])

        for batch in batches:
            rows = []
            for x in shingle_sets(*text_buffers(batch.column(1)), width):
                s1, s2 = key_of(x)
                rows.append((len(x), s1, s2))
                if len(x) and (s1, s2) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen[s1, s2] = None
                    held.append(x)
                    size += len(x)
            cols = list(zip(*rows)) or [[], [], []]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=["doc_id", "n", "s1", "s2", "bucket", "blob"])
            if size > HELD:
                yield flow()
                held.clear()
                size = 0
        if held:
            yield flow()

    return docs.mapInArrow(tidy_map(run), "doc_id long, n long, s1 long, s2 long, bucket long, blob binary")


def frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, counts) of the most frequent shingles."""

    def add(table: pa.Table) -> pa.Table:
        x = unpack_counts(table.column("blob").to_pylist())
        h, at = np.unique(x["h"], return_inverse=True)
        n = np.bincount(at, x["n"], len(h)).astype(np.int64)
        keep = n >= OFTEN
        return pa.table({"h": h[keep].view(np.int64), "n": n[keep]})

    found = counted.filter("blob is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(tidy_group(add), "h long, n long")
    table = found.orderBy(F.col("n").desc(), "h").limit(HOT).toArrow()
    h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, width: int, share: Share, hot, n_buckets: int) -> DataFrame:
    """Blobs of prefix records by shingle; equal sets once a task."""

    def run(batches):
        names, often = hot.value
        seen: dict[tuple, None] = {}
        held, size = [], 0

        def flow():
            out = np.empty(size, PREFIX)
            out["h"] = np.concatenate([h for h, _, _ in held])
            lengths = [len(h) for h, _, _ in held]
            out["node"] = np.repeat(np.array([s for _, s, _ in held], np.int64), lengths)
            out["n"] = np.repeat(np.array([n for _, _, n in held], np.uint32), lengths)
            return blob_batch(list(split_blobs(out, (out["h"] % np.uint64(n_buckets)).astype(np.int64))))

        for batch in batches:
            for x in shingle_sets(*text_buffers(batch.column(0)), width):
                if not len(x):
                    continue
                key = key_of(x)
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen[key] = None
                h = ordered(x, names, often)[: share.prefix(len(x))].copy()  # not a view that keeps the set
                held.append((h, key[0], len(x)))
                size += len(h)
            if size > HELD // 2:
                yield flow()
                held.clear()
                size = 0
        if held:
            yield flow()

    return docs.select("text").mapInArrow(tidy_map(run), "bucket long, blob binary")


def listed(x: np.ndarray, share: Share, paired: int = PAIRED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sets of compatible sizes in the inverted lists of prefix records: (MEMBER, the
    runs' lengths) of runs of up to `paired`, and EDGES that link the neighbours in longer ones."""
    x = x[np.lexsort((x["node"], x["n"], x["h"]))]
    same = (x["h"][1:] == x["h"][:-1]) & (x["node"][1:] == x["node"][:-1])
    x = x[np.concatenate(([True], ~same))] if len(x) else x
    n, node = x["n"].astype(np.int64), x["node"]
    apart = (x["h"][1:] != x["h"][:-1]) | ~share.fits(n[:-1], n[1:])
    starts = np.flatnonzero(np.concatenate(([True], apart))) if len(x) else np.empty(0, np.int64)
    length = np.diff(np.append(starts, len(x)))
    each = np.repeat(length, length)
    short = (each > 1) & (each <= paired)
    members = np.empty(int(short.sum()), MEMBER)
    members["node"], members["n"] = node[short], x["n"][short]
    i = np.flatnonzero(~apart & (each[1:] > paired))
    p, q = lowest(node[i], node[i + 1])  # the links of all long runs, as stars
    edges = np.empty(int((p != q).sum()), EDGES)
    edges["a"], edges["b"] = p[p != q], q[p != q]
    return members, length[(length > 1) & (length <= paired)], edges


def reordered(members: np.ndarray, length: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs and their lengths in the given order."""
    begin, length = (np.cumsum(length) - length)[order], length[order]
    at = np.cumsum(length) - length
    return members[np.repeat(begin - at, length) + np.arange(int(length.sum()))], length


def lowest_member(members: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(members["node"], np.cumsum(length) - length) if len(length) else np.empty(0, np.int64)


def run_blobs(members: np.ndarray, length: np.ndarray, n_buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, blob) of runs, by their lowest member."""
    bucket = (mix(lowest_member(members, length).view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    members, length = reordered(members, length, order)
    bucket, upto = bucket[order], np.concatenate(([0], np.cumsum(length)))
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        x = members[upto[a] : upto[b]]
        out.append((int(bucket[a]), (b - a).to_bytes(8, "little") + length[a:b].astype("<u4").tobytes() + x.tobytes()))
    return out


def read_runs(blobs) -> tuple[np.ndarray, np.ndarray]:
    members, length = [np.empty(0, MEMBER)], [np.empty(0, np.int64)]
    for x in blobs:
        x = x.as_buffer()
        n = int.from_bytes(x[:8], "little")
        length.append(np.frombuffer(x, "<u4", n, 8).astype(np.int64))
        members.append(np.frombuffer(x, MEMBER, -1, 8 + 4 * n))
    return np.concatenate(members), np.concatenate(length)


def paired_runs(members: np.ndarray, length: np.ndarray, share: Share) -> np.ndarray:
    """PAIRS of the sets that share runs, with the number of runs that they share. Runs of the
    same lowest member, which are mostly those of the same sets, are expanded together."""
    members, length = reordered(members, length, np.argsort(lowest_member(members, length), kind="stable"))
    upto = np.concatenate(([0], np.cumsum(length)))
    step = np.cumsum(length * (length - 1) // 2) // EXPANDED
    edges = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True]))) if len(step) else np.zeros(1, np.int64)
    held = [np.empty(0, PAIRS)]
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        x, run = members[upto[s] : upto[e]], np.repeat(np.arange(e - s), length[s:e])
        node, n = x["node"], x["n"].astype(np.int64)
        i = [np.flatnonzero((run[d:] == run[:-d]) & share.fits(n[:-d], n[d:])) for d in range(1, int(length[s:e].max()))]
        j = np.concatenate([k + d for d, k in enumerate(i, 1)])
        i = np.concatenate(i)
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.empty(len(i), PAIRS)
        pairs["a"], pairs["b"], pairs["na"], pairs["nb"], pairs["n"] = node[i], node[j], n[i], n[j], 1
        held.append(added(pairs))
    return added(np.concatenate(held))


def added(x: np.ndarray) -> np.ndarray:
    """PAIRS records, added up by pair."""
    x = x[np.lexsort((x["b"], x["a"]))]
    first = np.flatnonzero(np.concatenate(([True], (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])))) if len(x) else np.empty(0, np.int64)
    n = np.add.reduceat(x["n"].astype(np.int64), first) if len(first) else first
    x = x[first]
    x["n"] = n
    return x


def shared_enough(x: np.ndarray, share: Share) -> np.ndarray:
    """PAIRS records, added up by pair, of those that share enough prefix elements: all that
    a pair shares up to the nearer prefix's end are among them."""
    x = added(x)
    na, nb = x["na"].astype(np.int64), x["nb"].astype(np.int64)
    return x[x["n"] >= share.overlap(na, nb) + np.minimum(share.prefix(na) - na, share.prefix(nb) - nb)]


def candidates(records: DataFrame, share: Share, n_buckets: int, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between sets that may link, directly or over others."""

    names = ("bucket", "kind", "blob")

    def lists(table: pa.Table) -> pa.Table:
        members, length, edges = listed(read_blobs(table.column("blob"), PREFIX), share, paired)
        rows = [(b, 0, x) for b, x in run_blobs(members, length, n_buckets)]
        rows += [(b, 1, x) for b, x in split_blobs(edges, edges["a"] % n_buckets)]
        return pa.Table.from_batches([blob_batch(rows, names)])

    def pairs(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        x = paired_runs(*read_runs(table.filter(pa.array(kind == 0)).column("blob")), share)
        owner = (mix(x["a"].view(np.uint64) ^ mix(x["b"].view(np.uint64).copy())) % np.uint64(n_buckets)).astype(np.int64)
        rows = [(b, 0, x) for b, x in split_blobs(x, owner)]
        rows += [(r["bucket"], 1, r["blob"]) for r in table.filter(pa.array(kind == 1)).select(["bucket", "blob"]).to_pylist()]
        return pa.Table.from_batches([blob_batch(rows, names)])

    def links(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        x = shared_enough(read_blobs(table.filter(pa.array(kind == 0)).column("blob"), PAIRS), share)
        e = read_blobs(table.filter(pa.array(kind == 1)).column("blob"), EDGES)
        return pa.table({"a": np.concatenate([x["a"], e["a"]]), "b": np.concatenate([x["b"], e["b"]])})

    blobs = "bucket long, kind long, blob binary"
    found = records.groupBy("bucket").applyInArrow(tidy_group(lists), blobs)
    counted = found.groupBy("bucket").applyInArrow(tidy_group(pairs), blobs)
    return counted.groupBy("bucket").applyInArrow(tidy_group(links), "a long, b long")


class Index:
    """Inverted lists of a block of sets, numbered in ascending size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.names, self.start = np.unique(flat, return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def search(self, x: np.ndarray, share: Share, first: int, last: int) -> np.ndarray:
        """Members numbered first..last-1 that reach the share with the set x."""
        n = len(x)
        first = max(first, int(np.searchsorted(self.sizes, share.least(n))))
        last = min(last, int(np.searchsorted(self.sizes, n * share.den // share.num, side="right")))
        if first >= last or not len(self.names):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)
        at = at[self.names[at] == x]
        least = int(share.overlap(n, int(self.sizes[first])))
        if len(at) < least:
            return np.empty(0, np.int64)
        a, b = self.start[at], self.end[at]
        length = b - a
        order = np.argsort(-length, kind="stable")
        a, b, length = a[order], b[order], length[order]
        # set aside long lists while that spares more than probing them costs
        typical = max(1, int(length[len(length) // 2]))
        aside = min(least - 1, int((length > 16 * typical).sum()))
        steps = np.repeat(a[aside:] - np.concatenate(([0], np.cumsum(length[aside:])[:-1])), length[aside:])
        # the short lists ascend, so a stable sort merges them; equal neighbours are counted
        merged = np.sort(self.owner[steps + np.arange(len(steps))], kind="stable")
        head = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))) if len(merged) else merged
        near, count = merged[head], np.diff(np.append(head, len(merged)))
        need = share.overlap(n, self.sizes[near])
        fine = (near >= first) & (near < last) & (count >= np.maximum(need - aside, 1))
        near, count, need = near[fine], count[fine], need[fine]
        for i in range(aside):
            if not len(near):
                break
            long = self.owner[a[i] : b[i]]
            p = np.searchsorted(long, near)
            count += (p < len(long)) & (long[np.minimum(p, len(long) - 1)] == near)
            fine = count + (aside - i - 1) >= need
            near, count, need = near[fine], count[fine], need[fine]
        return near[count >= need]


def tile_links(nodes_a, copies_a, sets_a, nodes_b, copies_b, sets_b, share: Share):
    """((node, links), (a, b)) of a tile: links weighted by copies and a spanning forest.
    Without a second block, links within the first."""
    own = sets_b is None
    index = Index(sets_a)
    queries = (nodes_a, copies_a, sets_a) if own else (nodes_b, copies_b, sets_b)
    links_a, links_q = np.zeros(len(sets_a), np.int64), np.zeros(len(queries[2]), np.int64)
    p, q, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, x in enumerate(queries[2]):
        found = index.search(x, share, 0, i if own else len(sets_a))
        if len(found):
            links_a[found] += queries[1][i]
            links_q[i] += copies_a[found].sum()
            p.append(nodes_a[found])
            q.append(np.full(len(found), queries[0][i]))
            size += len(found)
            if size > 1 << 20:
                n, m = lowest(np.concatenate(p), np.concatenate(q))
                p, q, size = [n[n != m]], [m[n != m]], 0
    n, m = lowest(np.concatenate(p), np.concatenate(q))
    if own:
        nodes, links = nodes_a, links_a + links_q
    else:
        nodes, links = np.concatenate([nodes_a, nodes_b]), np.concatenate([links_a, links_q])
    return (nodes[links > 0], links[links > 0]), (n[n != m], m[n != m])


def tile_pairs(one, two, sets, share: Share):
    """Yields (i, j) arrays of the linked pairs of a tile; one and two number its blocks'
    sets in ascending size (two is empty for links within one)."""
    index = Index([sets[i] for i in one])
    for n, i in enumerate((two if len(two) else one).tolist()):
        found = index.search(sets[i], share, 0, len(one) if len(two) else n)
        if len(found):
            yield np.full(len(found), i), one[found]


def packed(x: np.ndarray, text: bytes) -> bytes:
    """A set to send: its text, compressed, after the text's length, or the hashes after RAW if they are shorter."""
    short = pa.compress(text, codec="zstd", asbytes=True)
    return len(text).to_bytes(8, "little") + short if len(short) < x.nbytes else RAW + x.tobytes()


def unpacked(blobs, width: int) -> list[np.ndarray]:
    """The sets of packed() blobs; texts are divided some MB at a time."""
    out: list = []
    held, size = [], 0

    def divide():
        offsets = np.cumsum([0, *(len(t) for _, t in held)])
        for (i, _), x in zip(held, shingle_sets(np.frombuffer(b"".join(t for _, t in held), np.uint8), offsets, width)):
            out[i] = x.copy()  # not a view of all of them

    for x in blobs:
        x = x.as_buffer()
        if x[:8] == RAW:
            out.append(np.frombuffer(x, np.uint64, -1, 8))
            continue
        held.append((len(out), pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)))
        out.append(None)
        size += len(held[-1][1])
        if size > 4 << 20:
            divide()
            held.clear()
            size = 0
    if held:
        divide()
    return out


def set_rows(batches, width: int):
    """Batches whose second column is a text -> (s1, s2, n, packed set) of those with shingles."""
    for batch in slices(batches):
        data, offsets = text_buffers(batch.column(1))
        rows = [(*key_of(x), len(x), packed(x, data[a:b].tobytes())) for x, a, b in zip(shingle_sets(data, offsets, width), offsets[:-1].tolist(), offsets[1:].tolist()) if len(x)]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.binary())], names=["s1", "s2", "n", "packed"])


def id_filter(wanted: DataFrame, size: int) -> np.ndarray:
    """A filter of `size` bits with those of wanted.low_doc set, packed. Executors pack and
    unite its pages, so what reaches the driver is its size / 8 bytes at most."""
    page = min(PAGE, size)

    def pages(batches):
        own = np.zeros(size // 8, np.uint8)
        for b in batches:
            place = number(b.column(0), size)
            np.bitwise_or.at(own, place >> 3, (1 << (place & 7)).astype(np.uint8))
        each = own.reshape(-1, page // 8)
        some = np.flatnonzero(each.any(1)).tolist()
        yield blob_batch([(i, pa.compress(each[i].tobytes(), codec="zstd", asbytes=True)) for i in some], ("page", "blob"))

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(page // 8, np.uint8)
        for blob in table.column("blob").to_pylist():
            bits |= np.frombuffer(pa.decompress(blob, page // 8, codec="zstd", asbytes=True), np.uint8)
        return pa.table({"page": table.column("page").slice(0, 1), "blob": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    found = wanted.select("low_doc").mapInArrow(tidy_map(pages), "page long, blob binary").groupBy("page").applyInArrow(tidy_group(unite), "page long, blob binary")
    for r in found.toLocalIterator():
        bits[r.page * (page // 8) : (r.page + 1) * (page // 8)] = np.frombuffer(r.blob, np.uint8)
    return bits


def wanted_sets(docs: DataFrame, wanted: DataFrame, width: int, most: int = FILTER_BITS) -> DataFrame:
    """(s1, s2, n, packed set) of the documents in wanted.low_doc, and of some others. Where a
    filter of `most` bits is enough to tell them, it is broadcast; else the texts are
    joined with the ids, so that no more than the wanted ones leave a task as sets."""
    n = max(1, wanted.count())
    if EACH * n > most:
        ids = wanted.select(F.coalesce("low_doc", F.lit(-(1 << 62))).alias("low")).distinct()
        held = docs.join(ids.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(-(1 << 62))) == F.col("low"), "left_semi")
        return held.mapInArrow(tidy_map(lambda batches: set_rows(batches, width)), "s1 long, s2 long, n long, packed binary")
    size = 1 << max(10, (EACH * n - 1).bit_length())
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, size))

    def run(batches):
        known = held.value

        def asked():
            for batch in batches:
                place = number(batch.column(0), size)
                batch = batch.filter(pa.array((known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
                if batch.num_rows:
                    yield batch

        yield from set_rows(asked(), width)

    return docs.mapInArrow(tidy_map(run), "s1 long, s2 long, n long, packed binary")


def similar(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED, filter_bits: int = FILTER_BITS) -> DataFrame:
    """For every row: (doc_id, n_shingles, n_similar, component_id) by Jaccard >= num/den
    of the sets of shingles of `width` words; words are runs without ASCII white space,
    A-Z lower-cased; of fewer words, the whole sequence is the one shingle.

    n_similar counts other rows linked directly, copies included; component_id is the
    smallest doc_id reachable (null ids don't count), the row's own included. Null, empty
    and blank texts have no shingles and link with nothing. Texts of any length count
    whole. Rows with equal doc_ids are rows of their own. Other columns are ignored; an
    empty table gives no rows.
    """
    share = Share(num, den)
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    n_buckets = buckets(docs, factor=1.2, each=8 << 20)
    first = cut(signatures(docs, width, n_buckets))
    rows = first.filter("n is not null").select("doc_id", "n", "s1", "s2")
    hot = docs.sparkSession.sparkContext.broadcast(frequent(first))
    records = prefixes(docs, width, share, hot, n_buckets)
    nodes = components(candidates(records, share, n_buckets, paired))

    classes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low_doc"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    clustered = cut(classes.join(nodes.select(F.col("node").alias("s1"), F.col("component").alias("cluster")), "s1").withColumn("node", F.monotonically_increasing_id()))
    # blocks of a cluster, in ascending size: ranges of sizes that hold about a block's
    # documents and shingles, the largest ranges split by hash
    sizes = clustered.groupBy("cluster", "n").agg(F.count("*").alias("docs"))
    by_size = "partition by cluster order by n rows between unbounded preceding and 1 preceding"
    placed = sizes.withColumn("before", F.expr(f"coalesce(sum(docs) over ({by_size}), 0)")).withColumn("load", F.expr(f"coalesce(sum(docs * n) over ({by_size}), 0)"))
    placed = placed.withColumn("block", F.greatest(F.floor(F.col("before") / BLOCK_DOCS), F.floor(F.col("load") / BLOCK_SHINGLES)))
    placed = placed.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("docs") * F.col("n") / BLOCK_SHINGLES)).cast("int"))
    placed = cut(placed.select("cluster", "n", "block", "parts"))
    members = cut(clustered.join(placed, ["cluster", "n"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))
    blocks = cut(members.groupBy("cluster", "block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("docs")).withColumn("b", F.monotonically_increasing_id()))
    a = blocks.select("cluster", F.col("b").alias("ba"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("docs").alias("docs_a"))
    b = blocks.select("cluster", F.col("b").alias("bb"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("docs").alias("docs_b"))
    tiles = a.join(b, "cluster").filter(f"ba <= bb and {den} * high_a >= {num} * low_b and {den} * high_b >= {num} * low_a")
    lone = blocks.filter("docs < 2").select(F.col("b").alias("ba"), F.col("b").alias("bb"))
    tiles = tiles.select("ba", "bb", (F.greatest(F.col("docs_a") * F.col("high_a"), F.col("docs_b") * F.col("high_b")) > SMALL_TILE).alias("large")).join(lone, ["ba", "bb"], "left_anti")
    # a large tile is a task call of its own; small ones share calls
    tiles = tiles.withColumn("tile", F.monotonically_increasing_id())
    tiles = cut(tiles.withColumn("task", F.when(F.col("large"), -1 - F.col("tile")).otherwise(F.pmod(F.xxhash64("tile"), F.lit(n_buckets)))).drop("large"))
    sides = tiles.select(F.col("ba").alias("b"), "tile", "task", F.lit(0).alias("side")).union(tiles.filter("ba != bb").select("bb", "tile", "task", F.lit(1)))
    work = members.join(blocks.select("cluster", "block", "part", "b"), ["cluster", "block", "part"]).join(sides, "b")
    sets = wanted_sets(docs, clustered, width, filter_bits).dropDuplicates(["s1", "s2", "n"])
    tasks = work.select("s1", "s2", "n", "node", "copies", "tile", "task", "side").join(sets, ["s1", "s2", "n"])

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("n", "ascending")])
        number_, side = table.column("tile").to_numpy(), table.column("side").to_numpy()
        nodes_, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        sets_ = unpacked(table.column("packed"), width)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(number_)) + 1, [len(number_)]))
        found, forest = [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            one = np.flatnonzero(side[s:e] == 0) + s
            two = np.flatnonzero(side[s:e] == 1) + s
            pick = lambda i: (nodes_[i], copies[i], [sets_[k] for k in i])
            x, y = tile_links(*pick(one), *(pick(two) if len(two) else (None, None, None)), share)
            found.append(x)
            forest.append(y)
        join = lambda rows, k: np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.int64)
        n, links, p, q = join(found, 0), join(found, 1), join(forest, 0), join(forest, 1)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"node": pa.chunked_array([pa.array(n, pa.int64()), pa.array(p, pa.int64())]), "links": pa.chunked_array([pa.array(links, pa.int64()), none(len(p))]), "other": pa.chunked_array([none(len(n)), pa.array(q, pa.int64())])})

    linked = cut(tasks.drop("s1", "s2").groupBy("task").applyInArrow(tidy_group(tile), "node long, links long, other long"))
    n_links = linked.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = clustered.select("s1", "s2", "n", "node", "low_doc").join(n_links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = known.groupBy("component").agg(F.min("low_doc").alias("low"))
    known = known.join(lows, "component").select("s1", "s2", "n", "links", "low")
    classes = cut(classes.join(known, ["s1", "s2", "n"], "left").select("s1", "s2", F.col("n").alias("size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.when(F.col("links").isNull(), F.col("low_doc")).otherwise(F.col("low")).alias("component_id")).filter("n_similar > 0"))
    out = rows.join(classes, (rows.s1 == classes.s1) & (rows.s2 == classes.s2) & (rows.n == classes["size"]), "left")
    return out.select(rows.doc_id, F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n_similar").isNull(), rows.doc_id).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """docs' rows, with all their columns, of which each component of similar() keeps one:
    that of the smallest id; of rows with equal ids the first by a hash of their columns.
    Rows without an id come after all others, and are rows of their own. Rows without
    shingles stay."""
    name = unused(docs, "kept_doc")
    repeated = not docs.groupBy(col(id_col)).count().filter(f"count > 1 or {'`' + id_col + '`'} is null").isEmpty()
    if not repeated:
        found = similar(docs, num, den, width, id_col, text_col)
        found = cut(found.select(F.col("doc_id").alias(name), (F.col("doc_id") == F.col("component_id")).alias("stays")))
        stays, goes = (found.filter(F.col("stays") == x).select(name) for x in (True, False))
        match = col(id_col).cast("long") == F.col(name)
        # the shorter list is broadcast if it may be: else the texts are exchanged
        n, m = stays.count(), goes.count()
        if min(n, m) <= sent:
            return docs.join(F.broadcast(stays), match, "left_semi") if n < m else docs.join(F.broadcast(goes), match, "left_anti")
        return docs.join(stays, match, "left_semi")
    order = F.struct(col(id_col).isNull(), col(id_col), F.xxhash64(*(col(c) for c in docs.columns)))
    own = F.struct(*(col(c) for c in docs.columns)).alias("row_")
    rows = cut(numbered(docs.select(own, order.alias("order_")), F.col("order_")).select("row_", "nth", F.col("row_")[text_col].alias("text")))
    found = similar(rows.select("nth", "text"), num, den, width, "nth", "text")
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_"))
    return rows.join(kept, F.col("nth") == F.col("kept_"), "left_semi").select(*(F.col("row_")[c].alias(c) for c in docs.columns))
