"""Operator 10: line dedup by an exact set-similarity join.

Method. A line is the set of its words (A-Z lower-cased, as 64-bit hashes), ordered by
rarity. Lines of sizes n and m have Jaccard >= t only if they share T = ceil(t/(1+t) *
(n + m)) words, so they share one in their prefixes of n - ceil(t n) + 1 rarest words
(prefix filter), their sizes are within t of each other (length filter), and no more
than n - T of a line's words come before the first one shared (positional filter). A
64-bit parity map of each set bounds the words not shared and rejects nearly all other
pairs. What is left is verified on whole sets; a line goes if an earlier one, by doc_id
and line number, is similar to it.

How it scales.
- Rarity comes from counters over all words of all lines, in a table of fixed size
  (words that share a counter share its count: an order, not a filter).
- Equal sets are one class; of a class only its first line can stay, and only the
  first of a task leaves it, so a line that a third of all documents hold costs a
  record for each task.
- Records go through fixed-width blobs by word. A word's list is compared in place, size
  by size, and leaves as stars, not as pairs. Long lines, whose parity maps say little,
  leave as pairs that must then share as many prefix words as a link needs, unless a
  list holds many of them. Candidates' components are verified in bounded tiles.
- Texts are read twice and exchanged once; only lines in components send their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import buckets, col, cut, mix, split_blobs, text_buffers, tidy_group, tidy_groups, tidy_map, unused
from glyphmill.llm.graph import components, lowest
from glyphmill.llm.jaccard import PAIRS, Share, added, shared_enough, tile_pairs
from glyphmill.llm.shingles import words
from glyphmill.llm.suffix import NO_ID, pack, unpack

#: Counters of words, and classes of rarity (six bits).
COUNTERS, CLASSES = 1 << 21, 64
#: Words handled at once; prefix records, and lines without any, held before they flow on.
PIECE, HELD = 400_000, 800_000
#: Longest list of a word that is compared place by place; longer ones go by size. Pairs
#: of maps that are compared without dividing them.
LIST, BLOCKED = 512, 1 << 26
#: Lines of more words have the wider map; those of still more count as long, as it says
#: less of them. Most long lines of a list whose pairs are counted.
WIDE, LONG, PAIRED = 48, 160, 64
#: Lines and words of a tile's block, and words up to which it shares a task call with others.
BLOCK, BLOCK_WORDS, SMALL_TILE = 2048, 1 << 20, 200_000
#: Near pairs of lists held as they are before they are folded to stars and counted pairs,
#: and counted pairs held before they flow on.
FOLDED, COUNTED = 1 << 19, 1 << 21

PREFIX = np.dtype([("h", "<u4"), ("node", "<i8"), ("n", "<u4"), ("at", "u1"), ("map", "<u8")])
#: Lines over WIDE words have 128 bits: `half` maps about half of the words, map ^ half the rest.
WIDE_PREFIX = np.dtype([*PREFIX.descr, ("half", "<u8")])
LINE = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<u4"), ("s1", "<i8"), ("s2", "<i8"), ("n", "<u4")])
GONE = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<u4")])  # start: the line's number
EDGES = np.dtype([("a", "<i8"), ("b", "<i8")])
ROWS = "kind long, bucket long, blob binary"
LINES, WORDS, REMOVED, EDGE, PAIR, WIDE_WORDS = range(6)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["kind", "bucket", "blob"])


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of all lines, each one's text, its number in the text) of a byte buffer.
    A line's newline belongs to it; texts end their last line."""
    a, b = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[a:b] == 10) + a + 1
    owner = np.searchsorted(offsets, breaks - 1, side="right") - 1
    per = np.bincount(owner, minlength=len(offsets) - 1) + 1
    text = np.repeat(np.arange(len(offsets) - 1), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.empty(len(text), np.int64)
    starts[nth == 0] = offsets[:-1]
    starts[nth > 0] = breaks
    return np.append(starts, b), text, nth


def line_sets(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray):
    """(line of each distinct word, word, first word of each non-blank line) with each
    line's words from the rarest on."""
    h, counts = words(data, offsets)
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = line << np.uint64(44) | rarity[(h & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(38) | h >> np.uint64(26)
    order = np.argsort(key)
    h, line = h[order], line[order].astype(np.int64)
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
        h, line = h[keep], line[keep]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(h) else np.empty(0, np.int64)
    return line, h, first


def class_names(h: np.ndarray, first: np.ndarray):
    """(s1, s2, parity map, its half) of the sets that begin at `first`."""
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    one = mix(h ^ np.uint64(0x8CB92BA72F3D8DD7))
    s1 = np.add.reduceat(one, first)
    s2 = np.bitwise_xor.reduceat(mix(h + np.uint64(0x5DEECE66D)), first)
    bit = np.uint64(1) << (one & np.uint64(63))
    parity = np.bitwise_xor.reduceat(bit, first)
    half = np.bitwise_xor.reduceat(bit * ((one >> np.uint64(6)) & np.uint64(1)), first)
    return s1.view(np.int64), s2.view(np.int64), parity, half


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of lines that hold about PIECE words at most (a line is never divided)."""
    a, step = 0, 6 * PIECE
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        b = min(b, a + (1 << 19))
        yield a, b
        a = b


def count_words(docs: DataFrame) -> np.ndarray:
    """Class of rarity of each counter, from all words of all texts."""
    spans = 16

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a in range(0, len(offsets) - 1, 2000):
                h, _ = words(data, offsets[a : a + 2001])
                total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        each = total.reshape(spans, -1)
        rows = [(0, i, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for i, x in enumerate(each) if x.any()]
        yield batch_of(rows)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // spans, np.int64)
        for blob in table.column("blob").to_pylist():
            total += np.frombuffer(pa.decompress(blob, total.nbytes, codec="zstd", asbytes=True), np.int64)
        kind = np.minimum(np.log2(np.maximum(total, 1)) * 2, CLASSES - 1).astype(np.uint8)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "blob": pa.array([kind.tobytes()], pa.binary())})

    out = np.zeros((spans, COUNTERS // spans), np.uint8)
    for r in docs.select("text").mapInArrow(tidy_map(run), ROWS).groupBy("bucket").applyInArrow(tidy_group(add), "bucket long, blob binary").collect():
        out[r.bucket] = np.frombuffer(r.blob, np.uint8)
    return out.ravel()


def repeated(x: np.ndarray) -> np.ndarray:
    """Whether a line record is at the same place as the one before: that of an equal row."""
    same = np.zeros(len(x), bool)
    if len(x):
        same[1:] = (x["doc"][1:] == x["doc"][:-1]) & (x["tag"][1:] == x["tag"][:-1]) & (x["start"][1:] == x["start"][:-1])
    return same


def places(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), GONE)
    for name in GONE.names:
        out[name] = x[name]
    return out


def gather(docs: DataFrame, rarity, share: Share, least: int, n: int) -> DataFrame:
    """Rows of prefix records by word, lines by class and lines known to go by document."""

    def run(batches):
        table = rarity.value
        lines, prefix, size = [], [], 0

        def flow():
            x = np.concatenate([np.empty(0, LINE), *lines])
            order = np.lexsort((x["start"], x["tag"], x["doc"], x["s2"], x["s1"]))
            x = x[order]
            later = np.concatenate(([False], (x["s1"][1:] == x["s1"][:-1]) & (x["s2"][1:] == x["s2"][:-1]))) if len(x) else np.empty(0, bool)
            gone = places(x[later & ~repeated(x)])
            rows = by_bucket(gone, doc_bucket(gone, n), REMOVED)
            x = x[~later]
            rows += by_bucket(x, (x["s1"].view(np.uint64) % np.uint64(n)).astype(np.int64), LINES)
            p, owner = (np.concatenate([e, *(c[i] for c in prefix)]) for i, e in enumerate((np.empty(0, WIDE_PREFIX), np.empty(0, np.int64))))
            # a class of several lines needs one line's records
            order = np.lexsort((p["h"], p["node"]))
            p, owner = p[order], owner[order]
            keep = np.concatenate(([True], (p["h"][1:] != p["h"][:-1]) | (p["node"][1:] != p["node"][:-1]))) if len(p) else np.empty(0, bool)
            p, owner = p[keep], owner[keep]
            wide = p["n"] > WIDE
            rows += [(WIDE_WORDS, b, d) for b, d in split_blobs(p[wide], owner[wide])]
            slim = np.empty(int((~wide).sum()), PREFIX)
            for name in PREFIX.names:
                slim[name] = p[name][~wide]
            rows += [(WORDS, b, d) for b, d in split_blobs(slim, owner[~wide])]
            return batch_of(rows)

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            data, offsets = text_buffers(batch.column(2))
            edges, text, nth = line_offsets(data, offsets)
            for a, b in pieces(data, edges):
                line, h, first = line_sets(data, edges[a : b + 1], table)
                length = np.diff(np.append(first, len(h)))
                s1, s2, parity, half = class_names(h, first)
                own = line[first] + a
                fine = length >= least
                lone = (share.overlap(length, length) == length) & ~share.fits(length, length + 1)  # similar to equal sets alone: the class says it
                x = np.empty(int(fine.sum()), LINE)
                x["doc"], x["tag"], x["start"] = ids[text[own[fine]]], tags[text[own[fine]]], nth[own[fine]]
                x["s1"], x["s2"], x["n"] = s1[fine], s2[fine], length[fine]
                lines.append(x)
                at = np.arange(len(h)) - np.repeat(first, length)
                used = (at < np.repeat(share.prefix(length), length)) & np.repeat(fine & ~lone, length)
                which = np.repeat(np.arange(len(first)), length)[used]
                p = np.empty(len(which), WIDE_PREFIX)
                p["h"], p["node"], p["n"], p["map"] = h[used] >> np.uint64(32), s1[which], length[which], parity[which]
                p["half"] = half[which]
                p["at"] = np.minimum(at[used], 255)
                prefix.append((p, (h[used] % np.uint64(n)).astype(np.int64)))
                size += len(p) + int((fine & lone).sum())
                if size > HELD:
                    yield flow()
                    lines.clear()
                    prefix.clear()
                    size = 0
        if lines:
            yield flow()

    return docs.mapInArrow(tidy_map(run), ROWS)


def doc_bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x["doc"].view(np.uint64) + x["tag"]) % np.uint64(n)).astype(np.int64)


def by_bucket(x: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(x)])) if len(x) else [0]
    return [(kind, int(bucket[a]), pack(x[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def apart(parity: np.ndarray, half: np.ndarray, wide, i, j) -> np.ndarray:
    """Bits in which the maps of rows i and j differ: a lower bound of the words that one of
    two lines has alone. Of lines that are both wide, 128 bits are compared."""
    whole, part = parity[i] ^ parity[j], half[i] ^ half[j]
    return np.where(wide, np.bitwise_count(part).astype(np.int64) + np.bitwise_count(whole ^ part), np.bitwise_count(whole))


def parity_pairs(parity, half, a: np.ndarray, b: np.ndarray, most: int, wide: bool, same: bool):
    """Yields (i, j) of rows a and b whose maps differ in at most `most` bits. Blocks up to
    BLOCKED pairs are compared whole; beyond, maps within `most` bits of each other agree
    in one of most + 1 parts, so each part's equal values are compared apart."""
    def compare(a, b):
        step = max(1, (1 << 21) // max(1, len(b)))
        for s in range(0, len(a), step):
            p, q = np.nonzero(apart(parity, half, wide, a[s : s + step, None], b[None, :]) <= most)
            p, q = a[s + p], b[q]
            yield (p[p < q], q[p < q]) if same else (p, q)

    if len(a) * len(b) <= BLOCKED or most + 1 > 16:
        yield from compare(a, b)
        return
    edges = [64 * i // (most + 1) for i in range(most + 2)]
    for low, high in zip(edges, edges[1:]):
        mask = np.uint64((1 << (high - low)) - 1)
        ka, kb = (parity[a] >> np.uint64(low)) & mask, (parity[b] >> np.uint64(low)) & mask
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, kb = ka[oa], kb[ob]
        for value in np.intersect1d(ka, kb):
            yield from compare(a[oa[np.searchsorted(ka, value) : np.searchsorted(ka, value, side="right")]], b[ob[np.searchsorted(kb, value) : np.searchsorted(kb, value, side="right")]])


def near_in_lists(x: np.ndarray, share: Share, longest: int = LIST, paired: int = PAIRED) -> tuple[np.ndarray, np.ndarray]:
    """All that near_pieces() gives at once."""
    edges, pairs = zip(*near_pieces(x, share, longest, paired))
    return np.concatenate(edges), added(np.concatenate(pairs))


def near_pieces(x: np.ndarray, share: Share, longest: int = LIST, paired: int = PAIRED, folded: int = FOLDED, counted: int = COUNTED):
    """Yields (edges, pairs) of the words' lists by length, position and parity map. Edges are
    stars of candidates, all in the last piece; pairs are of long lines, whose maps say
    little, and still need as many shared prefix words as a link takes (those of a pair in
    all pieces count together). No more than about `folded` near pairs are held as they are."""
    x = x[np.lexsort((x["node"], x["n"], x["h"]))]
    if len(x):
        x = x[np.concatenate(([True], (x["h"][1:] != x["h"][:-1]) | (x["node"][1:] != x["node"][:-1])))]
    h, n, at, parity, half, node = x["h"], x["n"].astype(np.int64), x["at"].astype(np.int64), x["map"], x["half"], x["node"]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(x) else np.empty(0, np.int64)
    length = np.diff(np.append(starts, len(x)))
    left = np.repeat(np.where(length <= longest, starts + length, 0), length) - np.arange(len(x))  # to the list's end
    big = n > LONG
    crowd = np.add.reduceat(big.astype(np.int64), starts) if len(x) else starts
    many = np.repeat(crowd > paired, length)  # lists that hold many long lines
    a, b, pa_, pb_, held = [], [], [], [], 0
    edges, pairs = np.empty(0, EDGES), np.empty(0, PAIRS)

    def sort_out(i, j, need):
        """Pairs near by their maps: of short lines, edges where the words before fit; of
        long ones, pairs, or edges where the list holds many."""
        nonlocal held
        early = (at[i] <= n[i] - need) & (at[j] <= n[j] - need)
        one = np.where(big[i], many[i], early)
        a.append(i[one])
        b.append(j[one])
        two = big[i] & ~many[i]
        pa_.append(i[two])
        pb_.append(j[two])
        held += len(a[-1]) + len(pa_[-1])

    def fold():
        nonlocal edges, pairs, held
        none = np.empty(0, np.int64)
        i, j = np.concatenate([none, *a]), np.concatenate([none, *b])
        p, q = lowest(np.concatenate([edges["a"], node[i]]), np.concatenate([edges["b"], node[j]]))
        edges = np.empty(int((p != q).sum()), EDGES)
        edges["a"], edges["b"] = p[p != q], q[p != q]
        i, j = np.concatenate([none, *pa_]), np.concatenate([none, *pb_])
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        more = np.empty(len(i), PAIRS)
        more["a"], more["b"], more["na"], more["nb"], more["n"] = node[i], node[j], n[i], n[j], 1
        pairs = added(np.concatenate([pairs, added(more)]))
        for c in (a, b, pa_, pb_):
            c.clear()
        held = 0

    def near_places():
        """Yields (i, j, least overlap) of the near records of the lists, some lists at a time,
        so that what a pair shares in lists nearby is counted at once."""
        load = np.cumsum(np.minimum(length, longest) * length // 2) // max(1, folded)
        cuts = np.flatnonzero(np.concatenate(([True], load[1:] != load[:-1], [True]))) if len(load) else np.zeros(1, np.int64)
        ends = np.append(starts, len(x))
        for s, e in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist()):
            i = np.flatnonzero(left[s:e] > 1) + s
            d = 1
            while len(i):
                j = i + d
                fit = share.fits(n[i], n[j])
                i, j = i[fit], j[fit]  # sizes ascend: beyond the first that doesn't fit none does
                need = share.overlap(n[i], n[j])
                near = apart(parity, half, n[i] > WIDE, i, j) <= n[i] + n[j] - 2 * need
                yield i[near], j[near], need[near]
                d += 1
                i = i[left[i] > d]
        for s, k in zip(starts[length > longest].tolist(), length[length > longest].tolist()):
            sizes, first = np.unique(n[s : s + k], return_index=True)
            ends = np.append(first[1:], k)
            for u, (low, f, e) in enumerate(zip(sizes.tolist(), first.tolist(), ends.tolist())):
                for high, g, t in zip(sizes[u:].tolist(), first[u:].tolist(), ends[u:].tolist()):
                    if not share.fits(low, high):
                        break
                    need = int(share.overlap(low, high))
                    if need == low == high:
                        continue  # only equal sets, which are one class
                    for p, q in parity_pairs(parity, half, np.arange(s + f, s + e), np.arange(s + g, s + t), low + high - 2 * need, low > WIDE, low == high):
                        yield p, q, need

    for found in near_places():
        sort_out(*found)
        if held > folded:
            fold()
            if len(pairs) > counted:
                yield edges[:0], pairs
                pairs = pairs[:0]
    fold()
    yield edges, pairs


def first_lines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line of each class, lines of classes that are later ones)."""
    x = x[np.lexsort((x["start"], x["tag"], x["doc"], x["n"], x["s2"], x["s1"]))]
    new = np.concatenate(([True], (x["s1"][1:] != x["s1"][:-1]) | (x["s2"][1:] != x["s2"][:-1]) | (x["n"][1:] != x["n"][:-1]))) if len(x) else np.empty(0, bool)
    return x[new], places(x[~new & ~repeated(x)])


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows and columns, with text without the lines that repeat earlier ones, and
    `lines_` and `removed_` (numbers of lines; with more underscores where docs have columns
    called so): a line goes if an earlier line, by (doc_id, line number), has Jaccard >=
    num/den of word sets with it, judged on the input.

    Lines are divided by \\n; words are runs without ASCII white space, A-Z lower-cased.
    Blank lines always stay; with a larger `least`, all lines under so many distinct words do,
    and remove nothing. A line without ASCII white space (Chinese, Japanese, Thai)
    is one word, so only its copies go. Null texts stay null, empty ones empty; texts and lines of any length
    are handled whole. A null doc_id counts as larger than all others. Rows with equal
    doc_ids are ordered by a hash of their texts; of fully equal rows each keeps the same
    lines. Columns of docs called as any used here don't clash. An empty table gives no rows.
    """
    share = Share(num, den)
    own = F.struct(*(col(c) for c in docs.columns if c != text_col), F.lit(0).alias(unused(docs, "none"))).alias("row_")
    keyed = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), col(text_col).cast("string").alias("text_"), own)
    unique = keyed.groupBy("doc").count().filter("count > 1").isEmpty()
    keyed = keyed.withColumn("tag", F.lit(0).cast("long") if unique else F.coalesce(F.xxhash64("text_"), F.lit(0)))
    texts = keyed.select("doc", "tag", F.col("text_").alias("text"))
    n = buckets(texts, factor=1.2, each=16 << 20)
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(count_words(texts))

    def reduce_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        kinds = table.column("kind").to_numpy()
        blobs = lambda k: table.filter(pa.array(kinds == k)).column("blob").to_pylist()
        slim = np.concatenate([np.empty(0, PREFIX), *(np.frombuffer(b, PREFIX) for b in blobs(WORDS))])
        x = np.zeros(len(slim), WIDE_PREFIX)
        for name in PREFIX.names:
            x[name] = slim[name]
        x = np.concatenate([x, *(np.frombuffer(b, WIDE_PREFIX) for b in blobs(WIDE_WORDS))])
        del slim
        for edges, pairs in near_pieces(x, share):
            rows = [(EDGE, b, d) for b, d in split_blobs(edges, edges["a"] % n)]
            yield batch_of(rows + [(PAIR, b, d) for b, d in split_blobs(pairs, ((pairs["a"] ^ (pairs["b"] << 1)) % n))])
        rows = []
        del x
        firsts, gone = first_lines(unpack(blobs(LINES), LINE))
        if len(firsts):
            rows += [(LINES, int(table.column("bucket")[0].as_py()), pack(firsts))]
        rows += by_bucket(gone, doc_bucket(gone, n), REMOVED)
        rows += [(REMOVED, r["bucket"], r["blob"]) for r in table.filter(pa.array(kinds == REMOVED)).select(["bucket", "blob"]).to_pylist()]
        yield batch_of(rows)

    found = cut(gather(texts, rarity, share, least, n).groupBy("bucket").applyInArrow(tidy_groups(reduce_bucket), ROWS))

    def edges_of(batches):
        for b in batches:
            x = np.concatenate([np.empty(0, EDGES), *(np.frombuffer(c, EDGES) for c in b.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(x["a"]), pa.array(x["b"])], names=["a", "b"])

    def lines_of(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                x = unpack([blob], LINE)
                yield pa.RecordBatch.from_arrays([pa.array(x["s1"]), pa.array(x["s2"]), pa.array(x["n"].astype(np.int64)), pa.array(x["doc"]), pa.array(x["tag"].view(np.int64)), pa.array(x["start"].astype(np.int64))], names=["s1", "s2", "n", "doc", "tag", "line"])

    def enough(table: pa.Table) -> pa.Table:
        x = shared_enough(np.concatenate([np.frombuffer(b, PAIRS) for b in table.column("blob").to_pylist()]), share)
        return pa.table({"a": x["a"], "b": x["b"]})

    edges = found.filter(F.col("kind") == EDGE).select("blob").mapInArrow(tidy_map(edges_of), "a long, b long")
    edges = edges.union(found.filter(F.col("kind") == PAIR).groupBy("bucket").applyInArrow(tidy_group(enough), "a long, b long"))
    nodes = components(edges)
    firsts = found.filter(F.col("kind") == LINES).select("blob").mapInArrow(tidy_map(lines_of), "s1 long, s2 long, n long, doc long, tag long, line long")
    asked = cut(firsts.join(nodes.select(F.col("node").alias("s1"), F.col("component").alias("cluster")), "s1").select("cluster", "n", "doc", "tag", "line").withColumn("node", F.monotonically_increasing_id()))
    sizes = asked.groupBy("cluster", "n").agg(F.count("*").alias("lines"))
    before = lambda x: F.expr(f"coalesce(sum({x}) over (partition by cluster order by n rows between unbounded preceding and 1 preceding), 0)")
    # a line may be a whole text: blocks are bounded by words as well
    placed = sizes.withColumn("block", F.greatest(F.floor(before("lines") / BLOCK), F.floor(before("lines * n") / BLOCK_WORDS)))
    placed = placed.withColumn("parts", F.greatest(F.ceil(F.col("lines") / BLOCK), F.ceil(F.col("lines") * F.col("n") / BLOCK_WORDS)).cast("int"))
    members = cut(asked.join(placed.select("cluster", "n", "block", "parts"), ["cluster", "n"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))
    blocks = cut(members.groupBy("cluster", "block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("lines"), F.sum("n").alias("words")).withColumn("b", F.monotonically_increasing_id()))
    x, y = (blocks.select("cluster", *(F.col(c).alias(c + s) for c in ("b", "low", "high", "lines", "words"))) for s in "xy")
    tiles = x.join(y, "cluster").filter(f"bx <= by and {den} * highx >= {num} * lowy and {den} * highy >= {num} * lowx and (bx != by or linesx > 1)")
    tiles = tiles.withColumn("tile", F.monotonically_increasing_id())
    tiles = cut(tiles.select("bx", "by", "tile", F.when((F.greatest("linesx", "linesy") > BLOCK // 8) | (F.greatest("wordsx", "wordsy") > SMALL_TILE), -1 - F.col("tile")).otherwise(F.pmod(F.xxhash64("tile"), F.lit(n))).alias("task")))
    sides = tiles.select(F.col("bx").alias("b"), "tile", "task", F.lit(0).alias("side")).union(tiles.filter("bx != by").select("by", "tile", "task", F.lit(1)))
    numbered = members.join(blocks.select("cluster", "block", "part", "b"), ["cluster", "block", "part"]).select("b", "node", "doc", "tag", "line")
    wanted = numbered.groupBy(F.col("doc").alias("doc_r"), F.col("tag").alias("tag_r")).agg(F.collect_list(F.struct("line", "node", "b")).alias("asked"))

    def with_rows(right: DataFrame, how: str, left: DataFrame) -> DataFrame:
        on = left.doc == right.doc_r
        return left.join(right.hint("shuffle_hash"), on if unique else on & (left.tag == right.tag_r), how)

    def fetch(batches):
        table = rarity.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            asked_ = batch.column(3)
            spans = asked_.offsets.to_numpy()
            flat = asked_.flatten()
            line, node, b = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            text = np.repeat(np.arange(batch.num_rows), np.diff(spans))
            edges, _, nth = line_offsets(data, offsets)
            at = np.flatnonzero(nth == 0)[text] + line
            size = edges[at + 1] - edges[at]
            cuts = np.concatenate(([0], np.cumsum(size)))
            for p, q in pieces(data, cuts):
                body = np.concatenate([data[s:e] for s, e in zip(edges[at[p:q]].tolist(), edges[at[p:q] + 1].tolist())])
                own, h, first = line_sets(body, cuts[p : q + 1] - cuts[p], table)
                ends = np.append(first[1:], len(h)).tolist()
                sets = [np.sort(h[s:e]).tobytes() for s, e in zip(first.tolist(), ends)]
                which = own[first] + p
                docs_ = text[which]
                yield pa.RecordBatch.from_arrays([pa.array(node[which]), pa.array(b[which]), batch.column(0).take(pa.array(docs_)), batch.column(1).take(pa.array(docs_)), pa.array(line[which]), pa.array(sets, pa.binary())], names=["node", "b", "doc", "tag", "line", "words"])

    # row_ goes along unread: with the columns of the last join, its exchange is this one
    fetched = with_rows(wanted, "inner", keyed).select("doc", "tag", "text_", "asked", "row_").mapInArrow(tidy_map(fetch), "node long, b long, doc long, tag long, line long, words binary")
    work = fetched.join(sides, "b")

    def verify(table: pa.Table) -> pa.Table:
        """Later lines of each similar pair of a task's tiles."""
        table = table.append_column("size", pa.array([len(v.as_buffer()) for v in table.column("words")], pa.int64())).sort_by([("tile", "ascending"), ("size", "ascending")])
        tile, side = table.column("tile").to_numpy(), table.column("side").to_numpy()
        doc, tag, line = (table.column(c).to_numpy() for c in ("doc", "tag", "line"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("words")]
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((line, tag, doc))] = np.arange(len(doc))
        edges = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
        gone = np.zeros(len(tile), bool)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            one, two = np.flatnonzero(side[s:e] == 0) + s, np.flatnonzero(side[s:e] == 1) + s
            for i, j in tile_pairs(one, two, sets, share):
                gone[np.where(rank[i] > rank[j], i, j)] = True
        return pa.table({"doc": doc[gone], "tag": tag[gone], "line": line[gone]})

    late = work.groupBy("task").applyInArrow(tidy_group(verify), "doc long, tag long, line long")

    def removed_of(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                r = unpack([blob], GONE)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc"]), pa.array(r["tag"].view(np.int64)), pa.array(r["start"].astype(np.int64))], names=["doc", "tag", "line"])

    exact = found.filter(F.col("kind") == REMOVED).select("blob").mapInArrow(tidy_map(removed_of), "doc long, tag long, line long")
    gone = exact.union(late).groupBy(F.col("doc").alias("doc_r"), F.col("tag").alias("tag_r")).agg(F.collect_set("line").alias("gone"))
    lines = F.split(F.col("text_"), "\n", -1)
    joined = with_rows(gone, "left", keyed)
    kept = F.array_join(F.filter(lines, lambda s, i: ~F.array_contains("gone", i.cast("long"))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text_")).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(unused(docs, "lines_")), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias(unused(docs, "removed_")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256), with all lines that aren't blank taking part."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("lines_").alias("n_lines"), F.col("removed_").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
