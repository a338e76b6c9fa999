"""Operator 3: exact top-k inner products over integer vectors by MaxScore.

Method. Dimensions are the query's terms, a shard's column of a dimension its posting
list, and a term's bound the most that it can add within the shard (the query's weight
times the list's highest or lowest value). For each query the terms are ordered by
bound. Non-essential are those of the longest tail whose bounds together stay below the
query's k-th score so far: what a row gets from them alone can't make it a result. The
tail grows as that score rises. The essential postings are traversed, and a row whose
sum and the tail's bound reach the k-th score is a candidate; the others' lists are
probed for it term by term, some at a time, while it can still reach it. The first part
of a shard is short, to have a k-th score soon; parts then double. Every shard gives its
best k for each query; they are merged by score and id.

Scale. Query blocks meet candidate shards by equal tile keys, both packed to blocks of
bounded size, so no task holds more than two blocks and no row pair is ever emitted.
Work is that of a stated query set against all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.common import blob_batch, cut, tidy_group, tidy_map

#: Most rows of a candidate shard and of a query block.
SHARD, BLOCK = 1 << 16, 1 << 14
#: Rows of a shard's first part, and of a part at most; terms that are probed at once.
FIRST, CHUNK, PROBED = 128, 4096, 8


def sound(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def record(dim: int, wide: bool) -> np.dtype:
    return np.dtype([("row", "<i8"), ("id", "<i8"), ("known", "u1"), ("x", "<i8" if wide else "<i4", (dim,))])


class Scorer:
    """Best k of one shard for each query. `postings` counts the values read from posting
    lists, `pruned` the rows dropped before all of their terms were read."""

    def __init__(self, shard: np.ndarray, k: int, first: int = FIRST, chunk: int = CHUNK):
        self.k, self.shard, self.first, self.chunk = k, shard, first, chunk
        x = shard["x"].astype(np.int64)
        self.top = int(np.abs(x).max(initial=0))
        self.low, self.high = (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1], np.int64),) * 2
        self.x = x
        self.order_id = np.where(shard["known"] == 1, shard["id"], np.iinfo(np.int64).max)
        self.postings = self.pruned = 0
        self.lists: dict = {}

    def kind(self, q: np.ndarray):
        """The narrowest type whose sums are exact."""
        most = self.top * int(np.abs(q).max(initial=0)) * max(1, self.x.shape[1])
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def best(self, queries: np.ndarray):
        """(query number, candidate number, score) arrays with the k best of each query."""
        q = queries["x"].astype(np.int64)
        kind = self.kind(q)
        if kind not in self.lists:
            self.lists = {kind: np.ascontiguousarray(self.x.T.astype(kind))}
        bounds = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-bounds, axis=1, kind="stable")
        # rest[:, m]: what the terms from the m-th on can add together
        rest = np.zeros((len(q), q.shape[1] + 1), np.int64)
        rest[:, :-1] = np.take_along_axis(bounds, order, 1)[:, ::-1].cumsum(1)[:, ::-1]
        weights = np.take_along_axis(q, order, 1).astype(kind)
        out = [self.one(weights[i], order[i], rest[i], queries["row"][i], self.lists[kind]) for i in range(len(q))]
        number = np.repeat(np.arange(len(q)), [len(j) for j, _ in out])
        none = np.empty(0, np.int64)
        return number, np.concatenate([none, *(j for j, _ in out)]), np.concatenate([none, *(v for _, v in out)])

    def one(self, weights, order, rest, row, lists) -> tuple[np.ndarray, np.ndarray]:
        """(candidate numbers, scores) of one query's k best."""
        n, d = lists.shape[1], len(order)
        own = np.flatnonzero(self.shard["row"] == row)
        found, score, floor = np.empty(0, np.int64), np.empty(0, lists.dtype), None
        at, width = 0, self.first
        while at < n:
            part = lists[:, at : at + width]
            essential = d if floor is None or not (rest < floor).any() else int((rest < floor).argmax())
            s = weights[:essential] @ part[order[:essential]] if essential else np.zeros(part.shape[1], lists.dtype)
            self.postings += essential * part.shape[1]
            if floor is None:
                rows = np.arange(part.shape[1])
            else:
                rows = np.flatnonzero(s + rest[essential] >= floor)
                s = s[rows]
                for t in range(essential, d, PROBED):
                    if not len(rows):
                        break
                    more = order[t : t + PROBED]
                    s = s + weights[t : t + PROBED] @ part[more[:, None], rows]
                    self.postings += len(more) * len(rows)
                    able = s + rest[min(t + PROBED, d)] >= floor
                    rows, s = rows[able], s[able]
                if essential < d:
                    self.pruned += part.shape[1] - len(rows)
            rows = rows + at
            if len(own):
                other = ~np.isin(rows, own)
                rows, s = rows[other], s[other]
            if len(rows):
                found, score = np.concatenate([found, rows]), np.concatenate([score, s])
                best = np.lexsort((self.order_id[found], -score))[: self.k]
                found, score = found[best], score[best]
                if len(found) == self.k:
                    floor = int(score[-1])
            at, width = at + width, min(2 * width, self.chunk)
        return found, score.astype(np.int64)


def search(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shard: int = SHARD, block: int = BLOCK, first: int = FIRST, chunk: int = CHUNK) -> DataFrame:
    """For each row of vectors where `query` holds, the k rows (not itself) of the highest
    inner product of floor(scale * component), ties to the smaller id: (query_id, rank
    from 1, vec_id, score). All rows, if fewer than k.

    Vectors that are null or hold a null, NaN or infinite component take no part.
    Vectors of unequal length count as padded with zeros. Rows with equal ids are rows
    of their own (a query has one result for each); a null id ranks last among ties.
    Components beyond 64-bit integers saturate, scores beyond them wrap. Other columns are ignored; an empty
    table gives no rows.
    """
    x = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = cut(
        vectors.withColumn("is_query_", F.coalesce(query, F.lit(False)))
        .filter(sound(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("id"), F.col("is_query_").alias("is_query"), x.alias("x"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    n, queries, dim, top = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    dim, wide = dim or 0, (top or 0) >= 1 << 31 or (top or 0) < 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard), min(parts, n // 8192))
    blocks = max(1, -(-queries // block))
    kind = record(dim, wide)

    def pack(batches, number: int, copies: int, side: int):
        for batch in batches:
            ids, xs, row = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            out = np.zeros(batch.num_rows, kind)
            out["row"], out["known"] = row, ids.is_valid().to_numpy(zero_copy_only=False)
            out["id"] = ids.fill_null(0).to_numpy()
            offsets = xs.offsets.to_numpy()
            flat, length = xs.flatten().to_numpy(), np.diff(offsets)
            owner = np.repeat(np.arange(len(length)), length)
            out["x"][owner, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], length)] = flat
            own = row % number  # rows of a partition are consecutive: even shards
            for b in range(number):
                mine = out[own == b]
                for at in range(0, len(mine), 4096):
                    data = mine[at : at + 4096].tobytes()
                    yield blob_batch([(b * blocks + c if side else c * blocks + b, side, data) for c in range(copies)], ("tile", "side", "blob"))

    rows = rows.select("id", "x", "row", "is_query")
    packed = "tile long, side long, blob binary"
    candidates = rows.select("id", "x", "row").mapInArrow(tidy_map(lambda it: pack(it, shards, blocks, 1)), packed)
    wanted = rows.filter("is_query").select("id", "x", "row").mapInArrow(tidy_map(lambda it: pack(it, blocks, shards, 0)), packed)

    def tile(table: pa.Table) -> pa.Table:
        read = lambda s: np.concatenate([np.empty(0, kind), *(np.frombuffer(b, kind) for b, side in zip(table.column("blob").to_pylist(), table.column("side").to_pylist()) if side == s)])
        rows, asked = read(1), read(0)
        i, j, v = Scorer(rows, k, first, chunk).best(asked)
        out = (asked["row"][i], asked["id"][i], rows["id"][j], rows["known"][j] == 0, v)
        return pa.table({"row": out[0], "query_id": out[1], "vec_id": pa.array(out[2], pa.int64(), mask=out[3]), "score": out[4]})

    best = candidates.union(wanted).groupBy("tile").applyInArrow(tidy_group(tile), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
