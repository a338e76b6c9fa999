"""Operator 5: embedding near-duplicates by int8 tile products with rigorous bounds.

Method. Equal vectors of a label are first folded into one representative with a
count. A representative's unit vector u is quantised to int8 q with scale s; its
residual's norm e = |u - s q| is measured, not assumed. For a pair, the exact cosine
differs from s_a s_b (q_a . q_b) by at most |s_a q_a| e_b + e_a |u_b|; the integer
products of a tile are one exact matrix product. Pairs whose upper bound stays below
the threshold are done; all others are recomputed in double precision.

Scale. A label's representatives are cut into cells by their coordinate of the highest
variance (unit vectors of cosine >= t differ there by at most sqrt(2 - 2t), so distant
cells need no product) and hot cells into blocks of bounded size by row; tiles are
pairs of blocks. A tile returns link counts and a spanning forest of its links, never
its pairs, so groups of thousands of near copies stay linear in what is exchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, tidy_group
from glyphmill.llm.graph import components, lowest
from glyphmill.llm.topk import sound

#: Most representatives in a block; rows of a tile that are multiplied at once.
BLOCK, STRIP = 1 << 13, 512
#: What rounding in double precision can add to a cosine's computation, generously.
ROUNDING = 1e-12


class Block:
    """Unit vectors, their int8 forms and error bounds."""

    def __init__(self, nodes: np.ndarray, count: np.ndarray, x: np.ndarray):
        self.nodes, self.count, self.x = nodes, count, x
        top = np.abs(x).max(1, initial=0)
        y = x / top[:, None]
        self.u = y / np.sqrt((y * y).sum(1))[:, None]
        self.s = np.abs(self.u).max(1, initial=0) / 127.0
        self.q = np.rint(self.u / self.s[:, None]).astype(np.int8)
        near = self.q * self.s[:, None]
        self.size = np.sqrt((near * near).sum(1)) * (1 + 1e-12)
        self.e = np.sqrt(((self.u - near) ** 2).sum(1)) * (1 + 1e-12) + 1e-15


def links(a: Block, b: Block, threshold: float, same: bool, strip: int = STRIP):
    """Yields (rows of a, rows of b) of linked pairs, strip by strip; within a block each once."""
    wide = a.x.shape[1] * 127 * 127 >= 1 << 24
    kind = np.float64 if wide else np.float32
    qb = b.q.astype(kind).T
    for at in range(0, len(a.nodes), strip):
        part = slice(at, at + strip)
        product = (a.q[part].astype(kind) @ qb).astype(np.float64)
        product *= a.s[part, None]
        product *= b.s[None, :]
        upper = product + (a.size[part, None] * b.e[None, :] + a.e[part, None] * (1 + 1e-12) + ROUNDING)
        i, j = np.nonzero(upper >= threshold)
        i += at
        if same:
            once = i < j
            i, j = i[once], j[once]
        for step in range(0, len(i), 1 << 16):
            p, q = i[step : step + (1 << 16)], j[step : step + (1 << 16)]
            fine = np.einsum("ij,ij->i", a.u[p], b.u[q]) >= threshold
            if fine.any():
                yield p[fine], q[fine]


def tile_links(a: Block, b: Block, threshold: float, same: bool, strip: int = STRIP):
    """(node, links weighted by copies) and a spanning forest (a, b) of the tile's links."""
    na, nb = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    forest = (np.empty(0, np.int64), np.empty(0, np.int64))
    waiting, size = [forest], 0

    def fold():
        n, m = lowest(np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting]))
        return n[n != m], m[n != m]

    for p, q in links(a, b, threshold, same, strip):
        np.add.at(na, p, b.count[q])
        np.add.at(nb, q, a.count[p])
        waiting.append((a.nodes[p], b.nodes[q]))
        size += len(p)
        if size > 1 << 20:
            waiting, size = [fold()], 0
    nodes, n = np.concatenate([a.nodes, b.nodes]), np.concatenate([na, nb])
    return (nodes[n > 0], n[n > 0]), fold()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """For every row: (vec_id, n_links, component_id, kept) by cosine >= threshold among
    rows of an equal, non-null label, in double precision.

    n_links counts other rows linked directly, copies included; component_id is the
    smallest id reachable (null ids don't count); kept is whether that is the row's own.
    Vectors that are null or zero or hold a null, NaN or infinite component, and rows
    without a label, link with nothing and stay as their own components, as do vectors
    of unequal length with one another. Rows with equal ids are rows of their own. Other
    columns are ignored; an empty table gives no rows. threshold must be over 0.
    """
    # single-precision vectors travel as they are, and are doubled where they are used
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col) if single else F.transform(vector_col, lambda x: x.cast("double"))
    wide = F.transform("v", lambda x: x.cast("double"))
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    usable = sound(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    # 128 bits name a vector among its label's
    named = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("v")))
    reps = cut(
        named.filter("ok").groupBy("label", "h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("low_id"), F.first("v").alias("v"))
    )
    dims = reps.agg(F.max(F.size("v"))).first()[0] or 0
    norm = F.sqrt(F.aggregate(F.transform(wide, lambda x: (x / F.col("top")) * (x / F.col("top"))), F.lit(0.0), lambda s, x: s + x))
    units = reps.withColumn("top", F.array_max(F.transform(wide, F.abs))).withColumn("norm", norm)
    coordinate = lambda c: F.coalesce(F.get("v", F.lit(c)).cast("double") / F.col("top") / F.col("norm"), F.lit(0.0))
    spread = units.agg(*(F.variance(coordinate(c)).alias(f"c{c}") for c in range(min(dims, 256)))).first() if dims else []
    axis = max(range(len(spread)), key=lambda c: spread[c] or 0.0, default=0)
    width = math.sqrt(max(2 - 2 * threshold, 0.0)) / 2 * 1.001 + 1e-6
    units = cut(units.withColumn("cell", F.floor(coordinate(axis) / width).cast("int")).withColumn("dim", F.size("v")).select("label", "dim", "cell", "node", "copies", "low_id", "h1", "h2", "v"))
    cells = units.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # tiles: every block with itself and the blocks after it, up to two cells on
    one = cells.select("label", "dim", F.col("cell").alias("cell_a"), F.col("parts").alias("parts_a"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("far"))
    two = cells.select("label", "dim", F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b"))
    pairs = one.withColumn("cell_b", F.col("cell_a") + F.col("far")).join(two, ["label", "dim", "cell_b"])
    pairs = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    pairs = cut(pairs.filter("cell_a < cell_b or part_a <= part_b").select("label", "dim", "cell_a", "part_a", "cell_b", "part_b").withColumn("tile", F.monotonically_increasing_id()))
    sides = pairs.select("tile", "label", "dim", F.col("cell_a").alias("cell"), F.col("part_a").alias("part"), F.lit(0).alias("side")).union(
        pairs.filter("cell_a != cell_b or part_a != part_b").select("tile", "label", "dim", "cell_b", "part_b", F.lit(1))
    )
    blocks = units.join(cells, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    work = blocks.select("label", "dim", "cell", "part", "node", "copies", "v").join(sides, ["label", "dim", "cell", "part"]).select("tile", "side", "node", "copies", "v")

    def tile(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        flat = table.column("v").combine_chunks()
        flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(side), -1).astype(np.float64)
        nodes, count = table.column("node").to_numpy(), table.column("copies").to_numpy()
        first, second = side == 0, side == 1
        a = Block(nodes[first], count[first], x[first])
        b = Block(nodes[second], count[second], x[second]) if second.any() else None
        (n, links_), (p, q) = tile_links(a, b or a, threshold, b is None, strip)
        if b is None and len(n):  # a block with itself: both ends are its own rows
            n, at = np.unique(n, return_inverse=True)
            links_ = np.bincount(at, links_).astype(np.int64)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"node": pa.chunked_array([pa.array(n, pa.int64()), pa.array(p, pa.int64())]), "links": pa.chunked_array([pa.array(links_, pa.int64()), none(len(p))]), "other": pa.chunked_array([none(len(n)), pa.array(q, pa.int64())])})

    found = cut(work.groupBy("tile").applyInArrow(tidy_group(tile), "node long, links long, other long"))
    n_links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = units.join(n_links, "node", "left").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = classes.groupBy("component").agg(F.min("low_id").alias("component_id"))
    classes = classes.join(lows, "component").select(F.col("label").alias("label_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    on = F.col("ok") & (F.col("label") == F.col("label_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
    joined = named.select("vec_id", "ok", "label", "h1", "h2").join(classes, on, "left")
    own = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
