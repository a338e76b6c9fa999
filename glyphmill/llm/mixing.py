"""Operator 7: mixing sources to target weights with a hypergeometric splitting tree.

Method. Every source is cut into blocks of documents by a keyed hash, so that its
blocks, taken in order, are a random permutation of it; a second pass over them gives
repeats. Targets follow from the weights by resharing what exceeds a source's limit.
A source's quota is the whole passes its target holds, then whole blocks, then
documents of one last block (found by histograms of two levels, never by sorting the
source). A tree over the output shards splits the vector of block quotas: each node
draws the left half's share from the multivariate hypergeometric distribution, down
to single shards, so each source's quotas are met exactly. Each shard draws its own,
disjoint range of every source's permuted blocks and is shuffled within itself.

Scale. Texts are read once, for sizes; the rest works on a narrow table. A hot source
is spread over its blocks. The tree is drawn in two levels, whose distribution is that
of one: on the driver for groups of STRATA sources (one number a group and shard), then
on the executors for the sources of each group, given the group's shares. Blocks have
`block_words` words whatever a source's size; a mix has 10**9 of them at most (numpy's
limit for such draws: with the default, 65 trillion words), else it raises an error.
Shards are divided into ranges of the shuffling key, by the size of the input, so that
no task sorts more than about PART bytes; read in order, they are the shuffled shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.common import col, cut, input_bytes, numbered, tidy_group

#: Words a block holds about, and sources that are a group of the tree's first level.
BLOCK_WORDS, STRATA = 1 << 16, 4096
#: Parts that a source's permutation is divided into, twice, to find where its quota ends.
DIGITS = 12
#: Rows of a table of sources, times their columns, that are broadcast; a larger one is
#: joined salted.
BROADCAST_CELLS = 1 << 20
SALTS = 64
#: Bytes of a range of a shard, about.
PART = 128 << 20
WORDS = r"[^\x20\x09-\x0D]+"
BITS = 52


def size_of(text: Column) -> Column:
    """Words of a text, as runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place_of(doc_id: Column, seed: int) -> Column:
    """A document's place in its source's permutation, 0 <= place < 2**52."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed).cast("long")), 64 - BITS)


def level(sources: DataFrame, share: float, most: float) -> float:
    """Words a unit of weight gets once no target is above `most` times its source."""
    over = lambda x: F.col("weight") * F.lit(x) > F.col("source_size") * F.lit(most)
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    found, capped = share * total / free, -1
    while True:
        words, free, n = sources.agg(
            F.sum(F.when(over(found), F.col("source_size")).otherwise(0)), F.sum(F.when(over(found), 0).otherwise(F.col("weight"))), F.count(F.when(over(found), 1))
        ).first()
        if n == capped or not free:
            return found
        found, capped = (share * total - most * words) / free, n


def split(quotas: np.ndarray, shards: int, seed, totals: np.ndarray | None = None) -> np.ndarray:
    """How many blocks of each source each shard gets: (shards, sources), by recursive
    multivariate hypergeometric draws. Columns sum to the quotas exactly, rows to
    `totals`; without those, rows differ in their sums by the tree's rounding at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(q: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = q
            return
        mid = (a + b) // 2
        rng = np.random.default_rng([*np.atleast_1d(seed), a, b])
        n = int(q.sum()) * (mid - a) // (b - a) if totals is None else int(totals[a:mid].sum())
        left = rng.multivariate_hypergeometric(q, n, method="marginals")
        node(left, a, mid)
        node(q - left, mid, b)

    node(quotas.astype(np.int64), 0, shards)
    return out


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def join_sources(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """docs (source_, place, ...) with their source's row; no hot source meets in one task."""
    if few:
        return docs.join(F.broadcast(sources), same("source_", "source"), "left")
    salted = sources.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, same("source_", "source") & same("salt", "salt_"), "left").drop("salt", "salt_")


def block_of(place: str, blocks: str) -> Column:
    return F.floor(F.col(place) / F.lit(float(1 << BITS)) * F.col(blocks)).cast("long")


def quotas(docs: DataFrame, weights, share: float, most: float, seed: int, block_words: int) -> tuple[DataFrame, DataFrame, int]:
    """(narrow table of documents, table of sources with targets and last places, number of
    sources). Both are cut."""
    narrow = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source_"), size_of(F.col("text")).alias("size"), place_of(F.col("doc_id").cast("long"), seed).alias("place")))
    totals = narrow.groupBy(F.col("source_").alias("source")).agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, F.struct(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight))
    top = level(ranked, share, most)
    size, target = F.col("source_size"), F.col("target")
    sources = (
        ranked.withColumn("target", F.least(size * F.lit(float(most)), F.col("weight") * F.lit(top)))
        .withColumn("passes", F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long"))
        .withColumn("rest", target - F.col("passes") * size)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / block_words)).cast("long"))
    )
    count = ranked.count()
    few = count * 16 <= BROADCAST_CELLS

    # The last place of a source's remainder, in three steps that narrow it down.
    digit = lambda n: F.shiftright("place", BITS - n * DIGITS)
    placed = join_sources(narrow, sources.select("source", "rest"), few).withColumn("one", digit(1)).withColumn("two", digit(2))

    def boundary(rows: DataFrame, key: str) -> DataFrame:
        """The first group of each source at whose end the remainder is reached."""
        by = Window.partitionBy("source").orderBy(key)
        sums = rows.groupBy("source", key, "rest").agg(F.sum("size").alias("words"))
        cums = sums.withColumn("upto", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        firsts = cums.filter(F.col("upto") >= F.col("rest")).withColumn("n", F.row_number().over(by)).filter("n = 1")
        return firsts.select(F.col("source").alias("source_b"), F.col(key).alias("key_b"), (F.col("upto") - F.col("words")).alias("before_b"))

    wanted = placed.filter("rest > 0")
    first = cut(boundary(wanted, "one"))
    hint = F.broadcast if few else (lambda x: x)
    inner = wanted.join(hint(first), same("source", "source_b") & (F.col("one") == F.col("key_b"))).withColumn("rest", F.col("rest") - F.col("before_b")).drop("source_b", "key_b", "before_b")
    second = boundary(inner, "two")
    last = inner.join(second, same("source", "source_b") & (F.col("two") == F.col("key_b"))).withColumn("rest", F.col("rest") - F.col("before_b")).drop("source_b", "key_b")
    steps = last.groupBy("source", "rest", "place").agg(F.sum("size").alias("words"))
    steps = steps.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    # of the documents' ends, the nearest to the remainder; the place before all others ends at 0
    ends = steps.select("source", "rest", F.explode(F.array(F.struct(F.col("place"), F.col("upto")), F.struct((F.col("place") - 1).alias("place"), (F.col("upto") - F.col("words")).alias("upto")))).alias("end"))
    nearest = ends.groupBy(F.col("source").alias("source_n")).agg(F.min(F.struct(F.abs(F.col("end.upto") - F.col("rest")).alias("off"), F.col("end.place").alias("place"))).alias("best"))
    sources = sources.join(nearest, same("source", "source_n"), "left").withColumn("last_place", F.coalesce(F.col("best.place"), F.lit(-1)).cast("long")).drop("source_n", "best")
    sources = sources.withColumn("last_block", F.when(F.col("last_place") >= 0, block_of("last_place", "blocks")).otherwise(F.lit(-1)).cast("long"))
    return narrow, cut(sources.withColumn("quota", F.col("passes") * F.col("blocks") + F.col("last_block") + 1)), count


def with_shards(sources: DataFrame, shards: int, seed: int, strata: int = STRATA) -> DataFrame:
    """sources (nth, quota, ...) with `ends`: the number of its blocks that each shard's range
    ends before."""
    sources = sources.withColumn("stratum", F.floor(F.col("nth") / strata).cast("long"))
    found = {r.stratum: r.q for r in sources.groupBy("stratum").agg(F.sum("quota").alias("q")).collect()}
    order = sorted(found)
    if sum(found.values()) >= 10**9:
        raise ValueError(f"A mix has fewer than 10**9 blocks, not {sum(found.values())}: take a larger block_words.")
    shares = split(np.array([found[s] for s in order], np.int64), shards, (seed,)) if order else np.zeros((shards, 0), np.int64)
    table = sources.sparkSession.createDataFrame([(s, shares[:, n].tolist()) for n, s in enumerate(order)], "stratum long, shares array<long>")

    def divide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        stratum, totals = rows.column("stratum")[0].as_py(), np.array(rows.column("shares")[0].as_py(), np.int64)
        ends = split(rows.column("quota").to_numpy(), shards, (seed, stratum), totals).cumsum(0)
        return pa.table({"nth_": rows.column("nth"), "ends": pa.array(list(ends.T), pa.list_(pa.int64()))})

    drawn = cut(sources.select("stratum", "nth", "quota").join(table, "stratum").groupBy("stratum").applyInArrow(tidy_group(divide), "nth_ long, ends array<long>"))
    return sources.join(drawn, F.col("nth") == F.col("nth_")).drop("nth_", "stratum")


def shard_of(slot: Column) -> Column:
    return F.size(F.filter("ends", lambda e: e <= slot))


def copies() -> Column:
    return (F.col("passes") + (F.col("place") <= F.col("last_place")).cast("long")).cast("long")


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7, block_words: int = BLOCK_WORDS, strata: int = STRATA) -> DataFrame:
    """The mix of docs (doc_id, text, source): a row for each document with doc_id, size,
    source, source_size, target (its source's words in the mix), copies (how often the
    mix takes it, at most ceil(most)), taken (words) and shards (of each copy).

    Sources by code point, null as one of its own and last, take the weights in turn.
    Null and empty texts have size 0; texts are never cut. Rows with the same doc_id
    share a place in the permutation, and are taken alike; a null doc_id is such an id.
    Sources without words get nothing. Other columns are ignored, so their names can't
    clash; an empty table gives no rows. Reruns agree: all draws follow from seed,
    doc_ids and sizes.
    """
    narrow, sources, n = quotas(docs, weights, share, most, seed, block_words)
    sources = with_shards(sources, shards, seed, strata)
    rows = join_sources(narrow, sources, n * (shards + 16) <= BROADCAST_CELLS).withColumn("copies", copies())
    slot = lambda epoch: epoch * F.col("blocks") + block_of("place", "blocks")
    drawn = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda epoch: shard_of(slot(epoch)))).otherwise(F.array().cast("array<int>"))
    return rows.select("doc_id", "size", F.col("source_").alias("source"), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), drawn.alias("shards"))


def draw(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7, block_words: int = BLOCK_WORDS, strata: int = STRATA, part: int = PART) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' columns, shuffled: rows are
    spread by shard and range of a keyed hash, and ordered by it within a range. Cases as
    in plan(); columns may have any names."""
    _, sources, n = quotas(docs, weights, share, most, seed, block_words)
    sources = with_shards(sources, shards, seed, strata).select("source", "passes", "last_place", "blocks", "ends")
    own = F.struct(*(col(c) for c in docs.columns)).alias("row_")
    rows = docs.select(own, F.col("source").cast("string").alias("source_"), place_of(F.col("doc_id").cast("long"), seed).alias("place"))
    rows = join_sources(rows, sources, n * (shards + 16) <= BROADCAST_CELLS).withColumn("copies", copies()).filter("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("slot_", F.col("epoch") * F.col("blocks") + block_of("place", "blocks"))
    ranges = min(1 << 20, max(1, -(-int(input_bytes(docs) * share) // (shards * part))))
    rows = rows.select("row_", shard_of(F.col("slot_")).alias("shard_"), F.xxhash64("place", "epoch", F.lit(seed + 1)).alias("key_"))
    rows = rows.withColumn("range_", F.floor((F.col("key_") / F.lit(float(1 << 64)) + 0.5) * ranges).cast("long"))
    rows = rows.repartition("shard_", "range_").sortWithinPartitions("shard_", "range_", "key_")
    return rows.select(*(F.col("row_")[c].alias(c) for c in docs.columns))
