"""How large an input is, and dealing out one that is small or of few large parts."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables up to so many bytes are dealt out; larger ones keep the splits of their files,
#: unless one of these has over MOST bytes of them (a row group isn't divided): then in
#: parts of PART.
SMALL, MOST, PART = 256 << 20, 64 << 20, 32 << 20
#: A plan whose rows come dealt out already.
DEALT = re.compile(r"Plan ==\n(?:[ :+-]*(?:Project|Filter|MapInArrow|Generate)\b.*\n)*[ :+-]*(?:Repartition \d+, true|RepartitionByExpression \[dealt_#)")
#: A plan that only reads files.
FILES = re.compile(r"Plan ==\n(?:[ :+-]*(?:Project|Filter)\b.*\n)*[ :+-]*(Relation\b.*)")
UNITS = {u: 1 << (10 * i) for i, u in enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"))}


def optimized(df: DataFrame) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(mode="cost")
    return said.getvalue().partition("== Physical Plan ==")[0]


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, as explain() prints it; 2**50 where it has none.
    It sets numbers of partitions, never results."""
    return size_in(optimized(df))


def size_in(plan: str) -> int:
    found = re.search(r"sizeInBytes=([0-9.E+]+) (\w+)", plan)
    return min(1 << 50, int(float(found[1]) * UNITS.get(found[2], 1 << 50))) if found else 1 << 50


def largest_share(df: DataFrame) -> float:
    """The part of df's rows that its largest partition has. Counts read no column that df
    doesn't filter by, only the files' footers."""
    rows = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    return rows[0] / rows[1] if rows[1] else 0.0


def spread(df: DataFrame, small: int = SMALL, most: int = MOST, part: int = PART) -> DataFrame:
    """df, its rows dealt out to the session's shuffle partitions if it is small: a table of a
    few MB is often one row group, that is one task, whatever it costs to work on. So may a
    large one be: where files have a part of over `most` bytes, rows are dealt out, too."""
    if df.isStreaming:
        return df
    plan = optimized(df)
    size, parts = size_in(plan), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if DEALT.search(plan):
        return df
    if size <= small:
        return df.repartition(parts)
    files = FILES.search(plan)
    whole = size_in(files[1]) if files else 0  # the estimate of a few columns makes little of texts
    if whole <= most or largest_share(df) * whole <= most:
        return df
    # dealt by number: repartition() alone would sort each part first, to be repeatable
    names = [f"c{i}" for i in range(len(df.columns))]
    dealt = df.toDF(*names).withColumn("dealt_", F.monotonically_increasing_id())
    return dealt.repartition(max(parts, whole // part), "dealt_").drop("dealt_").toDF(*df.columns)
