"""A corpus pipeline of five operators: what is toxic goes, then repeated lines, then near
duplicates; what is left is mixed to target weights and encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that the caller writes as Parquet and reads again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, jaccard, lines, mixing, toxicity
from glyphmill.llm.common import col, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.3 or more go. The model is fitted on the labelled
    documents among docs."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that repeat an earlier one go, blank ones apart; every document stays,
    with n_chars as its text now has."""
    out = lines.dedup_lines(docs, num=80, den=100).select(*(col(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents linked by a Jaccard of 0.8 or more, one stays."""
    return jaccard.representatives(docs, num=80, den=100, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix of sources takes them, shuffled."""
    return mixing.draw(docs, weights=(5, 2, 1), share=1.5, most=2.0, shards=64)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: (doc_id, n_tokens, ids, exact): a row for each of the mix's documents, its
    ids, and whether they decode to the text."""
    coded = bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=True)
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses trained scores, draws and BPE; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
