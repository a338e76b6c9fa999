"""Counting over DataFrames.

Chunks, tokens and measures come from one Arrow pass over one scan: a text is divided and
measured at once, in the worker, and leaves as rows or numbers. Within it, text whose
letters are Latin is measured by one expression; other text by the boundary kernel. Word
counts without chunks (`words_of`) are built-in expressions for Latin text, and only
other text reaches Python.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import native
from glyphmill.functions.counting import count as count_text
from glyphmill.functions.measure import MEASURES, measure, simple
from glyphmill.functions.measure import tokens as word_tokens
from glyphmill.functions.options import CountOptions, needs_non_words, needs_whitespace, resolve_context, resolve_mode
from glyphmill.functions.segment import segment
from glyphmill.functions.tokens import count_graphemes, count_words
from glyphmill.operators.spread import spread

WHITESPACE = "struct<spaces: bigint, tabs: bigint, newlines: bigint, other: bigint>"
NON_WORDS = f"struct<emoji: array<string>, symbols: array<string>, punctuation: array<string>, whitespace: {WHITESPACE}, counts: struct<emoji: bigint, symbols: bigint, punctuation: bigint, whitespace: bigint>>"
ITEM = f"struct<idx: int, locale: string, text: string, words: bigint, chars: bigint, segments: array<string>, non_words: {NON_WORDS}>"
RESULT = f"struct<total: bigint, counts: struct<words: bigint, non_words: bigint, total: bigint>, mode: string, items: array<{ITEM}>, non_words: {NON_WORDS}>"


#: Characters of texts whose rows are held before they flow on.
HELD = 4_000_000


def quoted(name: str) -> Column:
    """The column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def through_arrow(df: DataFrame, text: str, fields: str, rows) -> DataFrame:
    """df's other columns beside the rows that rows(text) gives for each text. A small table
    is dealt out to all cores first; what is held at once is bounded by HELD."""
    others = [c for c in df.columns if c != text]
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]
    arrow = {"int": (pa.int32(), T.IntegerType()), "bigint": (pa.int64(), T.LongType()), "string": (pa.string(), T.StringType()), "boolean": (pa.bool_(), T.BooleanType())}
    kinds = [arrow[f.strip().split(" ")[1]][0] for f in fields.split(", ")]
    # names by place on the way: those of df may hold dots
    keep = [f"k{i}" for i in range(len(others))]
    source = df.select(*(quoted(c).alias(k) for c, k in zip(others, keep)), quoted(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            owner, columns, held = [], [[] for _ in names], 0

            def flow():
                at = pa.array(owner, pa.int32())
                kept = [batch.column(k).take(at) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, *names])

            for i in range(batch.num_rows):
                value = texts[i].as_py()
                if value is None:
                    continue
                own = list(zip(*rows(value)))
                if own:
                    owner += [i] * len(own[0])
                    for c, v in zip(columns, own):
                        c.extend(v)
                held += len(value)
                if held > HELD:
                    yield flow()
                    owner, columns, held = [], [[] for _ in names], 0
            yield flow()

    schema = T.StructType([*source.drop("text").schema.fields, *(T.StructField(n, arrow[f.strip().split(" ")[1]][1]) for n, f in zip(names, fields.split(", ")))])
    return spread(source).mapInArrow(run, schema).toDF(*others, *names)


def chunks(df: DataFrame, text: str = "text", options: CountOptions = CountOptions()) -> DataFrame:
    """One row for each locale chunk of each text: df's other columns, chunk_index, locale,
    text. Null and empty texts have none."""
    resolve_context(options)
    rows = lambda value: ((i, c.locale, c.text) for i, c in enumerate(segment(value, options)))
    return through_arrow(df, text, "chunk_index int, locale string, chunk_text string", rows).withColumnRenamed("chunk_text", "text")


def tokens(df: DataFrame, text: str = "text", options: CountOptions = CountOptions()) -> DataFrame:
    """One row for each word: df's other columns, chunk_index, locale, token_index, token."""
    resolve_context(options)

    def rows(value: str):
        easy = simple(value)
        for i, c in enumerate(segment(value, options)):
            for k, token in enumerate(word_tokens(c.text, easy)):
                yield i, c.locale, k, token

    return through_arrow(df, text, "chunk_index int, locale string, token_index int, token string", rows)


def measured(df: DataFrame, text: str = "text", options: CountOptions = CountOptions()) -> DataFrame:
    """One row for each chunk with its measures: df's other columns, chunk_index, locale,
    words, word_chars, emoji, symbols, punctuation, spaces, tabs, newlines, other and
    non_word_chars (graphemes of what counts as a non-word). Texts are divided and
    measured in one pass that gives numbers, not texts."""
    resolve_context(options)
    blank = options.include_whitespace

    def rows(value: str):
        easy = simple(value)
        for i, c in enumerate(segment(value, options)):
            yield i, c.locale, *measure(c.text, easy, blank)

    return through_arrow(df, text, "chunk_index int, locale string, " + ", ".join(f"{m} bigint" for m in MEASURES), rows)


def by_locale(measures: DataFrame, *keys: str) -> DataFrame:
    """Collector rows: sums by keys and locale, with first_at, the place where the locale
    first appears (order by it; a struct if keys don't fix the document)."""
    order = F.struct(*(F.col(c) for c in ("doc_id", "chunk_index") if c in measures.columns and c not in keys)) if "doc_id" not in keys else F.col("chunk_index")
    return measures.groupBy(*keys, "locale").agg(F.min(order).alias("first_at"), *(F.sum(c).alias(c) for c in MEASURES if c in measures.columns))


def total_of(measures: DataFrame, parts: tuple[str, ...], *keys: str) -> DataFrame:
    """Sum of the chosen parts by keys; only their columns are read."""
    columns = {"words": F.col("words"), "emoji": F.col("emoji"), "symbols": F.col("symbols"), "punctuation": F.col("punctuation"), "whitespace": F.col("spaces") + F.col("tabs") + F.col("newlines") + F.col("other")}
    value = sum((columns[p] for p in parts[1:]), columns[parts[0]])
    return measures.groupBy(*keys).agg(F.sum(value).alias("total"))


def result_struct(result) -> dict:
    """A kernel result as a row of RESULT."""
    def bag(n):
        if n is None:
            return None
        counts = n.counts()
        return {"emoji": n.emoji, "symbols": n.symbols, "punctuation": n.punctuation, "whitespace": vars(n.whitespace).copy() if n.whitespace else None, "counts": {k: counts.get(k) for k in ("emoji", "symbols", "punctuation", "whitespace")}}

    items = [{"idx": i, "locale": x.locale, "text": x.text, "words": x.words, "chars": x.chars, "segments": x.segments, "non_words": bag(x.non_words)} for i, x in enumerate(result.items)]
    counts = result.counts and {"words": result.counts["words"], "non_words": result.counts["nonWords"], "total": result.counts["total"]}
    return {"total": result.total, "counts": counts, "mode": result.mode, "items": items, "non_words": bag(result.non_words)}


def count(df: DataFrame, text: str = "text", options: CountOptions = CountOptions()) -> DataFrame:
    """df with `result`, the nested result of each text in the options' mode. Null texts have
    null results; an empty text has a total of 0 and no items."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    resolve_context(options)
    kind = to_arrow_type(_parse_datatype_string(RESULT))
    at = df.columns.index(text)
    safe = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = T.StructType([*safe.schema.fields, T.StructField("result", _parse_datatype_string(RESULT))])

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                values = [None if t is None else result_struct(count_text(t, options)) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, "result"])

    return spread(safe).mapInArrow(run, schema).toDF(*df.columns, "result")


def collected_options(options: CountOptions, parts: tuple[str, ...]) -> CountOptions:
    """Options that also collect what a total of the parts needs."""
    from dataclasses import replace

    return replace(options, mode=resolve_mode(options.mode), non_words=options.non_words or needs_non_words(parts), include_whitespace=options.include_whitespace or needs_whitespace(parts))


def register(spark: SparkSession) -> None:
    """count_words, count_graphemes and segment_by_locale for SQL, and the table function
    locale_chunks(text) for LATERAL."""
    @F.pandas_udf("bigint")
    def graphemes(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else count_graphemes(t)).astype("Int64")

    @F.pandas_udf("array<string>")
    def locales(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [c.locale for c in segment(t)])

    @F.udtf(returnType="chunk_index int, locale string, text string")
    class LocaleChunks:
        def eval(self, text: str):
            for i, c in enumerate(segment(text) if text else []):
                yield i, c.locale, c.text

    spark.udf.register("count_words", _words)
    spark.udf.register("count_graphemes", graphemes)
    spark.udf.register("segment_by_locale", locales)
    spark.udtf.register("locale_chunks", LocaleChunks)


@F.pandas_udf(T.LongType())
def _words(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else count_words(t)).astype("Int64")


def words_of(text: Column) -> Column:
    """Words of any text: built in where letters are Latin; only other texts reach Python."""
    return F.coalesce(_words(F.when(~native.latin_only(text), text)), native.words(text))
