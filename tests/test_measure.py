import random

import regex
from pyspark.sql import functions as F

from glyphmill.functions.measure import measure, simple, tokens
from glyphmill.functions.patterns import FAST_WORD, WORD
from glyphmill.functions.tokens import count_graphemes, word_list
from glyphmill.operators import frames
from glyphmill.operators.spread import SMALL, input_bytes, spread
from glyphmill.plans import catalogue

PARTS = ["a", "é", "ñ", "word", "7", "42", "_", "__", ".", ",", ":", "'", "’", ";", " ", "\t", "\r", "\n", "\r\n", "\xa0", "½", "€", "+", "-", "漢", "か", "а", "é", "👋", "1️⃣", "!"]


def texts(n=3000):
    rng = random.Random(6)
    return ["".join(rng.choices(PARTS[: rng.choice([5, 16, 25, len(PARTS)])], k=rng.randint(0, 14))) for _ in range(n)]


def test_both_forms_of_the_pattern_find_the_same(spark):
    slow, fast = regex.compile(WORD), regex.compile(FAST_WORD)
    every = texts()
    for t in every:
        assert slow.findall(t) == fast.findall(t)
    df = spark.createDataFrame([(t,) for t in every], "t string")
    assert df.filter(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)) != F.regexp_extract_all("t", F.lit(FAST_WORD), F.lit(0))).count() == 0


def test_simple_texts_measure_as_the_kernel_does():
    seen = 0
    for t in texts():
        if simple(t):
            seen += 1
            assert tokens(t, True) == word_list(t)
            for blank in (False, True):
                assert measure(t, True, blank) == measure(t, False, blank), t
    assert seen > 800


def test_word_counts_of_any_script(spark):
    every = [*texts(400), None, "", "안녕 мир नमस्ते 漢字かな hello"]
    df = spark.createDataFrame(list(enumerate(every)), "i long, t string")
    got = {r.i: r.n for r in df.select("i", frames.words_of(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else len(word_list(t)) for i, t in enumerate(every)}


def test_one_python_pass_over_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "a niño"), (2, "en", "s", "x")], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("collector_by_document", "corpus_collector", "tokens_tall", "chunks_tall", "counts_flat"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        first = plan.partition("== Initial Plan ==")[0]
        assert first.count("MapInArrow") == 1 and first.count("Scan parquet") == 1, name


def test_small_tables_are_dealt_out(spark):
    df = spark.range(100).coalesce(1)
    assert 0 < input_bytes(df) < SMALL
    assert spread(df).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = spread(df).selectExpr("id + 1 AS id").filter("id > 3")
    assert spread(once) is once and spread(once.groupBy("id").count()) is not once
    large = spark.range(1 << 40)
    assert input_bytes(large) > SMALL and spread(large) is large


def test_long_texts_leave_in_parts(spark):
    df = spark.createDataFrame([(i, "El niño. the rest. " * 60_000) for i in range(8)] + [(9, "x")], "i long, text string").coalesce(1)
    rows = frames.measured(df).groupBy("i").agg(F.sum("words").alias("w"), F.count("*").alias("n")).collect()
    assert {(r.i, r.w) for r in rows} == {(i, 240_000) for i in range(8)} | {(9, 1)}
    assert count_graphemes("x\r\n") == 2


def test_large_row_groups_are_dealt_out(spark, tmp_path):
    path = f"{tmp_path}/one.parquet"
    texts = spark.range(30_000).selectExpr("id", "id % 7 AS `a.b`", "sha2(string(id), 256) AS text")
    texts.coalesce(1).write.parquet(path)  # a row group, that is a task, however many splits
    df = spark.read.parquet(path).select("id", "`a.b`", "text")
    even = spread(df, small=0, most=100_000, part=400_000)
    assert even.columns == df.columns and even.exceptAll(df).isEmpty() and even.count() == 30_000
    held = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 4 and max(held) < 12_000
    once = even.filter("id > 3")
    assert spread(once, small=0, most=100_000) is once
    # parts that are small enough stay where they are, and what isn't read from files is left alone
    assert spread(df, small=0) is df
    joined = df.join(df.select("id"), "id")
    assert spread(joined, small=0, most=0) is joined
