import pytest
from pyspark.sql import functions as F

from glyphmill.functions import native
from glyphmill.functions.counting import count
from glyphmill.functions.options import CountOptions
from glyphmill.functions.segment import segment
from glyphmill.functions.tokens import NonWords, Whitespace, count_graphemes, segments, word_list
from glyphmill.operators import frames
from glyphmill.streaming import live

TEXTS = [
    "Hello world", "Hi 👋, world! 1️⃣", "el niño. the rest", "Überzug and Ranger", "こんにちは 漢字、漢字 test", "", None, "a_b __ _ x:y 3.14 1,000 don't", "é\r\n tab\t nbsp\xa0 € + = ¿qué?", "안녕 мир नमस्ते สวัสดี", "x" * 5000 + " y", "«quoted» ‹text› ½ №",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("options", [CountOptions(), CountOptions(latin_tag_hint="en"), CountOptions(use_default_latin_hints=False)])
def test_chunks_equal_the_kernel(docs, options):
    got = sorted(map(tuple, frames.chunks(docs, options=options).collect()))
    want = sorted((i, n, c.locale, c.text) for i, t in enumerate(TEXTS) if t for n, c in enumerate(segment(t, options)))
    assert got == want


def test_tokens_equal_the_kernel(docs):
    got = sorted((r.doc_id, r.chunk_index, r.token_index, r.token) for r in frames.tokens(docs).collect())
    want = sorted((i, n, k, w) for i, t in enumerate(TEXTS) if t for n, c in enumerate(segment(t)) for k, w in enumerate(word_list(c.text)))
    assert got == want


@pytest.mark.parametrize("blank", [False, True])
def test_measures_equal_the_kernel(docs, blank):
    options = CountOptions(non_words=True, include_whitespace=blank)
    want = []
    for i, t in enumerate(TEXTS):
        for n, c in enumerate(segment(t) if t else []):
            bag, w, words, chars, rest = NonWords(), Whitespace(), 0, 0, 0
            w.add(c.text)
            for part, is_word in segments(c.text):
                if is_word:
                    words += 1
                    chars += count_graphemes(part)
                elif bag.add(part, blank):
                    rest += count_graphemes(part)
            want.append((i, n, words, chars, len(bag.emoji), len(bag.symbols), len(bag.punctuation), w.spaces, w.tabs, w.newlines, w.other))
    got = frames.measured(docs, options=options)
    names = ("doc_id", "chunk_index", "words", "word_chars", "emoji", "symbols", "punctuation", "spaces", "tabs", "newlines", "other")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_nested_results(docs):
    for mode in ("chunk", "segments", "collector", "char", "char-collector"):
        options = CountOptions(mode, non_words=True)
        for r in frames.count(docs, options=options).collect():
            t = TEXTS[r.doc_id]
            if t is None:
                assert r.result is None
                continue
            k = count(t, options)
            assert (r.result.total, r.result.mode, [i.locale for i in r.result["items"]]) == (k.total, mode, [i.locale for i in k.items])


def test_totals_agree_for_any_partitioning(docs):
    def totals(n):
        return sorted(map(str, frames.by_locale(frames.measured(docs.repartition(n))).collect()))

    assert totals(1) == totals(2) == totals(8)


def test_first_appearance_orders_locales(docs):
    rows = frames.by_locale(frames.measured(docs)).orderBy("first_at").select("locale").collect()
    assert [r.locale for r in rows][:3] == ["und-Latn", "es", "de"]


def test_sql_functions(spark, docs):
    frames.register(spark)
    docs.createOrReplaceTempView("d")
    r = spark.sql("SELECT count_words(text) w, count_graphemes(text) g, segment_by_locale(text) l FROM d WHERE doc_id = 1").first()
    assert (r.w, r.g, r.l) == (2, 14, ["und-Latn"])
    rows = spark.sql("SELECT c.* FROM d, LATERAL locale_chunks(text) c WHERE doc_id = 2").collect()
    assert [(x.locale, x.text) for x in rows] == [("und-Latn", "el "), ("es", "niño. "), ("und-Latn", "the rest")]


def test_native_helpers(spark):
    df = spark.createDataFrame([(" a \n b\t", 1), ("x", 2)], "t string, n int")
    got = df.select(native.preview(F.col("t")).alias("p"), native.plural(F.col("n")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("a b", "1 word"), ("x", "2 words")]


def test_streams(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=i), "en" if i % 2 else "de", "two words") for i in range(30)]
    spark.createDataFrame(rows, "ts timestamp, lang string, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    s = live.read_parquet(spark, str(tmp_path / "in"), files_at_once=1)
    assert {tuple(r) for r in live.run_to_end(live.words_by(s, "lang"), "complete").collect()} == {("en", 30), ("de", 30)}
    s = live.read_parquet(spark, str(tmp_path / "in"))
    out = live.run_to_end(live.words_over_time(s, "ts", "10 minutes", "0 minutes", "lang"), "update")
    assert out.agg(F.sum("words")).first()[0] == 60


def test_columns_of_any_names(spark):
    df = spark.createDataFrame([(1, "el niño", None, "x")], "`a.b` int, `my text` string, v void, locale_ string")
    for f in (frames.chunks, frames.tokens, frames.measured, frames.count):
        out = f(df, text="my text")
        rows = out.collect()
        assert rows and all(r["a.b"] == 1 and r.locale_ == "x" for r in rows), f
