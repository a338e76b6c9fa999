"""Named queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import native
from glyphmill.functions.options import LATIN_RULES
from glyphmill.functions.patterns import WORD
from glyphmill.operators import detect, frames
from glyphmill.operators.frames import words_of
from glyphmill.operators.spread import spread
from glyphmill.plans.detection_sql import DECISIONS
from glyphmill.sources import corpus, frontmatter
from glyphmill.streaming import live

P = WORD.replace("'", "''")
HARD_SQL = r"[\r\n,.!?;:，、。！？；：．｡､]"
BREAK_SQL = r"[\s,.!?;:，、。！？；：．｡､]"


def words_sql(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{P}')) AS BIGINT)"


def bare_sql(text: str) -> str:
    return f"regexp_replace({text}, '{P}', '', 'g')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))


def count_sql(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


def chunk_sql(columns: str = "") -> str:
    """Common table expressions that end in chunks(doc_id, columns, chunk_index, locale, text):
    the segmentation as window functions over single characters (Latin texts only)."""
    tags = " ".join(f"WHEN strpos('{chars}', ch) > 0 THEN '{tag}'" for tag, chars in LATIN_RULES)
    return f"""
chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
kinds AS (SELECT *, regexp_matches(ch, '\\p{{Latin}}') AS lat, regexp_matches(ch, '{HARD_SQL}') AS hb, regexp_matches(ch, '{BREAK_SQL}') AS pb FROM chars),
tagged AS (SELECT *, CASE WHEN NOT lat THEN NULL {tags} END AS tag FROM kinds),
spans AS (SELECT *, sum(CAST(hb AS INT)) OVER d AS span, sum(CAST(pb AS INT)) OVER d AS tok FROM tagged WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
carried AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY doc_id, span ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carry,
  first_value(tag IGNORE NULLS) OVER (PARTITION BY doc_id, tok ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM spans),
voted AS (SELECT *, CASE WHEN lat THEN coalesce(carry, nxt, 'und-Latn') WHEN NOT pb AND carry IS NULL THEN nxt END AS loc0 FROM carried),
placed AS (SELECT *, coalesce(last_value(loc0 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(loc0 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'und-Latn') AS loc FROM voted),
cuts AS (SELECT *, CASE WHEN loc IS DISTINCT FROM lag(loc) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS cut FROM placed),
pieces AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM cuts),
chunks AS (SELECT doc_id, CAST(n AS INTEGER) AS chunk_index, min(loc) AS locale, string_agg(ch, '' ORDER BY i) AS text FROM pieces GROUP BY doc_id, n)"""


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {words_sql('text')} AS words FROM documents")
def words_per_document(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("words"))


@query(f"SELECT lang, CAST(sum({words_sql('text')}) AS BIGINT) AS words, count(*) AS docs FROM documents GROUP BY lang")
def words_by_lang(spark, sf_dir):
    return documents(spark, sf_dir, "lang").groupBy("lang").agg(F.sum(words_of(F.col("text"))).alias("words"), F.count("*").alias("docs"))


@query(f"SELECT source, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM documents GROUP BY source")
def words_by_source(spark, sf_dir):
    return documents(spark, sf_dir, "source").groupBy("source").agg(F.sum(words_of(F.col("text"))).alias("words"))


@query("SELECT doc_id, CAST(length_grapheme(text) AS BIGINT) AS graphemes FROM documents")
def graphemes_per_document(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.graphemes(F.col("text")).alias("graphemes"))


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '{P}'), lambda x: length_grapheme(x))), 0) AS BIGINT) AS chars FROM chunks")
def char_mode(spark, sf_dir):
    return frames.measured(documents(spark, sf_dir)).select("doc_id", "chunk_index", F.col("word_chars").alias("chars"))


@query(f"WITH {chunk_sql()} SELECT doc_id, locale, CAST(sum(coalesce(list_sum(list_transform(regexp_extract_all(text, '{P}'), lambda x: length_grapheme(x))), 0)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id, locale")
def char_collector_mode(spark, sf_dir):
    return frames.by_locale(frames.measured(documents(spark, sf_dir)), "doc_id").select("doc_id", "locale", F.col("word_chars").alias("chars"))


@query(f"WITH {chunk_sql()}, t AS (SELECT doc_id, chunk_index, locale, regexp_extract_all(text, '{P}') AS w FROM chunks) SELECT doc_id, chunk_index, locale, CAST(unnest(generate_series(0, len(w) - 1)) AS INTEGER) AS token_index, unnest(w) AS token FROM t WHERE len(w) > 0")
def tokens_tall(spark, sf_dir):
    return frames.tokens(documents(spark, sf_dir))


@query(f"SELECT doc_id, {count_sql(bare_sql('text'), chr(92) + 'p{P}')} AS punctuation, {count_sql(bare_sql('text'), chr(92) + 'p{S}')} AS symbols FROM documents")
def punctuation_symbols(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", native.punctuation(text).alias("punctuation"), native.symbols(text).alias("symbols"))


@query(r"SELECT doc_id, len(text) - len(replace(text, ' ', '')) AS spaces, len(text) - len(replace(text, chr(9), '')) AS tabs, len(text) - len(replace(replace(text, chr(10), ''), chr(13), '')) AS newlines, CAST(0 AS BIGINT) AS other FROM documents")
def whitespace_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in native.whitespace(F.col("text")).items()))


@query(f"WITH {chunk_sql()} SELECT doc_id, CAST(sum({words_sql('text')}) AS BIGINT) AS words, CAST(sum({count_sql(bare_sql('text'), '[' + chr(92) + 'p{P}' + chr(92) + 'p{S}]')}) AS BIGINT) AS non_words, CAST(sum({words_sql('text')} + {count_sql(bare_sql('text'), '[' + chr(92) + 'p{P}' + chr(92) + 'p{S}]')}) AS BIGINT) AS total FROM chunks GROUP BY doc_id")
def counts_flat(spark, sf_dir):
    m = frames.measured(documents(spark, sf_dir)).withColumn("rest", F.expr("emoji + symbols + punctuation"))
    return m.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("rest").alias("non_words"), F.sum(F.col("words") + F.col("rest")).alias("total"))


@query(f"WITH {chunk_sql()} SELECT doc_id, CAST(sum({words_sql('text')} + {count_sql(bare_sql('text'), chr(92) + 'p{P}')}) AS BIGINT) AS total FROM chunks GROUP BY doc_id")
def total_of_words_punctuation(spark, sf_dir):
    return frames.total_of(frames.measured(documents(spark, sf_dir)), ("words", "punctuation"), "doc_id")


@query(f"WITH {chunk_sql()} SELECT locale, CAST(sum({count_sql('text', chr(92) + 'p{Latin}')}) AS BIGINT) AS letters, count(*) AS chunks FROM chunks GROUP BY locale")
def locale_letter_totals(spark, sf_dir):
    return frames.chunks(documents(spark, sf_dir)).groupBy("locale").agg(F.sum(native.matches(F.col("text"), r"\p{IsLatin}")).alias("letters"), F.count("*").alias("chunks"))


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, locale, text FROM chunks")
def chunks_tall(spark, sf_dir):
    return frames.chunks(documents(spark, sf_dir))


@query(f"WITH {chunk_sql()} SELECT doc_id, locale, min(chunk_index) AS first_at, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM chunks GROUP BY doc_id, locale")
def collector_by_document(spark, sf_dir):
    return frames.by_locale(frames.measured(documents(spark, sf_dir)), "doc_id").select("doc_id", "locale", "first_at", "words")


@query(f"WITH {chunk_sql()} SELECT locale, CAST(sum({words_sql('text')}) AS BIGINT) AS words, min(doc_id) AS first_doc FROM chunks GROUP BY locale")
def corpus_collector(spark, sf_dir):
    return frames.by_locale(frames.measured(documents(spark, sf_dir))).select("locale", "words", F.col("first_at.doc_id").alias("first_doc"))


@query("SELECT doc_id, " + ", ".join(f"{count_sql('text', '[' + chars.replace('¿', '').replace('¡', '') + ']')} AS {tag}_" for tag, chars in LATIN_RULES) + " FROM documents")
def hint_rule_hits(spark, sf_dir):
    hits = [native.matches(F.col("text"), "[" + chars.replace("¿", "").replace("¡", "") + "]").alias(f"{tag}_") for tag, chars in LATIN_RULES]
    return documents(spark, sf_dir).select("doc_id", *hits)


def with_frontmatter(spark, sf_dir) -> DataFrame:
    head = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    return documents(spark, sf_dir, "lang", "source").select("doc_id", head.alias("text"))


@query(f"SELECT doc_id, 'frontmatter' AS source, 'frontmatter' AS name, {words_sql(chr(39) + 'lang: ' + chr(39) + ' || lang || chr(10) || ' + chr(39) + 'source: ' + chr(39) + ' || source')} AS words FROM documents UNION ALL SELECT d.doc_id, 'content', 'content', w.words FROM documents d JOIN (WITH {chunk_sql()} SELECT doc_id, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM chunks GROUP BY doc_id) w USING (doc_id)")
def section_split(spark, sf_dir):
    m = frontmatter.measured(with_frontmatter(spark, sf_dir), mode="split")
    return m.groupBy("doc_id", "source", "name").agg(F.sum("words").alias("words"))


@query("SELECT doc_id, 'frontmatter' AS source, 'lang' AS name, 'lang: ' || lang AS text FROM documents UNION ALL SELECT doc_id, 'frontmatter', 'source', 'source: ' || source FROM documents")
def frontmatter_keys(spark, sf_dir):
    return frontmatter.sections(with_frontmatter(spark, sf_dir), mode="per-key").select("doc_id", "source", "name", "text")


@query(f"WITH k AS (SELECT 'lang' AS name, 'lang: ' || lang AS text FROM documents UNION ALL SELECT 'source', 'source: ' || source FROM documents) SELECT 'frontmatter' AS source, name, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM k GROUP BY name")
def section_aggregate(spark, sf_dir):
    return frontmatter.aggregate(frontmatter.measured(with_frontmatter(spark, sf_dir), mode="per-key").groupBy("doc_id", "source", "name").agg(F.sum("words").alias("total"))).withColumnRenamed("total", "words")


@query(f"SELECT conv_id, role, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM conversations GROUP BY conv_id, role")
def conversation_words(spark, sf_dir):
    return spread(table(spark, sf_dir, "conversations")).groupBy("conv_id", "role").agg(F.sum(words_of(F.col("text"))).alias("words"))


@query(f"SELECT page_id, {words_sql('html')} AS words FROM pages")
def page_words(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", words_of(F.col("html")).alias("words"))


PATH_SQL = r"regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1)"


@query(rf"SELECT page_id, {PATH_SQL} AS path, lower(regexp_extract({PATH_SQL}, '[^/.][^/]*(\.[^./]*)$', 1)) AS extension FROM pages WHERE lower(regexp_extract({PATH_SQL}, '[^/.][^/]*(\.[^./]*)$', 1)) IN ('', '.html')")
def extension_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)?", 1).alias("path"))
    return pages.withColumn("extension", corpus.extension(F.col("path"))).filter(F.col("extension").isin("", ".html"))


@query(f"SELECT page_id, url FROM pages WHERE regexp_matches({PATH_SQL}, '[13579]')")
def path_regex(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)?", 1).alias("path"))
    return pages.filter(corpus.matches_path(F.col("path"), "[13579]")).select("page_id", "url")


@query("SELECT url AS path, CASE WHEN max(direct) = 1 THEN 'direct' ELSE 'directory' END AS source FROM (SELECT url, 0 AS direct FROM pages UNION ALL SELECT url, 1 FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def path_dedupe(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    found = pages.select("path", F.lit("directory").alias("source"))
    given = pages.filter(F.col("page_id") % 3 == 0).select("path", F.lit("direct").alias("source"))
    return corpus.dedupe(found.union(given))


@query("SELECT doc_id, " + count_sql("text", r"\p{Latin}") + " AS script_chars, " + ", ".join(f"{count_sql('text', chr(92) + 'p{Latin}')} >= {n} AS {m}" for m, n in (("normal", 24), ("strict", 30), ("loose", 20))) + " FROM documents")
def eligibility_latin(spark, sf_dir):
    n = native.matches(F.col("text"), r"\p{IsLatin}")
    return documents(spark, sf_dir).select("doc_id", n.alias("script_chars"), *((n >= detect.least_chars("und-Latn", m)).alias(name) for name, m in (("normal", "default"), ("strict", "strict"), ("loose", "loose"))))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{Latin}]+', ' ', 'g'), '^ | $', '', 'g') AS sample FROM documents")
def normalized_sample(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.latin_sample(F.col("text")).alias("sample"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Latin}+')) AS BIGINT) AS runs, len(regexp_extract_all(text, '\p{Latin}+')) >= 4 AS enough FROM documents")
def content_gate_words(spark, sf_dir):
    runs = native.matches(F.col("text"), r"\p{IsLatin}+")
    return documents(spark, sf_dir).select("doc_id", runs.alias("runs"), (runs >= 4).alias("enough"))


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 160) AS preview FROM documents")
def preview_160(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", native.preview(F.col("text")).alias("preview"))


@query(f"WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '{P}')) AS token FROM benchmark) SELECT token, count(*) AS n, count(DISTINCT item_id) AS items FROM w GROUP BY token")
def benchmark_vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(native.word_list(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


@query(f"SELECT toxic, quality, CAST(sum({words_sql('text')}) AS BIGINT) AS words, count(*) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY toxic, quality")
def words_by_label(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("words"))
    return words.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "quality").agg(F.sum("words").alias("words"), F.count("*").alias("docs"))


@query(f"SELECT source, lang, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM documents GROUP BY ROLLUP (source, lang)")
def words_rollup(spark, sf_dir):
    words = documents(spark, sf_dir, "source", "lang").withColumn("words", words_of(F.col("text")))
    return words.rollup("source", "lang").agg(F.sum("words").alias("words"))


@query(f"SELECT lang, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM documents GROUP BY lang")
def streaming_words(spark, sf_dir):
    return live.run_to_end(live.words_by(live.read_parquet(spark, f"{sf_dir}/documents.parquet", deal=True), "lang"), "complete")


NON_WORD = "[" + chr(92) + "p{P}" + chr(92) + "p{S}]"


@query(
    f"WITH {chunk_sql()}, c AS (SELECT doc_id, locale, {words_sql('text')} AS w, {count_sql(bare_sql('text'), NON_WORD)} AS n FROM chunks) "
    "SELECT doc_id, CAST(sum(w) + sum(n) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS words, CAST(sum(n) AS BIGINT) AS non_words, 'collector' AS mode, CAST(count(DISTINCT locale) AS INTEGER) AS locales FROM c GROUP BY doc_id"
)
def nested_results(spark, sf_dir):
    from glyphmill.functions.options import CountOptions

    out = frames.count(documents(spark, sf_dir), options=CountOptions("collector", non_words=True))
    return out.select("doc_id", "result.total", "result.counts.words", "result.counts.non_words", "result.mode", F.size("result.items").alias("locales"))


@query(f"WITH {DECISIONS} SELECT doc_id, CAST(0 AS INTEGER) AS window_index, 'und-Latn' AS route_tag, eligible, gate_passed, lang, confidence, accepted, final_tag, fallback_reason FROM decisions")
def detect_language(spark, sf_dir):
    return detect.resolve(documents(spark, sf_dir)).select("doc_id", "window_index", "route_tag", "eligible", "gate_passed", "lang", "confidence", "accepted", "final_tag", "fallback_reason")


REASONS = ("notEligible", "noCandidate", "corroborationUnreliable", "qualityGate", "belowThreshold")


@query(
    f"WITH {DECISIONS} SELECT count(*) AS windows, count(*) AS latin_windows, CAST(0 AS BIGINT) AS han_windows, CAST(count_if(accepted) AS BIGINT) AS accepted, CAST(count_if(path = 'reliable') AS BIGINT) AS reliable, CAST(count_if(path = 'corroborated') AS BIGINT) AS corroborated, "
    + ", ".join(f"CAST(count_if(fallback_reason = '{r}') AS BIGINT) AS {r}" for r in REASONS)
    + " FROM decisions"
)
def detector_summary(spark, sf_dir):
    return detect.summary(detect.resolve(documents(spark, sf_dir)))


@query(
    f"""WITH {chunk_sql()}, {DECISIONS},
    t AS (SELECT c.doc_id, c.chunk_index, c.text, CASE WHEN c.locale = 'und-Latn' AND d.accepted THEN d.final_tag ELSE c.locale END AS locale FROM chunks c JOIN decisions d USING (doc_id)),
    n AS (SELECT *, CASE WHEN locale IS DISTINCT FROM lag(locale) OVER (PARTITION BY doc_id ORDER BY chunk_index) THEN 1 ELSE 0 END AS cut FROM t),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM n),
    u AS (SELECT doc_id, locale, string_agg(text, '' ORDER BY chunk_index) AS text FROM g GROUP BY doc_id, k, locale)
    SELECT locale, count(*) AS chunks, CAST(sum({words_sql('text')}) AS BIGINT) AS words FROM u GROUP BY locale"""
)
def detected_locales(spark, sf_dir):
    return detect.chunks(documents(spark, sf_dir)).groupBy("locale").agg(F.count("*").alias("chunks"), F.sum(words_of(F.col("text"))).alias("words"))
