from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glyphmill.llm import mixing, toxicity
from test_jaccard import brute as brute_similar
from test_lines import brute as brute_lines
from test_toxicity import corpus as toxic_corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs, labels = toxic_corpus(500)
    shared = "a line of eight words that many documents share"
    rows = []
    for i, text, _ in docs:
        lines = [text, shared] if i % 3 == 0 else [text]
        if i % 7 == 0:
            lines.append(" ".join(f"w{i}x{k}" for k in range(40)))
        rows.append((i, "\n".join(lines), "en", "abc"[i % 3] if i % 11 else None, 0))
    rows += [(1000 + i, rows[4][1] + f" tail{i}", "en", "a", 0) for i in range(12)] + [(2000, None, "en", "b", 0), (2001, "", None, "c", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_each_stage_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "source_mixing", "bpe"]
    step = iter(f for _, f in corpus_pipeline.STAGES)

    def apply(df):
        out = next(step)(spark, df, tables)
        return spark.createDataFrame(out.collect(), out.schema)

    clean = apply(docs)
    fine = {r.doc_id for r in toxicity.scored(docs, labels).filter("predicted = 0").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == fine
    assert 300 < len(fine) < docs.count()

    short = apply(clean)
    want = brute_lines([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(((r.doc_id, r.text) for r in short.collect()), key=str) == sorted(((i, t) for i, t, *_ in want), key=str)
    assert all(r.n_chars == len(r.text) for r in short.collect() if r.text is not None)

    single = apply(short)
    kept = {i for i, _, _, c in brute_similar([(r.doc_id, r.text) for r in short.collect()]) if i == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept)

    mixed = apply(single)
    copies = {r.doc_id: r.copies for r in mixing.plan(single).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    coded = apply(mixed).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    assert len(coded) == mixed.count() and all(r.exact for r in coded)
    for r in coded[::5]:
        assert r.ids == ",".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids))

    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(str, whole.collect())) == sorted(map(str, coded))


def test_short_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "Les.\na b", "en", "a", 8), (2, "\nles.\nb c", "en", "a", 9)], SCHEMA)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()) == [(1, "Les.\na b", 8), (2, "\nb c", 4)]
