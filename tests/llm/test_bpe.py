import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm.bpe import Codec, digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC, REFERENCE = Codec(PATH), Tokenizer.from_file(PATH)
PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\r\n", "\t", "é", "世界", "12", "'s", "'", "<|endoftext|>", "\x1c", "\x85", "😀", "　", "_", "-- "])


def expected(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    return ids, REFERENCE.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join) | st.text(max_size=40))
def test_equals_the_library(text):
    ids, decoded = expected(text)
    assert CODEC.encode(text) == ",".join(map(str, ids))
    assert CODEC.decode(CODEC.encode(text)) == decoded


def test_one_very_long_piece():
    text = "abcab" * 20_000
    assert CODEC.encode(text) == ",".join(map(str, expected(text)[0]))


def test_rows(spark):
    rows = [(1, "Hello  world, it's 42.\n\nBye"), (2, ""), (3, None), (None, "x<|endoftext|> y"), (1, "Hello  world, it's 42.\n\nBye")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids, decoded = expected(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    got = [tuple(r) for r in digests(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert digests(df.limit(0), PATH).count() == 0
