import pytest

from glyphmill.functions.counting import as_dict, base_output, count, merge, total_of
from glyphmill.functions.options import CountOptions, HintRule, normalize_mode, parse_total_of, resolve_mode
from glyphmill.functions.segment import segment
from glyphmill.functions.tokens import count_graphemes, count_words


def seg(text, **options):
    return [(c.locale, c.text) for c in segment(text, CountOptions(**options))]


@pytest.mark.parametrize("text,options,want", [
    ("Hello 世界", {}, [("und-Latn", "Hello "), ("und-Hani", "世界")]),
    ("Hello world", {"latin_locale_hint": "en"}, [("en", "Hello world")]),
    ("Hello world", {"latin_tag_hint": " ", "latin_language_hint": "fr"}, [("fr", "Hello world")]),
    ("漢字測試", {"han_tag_hint": "zh-Hant"}, [("zh-Hant", "漢字測試")]),
    ("A lot of things should be done. Überzug and Ranger", {}, [("und-Latn", "A lot of things should be done. "), ("de", "Überzug and Ranger")]),
    ("el niño", {}, [("und-Latn", "el "), ("es", "niño")]),
    ("el niño", {"latin_locale_hint": "en"}, [("en", "el ni"), ("es", "ño")]),
    ("über. the rest", {}, [("de", "über. "), ("und-Latn", "the rest")]),
    ("über the rest", {}, [("de", "über the rest")]),
    ("こんにちは漢字。漢字", {}, [("ja", "こんにちは漢字。"), ("und-Hani", "漢字")]),
    ("🙂こんにちは", {}, [("ja", "🙂こんにちは")]),
    ("안녕 мир नमस्ते สวัสดี مرحبا", {}, [("ko", "안녕 "), ("ru", "мир "), ("hi", "नमस्ते "), ("th", "สวัสดี "), ("ar", "مرحبا")]),
    ("αβγ", {}, [("und-Latn", "αβγ")]),
    ("", {}, []),
])
def test_segmentation(text, options, want):
    assert seg(text, **options) == want


@pytest.mark.parametrize("word,tag", zip(["für", "niño", "não", "œuvre", "ząb", "ağ", "română", "idő", "það"], ["de", "es", "pt", "fr", "pl", "tr", "ro", "hu", "is"]))
def test_default_rules(word, tag):
    assert seg(word) == [(tag, word)]


def test_rules_by_priority_then_order():
    a, b = HintRule("x-first", "[q]"), HintRule("x-priority", "[q]", 5)
    assert seg("q", latin_hint_rules=(a, HintRule("x-second", "q"))) == [("x-first", "q")]
    assert seg("q", latin_hint_rules=(a, b)) == [("x-priority", "q")]
    with pytest.raises(ValueError, match="invalid Unicode regex pattern"):
        seg("q", latin_hint_rules=(HintRule("x", "["),))
    with pytest.raises(ValueError, match="tag must be a non-empty string"):
        seg("q", latin_hint_rules=(HintRule(" ", "a"),))
    with pytest.raises(ValueError, match="at most 256"):
        seg("q", latin_hint_rules=(HintRule("x", "a" * 257),))
    with pytest.raises(ValueError, match="finite"):
        seg("q", latin_hint_rules=(HintRule("x", "a", float("nan")),))


def test_words_and_graphemes():
    assert [count_words(t) for t in ("Hello world", "Hi 👋 world", "Don't stop", "Visit https://example.com today", "1️⃣", "_ __ a_b")] == [2, 2, 2, 4, 0, 2]
    assert [count_graphemes(t) for t in ("👨‍👩‍👧‍👦", "🇸🇪", "⭐️", "é", "\r\n", "abc")] == [1, 1, 1, 1, 1, 3]


def test_non_words():
    r = count("Hi 👋, world! 1️⃣", CountOptions(non_words=True))
    n = r.items[0].non_words.counts()
    assert n == {"emoji": 2, "symbols": 0, "punctuation": 2} and r.counts == {"words": 2, "nonWords": 4, "total": 6}
    assert count("Hi \tthere\n", CountOptions(non_words=True)).counts == {"words": 2, "nonWords": 0, "total": 2}
    r = count("Hi \tthere\n", CountOptions(non_words=True, include_whitespace=True))
    assert vars(r.items[0].non_words.whitespace) == {"spaces": 1, "tabs": 1, "newlines": 1, "other": 0} and r.counts["total"] == 5
    n = count("© 👋!", CountOptions("collector", non_words=True)).non_words.counts()
    assert n == {"emoji": 1, "symbols": 1, "punctuation": 1}
    assert count("©️", CountOptions("collector", non_words=True)).non_words.counts()["emoji"] == 1


def test_char_modes():
    assert count("Hi 👋, world!", CountOptions("char")).total == 7
    assert count("Hi 👋, world!", CountOptions("char", non_words=True)).total == 10
    r = count("Hi 世界 hi", CountOptions("char-collector"))
    assert (r.total, [(i.locale, i.chars) for i in r.items]) == (6, [("und-Latn", 4), ("und-Hani", 2)])
    r = count("Hi, 世界!", CountOptions("char-collector", non_words=True))
    assert r.counts == {"words": 4, "nonWords": 2, "total": 6}
    assert [(i.chars, i.non_words.counts()["punctuation"]) for i in r.items] == [(3, 1), (3, 1)]


def test_modes():
    for name in ("char-collector", "colchar", "chars_collect", "character colle", "collector-char", "COL CHARS"):
        assert normalize_mode(name) == "char-collector"
    assert [normalize_mode(n) for n in ("chunks", "seg", "colle", "characters", "col", "", None, "char-seg")] == ["chunk", "segments", "collector", "char", None, None, None, None]
    assert resolve_mode("nonsense") == "chunk"


def test_merge_total_of_and_base_output():
    a, b = (count(t, CountOptions("char-collector")) for t in ("Hi 世界", "Yo 世界"))
    assert [(i.locale, i.chars) for i in merge([a, b]).items] == [("und-Latn", 4), ("und-Hani", 4)]
    with pytest.raises(ValueError, match="different breakdown modes"):
        merge([a, count("x")])
    assert merge([]).total == 0
    r = count("Hi 👋, world!", CountOptions(non_words=True))
    assert total_of(r, parse_total_of("emoji,punction")) == 3
    r = count("Hi, world!", CountOptions("char", non_words=True))
    assert total_of(r, ("punctuation",)) == 2 and base_output(r).total == 7 and base_output(r).counts is None
    assert parse_total_of("Words, word,emojis") == ("words", "emoji")
    with pytest.raises(ValueError, match="Invalid total-of part"):
        parse_total_of("letters")


def test_json_form():
    assert as_dict(count("Hi")) == {"total": 1, "breakdown": {"mode": "chunk", "items": [{"locale": "und-Latn", "text": "Hi", "words": 1}]}}
