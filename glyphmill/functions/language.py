"""Language identification: a scorer of function words and letters for Latin text, and the
share of kana for Han text. Any callable text -> Guess | None can take its place."""

from __future__ import annotations

import functools
import importlib
import math
from collections import Counter
from dataclasses import dataclass

import regex


@dataclass(frozen=True)
class Guess:
    lang: str
    script: str
    confidence: float
    reliable: bool


#: ISO 639-3 -> tag of what a Latin window can become; of what a Han window can.
LATIN_TAGS = dict(zip("cat ces dan deu eng fin fra hun ita lat nld pol por ron spa swe tur".split(), "ca cs da de en fi fr hu it la nl pl pt ro es sv tr".split()))
HAN_TAGS = {"cmn": "zh", "jpn": "ja"}

_WORDS = {
    "eng": "the of and to in is that it for was on are as with his they at be this from have or by not but what all were when your can there an each which how their if will has more do about so them would these her than been who its now into could our other some only then also after before does should because while where expected clearly requires explains understand readers users behavior feature people every over under between through during without within",
    "fra": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce cette ces il elle nous vous ils elles ne se son sa ses par plus ou mais être été sont fait comme tout leur leurs si sans aussi bien peut ont avant après entre chaque dont même votre notre où lorsque afin très",
    "deu": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann wir ich diese dieser",
    "spa": "el la los las de que y en un una es por con para no se su sus al lo como más pero del este esta ha son fue ser muy sin sobre también hay donde quien desde todo nos cuando entre ellos porque hasta había era está están",
    "por": "o a os as de que e do da em um uma para com não por mais dos das no na nos nas se como mas ao ele ela seu sua ou ser quando muito há já está eu também só pelo pela até isso são foi tem",
    "ita": "il lo la gli le di che e un una in per non con del della dei delle è sono da al alla come più ma si nel nella anche questo questa ha su dal dalla se o ci essere stato fra tra quando molto sempre",
    "nld": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog door naar uit hij ze wordt heeft werd worden deze dit die wat over tot kan hebben meer was geen we",
    "swe": "och att det i en som är på för med av den till inte om ett han hon men var sig från så kan när nu ska eller har vi jag efter vid också mycket skulle där alla detta",
    "dan": "og at det er en til på som med for af den de ikke der et har vi han kan men om var fra sig så ved eller være når blev også efter hun meget skal nu jeg denne",
    "fin": "ja on ei se että oli hän joka mutta ovat kuin niin myös tai kun sen mukaan ole jos siitä vain sitä mitä ne olla tämä nyt voi hänen vielä kanssa",
    "pol": "i w na z do nie się to że jest o jak po od za ale przez co dla tak są był było który która które tego już czy może być jego oraz ich tym tylko",
    "ces": "a v na se je že s z do o i to jako za by pro ale jeho po který která které od ve k jsou jsem byl bylo také nebo při jen již tak",
    "hun": "a az és hogy nem is egy meg van volt de ez csak ha mint azt el már ki még vagy minden akkor lesz után ezt amely szerint nagyon között",
    "ron": "și în de la a cu pe că nu o un este din pentru care mai să au se sunt ale fost fi sau dar ca după prin până fără când acest această",
    "tur": "ve bir bu da de için ile olarak çok daha olan gibi en kadar sonra ne var ki ama değil ya mi her o ise oldu olduğu tarafından",
    "cat": "el la els les de que i en un una és per amb no es del al dels com més però ha són va ser també sobre aquest aquesta seva seu on quan fins",
    "lat": "et in est non ad ut cum quod sed qui ex de si ab quae per aut hoc nec esse sunt enim atque autem etiam vel quam",
}
_LETTERS = {"deu": "äöüß", "fra": "éèêàçùœîôû", "spa": "ñáíóúé", "por": "ãõçáâêó", "swe": "åäö", "dan": "æøå", "fin": "äö", "pol": "ąćęłńóśźż", "ces": "ěščřžýáíéůú", "hun": "őűáéíóúöü", "ron": "ăâîșțşţ", "tur": "ığşçöü", "cat": "çàèéíòóú·", "ita": "àèéìòù", "nld": "ëïé"}
_VOTES: dict[str, list[str]] = {}
for _lang, _list in _WORDS.items():
    for _w in set(_list.split()):
        _VOTES.setdefault(_w, []).append(_lang)
#: Endings and clusters typical of English prose words that aren't function words.
_ENGLISH = regex.compile(r"(?:tion|tions|ing|ment|ness|able|ful|ally|edly|ough|ight|wh\w+|th\w+)$")
LATIN_WORD = regex.compile(r"\p{Script=Latin}+")
CJ = regex.compile(r"[\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Han}]")
KANA, HAN = regex.compile(r"[\p{Script=Hiragana}\p{Script=Katakana}]"), regex.compile(r"\p{Script=Han}")


@functools.lru_cache(maxsize=1 << 17)
def votes(word: str) -> tuple[tuple[str, float], ...]:
    """(language, weight) of what a word, as written, speaks for."""
    w = word.lower()
    hit = _VOTES.get(w, ())
    out = [(lang, 1.6 / math.sqrt(len(hit))) for lang in hit]
    if not hit and w.isascii() and _ENGLISH.search(w):
        out.append(("eng", 0.7))
    if not w.isascii():
        out += [(lang, 0.5) for lang, letters in _LETTERS.items() if any(c in letters for c in w)]
    return tuple(out)


def identify(text: str) -> Guess | None:
    """The likeliest language of a text, or None where nothing speaks for any."""
    kana, han = (len(KANA.findall(text)), len(HAN.findall(text))) if CJ.search(text) else (0, 0)
    words = Counter(LATIN_WORD.findall(text))
    if kana + han > sum(len(w) * n for w, n in words.items()):
        if kana:
            share = kana / (kana + han)
            return Guess("jpn", "Hiragana" if share >= 0.5 else "Mandarin", min(1.0, 0.8 + share), kana >= 2 and share > 0.1)
        return Guess("cmn", "Mandarin", min(1.0, 0.7 + han / 40), han >= 12)
    if not words:
        return None
    scores = dict.fromkeys(_WORDS, 0.0)
    for w, n in words.items():
        for lang, weight in votes(w):
            scores[lang] += weight * n
    # rounded: equal votes in another order are a tie
    ranked = sorted(((lang, round(s, 9)) for lang, s in scores.items()), key=lambda x: (-x[1], x[0]))
    (best, top), (_, second) = ranked[0], ranked[1]
    if top <= 0:
        return None
    coverage = min(1.0, top / (0.45 * words.total()))
    margin = (top - second) / top
    confidence = round(min(1.0, 0.35 * coverage + 0.65 * min(1.0, margin * 1.6)), 4)
    return Guess(best, "Latin", confidence, confidence >= 0.6 and top >= 1.4)


def tag_of(guess: Guess | None, route: str) -> str | None:
    """The tag that a guess stands for on a route, if its script fits."""
    if guess is None:
        return None
    if route == "und-Latn":
        return LATIN_TAGS.get(guess.lang) if guess.script == "Latin" else None
    fits = {"cmn": ("Mandarin",), "jpn": ("Mandarin", "Hiragana", "Katakana")}
    return HAN_TAGS[guess.lang] if guess.script in fits.get(guess.lang, ()) else None


@functools.lru_cache(maxsize=8)
def load_engine(name: str | None = None):
    """An engine by its name, module:function; the built-in one without a name. It is loaded
    once a process, when it is first needed."""
    if not name:
        return identify
    module, mark, function = name.partition(":")
    try:
        found = getattr(importlib.import_module(module), function) if mark else None
    except (ImportError, AttributeError) as error:
        raise ValueError(f"The language engine {name} can't be loaded: {error}.") from None
    if not callable(found):
        raise ValueError(f"The language engine {name} can't be loaded: give it as module:function.")
    return found
