"""The scan by runs against a plain fold over characters."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.functions.options import CountOptions, HintRule, resolve_context
from glyphmill.functions.segment import BREAK, HARD, SCRIPTS, segment

TESTS = [(tag, regex.compile(f"[{s}]")) for tag, _, s in SCRIPTS]
LATIN, HAN = regex.compile(r"\p{Script=Latin}"), regex.compile(r"\p{Script=Han}")


def fold(text, options):
    ctx = resolve_context(options)
    out, now, buf, scripted, wall = [], "und-Latn", "", False, False
    for c in text:
        found = next((t for t, p in TESTS if p.match(c)), None)
        if found is None and HAN.match(c):
            found = now if not wall and now.startswith("ja") else ctx.han_hint or "und-Hani"
        elif found is None and LATIN.match(c):
            tag = ctx.rule_tag(c)
            if tag and tag != "und-Latn":
                found = tag
            elif not wall and now in ctx.latin_locales and now != "und-Latn":
                found = now
            else:
                found = ctx.latin_hint or "und-Latn"
        if not buf or found and not scripted:
            now, scripted = found or now, scripted or bool(found)
            buf += c
        elif found and found != now:
            cut = max((m.start() for m in BREAK.finditer(buf)), default=-1)
            if now == "und-Latn" and found in ctx.latin_locales:
                if cut >= 0:
                    out.append((now, buf[: cut + 1]))
                buf = buf[cut + 1 :] + c
            else:
                out.append((now, buf))
                buf = c
            now, scripted = found, True
        else:
            buf += c
        wall = (wall or c in HARD) if found is None else False
    if buf:
        out.append((now, buf))
    merged = []
    for locale, part in out:
        if merged and merged[-1][0] == locale:
            merged[-1] = (locale, merged[-1][1] + part)
        else:
            merged.append((locale, part))
    return merged


OPTIONS = [CountOptions(), CountOptions(latin_tag_hint="en"), CountOptions(latin_tag_hint="de", han_tag_hint="ja-JP"), CountOptions(use_default_latin_hints=False), CountOptions(latin_hint_rules=(HintRule("x", "[a1]"), HintRule("y", "[b]", 2)), latin_locale_hint="x")]
PARTS = st.sampled_from(list("abz ü ñ ő â . , 。 ¿ 1 - \n ' 漢 字 か カ 한 ж α 🙂 ٣".replace(" ", "")) + [" ", "  ", "\t", "﻿", "\r\n", "word", "Übe"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=16).map("".join), st.sampled_from(OPTIONS))
def test_scan_equals_fold(text, options):
    assert [(c.locale, c.text) for c in segment(text, options)] == fold(text, options)
