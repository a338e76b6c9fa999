"""Rendering of results: raw, JSON and labelled text."""

from __future__ import annotations

import json

from glyphmill.functions.counting import Result, as_dict, base_output, total_of


def plural(n: int, one: str = "word") -> str:
    return f"{n} {one if n == 1 else one + 's'}"


def with_override(result: Result, parts: tuple[str, ...] | None, collected_for_it: bool) -> tuple[Result, int | None]:
    """(the result to print, the total of parts); the override sees the result before it is
    stripped of what was collected for it alone."""
    override = total_of(result, parts) if parts else None
    return (base_output(result) if parts and collected_for_it else result), override


def raw(result: Result, override: int | None = None) -> str:
    return str(result.total if override is None else override)


def payload(result: Result, parts: tuple[str, ...] | None = None, override: int | None = None) -> dict:
    out = as_dict(result)
    if override is not None:
        out["meta"] = {"totalOf": list(parts or ()), "totalOfOverride": override}
    return out


def to_json(value: object, pretty: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2) if pretty else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def standard(result: Result, override: int | None = None, parts: tuple[str, ...] | None = None) -> str:
    """Labelled lines with a breakdown by chunk or locale."""
    unit = "character" if result.mode.startswith("char") else "word"
    lines = [f"Total-of (override: {', '.join(parts or ())}): {override}"] if override is not None else []
    lines.append(f"Total {unit}s: {result.counts['words'] if result.counts else result.total}")
    if result.counts:
        lines.append(f"Non-words: {result.counts['nonWords']}")
        lines.append(f"Total count: {result.counts['total']}")
    for item in result.items:
        n = item.chars if item.chars is not None else item.words
        shown = "" if item.text is None else f" {json.dumps(item.text, ensure_ascii=False)}"
        lines.append(f"Locale {item.locale}: {plural(n, unit)}{shown}")
        if item.non_words is not None:
            lines.append("  " + ", ".join(f"{k}: {v}" for k, v in item.non_words.counts().items()))
    if result.non_words is not None:
        lines.append("Non-words by kind: " + ", ".join(f"{k}: {v}" for k, v in result.non_words.counts().items()))
    return "\n".join(lines)


def files(rows: list[tuple[str, Result, int | None]], merged: Result, override: int | None = None, parts=None) -> str:
    """A block for each file, then the merged one."""
    blocks = [f"[File] {path}\n{standard(r, o, parts)}" for path, r, o in rows]
    return "\n\n".join([*blocks, f"[Merged] {plural(len(rows), 'file')}\n{standard(merged, override, parts)}"])


def quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def guess_line(guess: dict | None) -> str:
    return "none" if guess is None else f"{guess['lang']}/{guess['script']} confidence={guess['confidence']} reliable={str(guess['reliable']).lower()}"


def inspected(found: dict, titled: bool = True) -> list[str]:
    """An inspection as labelled lines."""
    lines = ["Detector inspect", f"View: {found['view']}", f"Detector: {found['detector']}", ""] if titled else []
    lines.append("Input")
    if found.get("path"):
        lines.append(f"Path: {found['path']}")
    lines += [f"Text length: {found['input']['textLength']}", f"Preview: {quoted(found['input']['preview'])}", ""]
    if found["view"] == "engine":
        if "note" in found:
            return [*lines, f"Decision: {found['note']}"]
        lines += ["Sample", f"Text: {quoted(found['sample']['text'][:160])}", f"Normalized: {quoted(found['sample']['normalized'][:160])}", "", "Engine"]
        return [*lines, f"Raw: {guess_line(found['raw'])}", f"Normalized: {guess_line(found['normalized'])}", f"Tag: {found['tag'] or 'none'}"]
    lines.append("Chunks")
    lines += [" | ".join(x for x in (f"[{c['index']}] {c['locale']}", c["source"], c["reason"], quoted(c["text"][:160])) if x) for c in found["chunks"]] or ["(none)"]
    if "windows" in found:
        lines += ["", "Windows"]
        lines += [f"[{w['index']}] {w['routeTag']} -> {', '.join(w.get('finalLocales', [w['finalTag']]))} | {w['path']}" + (f" | {w['fallbackReason']}" if w["fallbackReason"] else "") + f" | {guess_line(w['raw'])}" for w in found["windows"]] or ["(none)"]
        lines += ["", "Resolved chunks"]
        lines += [f"[{i}] {c['locale']} | {quoted(c['text'][:160])}" for i, c in enumerate(found["resolvedChunks"])] or ["(none)"]
    else:
        lines += ["", f"Decision: {found['decision']}"]
    return lines


def inspected_batch(body: dict) -> list[str]:
    """A batch of inspections as labelled lines."""
    s = body["summary"]
    lines = ["Detector inspect batch", f"View: {body['view']}", f"Detector: {body['detector']}", f"Section: {body['section']}", f"Requested: {s['requestedInputs']}, succeeded: {s['succeeded']}, skipped: {s['skipped']}, failed: {s['failed']}"]
    for f in body["files"]:
        lines += ["", f"[File] {f['path']}", *inspected(f["result"], titled=False)]
    for name in ("skipped", "failures"):
        if body[name]:
            lines += ["", name.capitalize(), *(f"{r['path']}: {r['reason']}" for r in body[name])]
    return lines
