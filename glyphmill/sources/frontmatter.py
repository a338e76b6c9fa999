"""Frontmatter of documents (YAML, TOML, JSON) and counts by section."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.measure import MEASURES, measure, simple
from glyphmill.functions.options import CountOptions, resolve_context
from glyphmill.functions.segment import segment
from glyphmill.operators.frames import quoted, through_arrow

FENCES = {"---": "yaml", "+++": "toml", ";;;": "json"}
MODES = ("all", "split", "frontmatter", "content", "per-key", "split-per-key")


@dataclass
class Parsed:
    frontmatter: str | None
    content: str
    data: object = None
    kind: str | None = None


def fence(line: str) -> str | None:
    return FENCES.get(line.strip(" \t"))


def parse(text: str) -> Parsed:
    """Frontmatter and content. Unterminated fences and invalid leading JSON are content;
    a fenced block that doesn't parse keeps its text and kind, without data."""
    lines = text.replace("\r\n", "\n").split("\n")
    lines[0] = lines[0].removeprefix("﻿")
    whole, kind = "\n".join(lines), fence(lines[0])
    if kind is None:
        return leading_json(whole)
    end = next((i for i in range(1, len(lines)) if fence(lines[i]) == kind), None)
    if end is None:
        return Parsed(None, whole)
    inner = "\n".join(lines[1:end])
    return Parsed(inner, "\n".join(lines[end + 1 :]), READERS[kind](inner), kind)


def leading_json(whole: str) -> Parsed:
    start = len(whole) - len(whole.lstrip("\t \n"))
    depth, quoted, i = 0, False, start
    while whole[start : start + 1] == "{" and i < len(whole):
        c = whole[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                data = read_json(whole[start : i + 1])
                if data:
                    return Parsed(whole[start : i + 1], whole[i + 1 :].removeprefix("\n"), data, "json")
                break
        i += 1
    return Parsed(None, whole)


def read_json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def read_yaml(text: str):
    """A mapping by YAML 1.2's core schema, else None."""
    import yaml

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+.0123456789")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{pattern})$"), first)
    Core.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if node.value[:2] in ("0o", "0x") else int(node.value))

    def mapping(self, node, deep=False):
        names = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(str, names))) < len(names):
            raise yaml.YAMLError("duplicate key")
        return {key_text(k): self.construct_object(v, deep=True) for k, (_, v) in zip(names, node.value)}

    Core.add_constructor("tag:yaml.org,2002:map", mapping)
    try:
        data = yaml.load(text, Core)  # noqa: S506 - a safe loader
    except (yaml.YAMLError, ValueError, TypeError):
        return None
    return data if isinstance(data, dict) else None


def key_text(key: object) -> str:
    return key if isinstance(key, str) else plain(key)


# TOML, the part that frontmatter uses: tables, dotted keys, arrays of tables, inline
# tables, arrays of scalars and strings over several lines.

NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
ESCAPES = (("\\\\", "\\"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"))


class Malformed(ValueError):
    pass


def outside_quotes(text: str):
    """(place, character) of what isn't within quotes."""
    quote, skip = None, False
    for i, c in enumerate(text):
        if quote:
            if skip:
                skip = False
            elif c == "\\" and quote == '"':
                skip = True
            elif c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        else:
            yield i, c
    if quote:
        raise Malformed(text)


def without_comment(line: str) -> str:
    try:
        return next((line[:i] for i, c in outside_quotes(line) if c == "#"), line)
    except Malformed:
        return line


def divided(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside quotes and brackets."""
    parts, depth, start = [], 0, 0
    for i, c in outside_quotes(text):
        depth += (c in "[{") - (c in "]}")
        if c == by and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def key_path(key: str) -> str:
    key = key.strip()
    if len(key) > 1 and key[0] in "\"'" and key[-1] == key[0]:
        path = key[1:-1]
        if not path:
            raise Malformed(key)
        return path
    parts = [p.strip() for p in key.split(".")]
    if not all(parts):
        raise Malformed(key)
    return ".".join(parts)


def unescaped(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def toml_value(text: str):
    text = text.strip()
    if not text:
        raise Malformed(text)
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return unescaped(text[1:-1]) if text[0] == '"' else text[1:-1]
    if text[0] == "[":
        if text[-1] != "]":
            raise Malformed(text)
        inner = text[1:-1].strip()
        items = [toml_value(p) for p in divided(inner)] if inner else []
        if any(isinstance(i, (list, dict)) for i in items):
            raise Malformed(text)
        return items
    if text[0] == "{":
        if text[-1] != "}":
            raise Malformed(text)
        out = {}
        for part in divided(text[1:-1]) if text[1:-1].strip() else []:
            name, value = assignment(part)
            value = toml_value(value)
            if isinstance(value, dict):
                raise Malformed(text)
            out[key_path(name)] = value
        return out
    if text in ("true", "false"):
        return text == "true"
    if NUMBER.fullmatch(text):
        return float(text) if re.search(r"[.eE]", text) else int(text)
    return text


def assignment(line: str) -> tuple[str, str]:
    at = next((i for i, c in outside_quotes(line) if c == "="), None)
    if at is None:
        raise Malformed(line)
    return line[:at], line[at + 1 :]


def read_toml(text: str):
    """Flat data of a TOML block: dotted names to text or scalars; None if any line is malformed."""
    out: dict = {}
    tables: dict[str, list[dict]] = {}
    target, prefix = out, ""
    lines = iter(text.split("\n"))
    try:
        for raw in lines:
            line = without_comment(raw).strip()
            if not line:
                continue
            if line.startswith("[["):
                if not line.endswith("]]"):
                    return None
                name = key_path(line[2:-2])
                if name in out and name not in tables:
                    return None
                out.setdefault(name, None)
                target, prefix = {}, ""
                tables.setdefault(name, []).append(target)
                continue
            if line.startswith("["):
                if not line.endswith("]"):
                    return None
                target, prefix = out, key_path(line[1:-1]) + "."
                continue
            name, value = (raw.split("=", 1) if "=" in raw and re.search(r"=\s*(\"\"\"|''')", raw) else assignment(line))
            name, value = prefix + key_path(name), value.strip()
            mark = value[:3]
            if mark in ('"""', "'''"):
                body = value[3:]
                while mark not in body:
                    body += "\n" + next(lines)
                body, _, rest = body.partition(mark)
                if without_comment(rest).strip():
                    return None
                target[name] = unescaped(body.removeprefix("\n")) if mark == '"""' else body.removeprefix("\n")
                continue
            found = toml_value(value)
            if isinstance(found, dict):
                target.update({f"{name}.{k}": flat(v) for k, v in found.items()})
            else:
                target[name] = flat(found)
    except (Malformed, StopIteration):
        return None
    for name, rows in tables.items():
        out[name] = " | ".join(", ".join(f"{k}={plain(v)}" for k, v in row.items()) for row in rows)
    return out


def flat(value):
    return ", ".join(map(plain, value)) if isinstance(value, list) else value


READERS = {"yaml": read_yaml, "toml": read_toml, "json": read_json}


def plain(value: object) -> str:
    """A value as text: numbers and booleans as ECMAScript prints them, records as JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, (str, int)):
        return str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def ordered_items(data: object) -> list[tuple[str, object]]:
    """Entries of a record: integer names first, ascending, then as they came."""
    if not isinstance(data, dict):
        return []
    index = [k for k in data if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1]
    return [(k, data[k]) for k in sorted(index, key=int)] + [(k, v) for k, v in data.items() if k not in index]


def key_items(data: object) -> list[tuple[str, str]]:
    out = []
    for key, value in ordered_items(data):
        text = plain(value)
        out.append((key, f"{key}: {text}" if text else key))
    return out


def section_texts(text: str, mode: str) -> list[tuple[str, str, str]]:
    """(source, name, text) of a document's sections; `all` takes the text as it is."""
    if mode not in MODES:
        raise ValueError(f"Unknown section mode: {mode}.")
    if mode == "all":
        return [("content", "all", text)]
    p = parse(text)
    front, content = ("frontmatter", "frontmatter", p.frontmatter or ""), ("content", "content", p.content)
    keys = [("frontmatter", k, t) for k, t in key_items(p.data)]
    return {"split": [front, content], "frontmatter": [front], "content": [content], "per-key": keys, "split-per-key": [*keys, content]}[mode]


def sections(df: DataFrame, text: str = "text", mode: str = "split") -> DataFrame:
    """A row for each section of each document: df's other columns, section_index, source,
    name, text, frontmatter_type. Null texts have none."""
    if mode not in MODES:
        raise ValueError(f"Unknown section mode: {mode}.")
    if mode == "all":
        keep = [quoted(c) for c in df.columns if c != text]
        return df.filter(quoted(text).isNotNull()).select(*keep, F.lit(0).alias("section_index"), F.lit("content").alias("source"), F.lit("all").alias("name"), quoted(text).alias("text"), F.lit(None).cast("string").alias("frontmatter_type"))

    def rows(value: str):
        kind = parse(value).kind
        for i, (source, name, part) in enumerate(section_texts(value, mode)):
            yield i, source, name, part, kind

    out = through_arrow(df, text, "section_index int, source string, name string, section_text string, frontmatter_type string", rows)
    return out.withColumnRenamed("section_text", "text")


def measured(df: DataFrame, text: str = "text", mode: str = "split", options: CountOptions = CountOptions()) -> DataFrame:
    """A row for each chunk of each section, with its measures: sections() and then
    frames.measured(), in one pass."""
    if mode not in MODES:
        raise ValueError(f"Unknown section mode: {mode}.")
    resolve_context(options)
    blank = options.include_whitespace

    def rows(value: str):
        for i, (source, name, part) in enumerate(section_texts(value, mode)):
            easy = simple(part)
            for k, c in enumerate(segment(part, options)):
                yield i, source, name, k, c.locale, *measure(c.text, easy, blank)

    return through_arrow(df, text, "section_index int, source string, name string, chunk_index int, locale string, " + ", ".join(f"{m} bigint" for m in MEASURES), rows)


def aggregate(totals: DataFrame) -> DataFrame:
    """Sums of (source, name, total) rows, frontmatter before content, names by collation."""
    out = totals.groupBy("source", "name").agg(F.sum("total").alias("total"))
    return out.orderBy(F.when(F.col("source") == "frontmatter", 0).otherwise(1), F.collate("name", "UNICODE"), "name")


def shared_type(df: DataFrame) -> DataFrame:
    """The frontmatter type that all documents have; null if they differ or any has none."""
    kind = F.coalesce("frontmatter_type", F.lit("-"))
    return df.agg(F.when((F.min(kind) == F.max(kind)) & (F.min(kind) != "-"), F.min(kind)).alias("frontmatter_type"))
