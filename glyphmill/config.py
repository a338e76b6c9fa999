"""Configuration: defaults < user file < file in the working folder < environment < flags."""

from __future__ import annotations

import json
import os
import re
import sys
import tomllib
from dataclasses import dataclass, field

NAMES = ("glyphmill.config.toml", "glyphmill.config.jsonc", "glyphmill.config.json")
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
GATES = ("default", "strict", "loose", "off")

#: Closed record: section -> key -> type, or the allowed values.
SCHEMA: dict = {
    "detector": ("script", "model"),
    "contentGate": {"mode": GATES},
    "path": {"mode": ("auto", "manual"), "recursive": bool, "includeExtensions": list, "excludeExtensions": list, "detectBinary": bool},
    "progress": {"mode": ("auto", "on", "off")},
    "output": {"format": ("standard", "raw", "json"), "pretty": bool, "totalOf": list},
    "reporting": {"skippedFiles": bool, "debugReport": {"path": str, "tee": bool}},
    "logging": {"level": ("info", "debug"), "verbosity": ("compact", "verbose")},
    "inspect": {"detector": ("script", "model"), "contentGate": {"mode": GATES}},
}
ENVIRONMENT = {
    "GLYPHMILL_DETECTOR": ("detector",), "GLYPHMILL_CONTENT_GATE": ("contentGate", "mode"), "GLYPHMILL_PATH_MODE": ("path", "mode"), "GLYPHMILL_RECURSIVE": ("path", "recursive"),
    "GLYPHMILL_INCLUDE_EXT": ("path", "includeExtensions"), "GLYPHMILL_EXCLUDE_EXT": ("path", "excludeExtensions"), "GLYPHMILL_DETECT_BINARY": ("path", "detectBinary"), "GLYPHMILL_PROGRESS": ("progress", "mode"),
    "GLYPHMILL_FORMAT": ("output", "format"), "GLYPHMILL_PRETTY": ("output", "pretty"), "GLYPHMILL_TOTAL_OF": ("output", "totalOf"), "GLYPHMILL_SKIPPED": ("reporting", "skippedFiles"),
}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    values: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def get(self, *keys: str, default=None):
        at = self.values
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at

    def inspecting(self, *keys: str, default=None):
        """A setting of inspect, or else the general one."""
        return self.get("inspect", *keys, default=self.get(*keys, default=default))


def strip_comments(text: str) -> str:
    """JSON of JSON with comments."""
    out, i = [], 0
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*', re.S)
    while m := token.search(text, i):
        out.append(text[i : m.start()])
        i = m.end()
        if m.group() == "/*":
            end = text.find("*/", i)
            if end < 0:
                raise ConfigError("Unterminated block comment.")
            out.append("\n" * text.count("\n", i, end))
            i = end + 2
        elif m.group()[0] == '"':
            out.append(m.group())
    return "".join([*out, text[i:]])


def check(value: object, schema: dict = SCHEMA, at: str = "") -> None:
    """Raises ConfigError at the dotted path of what doesn't fit."""
    if not isinstance(value, dict):
        raise ConfigError(f"{at or 'config'} must be an object.")
    for key, item in value.items():
        path = f"{at}.{key}" if at else key
        if key not in schema:
            raise ConfigError(f"Unknown config key: {path}.")
        kind = schema[key]
        if isinstance(kind, dict):
            check(item, kind, path)
        elif isinstance(kind, tuple):
            if item not in kind:
                raise ConfigError(f"{path} must be one of: {', '.join(kind)}.")
        elif not isinstance(item, kind) or kind is list and not all(isinstance(x, str) for x in item):
            raise ConfigError(f"{path} must be {'a list of strings' if kind is list else {bool: 'a boolean', str: 'a string'}[kind]}.")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = tomllib.loads(text) if path.endswith(".toml") else json.loads(strip_comments(text) if path.endswith(".jsonc") else text)
    except (tomllib.TOMLDecodeError, json.JSONDecodeError) as error:
        raise ConfigError(f"{path}: {error}") from None
    check(data)
    return data


def merge(low: dict, high: dict, deep: int = 2) -> dict:
    """high over low, section by section; lists replace."""
    out = dict(low)
    for key, value in high.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict) and deep
        out[key] = merge(out[key], value, deep - 1) if both else value
    return out


def discover(folder: str) -> tuple[str | None, list[str]]:
    """(the folder's config file, notes on others that it hides)."""
    found = [p for n in NAMES if os.path.isfile(p := os.path.join(folder, n))]
    notes = [f"ignored {p}: {found[0]} comes first" for p in found[1:]]
    return (found[0] if found else None), notes


def user_folder(env: dict | None = None) -> str:
    env = os.environ if env is None else env
    if os.name == "nt":
        return os.path.join(env.get("APPDATA", ""), "glyphmill")
    if sys.platform == "darwin" and not env.get("XDG_CONFIG_HOME"):
        return os.path.join(env.get("HOME", ""), "Library", "Application Support", "glyphmill")
    return os.path.join(env.get("XDG_CONFIG_HOME") or os.path.join(env.get("HOME", ""), ".config"), "glyphmill")


def from_environment(env: dict) -> dict:
    out: dict = {}
    for name, path in ENVIRONMENT.items():
        raw = (env.get(name) or "").strip()
        if not raw:
            continue
        kind = SCHEMA
        for k in path:
            kind = kind[k]
        if kind is bool:
            if raw.lower() not in TRUE | FALSE:
                raise ConfigError(f"{name} must be one of 1/true/yes/on or 0/false/no/off.")
            value: object = raw.lower() in TRUE
        else:
            value = [v.strip() for v in raw.split(",") if v.strip()] if kind is list else raw
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = value
    gate = out.get("contentGate", {}).get("mode")
    if gate:
        out.setdefault("inspect", {}).setdefault("contentGate", {})["mode"] = gate
    check(out)
    return out


def resolve(folder: str = ".", env: dict | None = None, flags: dict | None = None) -> Config:
    env = dict(os.environ) if env is None else env
    config = Config()
    for place in (user_folder(env), folder):
        path, notes = discover(place)
        config.notes += notes
        if path:
            config.values = merge(config.values, load(path))
    config.values = merge(config.values, from_environment(env))
    config.values = merge(config.values, flags or {})
    check(config.values)
    return config
