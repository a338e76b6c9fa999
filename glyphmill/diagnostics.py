"""Debug events, progress lines and parallelism advice."""

from __future__ import annotations

import datetime
import json
import os
import sys
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("compact", "verbose")


class Channel:
    """Events as JSON lines to a file, the terminal, or both; verbose events only if asked."""

    def __init__(self, path: str | None = None, tee: bool = False, verbosity: str = "compact", stream=None):
        if verbosity not in LEVELS:
            raise ValueError(f"Unknown verbosity: {verbosity}.")
        self.run_id, self.verbosity, self.stream = uuid.uuid4().hex, verbosity, stream or sys.stderr
        self.path = Path(report_path(path)) if path else None
        self.to_terminal = tee or path is None

    def emit(self, event: str, verbosity: str = "compact", **details) -> None:
        if verbosity == "verbose" and self.verbosity != "verbose":
            return
        topic, _, _ = event.partition(".")
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds")
        line = json.dumps({"schemaVersion": 1, "timestamp": now, "runId": self.run_id, "topic": topic, "event": event, "verbosity": verbosity, **details}, ensure_ascii=False)
        if self.to_terminal:
            print(f"[debug] {line}", file=self.stream)
        if self.path:
            with self.path.open("a", encoding="utf-8") as f:
                f.write(line + "\n")


def report_path(path: str) -> str:
    """path, or with a folder a name of the current time in it that isn't taken."""
    if not os.path.isdir(path):
        return path
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%d-%H%M%S")
    n, name = 0, os.path.join(path, f"debug-{stamp}-utc.jsonl")
    while os.path.exists(name):
        n += 1
        name = os.path.join(path, f"debug-{stamp}-utc-{n}.jsonl")
    return name


def events(decisions: DataFrame) -> DataFrame:
    """Detection decisions as JSON lines (a `value` column, for df.write.text)."""
    keep = [c for c in ("doc_id", "window_index", "route_tag", "script_chars", "eligible", "gate_passed", "lang", "confidence", "accepted", "path", "final_tag", "fallback_reason", "preview") if c in decisions.columns]
    body = F.struct(F.lit(1).alias("schemaVersion"), F.lit("detector.window").alias("event"), *keep)
    return decisions.select(F.to_json(body).alias("value"))


class Progress:
    """Progress on a terminal (one line, rewritten) or as lines; nothing for a single file."""

    def __init__(self, total: int, mode: str = "auto", keep: bool = False, stream=None):
        self.stream, self.total, self.keep = stream or sys.stderr, total, keep
        self.tty = bool(getattr(self.stream, "isatty", bool)())
        self.shown = total > 1 and (mode == "on" or mode == "auto" and self.tty)
        self.done, self.began, self.tenth = 0, time.monotonic(), -1

    def step(self, n: int = 1) -> None:
        self.done += n
        tenth = 10 * self.done // max(1, self.total)
        if self.shown and (self.tty or tenth > self.tenth):
            self.tenth = tenth
            self.write(progress(self.done, self.total, time.monotonic() - self.began))

    def write(self, line: str) -> None:
        print("\r" + line if self.tty else line, end="" if self.tty else "\n", file=self.stream, flush=True)

    def close(self) -> None:
        if self.shown and self.tty:
            print("" if self.keep else "\r\x1b[2K", end="\n" if self.keep else "", file=self.stream, flush=True)


def progress(done: int, total: int, seconds: float) -> str:
    """A bar of 20 cells with counts and the time taken."""
    share = 1.0 if total == 0 else min(1.0, done / total)
    cells = int(share * 20)
    minutes, rest = divmod(seconds, 60)
    return f"[{'█' * cells}{'░' * (20 - cells)}] {share * 100:5.1f}% {done}/{total} {int(minutes):02d}:{rest:04.1f}"


def limits(cpus: int | None = None) -> dict[str, int]:
    """Cores, and partitions that serve them."""
    cpus = cpus or os.cpu_count() or 1
    return {"cpuLimit": cpus, "suggestedMaxJobs": 4 * cpus}


def partitions_advice(requested: int | None, cpus: int | None = None) -> tuple[int, str | None]:
    """(partitions to use, a warning if more were asked for than a machine of cpus serves)."""
    limit = limits(cpus)["suggestedMaxJobs"]
    if requested is None or requested <= limit:
        return requested or limit, None
    return limit, f"requested {requested} partitions; using {limit}"


def resource_advice(error: Exception, jobs: int) -> str | None:
    """What to do about an error of too many open files; None for other errors."""
    text = str(error)
    if not any(x in text for x in ("Too many open files", "EMFILE", "ENFILE")):
        return None
    return f"Too many open files at {jobs} partitions; {limits()['suggestedMaxJobs']} are suggested. Lower --jobs or raise the system's limit of open files."
