"""Command line: count texts or files, inspect detection, check the environment."""

from __future__ import annotations

import argparse
import os
import pickle
import sys
from collections import Counter

from glyphmill import config as settings
from glyphmill import diagnostics, output
from glyphmill.functions.counting import count
from glyphmill.functions.language import load_engine
from glyphmill.functions.options import CountOptions, HintRule, compile_rule, load_rules, needs_non_words, needs_whitespace, normalize_mode, parse_total_of
from glyphmill.functions.segment import SPACE
from glyphmill.operators import detect
from glyphmill.operators.batch import Counted, Job, folded, join, per_file
from glyphmill.sources.corpus import Filter
from glyphmill.sources.frontmatter import MODES as SECTIONS
from glyphmill.sources.frontmatter import parse as parse_sections

COMMANDS = ("count", "inspect", "doctor")


def version() -> str:
    """The installed distribution's version, else that of this tree."""
    from importlib import metadata

    import glyphmill

    try:
        return metadata.version("glyphmill")
    except metadata.PackageNotFoundError:
        return getattr(glyphmill, "__version__", "0.0.0")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill")
    p.add_argument("-V", "--version", action="version", version=f"glyphmill {version()}")
    sub = p.add_subparsers(dest="command")
    for name in ("count", "inspect"):
        s = sub.add_parser(name)
        s.add_argument("text", nargs="*")
        s.add_argument("-p", "--path", action="append", default=[])
        s.add_argument("--path-mode", choices=("auto", "manual"))
        s.add_argument("--recursive", action=argparse.BooleanOptionalAction)
        s.add_argument("--include-ext", action="append")
        s.add_argument("--exclude-ext", action="append")
        s.add_argument("--regex", action="append")
        s.add_argument("-d", "--detector", choices=("script", "model"))
        s.add_argument("--engine", metavar="MODULE:FUNCTION")
        s.add_argument("--content-gate", choices=detect.GATES)
        s.add_argument("-f", "--format", choices=("standard", "raw", "json") if name == "count" else ("standard", "json"))
        s.add_argument("--pretty", action="store_true")
        s.add_argument("--quiet-warnings", action="store_true")
        for hint in ("latin-language", "latin-tag", "latin-locale", "han-language", "han-tag"):
            s.add_argument(f"--{hint}")
        s.add_argument("--latin-hint", action="append", default=[], metavar="TAG=PATTERN")
        s.add_argument("--latin-hints-file")
        s.add_argument("--no-default-latin-hints", action="store_true")
        if name == "inspect":
            s.add_argument("--section", choices=("all", "frontmatter", "content"), default="all")
            s.add_argument("--view", choices=("pipeline", "engine"), default="pipeline")
            continue
        s.add_argument("--section", choices=SECTIONS, default="all")
        s.add_argument("-m", "--mode", default="chunk")
        s.add_argument("--non-words", action="store_true")
        s.add_argument("--include-whitespace", "--misc", action="store_true")
        s.add_argument("--total-of")
        s.add_argument("--merged", dest="scope", action="store_const", const="merged", default="merged")
        s.add_argument("--per-file", dest="scope", action="store_const", const="per-file")
        s.add_argument("--jobs", type=int)
        s.add_argument("--print-jobs-limit", action="store_true")
        s.add_argument("--progress", action=argparse.BooleanOptionalAction)
        s.add_argument("--keep-progress", action="store_true")
        s.add_argument("--debug", action="store_true")
        s.add_argument("--verbose", action="store_true")
        s.add_argument("--detector-evidence", action="store_true")
        s.add_argument("--debug-report", nargs="?", const=".")
        s.add_argument("--debug-report-tee", "--debug-tee", action="store_true")
        s.add_argument("--quiet-skips", action="store_true")
    d = sub.add_parser("doctor")
    d.add_argument("-f", "--format", choices=("standard", "json"), default="standard")
    d.add_argument("--pretty", action="store_true")
    return p


def refuse(wrong: bool, message: str) -> None:
    if wrong:
        raise ValueError(message)


def check_flags(args: argparse.Namespace, modelled: bool) -> None:
    """Flags that make sense with others only."""
    refuse(len(args.regex or ()) > 1, "--regex can be given once.")
    if args.command == "inspect":
        refuse(bool(args.path and args.text), "inspect takes a text or --path, not both.")
        return
    refuse(args.print_jobs_limit and bool(args.path or args.text), "--print-jobs-limit stands alone.")
    refuse(args.verbose and not args.debug, "--verbose needs --debug.")
    refuse(args.detector_evidence and not args.debug, "--detector-evidence needs --debug.")
    refuse(args.detector_evidence and not modelled, "--detector-evidence needs --detector model.")
    refuse(args.debug_report is not None and not args.debug, "--debug-report needs --debug.")
    refuse(args.debug_report_tee and args.debug_report is None, "--debug-report-tee (or --debug-tee) needs --debug-report.")
    refuse(args.jobs is not None and args.jobs < 1, "--jobs must be a positive integer.")


def hint_rules(args: argparse.Namespace) -> tuple[HintRule, ...]:
    rules = []
    for value in args.latin_hint:
        tag, mark, pattern = value.partition("=")
        refuse(not mark, f"--latin-hint takes TAG=PATTERN, not {value}.")
        rules.append(HintRule(tag, pattern))
        compile_rule(rules[-1], f"--latin-hint {value}")
    return (*rules, *(load_rules(args.latin_hints_file) if args.latin_hints_file else ()))


def options_of(args: argparse.Namespace, config: settings.Config) -> tuple[CountOptions, tuple[str, ...] | None, bool]:
    """(options, parts of the total, whether non-words are collected for it alone)."""
    counting = args.command == "count"
    named = (args.total_of or ",".join(config.get("output", "totalOf", default=[]))) if counting else ""
    parts = parse_total_of(named) if named else None
    mode = normalize_mode(args.mode) if counting else "chunk"
    refuse(mode is None, f"Invalid mode: {getattr(args, 'mode', None)}.")
    blank = counting and args.include_whitespace
    asked = counting and (args.non_words or blank)
    needed = bool(parts) and needs_non_words(parts)
    options = CountOptions(
        mode, args.latin_language, args.latin_tag, args.latin_locale, hint_rules(args), not args.no_default_latin_hints,
        args.han_language, args.han_tag, asked or needed, blank or bool(parts) and needs_whitespace(parts),
    )
    return options, parts, needed and not asked


def inline(args: argparse.Namespace) -> str:
    """Inline text or standard input, trimmed."""
    text = " ".join(args.text) if args.text else ("" if sys.stdin.isatty() else sys.stdin.read())
    text = text.strip(SPACE)
    refuse(not text, "No input provided. Give a text, --path or standard input.")
    return text


def find_files(args: argparse.Namespace, config: settings.Config):
    """(files, rejects) of --path, as DataFrames."""
    from pyspark.sql import SparkSession

    from glyphmill.sources.corpus import read_files

    include = args.include_ext or config.get("path", "includeExtensions")
    exclude = args.exclude_ext or config.get("path", "excludeExtensions")
    recursive = config.get("path", "recursive", default=True) if args.recursive is None else args.recursive
    keep = Filter.of(include, exclude, args.regex[0] if args.regex else None)
    return read_files(SparkSession.builder.getOrCreate(), args.path, keep, args.path_mode or config.get("path", "mode", default="auto"), recursive, config.get("path", "detectBinary", default=True))


def skipped_files(rejects) -> list[dict]:
    from glyphmill.sources.corpus import collated

    return [{"path": r.path, "reason": r.reason, "source": r.source} for r in rejects.orderBy(*collated()).toLocalIterator()]


def warn(args: argparse.Namespace, message: str | None) -> None:
    if message and not args.quiet_warnings:
        print(f"Warning: {message}", file=sys.stderr)


def channel_of(args: argparse.Namespace, config: settings.Config) -> diagnostics.Channel | None:
    debug = args.debug or config.get("logging", "level") == "debug"
    if not debug:
        return None
    path = args.debug_report or config.get("reporting", "debugReport", "path")
    tee = args.debug_report_tee or bool(config.get("reporting", "debugReport", "tee"))
    return diagnostics.Channel(path, tee, "verbose" if args.verbose else config.get("logging", "verbosity", default="compact"))


def run_count(args: argparse.Namespace, config: settings.Config) -> str:
    gate = args.content_gate or config.get("contentGate", "mode", default="default")
    modelled = (args.detector or config.get("detector", default="script")) == "model"
    check_flags(args, modelled)
    if args.print_jobs_limit:
        return output.to_json(diagnostics.limits())
    options, parts, only_for_it = options_of(args, config)
    form = args.format or config.get("output", "format", default="standard")
    debug = channel_of(args, config)
    job = Job(options, args.section, modelled, gate, parts, only_for_it, form != "json", debug.verbosity if debug and args.detector_evidence else None, args.engine)
    if modelled:
        load_engine(args.engine)
    emit = debug.emit if debug else lambda *a, **k: None
    emit("runtime.start", mode=options.mode, section=args.section, detector="model" if modelled else "script", files=len(args.path))
    rows, skipped = [], []
    if not args.path:
        merged = job.run(inline(args))
        rows.append((None, merged))
    else:
        jobs, advice = diagnostics.partitions_advice(args.jobs)
        warn(args, advice)
        files, rejects = find_files(args, config)
        if debug and not args.quiet_skips or config.get("reporting", "skippedFiles"):
            skipped = skipped_files(rejects)
            for r in skipped:
                print(f"skipped {r['path']}: {r['reason']}", file=sys.stderr)
                emit("batch.skips.item", "verbose", **r)
            emit("batch.skips.report", count=len(skipped))
        mode = config.get("progress", "mode", default="auto") if args.progress is None else "on" if args.progress else "off"
        shown = form == "standard" and mode != "off"
        bar = diagnostics.Progress(files.count() if shown else 0, mode, args.keep_progress)
        if args.jobs:
            files = files.repartition(jobs)
        if args.scope == "per-file" or job.evidence:
            found: list[Counted] = []
            for r in per_file(files, job).toLocalIterator():
                rows.append((r.path, pickle.loads(r.counted)))
                bar.step()
                emit("batch.file", "verbose", path=r.path, total=rows[-1][1].result.total)
            merged = join([c for _, c in rows])
        else:
            merged = folded(files, job, jobs if args.jobs else None)
            bar.step(merged.texts if merged else 0)
        bar.close()
        refuse(merged is None, "No readable text files were found.")
    for path, c in rows:
        for event in c.events:
            emit("detector.window.evidence", debug.verbosity, path=path, **{("decisionPath" if k == "path" else k): v for k, v in event.items()})
    summary = dict(sorted(merged.windows.items())) if modelled and debug else None
    if summary is not None:
        emit("detector.summary", mode="model", engine=args.engine or "word-votes", **summary)
    emit("runtime.end", total=merged.result.total, texts=merged.texts)
    result, override = merged.result, merged.override
    if form == "raw":
        return output.raw(result, override)
    by_file = args.path and args.scope == "per-file"
    if form == "json":
        body = output.payload(result, parts, override)
        if by_file:
            files_ = [{"path": p, "result": output.payload(c.result, parts, c.override)} for p, c in rows]
            body = {"scope": "per-file", "files": files_, "aggregate": body}
            if skipped and not args.quiet_skips:
                body["skipped"] = skipped
        found = {k: v for k, v in (("skipped", [] if args.quiet_skips else skipped), ("detector", summary and {"mode": "model", "engine": args.engine or "word-votes", **summary})) if v}
        if debug and found:
            body["debug"] = found
        return output.to_json(body, args.pretty or config.get("output", "pretty", default=False))
    return output.files([(p, c.result, c.override) for p, c in rows], result, override, parts) if by_file else output.standard(result, override, parts)


def chosen(text: str, section: str) -> str:
    """The part of a text that inspect looks at."""
    if section == "all":
        return text
    parsed = parse_sections(text)
    return (parsed.frontmatter or "") if section == "frontmatter" else parsed.content


def run_inspect(args: argparse.Namespace, config: settings.Config) -> tuple[str, int]:
    gate = args.content_gate or config.inspecting("contentGate", "mode", default="default")
    detector = args.detector or config.inspecting("detector", default="script")
    check_flags(args, detector == "model")
    options = options_of(args, config)[0]
    if args.view == "engine" and detector == "model" and (args.content_gate or gate != "default"):
        print("Info: the engine view shows what the engine says, whatever the content gate; the pipeline view shows its effect.", file=sys.stderr)
    pretty = args.pretty or config.get("output", "pretty", default=False)
    form = args.format or ("json" if config.get("output", "format") == "json" else "standard")
    look = lambda text: detect.inspect(chosen(text, args.section), options, detector, args.view, gate, load_engine(args.engine))
    if not args.path:
        found = look(inline(args))
        return output.to_json(found, pretty) if form == "json" else "\n".join(output.inspected(found)), 0
    from glyphmill.sources.corpus import in_order

    files, rejects = find_files(args, config)
    rows = [{"path": r.path, "result": look(r.text)} for r in in_order(files).toLocalIterator()]
    missed = skipped_files(rejects)
    skipped, failures = ([{"path": r["path"], "reason": r["reason"]} for r in missed if (r["source"] == "direct") is own] for own in (False, True))
    if len(args.path) == 1 and os.path.isfile(args.path[0]) and rows:
        found = {**rows[0]["result"], "path": rows[0]["path"]}
        return output.to_json(found, pretty) if form == "json" else "\n".join(output.inspected(found)), 0
    summary = {"requestedInputs": len(args.path), "succeeded": len(rows), "skipped": len(skipped), "failed": len(failures)}
    body = {"schemaVersion": 1, "kind": "detector-inspect-batch", "detector": detector, "view": args.view, "section": args.section, "summary": summary, "files": rows, "skipped": skipped, "failures": failures}
    said = output.to_json(body, pretty) if form == "json" else "\n".join(output.inspected_batch(body))
    return said, 1 if failures or not rows else 0


def doctor() -> dict:
    """What the environment offers: ok, warn or fail by check."""
    checks = {}
    for name in ("pyspark", "pyarrow", "regex", "yaml"):
        try:
            checks[name] = {"status": "ok", "version": getattr(__import__(name), "__version__", "?")}
        except ImportError as error:
            checks[name] = {"status": "warn" if name == "yaml" else "fail", "error": str(error)}
    words = count("Hello 世界").total
    checks["segmenter"] = {"status": "ok" if words >= 2 else "fail"}
    checks["worker"] = worker_check()
    states = [c["status"] for c in checks.values()]
    return {"status": "fail" if "fail" in states else "warn" if "warn" in states else "ok", "checks": checks, "parallelism": diagnostics.limits()}


def worker_check() -> dict:
    """Whether a Spark worker counts a text as this process does."""
    try:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        found = folded(spark.createDataFrame([("a", "Hello 世界")], "path string, text string"), Job(), 1)
        return {"status": "ok" if found and found.result.total == count("Hello 世界").total else "fail", "version": spark.version}
    except Exception as error:  # whatever keeps Spark from working is the finding
        return {"status": "fail", "error": str(error).splitlines()[0][:200]}


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in (*COMMANDS, "-h", "--help", "-V", "--version"):
        argv.insert(0, "count")
    args = parser().parse_args(argv)
    code = 0
    try:
        if args.command == "doctor":
            report = doctor()
            print(output.to_json(report, args.pretty) if args.format == "json" else "\n".join([f"status: {report['status']}", *(f"{k}: {v['status']}" for k, v in report["checks"].items())]))
            return {"ok": 0, "warn": 1, "fail": 2}[report["status"]]
        config = settings.resolve()
        for note in config.notes:
            warn(args, note)
        if args.command == "count":
            print(run_count(args, config))
        else:
            said, code = run_inspect(args, config)
            print(said)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except Exception as error:
        advice = diagnostics.resource_advice(error, getattr(args, "jobs", None) or 1)
        if advice is None:
            raise
        print(f"error: {advice}", file=sys.stderr)
        return 1
    return code


if __name__ == "__main__":
    sys.exit(main())
