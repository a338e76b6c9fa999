import io
import json

import pytest

from glyphmill.diagnostics import Channel, events, partitions_advice, progress, report_path
from glyphmill.operators import detect


def test_channel(tmp_path):
    out = io.StringIO()
    c = Channel(str(tmp_path / "x.jsonl"), tee=True, stream=out)
    c.emit("path.scan", files=3)
    c.emit("path.file", "verbose", name="a")
    line = json.loads((tmp_path / "x.jsonl").read_text())
    assert (line["topic"], line["files"], line["schemaVersion"]) == ("path", 3, 1) and out.getvalue().count("[debug]") == 1
    a = report_path(str(tmp_path))
    open(a, "w").close()
    assert report_path(str(tmp_path)) != a
    with pytest.raises(ValueError):
        Channel(verbosity="loud")


def test_progress_and_advice():
    assert progress(5, 10, 61.5) == "[██████████░░░░░░░░░░]  50.0% 5/10 01:01.5" and "100.0%" in progress(0, 0, 0)
    assert partitions_advice(5, 4) == (5, None) and partitions_advice(None, 2) == (8, None) and partitions_advice(99, 4)[0] == 16


def test_events(spark):
    df = spark.createDataFrame([(1, "short"), (2, "The readers of this guide understand that it is not what they expected.")], "doc_id long, text string")
    rows = [json.loads(r.value) for r in events(detect.resolve(df)).collect()]
    assert sorted((r["doc_id"], r["final_tag"]) for r in rows) == [(1, "und-Latn"), (2, "en")]
