"""Counting files on the cluster: each is read, divided and counted by an executor, and results
are merged in file order, partition by partition."""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill import output
from glyphmill.functions.counting import Result, count, merge, without_segments
from glyphmill.functions.language import load_engine
from glyphmill.functions.options import CountOptions
from glyphmill.operators import detect
from glyphmill.sources.corpus import collated
from glyphmill.sources.frontmatter import section_texts


@dataclass(frozen=True)
class Job:
    """What is done to each text."""

    options: CountOptions = CountOptions()
    section: str = "all"
    modelled: bool = False
    gate: str = "default"
    parts: tuple[str, ...] | None = None
    collected_for_it: bool = False
    compact: bool = False
    evidence: str | None = None  # compact or verbose
    engine: str | None = None  # module:function, loaded by the worker

    def run(self, text: str) -> Counted:
        """Each section is counted and normalised, then they are merged."""
        results, override, events, seen = [], 0, [], Counter()
        for *_, part in section_texts(text, self.section):
            if self.modelled:
                result, decisions = detect.count_traced(part, self.options, self.gate, load_engine(self.engine))
                seen.update(detect.counters(decisions))
                if self.evidence:
                    events += [detect.evidence(d, self.evidence == "verbose") for d in decisions]
            else:
                result = count(part, self.options)
            result, own = output.with_override(result, self.parts, self.collected_for_it)
            override += own or 0
            results.append(without_segments(result) if self.compact else result)
        whole = merge(results) if results else output.with_override(count("", self.options), self.parts, self.collected_for_it)[0]
        return Counted(whole, override if self.parts else None, 1, events, dict(seen))


@dataclass
class Counted:
    """A result, its total of parts, and how many texts it is of."""

    result: Result
    override: int | None
    texts: int
    events: list[dict]
    windows: dict[str, int]


def join(found: list[Counted]) -> Counted | None:
    """Results in order as one, without their events."""
    if not found:
        return None
    windows: Counter = Counter()
    for f in found:
        windows.update(f.windows)
    known = [f.override for f in found if f.override is not None]
    return Counted(merge([f.result for f in found]), sum(known) if known else None, sum(f.texts for f in found), [], dict(windows))


def per_file(files: DataFrame, job: Job) -> DataFrame:
    """(path, counted) of files (path, text), in their order; counted is a pickled Counted."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                done = pickle.dumps(job.run(batch.column(1)[i].as_py() or ""))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([done], pa.binary())], names=["path", "counted"])

    return files.select("path", "text").mapInArrow(run, "path string, counted binary").orderBy(*collated())


def folded(files: DataFrame, job: Job, partitions: int | None = None) -> Counted | None:
    """All files as one result. Each partition, a range of the paths' order, merges its own
    files; the driver merges as many results as there are partitions."""
    held = 64

    def run(batches):
        found: list[Counted] = []
        for batch in batches:
            for text in batch.column(0):
                found.append(job.run(text.as_py() or ""))
                if len(found) > held:
                    found = [join(found)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(join(found))], pa.binary())], names=["counted"])

    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", "text").repartitionByRange(n, *collated()).sortWithinPartitions(*collated())
    # partitions come back in the order of their ranges
    return join([pickle.loads(r.counted) for r in ranges.select("text").mapInArrow(run, "counted binary").toLocalIterator()])
