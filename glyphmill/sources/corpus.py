"""Finding the files of a corpus: expansion, filters, order, binary files, rejects."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".md", ".markdown", ".mdx", ".mdc", ".txt")
SNIFFED, SUSPICIOUS = 1024, 0.3


def extension_list(values) -> list[str]:
    """Extensions of comma lists: lower case, with a dot, each once."""
    out: dict[str, None] = {}
    for value in [values] if isinstance(values, str) else values or []:
        for part in value.split(","):
            name = "." + part.strip().lower().lstrip(".")
            if name != ".":
                out[name] = None
    return list(out)


@dataclass(frozen=True)
class Filter:
    """Extensions that pass (given ones replace the default; excluded ones win) and a pattern."""

    extensions: frozenset[str]
    pattern: str | None = None

    @classmethod
    def of(cls, include=None, exclude=None, pattern: str | None = None) -> Filter:
        names = extension_list(include) or list(EXTENSIONS)
        if pattern is not None and pattern.strip():
            try:
                re.compile(pattern)
            except re.error as error:
                raise ValueError(f"Invalid --regex pattern: {error}") from None
        else:
            pattern = None
        return cls(frozenset(names) - frozenset(extension_list(exclude)), pattern)

    def keeps(self, relative: str) -> str | None:
        """None if a path below its root passes, else the reason."""
        if os.path.splitext(relative)[1].lower() not in self.extensions:
            return "extension excluded"
        if self.pattern and not re.search(self.pattern, relative):
            return "regex excluded"
        return None


def extension(path: Column) -> Column:
    """The extension of a path in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def matches_path(path: Column, pattern: str) -> Column:
    return path.rlike(pattern)


def dedupe(paths: DataFrame) -> DataFrame:
    """One row for each path; given ones beat those found in a folder."""
    direct = F.max((F.col("source") == "direct").cast("int")) == 1
    return paths.groupBy("path").agg(F.when(direct, "direct").otherwise("directory").alias("source"))


def collated(column: str = "path") -> list[Column]:
    return [F.collate(column, "UNICODE"), F.col(column)]


def listing(paths: list[str], keep: Filter | None = None, mode: str = "auto", recursive: bool = True) -> tuple[list[tuple], list[tuple]]:
    """([(path, source)], [(path, reason, source)]) of given paths; folders are expanded in
    mode auto. Filters apply to what folders hold only, and what one root excludes by
    pattern but another accepts isn't reported."""
    keep = keep or Filter.of()
    found: dict[str, str] = {}
    rejects, excluded = [], {}

    def walk(root: str, folder: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as error:
            rejects.append((folder, f"directory read failed: {error.strerror}", "directory"))
            return
        for e in entries:
            path = os.path.abspath(e.path)
            if e.is_dir(follow_symlinks=False):
                if recursive:
                    walk(root, e.path)
            elif e.is_file(follow_symlinks=False):
                why = keep.keeps(os.path.relpath(path, root).replace(os.sep, "/"))
                if why is None:
                    found.setdefault(path, "directory")
                else:
                    excluded[path] = why

    for given in paths:
        path = os.path.abspath(given)
        if os.path.isdir(path) and mode == "auto":
            walk(path, path)
        elif os.path.isfile(path):
            found[path] = "direct"
        elif os.path.exists(path):
            rejects.append((path, "not a regular file", "direct"))
        else:
            rejects.append((path, "not readable: no such file or directory", "direct"))
    rejects += [(p, why, "directory") for p, why in excluded.items() if p not in found]
    return list(found.items()), rejects


def is_binary(content: Column) -> Column:
    """Whether a file's first bytes hold a NUL, or more than three in ten control bytes."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    pairs = F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))
    odd = F.size(F.filter(pairs, lambda b: b.rlike("^(?:0[0-8BCEF]|1.|7F)$")))
    return F.coalesce(F.exists(pairs, lambda b: b == "00") | (odd > F.size(pairs) * SUSPICIOUS), F.lit(False))


def in_order(files: DataFrame) -> DataFrame:
    """Files by the collation of their paths: a range sort, no task holds all of them."""
    return files.orderBy(*collated())


def read_shared(spark: SparkSession, roots: list[str], keep: Filter, mode: str, recursive: bool) -> tuple[DataFrame, DataFrame]:
    """(path, source, content; path, reason, source) of URIs on storage that executors share:
    folders are expanded and filtered by Spark, so no list of names passes the driver."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive and mode == "auto").lower()).load(roots)
    single = F.lit(False)
    for r in roots:
        single = single | (F.col("path") == r.rstrip("/"))
    found = read.select("path", "content", F.when(single, "direct").otherwise("directory").alias("source"))
    below = F.col("path")
    for r in roots:
        below = F.when(F.startswith(below, F.lit(r.rstrip("/") + "/")), F.substr(below, F.lit(len(r.rstrip("/")) + 2))).otherwise(below)
    listed = extension(F.col("path")).isin(sorted(keep.extensions))
    reason = F.when(F.col("source") == "direct", None).when(~listed, "extension excluded").when(~matches_path(below, keep.pattern) if keep.pattern else F.lit(False), "regex excluded")
    marked = found.withColumn("reason", reason)
    return marked.filter("reason is null").select("path", "source", "content"), marked.filter("reason is not null").select("path", "reason", "source")


def read_files(spark: SparkSession, paths: list[str], keep: Filter | None = None, mode: str = "auto", recursive: bool = True, detect_binary: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): files has path, source and text, as UTF-8 with bad bytes as U+FFFD;
    rejects has path, reason, source. Files are read by the executors. Of local folders
    the driver lists the names; URIs (with ://) are listed and filtered by Spark."""
    keep = keep or Filter.of()
    far, near = [p for p in paths if "://" in p], [p for p in paths if "://" not in p]
    files, rejects = listing(near, keep, mode, recursive)
    both = spark.createDataFrame([], "path string, source string, content binary")
    missed = spark.createDataFrame(rejects, "path string, reason string, source string")
    if files:
        named = spark.createDataFrame(files, "path string, source string")
        content = spark.read.format("binaryFile").load([f"file://{p}" for p, _ in files]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        both = named.join(content, "path", "left")
    if far:
        more, excluded = read_shared(spark, far, keep, mode, recursive)
        both, missed = both.unionByName(more), missed.union(excluded)
    both = both.withColumn("binary", is_binary(F.col("content")) if detect_binary else F.lit(False))
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    good = both.filter(~F.col("binary")).select("path", "source", text.alias("text"))
    bad = both.filter("binary").select("path", F.lit("binary file").alias("reason"), "source")
    return good, missed.union(bad)
