"""Counting over streams: segmentation and tokens keep no state between documents, so the
batch functions apply as they are; totals are streaming aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.frames import words_of


def read_parquet(spark: SparkSession, path: str, files_at_once: int | None = None, deal: bool = False) -> DataFrame:
    """A stream of the Parquet files at path (a folder or one file). With `deal`, rows are
    dealt out to the shuffle partitions: for files of few, large row groups."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = [f.rpartition("/")[2] for f in batch.inputFiles()] == [name]
    out = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if deal else out


def words_by(stream: DataFrame, *keys: str | Column, text: str = "text") -> DataFrame:
    """Words by keys (also windows of event time on a watermarked stream)."""
    return stream.groupBy(*keys).agg(F.sum(words_of(F.col(text))).alias("words"))


def words_over_time(stream: DataFrame, time: str, width: str, late: str, *keys: str, text: str = "text", slide: str | None = None) -> DataFrame:
    """Words by tumbling (or sliding) windows of event time; rows later than `late` don't
    count any more, and their windows are final."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return words_by(stream.withWatermark(time, late), window.alias("window"), *keys, text=text)


def run_to_end(stream: DataFrame, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """What a stream holds when all that is available now has passed through it."""
    name = f"live_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
