"""Streams: images and texts as files arrive, windows over events, state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """``path, content`` of new files: requests for a streaming query."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select("path", "modificationTime", "content")


def arriving_tables(spark: SparkSession, folder: str, schema, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """``at`` as a timestamp with a watermark; times without a zone are the session's."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed(events: DataFrame, at: str, size: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    span = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.groupBy(span, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    out = events.groupBy(F.session_window(at, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])


def running_counts(words: DataFrame, key: str = "word", keep_ms: int = 3_600_000) -> DataFrame:
    """Counts that go on from batch to batch: ``key, n``; a key's state goes
    after ``keep_ms`` without a row."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({key: [group[0]], "n": [n]})

    return words.groupBy(key).applyInPandasWithState(step, f"`{key}` string, n long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result: for tests and small checks."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
