"""Structured Streaming over event files: tumbling and session windows, deduplication, one-pass views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def event_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; the time column is made a timestamp, as watermarks need one."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    local = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_dir(spark, path) else reader.parquet(path)
    return local.withColumn(ts, F.col(ts).cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(events: DataFrame, width: str, by: str, delay: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, delay: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "complete", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there and return its result as a table in memory (complete) or in files (append)."""
    spark, name = stream.sparkSession, f"q{uuid.uuid4().hex}"
    at = f"{scratch(spark)}/stream-{name}"
    stream = transform(stream) if transform else stream
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def sliding(events: DataFrame, width: str, step: str, by: str, delay: str = "1 hour") -> DataFrame:
    """Windows of a width that begin every step; an event is in each that holds it."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), by).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", "top")


def running(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, top: how many events of a key there have been and the largest value, kept from batch to batch as state of the key. Events of a key come
    in Arrow batches; what is kept is two numbers."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, top = n + len(f), max(top, float(f[value].max()))
        state.update((n, top))
        yield pd.DataFrame({key: [name[0]], "n": [n], "top": [top]})

    kind = events.schema[key].dataType.simpleString()
    grouped = events.select(key, value).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind}, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)
