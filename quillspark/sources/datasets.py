"""Datasets over files: folders with a split each, lists of shards, read modes, a registry of datasets by name."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.cache import Cached, Dataset
from ..plans.config import Config, Registry
from ..schemas import SPLITS
from . import sinks

MODES = ("in_memory", "local_streaming", "online_streaming")


def read_mode(spark: SparkSession, path: str, mode: str = "local_streaming") -> DataFrame:
    """Parquet held in memory (and on disk beyond it), read as it is used, or as a stream of files that may still grow."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "online_streaming":
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows = spark.read.parquet(path)
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if mode == "in_memory" else rows


def buffer_shuffled(df: DataFrame, seed: int = 42, buffer: int = 10_000) -> DataFrame:
    """The shuffle of a stream: each task holds `buffer` rows and hands out one of them, by chance that the seed fixes, for each that comes. Rows do
    not leave their task, so batches and streams alike are shuffled without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rng, held = np.random.default_rng([seed, context.partitionId() if context else 0]), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > buffer:
                order = rng.permutation(held.num_rows)
                yield from held.take(pa.array(order[buffer:])).combine_chunks().to_batches()
                held = held.take(pa.array(order[:buffer]))
        if held is not None and held.num_rows:
            yield from held.take(pa.array(rng.permutation(held.num_rows))).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


class FolderDataset(Dataset):
    """Files under <path>/<split>; folders that are no split are left. Streaming reads them as a stream; shuffle is honoured in both ways."""

    class Config(Config):
        path: str
        format: Literal["parquet", "json", "orc"] = "parquet"
        streaming: bool = False
        shuffle: bool = False
        seed: int = 42
        buffer: int = 10_000

    name = "folder"

    def build(self, spark: SparkSession, split: str) -> DataFrame | None:
        path = f"{self.config.path}/{split}"
        if split not in SPLITS or not sinks.exists(spark, path):
            return None
        rows = spark.read.format(self.config.format).load(path)
        if self.config.streaming:
            rows = spark.readStream.format(self.config.format).schema(rows.schema).load(path)
        return buffer_shuffled(rows, self.config.seed, self.config.buffer) if self.config.shuffle else rows


DATASETS = Registry(Dataset)
DATASETS.register("folder", "quillspark.sources.datasets:FolderDataset")


def load_dataset(name: str, config: Config | dict | None = None, **params) -> Dataset:
    """A registered dataset with a config or with parameters for one."""
    return DATASETS.create(name, config, **params)


def reopen(spark: SparkSession, folder: str) -> Cached:
    return Cached(spark, folder)


class ShardList:
    """Parquet files of a folder in the order of their names, as one sequence: a row's place is the sum of the sizes of the files before and its place
    in its own file. Sizes come from one aggregate; of the files' names there is one each on the driver's side of no step."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "key"):
        self.spark, self.key = spark, key
        self.rows = spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("_shard"), F.col("_metadata.row_index").alias("_inner"))

    def sizes(self) -> DataFrame:
        """_shard, nsamples, first: a row for each file, so the window runs over files."""
        counts = self.rows.groupBy("_shard").agg(F.count(F.lit(1)).alias("nsamples"))
        before = F.sum("nsamples").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
        return counts.select("_shard", "nsamples", F.coalesce(before, F.lit(0)).alias("first"))

    def frame(self) -> DataFrame:
        """The rows with _pos, without the helper key."""
        placed = self.rows.join(self.sizes().select("_shard", "first"), "_shard").withColumn("_pos", F.col("first") + F.col("_inner"))
        return placed.drop("_shard", "_inner", "first", self.key)

    def __len__(self) -> int:
        return self.rows.count()

    def __getitem__(self, index: int) -> DataFrame:
        size = len(self)
        if not -size <= index < size:
            raise IndexError(index)
        return self.frame().where(F.col("_pos") == index % size)

    def by_id(self, sample_id: str, column: str = "sample_id") -> DataFrame:
        """The row with an id, and its place; the filter reaches the scan."""
        hit = self.rows.where(F.col(column) == F.lit(sample_id))
        return hit.join(self.sizes().select("_shard", "first"), "_shard").withColumn("_pos", F.col("first") + F.col("_inner")).drop("_shard", "_inner", "first", self.key)
