"""Sinks: splits with purge on failure, JSON lines, artifacts, error budgets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

INLINE_BYTES = 1 << 20


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def purge(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot move {old} to {new}")


def splits(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole where the file system can do that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temp), fs.makeQualified(p), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class WriteFailed(RuntimeError):
    """Says which split could not be written; its cause is the error as it was."""


def write_split(df: DataFrame, root: str, name: str, max_records: int = 100_000, shards: int | None = None, format: str = "parquet") -> int:
    """Files under root/name, visible only when whole: written beside it and renamed; what a failure leaves is purged and the error re-raised, Spark's
    own errors as WriteFailed and others as the same type. The number of rows, counted as they are written."""
    spark, path = df.sparkSession, f"{root}/{name}"
    temp = f"{root}/.{name}.incomplete"
    seen = Observation()
    try:
        rows = (df.repartition(shards) if shards else df).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").option("maxRecordsPerFile", max_records).format(_backend(format)).save(temp)
        purge(spark, path)
        rename(spark, temp, path)
    except Exception as e:
        purge(spark, temp)
        message = f"writing split {name} failed: {str(e).splitlines()[0][:300]}"
        if isinstance(e, (ValueError, TypeError, OSError)) and type(e).__module__ == "builtins":
            raise type(e)(message) from e
        raise WriteFailed(message) from e
    return int(seen.get["rows"])


BACKENDS = {"parquet": "parquet", "columnar": "parquet", "orc": "orc", "json": "json", "rows": "json"}


def _backend(name: str) -> str:
    if name not in BACKENDS:
        raise ValueError(f"no storage {name!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[name]


class Storage:
    """Splits of one backend under a root: write, read, list, probe and purge."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet"):
        self.spark, self.root, self.format = spark, root.rstrip("/"), _backend(format)

    def split_dir(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: Any) -> int:
        return write_split(df, self.root, name, format=self.format, **options)

    def read(self, name: str) -> DataFrame:
        if not self.split_exists(name):
            raise ValueError(f"no split {name} under {self.root}")
        return self.spark.read.format(self.format).load(self.split_dir(name))

    def split_exists(self, name: str) -> bool:
        return exists(self.spark, self.split_dir(name))

    def dataset_exists(self) -> bool:
        return bool(self.names())

    def names(self) -> list[str]:
        return splits(self.spark, self.root)

    def purge(self, name: str) -> None:
        purge(self.spark, self.split_dir(name))

    def totals(self) -> DataFrame:
        """split, files, nbytes: what has been written, from the file listing."""
        fs, _ = _fs(self.spark, self.root)
        rows = []
        for name in self.names():
            found = fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.split_dir(name)))
            sizes = [f.getLen() for f in found if not f.getPath().getName().startswith(("_", "."))]
            rows.append((name, len(sizes), sum(sizes)))
        return self.spark.createDataFrame(rows, "split string, files long, nbytes long")


def one_to_many(df: DataFrame, items: Column, key: str = "key") -> DataFrame:
    """Samples of a transform that gives a list of structs: a row for each, its key that of the sample with the place behind it; an empty list gives no
    row, null none either."""
    out = df.select(F.col(key).alias("_key"), F.posexplode(items).alias("_at", "_item"))
    return out.select(F.concat_ws("_", "_key", "_at").alias(key), "_item.*")


def sized_shards(df: DataFrame, size: Column, max_count: int, max_bytes: int, pos: str = "_pos") -> DataFrame:
    """df with `shard` from 1: rows in order of position; a shard is closed by the row that brings it to max_count rows, or by that with which the bytes
    since the last multiple of max_count rows pass a multiple of max_bytes. A shard so has max_bytes and one row at most, and only max_count rows are
    ordered at a time."""
    if max_count < 1 or max_bytes < 1:
        raise ValueError("shards hold a row at least")
    run, own = F.floor(F.col(pos) / max_count).cast("long"), size.cast("long")
    upto = F.sum("_size").over(Window.partitionBy("_run").orderBy(pos))
    rows = df.withColumns({"_run": run, "_size": own}).withColumn("_part", F.floor((upto - F.col("_size")) / max_bytes).cast("long"))
    parts = rows.groupBy("_run").agg(F.count_distinct("_part").alias("_parts"))
    # one row for each run of max_count rows: few beside the rows
    earlier = F.sum("_parts").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    start = parts.select("_run", F.coalesce(earlier, F.lit(0)).alias("_start"))
    place = F.dense_rank().over(Window.partitionBy("_run").orderBy("_part"))
    return rows.join(start, "_run").withColumn("shard", (F.col("_start") + place).cast("long")).select(*df.columns, "shard")


def write_artifacts(files: DataFrame, root: str) -> int:
    """files (path, content) -> files under root, each made once: a path names its content, so one that is there already is left. Tasks write
    through pyarrow, to any store that it and the executors reach. The number of files made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = f"{base}/{path}"
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    continue
                store.create_dir(name.rpartition("/")[0], recursive=True)
                temp = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(content.as_buffer())
                store.move(temp, name)
                made += 1
        yield pa.RecordBatch.from_pydict({"made": [made]})

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def append_merged(df: DataFrame, path: str) -> None:
    """Append rows whose columns may differ; read back with mergeSchema."""
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """One JSON object a line, non-ASCII kept; the number of rows, counted as they are written."""
    seen = Observation()
    rows = df.select(F.to_json(F.struct("*")).alias("value")).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").text(path)
    return int(seen.get["rows"])


def hoisted(df: DataFrame, content: str, path: str, artifacts: str, limit: int = INLINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, artifacts): content above the limit leaves the row for a content-addressed artifact, named by hash under a two-letter folder."""
    digest = F.sha2(F.col(content), 256)
    large = F.col(content).isNotNull() & F.col(path).isNull() & (F.length(content) > limit)
    name = F.concat(F.lit(f"{artifacts}/"), F.substring(digest, 1, 2), F.lit("/"), digest)
    files = df.where(large).select(digest.alias("sha256"), name.alias("path"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    return df.withColumns({path: F.when(large, name).otherwise(F.col(path)), content: F.when(~large, F.col(content))}), files


def tolerant(df: DataFrame, f: Callable[[dict], dict], schema: str, keep: list[str] | None = None) -> DataFrame:
    """f over rows, Arrow batches at a time; a row that raises gives its message in `error` and nulls, but for the columns of df named in keep."""
    names = [x.split()[0] for x in schema.split(",")]
    kept = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({**{k: row[k] for k in kept}, **f(row), "error": None})
                except Exception as e:  # the budget decides
                    out.append({**dict.fromkeys(names), **{k: row[k] for k in kept}, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    full = StructType.fromDDL(f"{schema}, error string")
    shape = to_arrow_schema(full)
    return df.mapInArrow(run, full)


def within_budget(df: DataFrame, budget: int = 10, path: str | None = None) -> DataFrame:
    """Rows without error; more errors than the budget are an error of their own. The rows are written once (to path, else to the scratch folder), so that
    the function whose errors they carry runs once."""
    from ..session import written

    if path is None:
        rows = written(df, "tolerated")
    else:
        df.write.mode("overwrite").parquet(path)
        rows = df.sparkSession.read.schema(df.schema).parquet(path)
    bad = rows.where("error is not null").limit(budget + 1).count()
    if bad > budget:
        raise RuntimeError(f"more than {budget} samples failed")
    return rows.where("error is null").drop("error")
