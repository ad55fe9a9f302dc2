"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.column import Column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_MB, BATCH_KEY = 4, "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
_written: list[str] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_kept: dict[tuple[str, str], object] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a folder of this process in local mode, an error on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
    if context.applicationId not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[context.applicationId] = "file://" + folder
    return _own_dirs[context.applicationId]


def staged_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends. Else they stay until the driver happens to collect its garbage, which it does the less often
    for each GB the longer its tasks run, so that those of many steps lie on the disks at once."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs no rerun of what is above. The shuffles of the write are
    not read again, so their files go with it.

    The tables stay, as results are read from them when they are used; `unstage` removes those that only later tables were made from, `drop_staged` all
    of them when the results have been written."""
    path = staged_path(df.sparkSession, tag)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete the tables of frames that `staged` gave, once no result reads them: what was made from them must have been staged or collected."""
    for df in frames:
        path = _places.pop(df)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this process has staged so far, once no result that reads it is needed; how many tables there were."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thin_batches(df: DataFrame) -> DataFrame:
    """df; its session hands rows to Python in Arrow batches of at most about BATCH_MB, whatever the rows' size, for both sides hold a batch whole.

    Spark reads this when a query runs, so it cannot be bound to one query. Every operator that hands texts to Python asks for it, so that none
    depends on which others ran before; a session that names a smaller bound of its own keeps that."""
    spark = df.sparkSession
    named = str(spark.conf.get(BATCH_KEY)).strip().lower()
    units = {"k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "b": 1, "": 1}
    number = named.rstrip("bgkm")
    size = int(number) * units[named[len(number) :]] if number.isdigit() else 0
    if not 0 < size <= BATCH_MB << 20:
        spark.conf.set(BATCH_KEY, f"{BATCH_MB}m")
    return df


def free_name(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept(operator: str, key: str, make: Callable[[], object]) -> object:
    """What a worker process keeps for the next tasks of an operator; the first task of another one frees it."""
    if (operator, key) not in _kept:
        _kept[operator, key] = make()
    return _kept[operator, key]


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_others(operator: str) -> None:
    for owned in [k for k in _kept if k[0] != operator]:
        del _kept[owned]


def lean(operator: str, run: Callable) -> Callable:
    """run (over record batches), begun without what other operators keep in the worker and ended by giving memory back."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; the JVM's lower() serves texts in which nothing else would change."""
    return F.when(c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts have about `limit` bytes, one row at least; only a run at a time becomes Python objects."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
