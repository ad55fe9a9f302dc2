"""Session builder and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def session(app: str = "quillspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset, a folder of this process in local mode, and an error on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = "file://" + folder
    return _own[context.applicationId]


def written(df: DataFrame, tag: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
