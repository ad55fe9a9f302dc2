"""Datasets materialised into hash-addressed folders with an atomically published manifest, all on Spark's file systems."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SPLITS
from ..sources import sinks
from .config import Config
from .transforms import provenance, transform_hash

VERSION = 1
MANIFEST = "snapshot.json"


@dataclass
class Snapshot:
    """The manifest of one cache: its presence means that the cache is whole."""

    name: str
    config: dict[str, Any]
    config_hash: str
    transform_hash: str
    stage: str
    counts: dict[str, int]
    schema: dict[str, str] = field(default_factory=dict)
    version: int = VERSION
    created_at: str = ""
    max_samples: int | None = None
    kind: str = "data"
    transforms: list[dict[str, Any]] = field(default_factory=list)
    #: What identifies the rows: the hashes of all steps from the source on, and their caps.
    lineage: list[str] = field(default_factory=list)

    def write(self, spark: SparkSession, folder: str) -> None:
        sinks.write_text(spark, f"{folder}/{MANIFEST}", json.dumps(asdict(self), indent=1, sort_keys=True))

    def errors(self) -> list[str]:
        """What keeps this manifest from being read: an empty config is valid, version 0 never, a newer one not by this reader."""
        found = []
        if not isinstance(self.version, int) or self.version < 1:
            found.append(f"version {self.version} is not valid")
        elif self.version > VERSION:
            found.append(f"version {self.version} is newer than {VERSION}")
        if not self.name:
            found.append("no name")
        if not isinstance(self.config, dict):
            found.append("config is no mapping")
        if any(k not in SPLITS or not isinstance(n, int) or n < 0 for k, n in self.counts.items()):
            found.append("counts are not of splits")
        return found

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Snapshot:
        known = {k: raw[k] for k in cls.__dataclass_fields__ if k in raw}
        if lacking := sorted({"name", "config", "config_hash", "transform_hash", "stage", "counts", "version"} - set(known)):
            raise ValueError(f"manifest without {', '.join(lacking)}")
        out = cls(**known)
        if bad := out.errors():
            raise ValueError("; ".join(bad))
        return out

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Snapshot | None:
        """None where there is no manifest or one that this version cannot read."""
        try:
            text = sinks.read_text(spark, f"{folder}/{MANIFEST}")
            return None if text is None else cls.from_dict(json.loads(text))
        except (ValueError, TypeError, AttributeError):
            return None


def discover(spark: SparkSession, root: str, stage: str | None = None, kind: str | None = None) -> list[tuple[str, Snapshot]]:
    """Valid snapshots at the root, in its children and two levels under storage/, sorted."""
    children = [f"{root}/{x}" for x in sinks.splits(spark, root)]
    deep = [f"{root}/storage/{x}/{y}" for x in sinks.splits(spark, f"{root}/storage") for y in sinks.splits(spark, f"{root}/storage/{x}")]
    found = [(p, s) for p in [root, *children, *deep] if (s := Snapshot.load(spark, p))]
    return [(p, s) for p, s in found if stage in (None, s.stage) and kind in (None, s.kind)]


class Dataset:
    """Named splits and a config. Subclasses implement build(spark, split) -> DataFrame or None."""

    class Config(Config):
        pass

    name = "dataset"
    kind = "data"

    def __init__(self, config: Config | None = None):
        self.config = config or self.Config()

    def build(self, spark: SparkSession, split: str) -> DataFrame | None:
        raise NotImplementedError

    def lineage(self) -> list[str]:
        return [f"{type(self).__name__}-{self.config.hash()}"]

    def split(self, spark: SparkSession, name: str, max_samples: int | None = None) -> DataFrame:
        if name not in SPLITS:
            raise ValueError(f"no split {name!r}")
        if max_samples is not None and max_samples < 0:
            raise ValueError("a cap is not negative")
        df = self.build(spark, name)
        if df is None:
            raise ValueError(f"{self.name} has no split {name}")
        if not isinstance(df, DataFrame):
            raise TypeError(f"{self.name} built a {type(df).__name__} for split {name}, not a DataFrame")
        return df if max_samples is None else df.limit(max_samples)

    def splits(self, spark: SparkSession, names: tuple[str, ...] = SPLITS) -> dict[str, DataFrame]:
        """Those of the named splits that there are."""
        return {n: self.split(spark, n) for n in names if self.build(spark, n) is not None}


class Cached(Dataset):
    """A cache reopened: its config is that of the dataset it was made of, as a mapping where the class is not known."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.snapshot = folder, Snapshot.load(spark, folder)
        if self.snapshot is None:
            raise ValueError(f"no valid snapshot in {folder}")
        self.name, self.kind = self.snapshot.name, self.snapshot.kind
        super().__init__(Config())

    @property
    def source_config(self) -> dict[str, Any]:
        return dict(self.snapshot.config)

    def lineage(self) -> list[str]:
        return list(self.snapshot.lineage)

    def build(self, spark: SparkSession, split: str) -> DataFrame | None:
        return spark.read.parquet(f"{self.folder}/{split}") if split in self.snapshot.counts else None

    def sample(self, spark: SparkSession, split: str, sample_id: str, key: str = "sample_id") -> DataFrame:
        """Point lookup; the filter reaches the Parquet scan."""
        return self.split(spark, split).where(F.col(key) == F.lit(sample_id))


def _lineage(dataset: Dataset, transform: Callable | None, max_samples: int | None) -> list[str]:
    cap = [] if max_samples is None else [f"max{max_samples}"]
    return [*dataset.lineage(), *cap, *([transform_hash(transform)] if transform else [])]


def cache_path(root: str, dataset: Dataset, transform: Callable | None = None, max_samples: int | None = None) -> str:
    """storage/<name>/<steps>: each step, from the source's class and config on, with its cap, is in the folder's name."""
    return "/".join([root.rstrip("/"), "storage", dataset.name, "-".join(_lineage(dataset, transform, max_samples)) + ("" if transform else "-none")])


def find(spark: SparkSession, dataset: Dataset, root: str, transform: Callable | None = None, max_samples: int | None = None, names: tuple[str, ...] = ()) -> str | None:
    """The folder of a whole cache that has the named splits, if there is one; the source is not built to know."""
    folder = cache_path(root, dataset, transform, max_samples)
    found = Snapshot.load(spark, folder)
    return folder if found and set(names) <= set(found.counts) else None


def cache(
    spark: SparkSession,
    dataset: Dataset,
    root: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    max_samples: int | None = None,
    stage: str = "raw",
    overwrite: bool = False,
    names: tuple[str, ...] = (),
) -> Cached:
    """Reuse a whole cache without touching the source, or write one: splits first, the manifest last. names: the splits that are needed, else all
    that the dataset has; a cache that lacks one is written anew."""
    folder = cache_path(root, dataset, transform, max_samples)
    if not overwrite and find(spark, dataset, root, transform, max_samples, names):
        return Cached(spark, folder)
    sinks.purge(spark, f"{folder}/{MANIFEST}")
    counts, schema = {}, {}
    for name in SPLITS:
        df = dataset.build(spark, name)
        if df is None:
            if name in names:
                raise ValueError(f"{dataset.name} has no split {name}")
            continue
        df = df.limit(max_samples) if max_samples is not None else df
        df = transform(df) if transform else df
        counts[name] = sinks.write_split(df, folder, name)
        schema = {f.name: f.dataType.simpleString() for f in df.schema}
    made = Snapshot(
        dataset.name, getattr(dataset, "source_config", None) or dataset.config.to_dict(), dataset.config.hash(), transform_hash(transform) if transform else "none", stage, counts, schema,
        created_at=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), max_samples=max_samples, kind=getattr(transform, "kind", dataset.kind), lineage=_lineage(dataset, transform, max_samples),
        transforms=[*(dataset.snapshot.transforms if isinstance(dataset, Cached) else []), *provenance(transform)],
    )
    made.write(spark, folder)
    return Cached(spark, folder)


class Builder:
    """load(...).cache(...).process(...).build(): steps are queued and run in order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.dataset, self.steps = spark, root, None, []

    def load(self, dataset: Dataset) -> Builder:
        self.dataset = dataset
        return self

    def cache(self, **options: Any) -> Builder:
        self.steps.append({"stage": "raw", **options})
        return self

    def process(self, transform: Callable[[DataFrame], DataFrame], **options: Any) -> Builder:
        self.steps.append({"stage": "processed", "transform": transform, **options})
        return self

    def build(self) -> Dataset:
        if self.dataset is None:
            raise ValueError("load a dataset before building")
        out = self.dataset
        for step in self.steps:
            out = cache(self.spark, out, self.root, **step)
        return out
