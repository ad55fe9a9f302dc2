"""Identity of caches, configs, modules, registries, datasets, downloads and logs."""

import functools
import logging
import tarfile
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import logs
from quillspark.operators.views import compose
from quillspark.plans import cache, config, transforms
from quillspark.sources import datasets, download, readers, sinks


class Numbers(cache.Dataset):
    class Config(config.Config):
        n: int = 3
        label: str | None = None

    name = "numbers"
    built = 0

    def build(self, s, split):
        Numbers.built += 1
        return s.range(self.config.n) if split != "validation" else None


def test_caches_of_configs_caps_closures_and_compositions_are_apart(spark, tmp_path):
    def build(n=3, cap=None, f=None, then=None):
        b = cache.Builder(spark, str(tmp_path)).load(Numbers(Numbers.Config(n=n))).cache(**({"max_samples": cap} if cap else {}))
        if f is not None:
            b = b.process(f)
        if then is not None:
            b = b.process(then)
        return b.build()

    twice = lambda df: df.withColumn("y", F.col("id") * 2)
    assert [build(n, f=twice).split(spark, "train").count() for n in (3, 7, 3)] == [3, 7, 3]
    assert [build(7, cap, f=twice).split(spark, "train").count() for cap in (2, 5, None)] == [2, 5, 7]
    first = [lambda df, k=k: df.limit(k) for k in (1, 2)]
    assert [build(7, f=f).split(spark, "train").count() for f in first] == [1, 2]

    def head(k):
        return lambda df: df.limit(k)

    assert [build(7, f=head(k)).split(spark, "train").count() for k in (1, 2)] == [1, 2]
    parts = [compose(head(k), twice) for k in (1, 2)]
    assert [build(7, f=p).split(spark, "train").count() for p in parts] == [1, 2]
    assert len({build(7, f=p).folder for p in parts} | {build(7, f=head(3)).folder}) == 3
    last = build(7, f=head(2), then=twice)
    assert [t["name"].rpartition(".")[2] for t in last.snapshot.transforms] == ["<lambda>", "<lambda>"] and last.source_config == {"n": 7, "label": None}
    before = Numbers.built
    assert build(7, f=head(2), then=twice).folder == last.folder and Numbers.built == before
    assert {s.stage for _, s in cache.discover(spark, str(tmp_path))} == {"raw", "processed"} and cache.discover(spark, str(tmp_path), kind="page") == []


def test_identity_of_functions():
    def make(n, scale=1):
        return lambda df: df.limit(n * scale)

    same = transforms.transform_hash
    assert same(make(1)) == same(make(1)) != same(make(2)) and same(make(1, 2)) != same(make(1, 3))
    assert same(functools.partial(make, 1)) != same(functools.partial(make, 2)) and same(compose(make(1))) != same(compose(make(2)))
    assert same(transforms.Compose(make(1), make(2))) != same(transforms.Compose(make(2), make(1)))
    assert same(lambda df: df.where(F.col("x") > 1)) != same(lambda df: df.where(F.col("x") > 2))


def test_cached_splits_and_snapshots(spark, tmp_path):
    d = Numbers()
    assert cache.find(spark, d, str(tmp_path)) is None
    made = cache.cache(spark, d, str(tmp_path), names=("train",))
    before = Numbers.built
    assert cache.find(spark, d, str(tmp_path)) == made.folder and cache.find(spark, d, str(tmp_path), names=("validation",)) is None and Numbers.built == before
    with pytest.raises(ValueError, match="validation"):
        cache.cache(spark, d, str(tmp_path), names=("validation",))
    raw = {"name": "x", "config": {}, "config_hash": "a", "transform_hash": "b", "stage": "raw", "counts": {"train": 1}, "version": 1}
    assert cache.Snapshot.from_dict(raw).errors() == []
    for broken in ({"version": 0}, {"version": 2}, {"counts": {"dev": 1}}, {"counts": {"train": -1}}, {"name": ""}):
        with pytest.raises(ValueError):
            cache.Snapshot.from_dict({**raw, **broken})
    with pytest.raises(ValueError, match="without"):
        cache.Snapshot.from_dict({"name": "x"})
    quoted = spark.createDataFrame([("a'b", 1), ("c", 2)], "sample_id string, n int")

    class One(cache.Dataset):
        name = "one"

        def build(self, s, split):
            return quoted if split == "train" else None

    assert cache.cache(spark, One(), str(tmp_path)).sample(spark, "train", "a'b").first().n == 1

    class Wrong(cache.Dataset):
        def build(self, s, split):
            return [1]

    with pytest.raises(TypeError):
        Wrong().split(spark, "train")


def test_configs_are_typed():
    with pytest.raises(TypeError, match="n is int"):
        Numbers.Config(n="abc")
    with pytest.raises(TypeError):
        Numbers.Config(n=True)
    assert Numbers.Config(label=None).label is None
    with pytest.raises(TypeError, match="JSON"):

        class Bad(config.Config):
            f: logging.Logger

    class Fine(config.Config):
        sizes: list[int] = [1]
        pair: tuple[int, str] = (1, "a")
        names: dict[str, float] = {}

    assert Fine(names={"a": 1}).to_dict() == {"sizes": [1], "pair": [1, "a"], "names": {"a": 1}}
    with pytest.raises(TypeError):
        Fine(pair=(1, 2))


def test_modules_and_datasets_by_name(spark, tmp_path):
    class Base(config.Module, abstract=True):
        class Config(config.Config):
            size: int = 1

    class Leaf(Base, name="leaf"):
        pass

    assert Leaf(size=2).config.size == 2 and repr(Leaf()) == "Leaf(config=Config(size=1))"
    with pytest.raises(TypeError, match="abstract"):
        Base()
    with pytest.raises(TypeError, match="name"):

        class Nameless(Base):
            pass

    with pytest.raises(ValueError, match="not both"):
        Leaf(Leaf.Config(), size=3)
    spark.range(5).write.parquet(f"{tmp_path}/d/train")
    spark.range(2).write.parquet(f"{tmp_path}/d/extra")
    made = datasets.load_dataset("folder", path=f"{tmp_path}/d", shuffle=True)
    assert list(made.splits(spark)) == ["train"] and sorted(r.id for r in made.split(spark, "train").collect()) == list(range(5))
    with pytest.raises(ValueError, match="valid fields.*path"):
        datasets.load_dataset("folder", root="x")
    with pytest.raises(ValueError, match="not both"):
        datasets.load_dataset("folder", {"path": "x"}, path="y")
    with pytest.raises(KeyError, match="folder"):
        datasets.load_dataset("folde")
    stream = datasets.load_dataset("folder", {"path": f"{tmp_path}/d", "streaming": True}).split(spark, "train")
    assert stream.isStreaming and datasets.read_mode(spark, f"{tmp_path}/d/train", "in_memory").count() == 5
    assert datasets.read_mode(spark, f"{tmp_path}/d/train", "online_streaming").isStreaming
    with pytest.raises(ValueError):
        datasets.read_mode(spark, "x", "far")
    shuffled = [r.id for r in datasets.buffer_shuffled(spark.range(200).coalesce(1), 3, 50).collect()]
    assert sorted(shuffled) == list(range(200)) != shuffled and shuffled == [r.id for r in datasets.buffer_shuffled(spark.range(200).coalesce(1), 3, 50).collect()]
    assert "quillspark.plans.cache" in config.import_submodules("quillspark.plans")
    assert config.represented({"a": np.zeros((2, 3)), "b": list(range(9)), "c": b"xyz"}) == "{'a': ndarray(shape=(2, 3), dtype=float64), 'b': [0, 1, 2, 3, ... 9 in all], 'c': bytes(3)}"


def test_shard_lists(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as string) as sample_id", "'k' as key").repartitionByRange(4, F.col("sample_id").cast("int")).sortWithinPartitions(F.col("sample_id").cast("int")).write.parquet(f"{tmp_path}/s")
    shards = datasets.ShardList(spark, f"{tmp_path}/s")
    assert len(shards) == 40 and shards[-1].first().sample_id == "39" and shards[7].columns == ["sample_id", "_pos"]
    assert shards.by_id("23").first()._pos == 23 and shards.sizes().count() == 4
    with pytest.raises(IndexError):
        shards[40]


def test_storage(spark, tmp_path):
    store = sinks.Storage(spark, f"file://{tmp_path}/x", "rows")
    assert not store.dataset_exists() and store.write(spark.range(7), "train", shards=2) == 7
    assert store.names() == ["train"] and store.read("train").count() == 7 and store.totals().first().files >= 1
    store.purge("train")
    with pytest.raises(ValueError):
        store.read("train")
    with pytest.raises(ValueError, match="known"):
        sinks.Storage(spark, "x", "tape")
    files = spark.createDataFrame([("ab/abc", b"1"), ("ab/abd", b"22")], "path string, content binary")
    assert [sinks.write_artifacts(files, f"file://{tmp_path}/art") for _ in (1, 2)] == [2, 0] and (tmp_path / "art/ab/abd").read_bytes() == b"22"
    assert sinks.write_jsonl(spark.range(3), f"{tmp_path}/l") == 3


def test_budget_runs_the_function_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def f(row):
        with open(seen, "a") as out:
            out.write("x")
        return {"y": row["id"]}

    assert sinks.within_budget(sinks.tolerant(spark.range(6), f, "y long"), 0).count() == 6 and len(seen.read_text()) == 6


def test_downloads(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("hello")
    with zipfile.ZipFile(src / "z.zip", "w") as z:
        z.write(src / "a.txt", "in/a.txt")
    with tarfile.open(src / "t.tar.gz", "w:gz") as t:
        t.add(src / "a.txt", "a.txt")
    whole = (src / "z.zip").read_bytes()
    for k in range(11):
        (src / f"p.zip.part{k}").write_bytes(whole[k * len(whole) // 11 : (k + 1) * len(whole) // 11])
    get = download.Downloads(tmp_path / "out")
    urls = [f"file://{src}/{n}" for n in ["a.txt", "z.zip", "t.tar.gz", *(f"p.zip.part{k}" for k in (10, *range(10)))]]
    got = get.get(urls)
    assert got["a.txt"].read_text() == (got["z.zip"] / "in/a.txt").read_text() == (got["t.tar.gz"] / "a.txt").read_text() == (got["p.zip"] / "in/a.txt").read_text() == "hello"
    for f in src.iterdir():
        f.unlink()
    assert get.get(urls) == got and not list(Path(tmp_path / "out").rglob("*.incomplete"))
    with pytest.raises(FileNotFoundError):
        download.fetch(f"file://{src}/gone", tmp_path / "g")
    with pytest.raises(ValueError, match="fetch drive"):
        download.fetch("drive://x/y", tmp_path / "g")
    tries = []
    real = download._stream
    try:
        download._stream = lambda url, target: (tries.append(url), target.write_text("late") if len(tries) == 3 else (_ for _ in ()).throw(ConnectionError()))
        assert download.fetch("http://h/{access_token}", tmp_path / "h", "tok", wait=0.01).read_text() == "late" and tries == ["http://h/tok"] * 3
    finally:
        download._stream = real
    evil = tmp_path / "evil.zip"
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError, match="leads out"):
        download.unpack(evil, tmp_path / "e")
    assert download.Source("https://h/x/data.tar.gz.part3?k=1").stem == "data"


def test_reading_bytes_and_ranges(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(50)))
    uris = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), (f"file://{tmp_path}/a.bin?offset=5&length=3",)], "uri string")
    assert sorted(len(r.content) for r in readers.load_bytes(spark, uris).collect()) == [3, 50]
    files = spark.createDataFrame([("a", bytes(range(50)))], "path string, content binary")
    ask = lambda *u: readers.tar_members(files, spark.createDataFrame([(x,) for x in u], "uri string")).collect()
    assert ask("a?offset=5&length=3")[0].content == bytes([5, 6, 7]) and ask("a?length=0&offset=50")[0].content == b""
    for bad, says in (("a", "required"), ("a?offset=49&length=2", "outside"), ("b?offset=1&length=1", "no file")):
        with pytest.raises(Exception, match=says):
            ask(bad)
    with pytest.raises(Exception, match="no way to read ftp"):
        readers.load_bytes(spark, spark.createDataFrame([("ftp://h/x",)], "uri string")).collect()
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(ValueError, match=r"b\.jsonl:3: not json"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int")


def test_logs(tmp_path):
    root = logs.get_logger()
    assert logs.get_logger("x").name == "quillspark.x" and len(root.handlers) >= 1
    paths = [logs.attach_file(tmp_path / "run.log") for _ in range(3)]
    assert [p.name for p in paths] == ["run.log", "run.log.1", "run.log.2"]
    logs.get_logger("x").warning("said")
    assert "said" in paths[0].read_text()
    quiet = logs.RankFilter(1)
    record = lambda level: logging.LogRecord("q", level, "", 0, "", (), None)
    assert not quiet.filter(record(logging.INFO)) and quiet.filter(record(logging.WARNING)) and "=" in logs.banner("x")
