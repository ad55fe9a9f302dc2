"""Catalog, sources, sinks and views beyond the queries."""

import zlib
from enum import Enum

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry, samples
from quillspark.operators import conversations, extract
from quillspark.operators.aggregates import distinct_counts, medians
from quillspark.operators.views import View, compose
from quillspark.plans import cache, config, transforms
from quillspark.sources import readers, sinks


class Kind(Enum):
    A = "a"


class Settings(config.Config):
    size: int
    kind: Kind = Kind.A


def test_config_is_frozen_and_hashed():
    a, b = Settings(size=1), Settings(size=1)
    assert a == b and a.hash() == b.hash() and a.to_dict() == {"size": 1, "kind": "a"} and Settings(size=2).hash() != a.hash()
    with pytest.raises(AttributeError):
        a.size = 3
    with pytest.raises(ValueError, match="unknown"):
        Settings(size=1, colour=2)
    with pytest.raises(ValueError, match="missing"):
        Settings()
    with pytest.raises(TypeError):
        Settings(size=object())


def test_registry():
    r = config.Registry(cache.Dataset)
    r.register("cached", "quillspark.plans.cache:Cached")
    assert r.get("cached") is cache.Cached
    with pytest.raises(ValueError):
        r.register("cached", cache.Cached)
    with pytest.raises(KeyError, match="cached"):
        r.get("cachet")
    with pytest.raises(TypeError):
        r.register("x", int)
    assert config.Registry.from_dict(r.to_dict()).names() == ["cached"]


def test_view(spark):
    v = View.of(spark.range(20), "id")
    assert [r.id for r in v[2:8:2].orderBy("id").collect()] == [2, 4, 6]
    assert v[-1].first().id == 19 and len(v.limit(100)) == 20
    assert [r.id for r in v.take([3, -1])] == [3, 19] if isinstance(v.take([3, -1]), list) else [r.id for r in v.take([3, -1]).collect()] == [3, 19]
    with pytest.raises(ValueError):
        v.limit(-1)
    with pytest.raises(IndexError):
        v[20]
    twice = compose(lambda d: d.withColumn("y", F.col("id") + 1), compose(lambda d: d.withColumn("y", F.col("y") * 2)))
    assert v.with_transform(twice).filter("y > 36").frame.orderBy("_pos").select("id", "_pos").collect() == [(18, 0), (19, 1)]


def test_a_limit_places_only_its_rows(spark):
    v = View.of(spark.range(100, -100, -1).repartition(5), "id")
    few = v.limit(3)
    assert [tuple(r) for r in few.frame.orderBy("_pos").collect()] == [(-99, 0), (-98, 1), (-97, 2)] and len(few) == 3
    assert "rows" not in vars(v._base) and len(v) == 200
    assert v.limit(0).frame.count() == 0 and v.limit(500).frame.count() == 200
    assert v.limit(10).limit(4)[-1].first().id == -96 and v.with_transform(lambda d: d).base is v.base


def test_medians(spark):
    rows = [("a", float(i * 7 % 101)) for i in range(101)] + [("b", 1.0)] * 50 + [("b", 3.0)] * 50 + [(None, 2.0), (None, 5.0), ("c", None), ("d", -4.0), ("d", None)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(7)
    got = {r.kind: r.median for r in medians(df, "kind", "v").collect()}
    assert got == {"a": 50.0, "b": 2.0, None: 3.5, "d": -4.0}
    assert medians(df.where("false"), "kind", "v").count() == 0
    # columns may have the names that the operator uses itself
    assert medians(df.select(F.col("kind").alias("part"), F.col("v").alias("g")), "part", "g").count() == 4


def test_distinct_counts(spark):
    rows = [("a", i * 7 % 5000) for i in range(20000)] + [("b", 1)] * 90 + [("b", None), ("c", None), (None, 4), (None, 4), (None, 5)]
    df = spark.createDataFrame(rows, "kind string, v long").repartition(7)
    got = {r.kind: (r.approx, r.exact) for r in distinct_counts(df, "kind", "v", 0.02).collect()}
    assert {k: exact for k, (_, exact) in got.items()} == {"a": 5000, "b": 1, "c": 0, None: 2}
    # the sketch is the one of all rows
    assert {k: approx for k, (approx, _) in got.items()} == {r.kind: r.n for r in df.groupBy("kind").agg(F.approx_count_distinct("v", 0.02).alias("n")).collect()}
    assert distinct_counts(df.where("false"), "kind", "v").count() == 0
    # columns may have the names that the operator uses itself
    assert distinct_counts(df.select(F.col("kind").alias("v"), F.col("v").alias("g")), "v", "g").count() == 4


def test_no_sketch_for_each_value(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["ext_approximate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [line.partition("keys=[")[2].partition("]")[0] for line in plan.splitlines() if "approx_count_distinct" in line and "keys=[" in line]
    assert keys and all("," not in k for k in keys), keys


@pytest.mark.parametrize(
    "bounds",
    [(None, None, -1), (-2, None, -3), (15, 3, -4), (3, 15, -1), (100, None, -7), (None, -100, -1), (-5, -1, None), (4, -4, 5), (18, 2, 1), (None, 100, 6)],
)
def test_slices_are_those_of_a_list(spark, bounds):
    rows = View.of(spark.range(20), "id")[slice(*bounds)].orderBy("_pos").collect()
    assert [r.id for r in rows] == list(range(20))[slice(*bounds)] and [r._pos for r in rows] == list(range(len(rows)))


def test_a_slice_has_a_step(spark):
    with pytest.raises(ValueError):
        View.of(spark.range(3), "id")[::0]


def test_cache_is_reused_and_published_last(spark, tmp_path):
    built = []

    class Numbers(cache.Dataset):
        name = "numbers"

        def build(self, s, split):
            built.append(split)
            return s.range(3 if split == "train" else 1) if split != "validation" else None

    t = transforms.Compose(lambda d: d.withColumn("y", F.col("id") * 2))
    first = cache.Builder(spark, str(tmp_path)).load(Numbers()).process(t).build()
    n = len(built)
    again = cache.cache(spark, Numbers(), str(tmp_path), t)
    assert len(built) == n and again.snapshot.counts == {"train": 3, "test": 1} and first.folder == again.folder
    assert [p for p, _ in cache.discover(spark, str(tmp_path), "processed")] == [again.folder]
    assert again.split(spark, "train").agg(F.sum("y")).first()[0] == 6
    with pytest.raises(ValueError):
        again.split(spark, "validation")
    with pytest.raises(ValueError):
        cache.Builder(spark, str(tmp_path)).build()


def test_failed_split_leaves_nothing(spark, tmp_path):
    bad = spark.range(3).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("int")).otherwise(1))
    with pytest.raises(RuntimeError):
        sinks.write_split(bad, f"file://{tmp_path}", "train")
    assert sinks.splits(spark, f"file://{tmp_path}") == []


def test_jsonl_skips_blanks_and_names_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="bad record"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int", strict=False).count() == 2


def test_error_budget(spark):
    def f(row):
        if row["id"] == 3:
            raise ValueError("three")
        return {"y": row["id"] + 1}

    out = sinks.tolerant(spark.range(6), f, "y long")
    assert sorted(r.y for r in sinks.within_budget(out, 1).collect()) == [1, 2, 3, 5, 6]
    with pytest.raises(RuntimeError):
        sinks.within_budget(out, 0)


def test_images_are_decoded(spark, tmp_path):
    def chunk(tag, data):
        return len(data).to_bytes(4, "big") + tag + data + zlib.crc32(tag + data).to_bytes(4, "big")

    raw = b"".join(b"\0" + bytes((9, 8, 7)) * 5 for _ in range(3))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (5).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    row = readers.read_images(spark, str(tmp_path)).first()
    assert (row.height, row.width, row.channels) == (3, 5, 3)


def test_columns(spark):
    one = spark.range(1)
    assert one.select(readers.byte_range(F.lit(b"0123456789"), F.lit(2), F.lit(4))).first()[0] == b"2345"
    assert one.select(geometry.switch_mode(geometry.switch_mode(F.array(*map(F.lit, (1.0, 2.0, 5.0, 7.0))), F.lit("xyxy")), F.lit("xywh"))).first()[0] == [1, 2, 5, 7]
    objects = F.from_json(F.lit('[{"segmentation":[[1,2],[3,4]]},{}]'), "array<struct<segmentation:array<array<double>>>>")
    got = one.select(samples.padded_polygons(objects).alias("p")).first().p
    assert got.lengths == [2, 0] and got.polygons[0] == [[1, 2], [3, 4]] and all(x != x for p in got.polygons[1] for x in p)
    with pytest.raises(Exception, match="unknown turn type"):
        one.select(conversations.decoded(F.lit('{"type":"song"}'))).collect()
    with pytest.raises(ValueError):
        samples.upsert(F.col("a"), "song", F.lit(1))
    words = one.select(extract.hocr_words(F.lit("<span class='ocrx_word' id='w' title='bbox 1 2 3 4; x_wconf 90'>hi</span>")).alias("w")).first().w
    assert words[0].text == "hi" and words[0].x1 == 3
    with pytest.raises(ValueError):
        readers.split(one, "song")
