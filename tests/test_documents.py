"""Images, documents, element trees, samples and streams on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import images as img, samples as smp
from quillspark.operators import conversations, documents, elements, images, joins, shards
from quillspark.operators.views import View
from quillspark.streaming import windows

RNG = np.random.default_rng(1)
PICTURE = RNG.integers(0, 256, (6, 9, 3), dtype=np.uint8)


def exif(orientation):
    return b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01" + orientation.to_bytes(2, "big") + b"\0\0\0\0\0\0"


def test_pixels():
    assert [img.oriented(PICTURE, k).shape[:2] for k in (1, 3, 5, 6, 7, 8, 99)] == [(6, 9), (6, 9), (9, 6), (9, 6), (9, 6), (9, 6), (6, 9)]
    assert (img.oriented(PICTURE, 6)[:, -1] == PICTURE[0]).all() and (img.oriented(PICTURE, 8)[::-1, 0] == PICTURE[0]).all() and (img.oriented(PICTURE, 3) == PICTURE[::-1, ::-1]).all()
    assert (img.oriented(PICTURE, 5) == PICTURE.swapaxes(0, 1)).all() and (img.oriented(PICTURE, 7) == PICTURE[::-1, ::-1].swapaxes(0, 1)).all()
    assert img.exif_orientation(b"..." + exif(6)) == 6 and img.exif_orientation(b"none") == 1 and img.exif_orientation(exif(77)) == 1
    assert (img.cropped(PICTURE, [2, 1, 5, 4]) == PICTURE[1:4, 2:5]).all() and img.cropped(PICTURE, [-1, 0, 3, 9]).shape == (9, 4, 3) and img.cropped(PICTURE, None) is PICTURE
    assert (img.resized(PICTURE, 9, 6) == PICTURE).all() and (img.resized(np.full((5, 7, 3), 90, np.uint8), 3, 11) == 90).all()
    assert img.fitted(PICTURE, 4).shape == (2, 4, 3) and img.fitted(PICTURE, 20) is PICTURE and img.fitted(np.zeros((1, 3000), np.uint8), 100).shape == (1, 100)
    ramp = np.tile(np.linspace(0, 250, 100), (4, 1)).astype(np.uint8)
    assert np.abs(np.diff(img.resized(ramp, 50, 4)[0].astype(int), 2)).max() <= 3
    assert (img.to_grey(np.full((2, 2, 3), 200, np.uint8)) == 200).all() and img.to_grey(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 76 and img.to_rgb(ramp).shape == (4, 100, 3)
    boxed = img.drawn(PICTURE, [[1, 1, 4, 3]], [(255, 0, 0)])
    assert (boxed[1, 1:5] == (255, 0, 0)).all() and (boxed[1:4, 4] == (255, 0, 0)).all() and (boxed[2, 2] == PICTURE[2, 2]).all() and (boxed[5] == PICTURE[5]).all()


def test_images_as_rows(spark, tmp_path):
    png = img.encode_png(PICTURE)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "turned.png").write_bytes(png[:33] + b"\0\0\0\0eXIf" + exif(6)[6:] + b"\0\0\0\0" + png[33:])
    read = {r.sample_id: r for r in images.read(spark, str(tmp_path / "a.png")).collect()}
    assert np.frombuffer(read["a.png"].data, np.uint8).reshape(6, 9, 3).tolist() == PICTURE.tolist()
    rows = images.read(spark, str(tmp_path / "a.png"))
    assert rows.select(images.shape(F.col("height"), F.col("width"), F.col("channels"))).first()[0] == [3, 6, 9]
    small = images.resize(rows, 4, 3).first()
    assert (small.height, small.width, len(small.data)) == (3, 4, 36) and images.grey(rows).first().channels == 1 and images.rgb(images.grey(rows)).first().channels == 3
    kinds = rows.withColumn("visual_type", F.explode(F.array(F.lit("image"), F.lit("pdf"))))
    assert sorted(r.width for r in images.preprocess(kinds, 3).collect()) == [3, 9] and images.resize_longest(rows, 3).first().height == 2
    cut = images.crop(rows.withColumn("crop_box", F.array(*map(F.lit, (1, 1, 4, 3))))).first()
    assert (cut.height, cut.width) == (2, 3)
    box = images.boxes_to_draw(F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), F.lit("xywh"), F.lit(True), F.col("width"), F.col("height"))
    marked = images.draw(rows.withColumns({"boxes": F.array(box), "colours": F.array(F.array(F.lit(255), F.lit(0), F.lit(0)))})).first()
    assert marked.boxes == [[0.0, 0.0, 4.5, 3.0]] and np.frombuffer(marked.data, np.uint8).reshape(6, 9, 3)[0, 2].tolist() == [255, 0, 0]
    art = images.artifacts(rows.unionByName(rows)).collect()
    assert len(art) == 1 and art[0].path[2] == "/" and images.png(rows).first().png == png
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image"):
        images.read(spark, str(tmp_path / "bad.png")).collect()
    assert images.read(spark, str(tmp_path / "bad.png"), "keep").first().data is None and images.read(spark, str(tmp_path / "bad.png"), "drop").count() == 0


def test_documents(spark):
    pdf = b"%PDF /Type /Pages /Kids [] /Count 3 >> /Type /Page /Type /Page /Type/Page"
    assert documents.page_count(pdf) == 3 and documents.page_count(b"/Type/Page x /Type /Page ") == 2 and documents.page_count(b"") == 0
    files = spark.createDataFrame([("d/a.pdf", pdf), ("d/none.pdf", b"")], "path string, content binary")
    assert [r.sample_id for r in documents.pdf_pages(files).orderBy("page_id").collect()] == ["a.pdf#0", "a.pdf#1", "a.pdf#2"]
    doc = spark.createDataFrame([("x", ["p", "q"])], "sample_id string, pages array<string>")
    assert doc.select(documents.get_page(F.col("pages"), F.lit(1)), documents.num_pages(F.col("pages"))).first()[:] == ("q", 2) and documents.page_rows(doc).count() == 2
    with pytest.raises(Exception, match="page 2 of 2"):
        doc.select(documents.get_page(F.col("pages"), F.lit(2))).collect()
    pages = spark.createDataFrame([("s", 100.0, 50.0)], "sample_id string, width double, height double")
    lines = spark.createDataFrame([("s", 7, 0.0, 0.0, 100.0, 20.0), ("s", 9, 0.0, 10.0, 100.0, 30.0)], "sample_id string, line_id int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("s", 1, 10.0, 10.0, 20.0, 18.0, "one"), ("s", 2, 10.0, 22.0, 30.0, 28.0, "two"), ("s", 3, 0.0, 40.0, 10.0, 50.0, "out"), ("s", 4, 0.0, 0.0, 1.0, 1.0, " ")], "sample_id string, word_id int, x0 double, y0 double, x1 double, y1 double, text string")
    tree = documents.text_tree(pages, lines, words).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.level) for r in tree] == [(0, -1, 1), (1, 0, 4), (2, 0, 4), (3, 1, 5), (4, 2, 5), (5, 0, 5)]
    assert tree[3].bbox == [0.1, 0.2, 0.2, 0.36] and tree[3].conf == 100 and tree[0].conf is None

    class Upper(documents.Extractor):
        def page(self, row):
            return [{"id": i, "parent_id": -1, "level": 5, "text": w.upper(), "conf": 1.0} for i, w in enumerate((row["text"] or "").split())]

    rows = spark.createDataFrame([("a", "x y"), ("b", None)], "sample_id string, text string")
    out = {r.sample_id: [e.text for e in r["items"]] for r in Upper(grey=False).replaced(rows).collect()}
    assert out == {"a": ["X", "Y"], "b": []} and Upper(segmentation=6, extra="-l eng").config_text() == "--oem 3 --psm 6 -l eng"
    with pytest.raises(ValueError):
        Upper(segmentation=14)
    with pytest.raises(TypeError):
        documents.visualised("conversation")
    assert documents.visualised("page") is images.draw


def test_elements(spark):
    one = spark.range(1)
    boxes = F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0)))
    items = elements.flat_words(F.array(F.lit("a"), F.lit(" ")), boxes)
    got = one.select(elements.word_boxes(items).alias("b"), elements.word_texts(items).alias("t"), elements.words(items).alias("w")).first()
    assert len(got.b) == 2 and got.t == ["a"] and [w.text for w in got.w] == ["a"] and got.w[0].bbox == [0, 0, 1, 1]
    with pytest.raises(Exception, match="differ in number"):
        one.select(elements.flat_words(F.array(F.lit("a")), boxes)).collect()
    made = lambda normalized: F.struct(F.lit("xyxy").alias("bbox_mode"), normalized.alias("normalized"), items.alias("items"))
    assert one.select(elements.checked(made(F.lit(False))).alias("e")).first().e["items"][1].bbox[2] == 2
    with pytest.raises(Exception, match="lies in"):
        one.select(elements.checked(made(F.lit(True)))).collect()
    none = made(F.lit(None).cast("boolean"))
    assert one.select(elements.with_read_defaults(none)["normalized"], elements.with_built_defaults(none)["normalized"]).first()[:] == (True, False)
    tree = F.from_json(F.lit('[{"id":5,"parent_id":-1,"bbox":[1]},{"id":1,"parent_id":5,"bbox":[2]},{"id":2,"parent_id":1,"bbox":[3]},{"id":9,"parent_id":77,"bbox":[4]}]'), "array<struct<id:int,parent_id:int,bbox:array<int>>>")
    assert one.select(elements.parent_boxes_hof(tree).alias("p")).first().p == [[1], [1], [2], [4]]
    rows = elements.element_rows(spark.createDataFrame([(1, "a b\n\nc"), (2, None), (3, "")], "doc_id long, text string"))
    assert [(r.id, r.parent_id, r.level, r.x1, r.y1, r.text) for r in rows.where("doc_id = 1").orderBy("id").collect()] == [
        (0, -1, 1, 2, 3, ""), (1, 0, 4, 2, 1, ""), (2, 0, 4, 0, 2, ""), (3, 0, 4, 1, 3, ""), (4, 1, 5, 1, 1, "a"), (5, 1, 5, 2, 1, "b"), (6, 3, 5, 1, 3, "c"),
    ]
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan") == 1 and rows.where("doc_id = 3").count() == 2


def test_samples(spark):
    one = spark.range(1)
    for text, says in (('{"song":{}}', "unknown annotation types: song"),):
        with pytest.raises(Exception, match=says):
            one.select(smp.from_json(F.lit(text))).collect()
    assert one.select(smp.from_json(F.lit(None).cast("string"))["ocr"]).first()[0] is None
    objects = F.from_json(F.lit('[{"label_value":1,"label_name":"a","bbox":[1,2,3,4],"segmentation":[[1,2],[3,4]],"iscrowd":true},{"label_value":2}]'), "array<struct<label_value:long,label_name:string,bbox:array<double>,segmentation:array<array<double>>,iscrowd:boolean>>")
    back = one.select(objects.alias("o"), smp.objects_from_arrays(smp.objects_to_arrays(objects)).alias("b")).first()
    assert back.o == back.b
    assert one.select(smp.as_polygon(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))))).first()[0] == [[1, 2], [3, 4]] and one.select(smp.as_polygon(F.array().cast("array<double>"))).first()[0] == []
    for bad in (smp.as_polygon(F.array(F.lit(1.0))), smp.checked_polygon(F.array(F.array(F.lit(1.0))))):
        with pytest.raises(Exception, match="two values"):
            one.select(bad).collect()
    with pytest.raises(Exception, match="scores are numbers"):
        one.select(smp.checked_sentiment(F.struct(F.create_map(F.lit("x"), F.lit(float("nan"))).alias("scores")))).collect()
    image = lambda path, content: F.struct(F.lit(path).cast("string").alias("file_path"), F.lit(content).cast("binary").alias("content_bytes"), F.lit(None).cast("array<int>").alias("crop_box"))
    assert one.select(smp.image_to_dict(image("p", b"x")).alias("i")).first().i.file_path is None and one.select(smp.image_to_dict(image("p", None)).alias("i")).first().i.file_path == "p"
    texts = smp.text_samples(spark.createDataFrame([(1, "é")], "i int, t string"), "i", "t")
    assert smp.sample_from_json(smp.sample_to_json(texts), "text").collect() == texts.collect()
    with pytest.raises(ValueError):
        smp.sample_from_json(texts, "song")
    layout = {"objects": {"_type": "Sequence", "feature": {"bbox": {"_type": "Sequence"}, "category_id": {"_type": "ClassLabel", "names": ["t", "f"]}}}, "x": {"_type": "Value"}}
    assert smp.infer_labels(layout) == {"layout_analysis": ["t", "f"]} and smp.infer_labels({"tags": [{"_type": "ClassLabel", "names": ["O"]}]}) == {"entity_labeling": ["O"]}
    with pytest.raises(Exception, match="no label 2"):
        one.select(smp.labelled(F.lit(2), ["a", "b"])).collect()


def test_calls_keep_blanks_within_texts(spark):
    said = spark.range(1).select(conversations.tool_call_text(F.lit('f"é'), F.lit('{"q": "hello  world",\n "n": [1, 2]}'))).first()[0]
    assert said == '{"name":"f\\"é","arguments":{"n":[1,2],"q":"hello  world"}}'


def test_views_and_shards(spark):
    v = View.of(spark.range(10), "id")
    with pytest.raises(IndexError):
        v.take([3, 10])
    with pytest.raises(IndexError):
        v.take([-11])
    assert [r.id for r in v.take([3, 3, -1]).collect()] == [3, 3, 9]
    sizes = spark.createDataFrame([(1, 4), (2, 0), (3, 100), (4, 1)], "shard int, nsamples long")
    got = shards.locate(spark.range(107).withColumnRenamed("id", "idx"), sizes).collect()
    assert len(got) == 105 and {(r.idx, r.shard, r.inner) for r in got} >= {(0, 1, 0), (3, 1, 3), (4, 3, 0), (103, 3, 99), (104, 4, 0)}
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 1, 10), (1, 5, 2, 11), (1, 4, 3, 12), (2, 10, 1, 13)], "k int, t int, i int, v int")
    assert {(r.x, r.v) for r in joins.as_of(left, right, ["k"], "t", "i", ["v"]).collect()} == {("a", 11), ("b", None), ("c", None)}


def test_late_events_are_left_out(spark, tmp_path):
    event = "select timestamp'{}' as ts, 'a' as event_type, 1.0 as value"
    for k, at in enumerate(("2024-01-01 10:10:00", "2024-01-02 10:00:00", "2024-01-02 10:30:00", "2024-01-01 10:20:00", "2024-01-03 10:00:00")):
        spark.sql(event.format(at)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        import time

        time.sleep(1.1)  # files are read in the order of their times
    stream = windows.event_stream(spark, f"{tmp_path}/e", files_per_trigger=1)
    got = windows.drained(windows.tumbling(stream, "1 hour", "event_type"), "append").orderBy("window_start").collect()
    assert [r.n for r in got] == [1, 2]
