"""Samples: keys, annotations, codecs."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.column import Column

from ..schemas import ANNOTATIONS, ANNOTATIONS_DDL, KINDS


def sample_key(sample_id: Column) -> Column:
    """A key that file systems take: dots, slashes and hashes become underscores."""
    return F.regexp_replace(sample_id, "[./#]", "_")


def no_annotations() -> Column:
    """The annotations struct with every type absent."""
    return F.struct(*(F.lit(None).cast(ddl).alias(name) for name, ddl in ANNOTATIONS.items()))


def text_samples(df: DataFrame, sample_id: str, text: str) -> DataFrame:
    return df.select(F.col(sample_id).cast("string").alias("sample_id"), F.create_map().cast("map<string,string>").alias("metadata"), no_annotations().cast(ANNOTATIONS_DDL).alias("annotations"), F.col(text).alias("text"))


def upsert(annotations: Column, kind: str, value: Column) -> Column:
    """Set one annotation; what was there of the same type is replaced."""
    if kind not in ANNOTATIONS:
        raise ValueError(f"unknown annotation type {kind!r}; known: {', '.join(ANNOTATIONS)}")
    return annotations.withField(kind, value.cast(ANNOTATIONS[kind]))


def has(annotations: Column, kind: str) -> Column:
    return annotations[kind].isNotNull()


def get(annotations: Column, kind: str) -> Column:
    """The annotation; an error where it is absent."""
    return F.coalesce(annotations[kind], F.raise_error(F.lit(f"no {kind} annotation")).cast(ANNOTATIONS[kind]))


def to_json(annotations: Column) -> Column:
    """JSON of what is there; null where nothing is."""
    return F.nullif(F.to_json(annotations), F.lit("{}"))


def from_json(json: Column) -> Column:
    """Annotations from JSON: null and {} have none of any type; a type that is not known is an error."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    unknown = F.filter(keys, lambda k: ~k.isin(*ANNOTATIONS))
    read = F.coalesce(F.from_json(json, ", ".join(f"{k} {v}" for k, v in ANNOTATIONS.items()), {"mode": "FAILFAST"}), no_annotations().cast(ANNOTATIONS_DDL))
    return F.when(F.size(unknown) == 0, read).otherwise(F.raise_error(F.concat(F.lit("unknown annotation types: "), F.array_join(unknown, ", "))).cast(ANNOTATIONS_DDL))


def sample_to_json(df: DataFrame) -> DataFrame:
    """A sample of any kind as one JSON text."""
    return df.select("sample_id", F.to_json(F.struct(*df.columns)).alias("json"))


def sample_from_json(df: DataFrame, kind: str, json: str = "json") -> DataFrame:
    """Samples of a kind from JSON texts; an unknown kind is an error, fields that are absent are null."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    return df.select(F.from_json(json, KINDS[kind], {"mode": "FAILFAST"}).alias("s")).select("s.*")


def checked_sentiment(sentiment: Column) -> Column:
    """Scores are numbers and meta values texts by type; scores that are null or no number are an error."""
    scores = F.map_values(sentiment["scores"])
    good = F.forall(scores, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(sentiment.isNull() | good, sentiment).otherwise(F.raise_error(F.lit("scores are numbers")))


def checked_polygon(polygon: Column) -> Column:
    """The polygon, or an error where a point has not two numbers."""
    fine = F.forall(polygon, lambda p: F.size(p) == 2)
    return F.when(polygon.isNull() | fine, polygon).otherwise(F.raise_error(F.lit("a point has two values")).cast("array<array<double>>"))


def as_polygon(numbers: Column) -> Column:
    """x, y, x, y, ... as points; an odd number of them is an error."""
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.slice(numbers, 2 * i + 1, 2))
    none = F.array().cast("array<array<double>>")
    return F.when(F.size(numbers) == 0, none).when(F.size(numbers) % 2 == 0, points).otherwise(F.raise_error(F.lit("points have two values")).cast("array<array<double>>"))


def objects_to_arrays(objects: Column) -> Column:
    """One array for each field of the objects, polygons padded; no objects give empty arrays."""
    field = lambda f: F.transform(objects, lambda o: o[f]).alias(f)
    return F.struct(*map(field, ("label_value", "label_name", "bbox", "iscrowd")), padded_polygons(objects).alias("segmentation"))


def objects_from_arrays(arrays: Column) -> Column:
    """What objects_to_arrays was made of; padding goes, a polygon without points is null."""
    shapes = F.zip_with(arrays["segmentation"]["polygons"], arrays["segmentation"]["lengths"], lambda p, n: F.when(n > 0, F.slice(p, F.lit(1), n)))
    zipped = F.arrays_zip(*(arrays[f].alias(f) for f in ("label_value", "label_name", "bbox")), shapes.alias("segmentation"), arrays["iscrowd"].alias("iscrowd"))
    return F.transform(zipped, lambda z: F.struct(*(z[f].alias(f) for f in ("label_value", "label_name", "bbox", "segmentation", "iscrowd"))))


def image_to_dict(image: Column) -> Column:
    """What an image is stored as: loaded content without its path, else the path; neither is an error."""
    source = image_source(image)
    return F.struct(F.when(source == "path", image["file_path"]).alias("file_path"), image["content_bytes"].alias("content_bytes"), image["crop_box"].alias("crop_box"))


def infer_labels(features: dict[str, Any]) -> dict[str, Any]:
    """Label sets from a description of features, by annotation type: a class label of names gives a classification, a sequence of them the labels of
    words, and objects with a category (or label) those of layouts. Nested features are looked through; other features give nothing.

    A feature is a mapping: {"_type": "ClassLabel", "names": [...]}, {"_type": "Sequence" or "List", "feature": ...}, or names of features."""
    out: dict[str, Any] = {}

    def names(feature: Any) -> list[str] | None:
        return list(feature["names"]) if isinstance(feature, dict) and feature.get("_type") == "ClassLabel" else None

    for name, feature in features.items():
        if found := names(feature):
            out.setdefault("classification", found)
            continue
        inner = feature.get("feature") if isinstance(feature, dict) and feature.get("_type") in ("Sequence", "List") else feature[0] if isinstance(feature, list) and feature else None
        if found := names(inner):
            out.setdefault("entity_labeling", found)
        elif (parts := inner if isinstance(inner, dict) and "_type" not in inner else feature if isinstance(feature, dict) and "_type" not in feature else None) is not None:
            for key, part in parts.items():
                of = part.get("feature") if isinstance(part, dict) and part.get("_type") in ("Sequence", "List") else part
                if re.search("categor|label", key) and (found := names(of)):
                    out.setdefault("layout_analysis", found)
    return out


def labelled(value: Column, names: list[str]) -> Column:
    """label_value, label_name of a class number; one that has no name is an error."""
    known = F.array(*map(F.lit, names))
    inside = (value >= 0) & (value < len(names))
    name = F.when(inside, F.get(known, value.cast("int"))).when(value.isNotNull(), F.raise_error(F.concat(F.lit("no label "), value.cast("string"))).cast("string"))
    return F.when(value.isNotNull(), F.struct(value.cast("long").alias("label_value"), name.alias("label_name")))


def image_source(image: Column) -> Column:
    """Content wins over a path; neither is an error."""
    return F.when(image["content_bytes"].isNotNull(), F.lit("content")).when(image["file_path"].isNotNull(), F.lit("path")).otherwise(F.raise_error(F.lit("an image needs content or a path")).cast("string"))


def padded_polygons(objects: Column) -> Column:
    """Polygons of all objects padded with NaN points to the longest, with their lengths."""
    size = lambda o: F.coalesce(F.size(o["segmentation"]), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(objects, size)), F.lit(0))
    nan = F.array(F.lit(float("nan")), F.lit(float("nan")))
    pad = lambda o: F.concat(F.coalesce(o["segmentation"], F.array().cast("array<array<double>>")), F.array_repeat(nan, longest - size(o)))
    return F.struct(F.transform(objects, pad).alias("polygons"), F.transform(objects, size).alias("lengths"))
