"""Images as rows: height, width, channels and data (bytes in rows of RGB or grey), and the work on their pixels in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.column import Column

from ..functions import images as img

PIXELS = {"height": "int", "width": "int", "channels": "int", "data": "binary"}


def read(spark: SparkSession, path: str, invalid: str = "error") -> DataFrame:
    """sample_id (the file's name), path and pixels of the images that the JVM decodes, upright as their files say. invalid: `error` refuses files that
    are no image, `keep` gives them null pixels, `drop` leaves them out."""
    if invalid not in ("error", "keep", "drop"):
        raise ValueError(f"no way {invalid!r} with files that are no image")
    files = spark.read.format("binaryFile").load(path).select(_uniform("path").alias("path"), F.substring("content", 1, 1 << 17).alias("head"))
    got = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    got = got.where("height > 0").select(_uniform("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")
    rows = files.join(got, "path", "left" if invalid != "drop" else "inner")
    if invalid == "error":
        rows = rows.withColumn("height", F.coalesce("height", F.raise_error(F.concat(F.lit("no image: "), F.col("path"))).cast("int")))
    shape = "path string, " + ", ".join(f"{k} {t}" for k, t in PIXELS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["data"] is None:
                    out.append({"path": r["path"], **dict.fromkeys(PIXELS)})
                    continue
                # the JVM hands out blue, green, red
                p = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                p = img.oriented(p[:, :, [2, 1, 0, 3][: p.shape[2]]] if p.shape[2] >= 3 else p, img.exif_orientation(r["head"]))
                out.append({"path": r["path"], **_row(p)})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    upright = rows.select("path", "head", *PIXELS).mapInArrow(run, shape)
    return upright.select(sample_name(F.col("path")).alias("sample_id"), "path", *PIXELS)


_SCHEMA = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])


def _row(p: np.ndarray) -> dict:
    return {"height": p.shape[0], "width": p.shape[1], "channels": 1 if p.ndim == 2 else p.shape[2], "data": p.tobytes()}


def _uniform(path: str) -> Column:
    """Local paths with as many slashes whichever source names them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def sample_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shape(height: Column, width: Column, channels: Column) -> Column:
    """(channels, height, width)."""
    return F.array(channels, height, width)


def mapped(df: DataFrame, f: Callable[..., np.ndarray], *args: str) -> DataFrame:
    """df with pixels replaced by f(pixels, *values of the columns args); rows with null pixels stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["data"] is not None:
                    p = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                    r.update(_row(f(p, *(r[a] for a in args))))
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def resize(df: DataFrame, width: int, height: int) -> DataFrame:
    return mapped(df, lambda p: img.resized(p, width, height))


def resize_longest(df: DataFrame, longest: int) -> DataFrame:
    return mapped(df, lambda p: img.fitted(p, longest))


def grey(df: DataFrame) -> DataFrame:
    return mapped(df, img.to_grey)


def rgb(df: DataFrame) -> DataFrame:
    return mapped(df, img.to_rgb)


def crop(df: DataFrame, box: str = "crop_box") -> DataFrame:
    return mapped(df, img.cropped, box)


def preprocess(df: DataFrame, longest: int, kind: str = "visual_type") -> DataFrame:
    """Shrinks images only; rows of another visual type stay as they are."""
    return mapped(df, lambda p, k: img.fitted(p, longest) if k == "image" else p, kind)


def boxes_to_draw(box: Column, mode: Column, normalized: Column, width: Column, height: Column) -> Column:
    """Corners in pixels, from either mode and from fractions of the sides."""
    from ..functions import geometry as geo

    corners = F.when(mode == "xywh", geo.to_xyxy(box)).otherwise(box)
    return geo.unnormalize(corners, width, height, normalized)


def draw(df: DataFrame, boxes: str = "boxes", colours: str = "colours", line: int = 1) -> DataFrame:
    """Outlines of boxes (an array of four numbers each) in colours (an array of three bytes each)."""
    return mapped(df, lambda p, b, c: img.drawn(p, b or [], [tuple(x) for x in c or []], line), boxes, colours)


def png(df: DataFrame) -> DataFrame:
    """df with `png`, the pixels as a file."""
    fields = [f for f in df.schema.fields if f.name != "png"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if r["data"] is None else img.encode_png(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])) for r in batch.to_pylist()]
            yield batch.append_column("png", pa.array(out, pa.binary()))

    from pyspark.sql.types import BinaryType, StructField, StructType

    return df.mapInArrow(run, StructType([*fields, StructField("png", BinaryType())]))


def artifacts(df: DataFrame) -> DataFrame:
    """path, content: the PNG of each distinct image, named by its hash under a folder of two letters, for `sinks.write_artifacts`."""
    digest = F.sha2("png", 256)
    named = png(df).where("png is not null").select(F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".png")).alias("path"), F.col("png").alias("content"))
    return named.dropDuplicates(["path"])
