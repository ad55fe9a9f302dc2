"""Bounding-box and image-size algebra as Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _dim(i: Column, width: Column, height: Column) -> Column:
    return F.when(i % 2 == 0, width).otherwise(height)


def normalize(box: Column, width: Column, height: Column, normalized: Column | None = None) -> Column:
    """Divide by (w, h, w, h) and clip to [0, 1]; boxes already normalised stay."""
    out = F.transform(box, lambda v, i: F.least(F.greatest(v / _dim(i, width, height), F.lit(0.0)), F.lit(1.0)))
    return out if normalized is None else F.when(normalized, box).otherwise(out)


def unnormalize(box: Column, width: Column, height: Column, normalized: Column | None = None) -> Column:
    out = F.transform(box, lambda v, i: v * _dim(i, width, height))
    return out if normalized is None else F.when(normalized, out).otherwise(box)


def to_xywh(box: Column) -> Column:
    return F.array(F.get(box, F.lit(0)), F.get(box, F.lit(1)), F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def to_xyxy(box: Column) -> Column:
    return F.array(F.get(box, F.lit(0)), F.get(box, F.lit(1)), F.get(box, F.lit(2)) + F.get(box, F.lit(0)), F.get(box, F.lit(3)) + F.get(box, F.lit(1)))


def switch_mode(box: Column, mode: Column) -> Column:
    return F.when(mode == "xyxy", to_xywh(box)).otherwise(to_xyxy(box))


def checked_box(box: Column) -> Column:
    """The box, or an error where it has not four values."""
    return F.when(F.size(box) == 4, box).otherwise(F.raise_error(F.lit("a box has four values")).cast("array<double>"))


def fitted_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Sides after the longer one is brought down to `longest`; never enlarged, truncated to integers."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    keep = F.greatest(width, height) <= longest
    side = lambda v: F.when(keep, v.cast("long")).when(v == F.greatest(width, height), F.lit(longest).cast("long")).otherwise(F.floor(v * scale))
    return side(width), side(height)


def center_in(px: Column, py: Column, box: Column) -> Column:
    return px.between(F.get(box, F.lit(0)), F.get(box, F.lit(2))) & py.between(F.get(box, F.lit(1)), F.get(box, F.lit(3)))
