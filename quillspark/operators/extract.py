"""Text layers: markup elements, carry-forward parents of recognised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column


def anchors(html: Column) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def hocr_words(html: Column) -> Column:
    """(x0, y0, x1, y1, conf, text) of each ocrx_word span of an hOCR page."""
    pattern = r"<span class='ocrx_word'[^>]*title='bbox (\d+) (\d+) (\d+) (\d+); x_wconf (\d+)[^']*'[^>]*>([^<]*)</span>"
    part = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(*(part(i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "conf", "text"), 1)))
    return F.transform(zipped, lambda z: F.struct(*(z[n].cast("double").alias(n) for n in ("x0", "y0", "x1", "y1", "conf")), z["text"].alias("text")))


def carried_parents(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows (key, order, level 1..5, id) -> parent_id: the last row seen one level up, -1 for none. A window per page."""
    seen = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.last(F.when(F.col("level") == n, F.col("id")), ignorenulls=True).over(seen)
    parent = F.when(F.col("level") == 2, last(1)).when(F.col("level") == 3, last(2)).when(F.col("level") == 4, last(3)).when(F.col("level") == 5, last(4))
    return rows.withColumn("parent_id", F.coalesce(parent, F.lit(-1)))


def adapter(df: DataFrame, extract, schema: str) -> DataFrame:
    """Runs an engine (PDF text, OCR) over pages: extract(iterator of pandas frames) -> iterator of frames of `schema`."""
    return df.mapInPandas(extract, schema)
