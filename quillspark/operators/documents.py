"""Documents: pages of files, access to pages, text layers as trees, what is drawn on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column

from ..schemas import LEVELS
from .elements import first_line_of

_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_COUNT = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b")


def page_count(content: bytes) -> int:
    """Pages of a PDF whose page tree is not compressed: the largest count that a node of the tree names, else the page objects."""
    named = [int(a or b) for a, b in _COUNT.findall(content)]
    return max(named, default=0) or len(_PAGE.findall(content))


def page_fan_out(files: DataFrame, pages: Column, name: Column) -> DataFrame:
    """A row for each page: sample_id `name#i`, page_id from 0. Files without pages give none."""
    known = files.withColumns({"_n": pages, "_name": name}).where("_n > 0")
    rows = known.withColumn("page_id", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    return rows.withColumn("sample_id", F.concat_ws("#", "_name", "page_id")).drop("_n", "_name")


def pdf_pages(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, page_id, sample_id of each page of each PDF."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "n": [page_count(bytes(c)) for c in f["content"]]})

    counted = files.select("path", "content").mapInPandas(run, "path string, n int")
    return page_fan_out(counted, F.col("n"), F.element_at(F.split("path", "/"), -1)).select("path", "page_id", "sample_id")


def render_scale(dpi: Column) -> Column:
    """Pixels for each point of a page."""
    return dpi / 72.0


def num_pages(pages: Column) -> Column:
    return F.size(pages)


def get_page(pages: Column, i: Column) -> Column:
    """The i-th page, from 0; outside the document an error."""
    inside = (i >= 0) & (i < F.size(pages))
    message = F.concat(F.lit("page "), i.cast("string"), F.lit(" of "), F.size(pages).cast("string"))
    return F.when(inside, F.get(pages, i)).otherwise(F.get(pages, F.raise_error(message).cast("int")))


def page_rows(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """A row for each page with its number."""
    return documents.select("sample_id", F.posexplode(pages).alias("page_id", "page"))


def text_tree(pages: DataFrame, lines: DataFrame, words: DataFrame, key: str = "sample_id") -> DataFrame:
    """The tree of a page's own text layer: pages (key, width, height), lines (key, line_id, x0..y1), words (key, word_id, x0..y1, text) in points ->
    key, id, parent_id, level, bbox (fractions of the page), text, conf (100 for words, null else).

    The page is element 0, lines follow in their order, then words in theirs. A word belongs to the first line that holds its centre, else to the page;
    blank words are left out. Joins are by page, so that no page meets another."""
    box = lambda: F.array(*(F.least(F.greatest(F.col(c) / F.col(d), F.lit(0.0)), F.lit(1.0)) for c, d in zip(("x0", "y0", "x1", "y1"), ("width", "height") * 2)))
    line_at = lines.withColumn("_l", F.row_number().over(Window.partitionBy(key).orderBy("line_id")))
    per_page = line_at.groupBy(key).agg(F.count(F.lit(1)).alias("_lines"))
    full = words.where(F.trim("text") != "")
    centre = full.select(key, "word_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    held = first_line_of(centre, line_at.select(key, F.col("_l").alias("line_id"), F.array("x0", "y0", "x1", "y1").alias("bbox")), [key])
    level = lambda name: F.lit(LEVELS[name]).alias("level")
    conf = lambda v: F.lit(v).cast("double").alias("conf")
    root = pages.select(key, F.lit(0).alias("id"), F.lit(-1).alias("parent_id"), level("page"), F.array(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0))).alias("bbox"), F.lit("").alias("text"), conf(None))
    middle = line_at.join(pages, key).select(key, F.col("_l").cast("int").alias("id"), F.lit(0).alias("parent_id"), level("line"), box().alias("bbox"), F.lit("").alias("text"), conf(None))
    place = F.row_number().over(Window.partitionBy(key).orderBy("word_id"))
    leaves = full.join(held, [key, "word_id"]).withColumn("_w", place).join(pages, key).join(per_page, key, "left")
    leaves = leaves.select(
        key, (F.coalesce("_lines", F.lit(0)) + F.col("_w")).cast("int").alias("id"), F.coalesce("line_id", F.lit(0)).cast("int").alias("parent_id"), level("word"), box().alias("bbox"), "text", conf(100.0)
    )
    return root.unionByName(middle).unionByName(leaves)


class Extractor:
    """A text engine over pages: subclasses implement page(row) -> rows. The input is untouched; what the engine gives becomes the content.

    options: language, page segmentation and engine modes, grey (whether pages are made grey first), as an engine's own text or mapping."""

    schema = "sample_id string, id int, parent_id int, level int, text string, conf double"

    def __init__(self, language: str = "eng", segmentation: int = 3, engine: int = 3, grey: bool = True, extra: str = ""):
        if not 0 <= segmentation <= 13 or not 0 <= engine <= 3:
            raise ValueError("segmentation modes are 0 to 13, engines 0 to 3")
        self.language, self.segmentation, self.engine, self.grey, self.extra = language, segmentation, engine, grey, extra

    def config_text(self) -> str:
        return " ".join(x for x in (f"--oem {self.engine}", f"--psm {self.segmentation}", self.extra) if x)

    def page(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        raise NotImplementedError

    def __call__(self, pages: DataFrame) -> DataFrame:
        names = [x.split()[0] for x in self.schema.split(",")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [{**e, "sample_id": r["sample_id"]} for r in frame.to_dict("records") for e in self.page(r)]
                yield pd.DataFrame(rows, columns=names)

        return pages.mapInPandas(run, self.schema)

    def replaced(self, pages: DataFrame) -> DataFrame:
        """pages with `items` made anew; a page without elements has an empty array."""
        found = self(pages).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("id", "parent_id", "level", "text", "conf"))).alias("items"))
        empty = F.array().cast("array<struct<id:int,parent_id:int,level:int,text:string,conf:double>>")
        return pages.drop("items").join(found, "sample_id", "left").withColumn("items", F.coalesce("items", empty))


def visualised(kind: str) -> Callable[..., DataFrame]:
    """What draws samples of a kind; kinds that cannot be drawn are a TypeError."""
    from . import images

    known = {"image": images.draw, "page": images.draw}
    if kind not in known:
        raise TypeError(f"samples of kind {kind!r} are not drawn; known: {', '.join(known)}")
    return known[kind]
