"""Layout hierarchy: page, lines and words as rows or as arrays of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.column import Column

from ..functions.geometry import center_in
from ..schemas import LEVELS

BOX = ["x0", "y0", "x1", "y1"]


def flat_words(words: Column, boxes: Column | None = None, segmentations: Column | None = None) -> Column:
    """Words, with a box and polygons each where given -> elements: ids from 0, no parent, word level. Lists of unequal lengths are an error."""
    extra = {k: c for k, c in (("bbox", boxes), ("segmentation", segmentations)) if c is not None}
    if not extra:
        return F.transform(words, lambda w, i: F.struct(i.alias("id"), F.lit(-1).alias("parent_id"), F.lit(LEVELS["word"]).alias("level"), w.alias("text")))
    fit = lambda c: F.when(F.size(c) == F.size(words), c).otherwise(F.raise_error(F.lit("words and what they have differ in number")))
    zipped = F.arrays_zip(words.alias("text"), *(fit(c).alias(k) for k, c in extra.items()))
    return F.transform(zipped, lambda e, i: F.struct(i.alias("id"), F.lit(-1).alias("parent_id"), F.lit(LEVELS["word"]).alias("level"), e["text"].alias("text"), *(e[k].alias(k) for k in extra)))


def _line_entries(lines: Column) -> Column:
    return F.transform(lines, lambda s, l: F.struct(F.lit(LEVELS["line"]).alias("level"), l.alias("line"), F.size(F.array_remove(F.split(s, " "), "")).alias("k"), F.lit("").alias("word")))


def _word_entries(lines: Column) -> Column:
    entry = lambda w, k, l: F.struct(F.lit(LEVELS["word"]).alias("level"), l.alias("line"), k.alias("k"), w.alias("word"))
    return F.flatten(F.transform(lines, lambda s, l: F.transform(F.array_remove(F.split(s, " "), ""), lambda w, k: entry(w, k, l))))


def element_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: bool = True) -> DataFrame:
    """doc_id, id, parent_id, level, x0, y0, x1, y1, text: page 0, then a row per text line, then (with words) the words, made in one pass over the texts.
    Word k of line l has the box (k, l, k+1, l+1). Null texts have none.

    An element's place in one array is its id; what follows from its level, line and place in the line is worked out behind the explode, in compiled code."""
    lines = F.split("t", "\n")
    widest = lambda entries: F.array_max(F.transform(entries, lambda e: e["k"]))
    page = lambda entries: F.array(F.struct(F.lit(LEVELS["page"]).alias("level"), (F.size(entries) - 1).alias("line"), widest(entries).alias("k"), F.lit("").alias("word")))
    inner = F.get(F.transform(F.array(_line_entries(lines)), lambda entries: F.concat(page(entries), entries)), F.lit(0))
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    rows = base.select("doc_id", F.posexplode(F.concat(inner, _word_entries(lines)) if words else inner).alias("id", "e"))
    level, line, k = F.col("e.level"), F.col("e.line"), F.col("e.k")
    is_word, is_page = level == LEVELS["word"], level == LEVELS["page"]
    return rows.select(
        "doc_id",
        "id",
        F.when(is_word, line + 1).when(is_page, -1).otherwise(0).alias("parent_id"),
        level.alias("level"),
        F.when(is_word, k).otherwise(0).cast("double").alias("x0"),
        F.when(is_page, 0).otherwise(line).cast("double").alias("y0"),
        F.when(is_word, k + 1).otherwise(k).cast("double").alias("x1"),
        (line + 1).cast("double").alias("y1"),
        F.col("e.word").alias("text"),
    )


def at(items: Column, level: str) -> Column:
    """Elements of a level; where no element has one, all."""
    return F.when(F.forall(items, lambda e: e["level"].isNull()), items).otherwise(F.filter(items, lambda e: e["level"] == LEVELS[level]))


def parent_boxes(rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Adds px0..py1, the parent's box; roots and dangling parents get their own. A left join by document and id with those rows that may be parents,
    all if not told."""
    parent = (rows if parents is None else parents).select(F.col("doc_id").alias("_d"), F.col("id").alias("_p"), *(F.col(c).alias(f"_{c}") for c in BOX))
    joined = rows.join(parent, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_p")), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_{c}", c).alias(f"p{c}") for c in BOX))


def parent_boxes_hof(items: Column) -> Column:
    """The same within an array of structs (id, parent_id, bbox). Where ids are places in the array a parent is one step away; an id elsewhere is looked
    for, which is linear for each such element."""
    ids = F.transform(items, lambda e: e["id"])
    near = lambda e: F.get(items, e["parent_id"].cast("int"))
    far = lambda e: F.get(items, F.array_position(ids, e["parent_id"]).cast("int") - 1)["bbox"]
    own = lambda e: F.when(e["parent_id"] == -1, e["bbox"]).when(near(e)["id"] == e["parent_id"], near(e)["bbox"]).otherwise(far(e))
    return F.transform(items, lambda e: F.coalesce(own(e), e["bbox"]))


def segment_boxes(rows: DataFrame, level: str = "line", parents: DataFrame | None = None) -> DataFrame:
    """Parent boxes of one level's elements; others are not joined."""
    return parent_boxes(rows.where(F.col("level") == LEVELS[level]), rows if parents is None else parents)


def dangling(rows: DataFrame) -> DataFrame:
    """Elements whose parent does not exist: left anti self join."""
    child = rows.where("parent_id <> -1")
    return child.join(rows.select("doc_id", F.col("id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti")


def word_boxes(items: Column) -> Column:
    """Boxes of words, those of blank words included."""
    return F.transform(at(items, "word"), lambda e: e["bbox"])


def word_texts(items: Column) -> Column:
    """Texts of words, blank ones left out."""
    return F.filter(F.transform(at(items, "word"), lambda e: e["text"]), lambda t: F.trim(t) != "")


def words(items: Column) -> Column:
    """(text, bbox) of words that aren't blank, so that both stay together."""
    return F.transform(F.filter(at(items, "word"), lambda e: F.trim(e["text"]) != ""), lambda e: F.struct(e["text"].alias("text"), e["bbox"].alias("bbox")))


def checked(elements: Column) -> Column:
    """elements (bbox_mode, normalized, items), or an error that says what is wrong: an item without four numbers, a normalised box out of [0, 1], an
    id that occurs twice."""
    items = elements["items"]
    boxes = F.transform(items, lambda e: e["bbox"])
    four = F.forall(boxes, lambda b: b.isNull() | (F.size(b) == 4))
    inside = F.forall(boxes, lambda b: b.isNull() | ((F.array_min(b) >= 0) & (F.array_max(b) <= 1)))
    once = F.size(F.array_distinct(F.transform(items, lambda e: e["id"]))) == F.size(items)
    wrong = lambda text: F.raise_error(F.lit(text))
    fault = F.when(~four, wrong("a box has four values")).when(elements["normalized"] & ~inside, wrong("a normalised box lies in [0, 1]")).when(~once, wrong("ids are unique"))
    return F.when(elements.isNull() | fault.isNull(), elements)


def with_read_defaults(elements: Column) -> Column:
    """What is read without saying so is normalised and in corners; what is built is not normalised (`with_built_defaults`)."""
    return elements.withField("normalized", F.coalesce(elements["normalized"], F.lit(True))).withField("bbox_mode", F.coalesce(elements["bbox_mode"], F.lit("xyxy")))


def with_built_defaults(elements: Column) -> Column:
    return elements.withField("normalized", F.coalesce(elements["normalized"], F.lit(False))).withField("bbox_mode", F.coalesce(elements["bbox_mode"], F.lit("xyxy")))


def joined_text(items: Column, sep: str = " ") -> Column:
    return F.array_join(F.filter(F.transform(items, lambda e: e["text"]), lambda t: t != ""), sep)


def content_text(text: Column, items: Column) -> Column:
    """The explicit text, else the joined words, else null."""
    return F.coalesce(text, F.nullif(joined_text(items), F.lit("")))


def first_line_of(words: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """words (key, word_id, cx, cy), lines (key, line_id, bbox) -> key, word_id, line_id: the first line whose box holds the centre, else null.

    The key bounds the range join to one page, so it is an equi-join with a residual condition.
    """
    inside = words.join(lines, key).where(center_in(F.col("cx"), F.col("cy"), F.col("bbox"))).groupBy(*key, "word_id").agg(F.min("line_id").alias("line_id"))
    return words.join(inside, [*key, "word_id"], "left").select(*key, "word_id", "line_id")
