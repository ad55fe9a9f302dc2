"""Samples, annotations, boxes, layout, conversations, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as geo, samples as smp
from ..operators import conversations as cnv, documents as dcm, elements as elm, extract as ext, flatten as flt, layers as lay
from ..session import table
from ..sources import readers
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    text = smp.text_samples(_docs(spark, d), "doc_id", "text")
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), "quality", "toxic")
    joined = text.join(labels, "sample_id", "left")
    marked = F.struct(F.col("quality").cast("long").alias("label_value"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label_name"))
    scores = F.struct(F.create_map(F.lit("toxicity"), F.col("toxic").cast("double")).alias("scores"), F.create_map().cast("map<string,string>").alias("meta"))
    a = smp.upsert(F.col("annotations"), "classification", F.when(F.col("quality").isNotNull(), marked))
    return joined.withColumn("annotations", smp.upsert(a, "sentiment", F.when(F.col("toxic").isNotNull(), scores)))


@query("select cast(doc_id as varchar) as sample_id, text, cast(length(text) as bigint) as n_chars from documents")
def text_instances(spark: SparkSession, d: str) -> DataFrame:
    """SMP-10."""
    return smp.text_samples(_docs(spark, d), "doc_id", "text").select("sample_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("select page_id, regexp_replace(url, '[./#]', '_', 'g') as key from pages")
def sample_key(spark: SparkSession, d: str) -> DataFrame:
    """SMP-1."""
    return table(spark, d, "pages").select("page_id", smp.sample_key(F.col("url")).alias("key"))


@query("""
select cast(doc_id as varchar) as sample_id, cast(toxic as bigint) as label_value,
case when toxic = 1 then 'toxic' else 'clean' end as label_name, cast(toxic as double) as toxicity from labels
""")
def upsert_annotation(spark: SparkSession, d: str) -> DataFrame:
    """SMP-2: the second classification replaces the first, other annotations stay."""
    a = _annotated(spark, d).where("quality is not null")
    new = F.struct(F.col("toxic").cast("long").alias("label_value"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label_name"))
    a = a.withColumn("annotations", smp.upsert(F.col("annotations"), "classification", new))
    return a.select("sample_id", "annotations.classification.label_value", "annotations.classification.label_name", F.col("annotations.sentiment.scores")["toxicity"].alias("toxicity"))


@query("""
select cast(d.doc_id as varchar) as sample_id, l.doc_id is not null as has_classification, false as has_ocr from documents d left
join labels l using (doc_id)
""")
def has_annotation(spark: SparkSession, d: str) -> DataFrame:
    """SMP-3."""
    a = F.col("annotations")
    return _annotated(spark, d).select("sample_id", smp.has(a, "classification").alias("has_classification"), smp.has(a, "ocr").alias("has_ocr"))


@query("select cast(doc_id as varchar) as sample_id, cast(quality as bigint) as label_value from labels")
def get_annotation(spark: SparkSession, d: str) -> DataFrame:
    """SMP-3."""
    return _annotated(spark, d).where("quality is not null").select("sample_id", smp.get(F.col("annotations"), "classification")["label_value"].alias("label_value"))


@query("""select cast(d.doc_id as varchar) as sample_id, case when l.doc_id is null then null else '{"label_value":' || quality || ',"label_name":"' || (case when quality = 1 then 'good' else 'poor' end) || '"}' end as json
from documents d left join labels l using (doc_id)""")
def annotation_json(spark: SparkSession, d: str) -> DataFrame:
    """SMP-4, SMP-6: absent annotations are null."""
    return _annotated(spark, d).select("sample_id", F.to_json("annotations.classification").alias("json"))


@query("select doc_id, case quality when 1 then 'good' else 'poor' end as label_name from labels")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """IMP-7: a dimension of two rows is broadcast."""
    names = spark.createDataFrame([(0, "poor"), (1, "good")], "quality int, label_name string")
    return table(spark, d, "labels").join(F.broadcast(names), "quality").select("doc_id", "label_name")


@query("""
select doc_id, cast(quality as bigint) as label_value, case quality when 0 then 'poor' else 'good' end as label_name,
cast(toxic as bigint) as word_label, case toxic when 0 then 'clean' else 'toxic' end as word_name from labels
""")
def label_name_infer(spark: SparkSession, d: str) -> DataFrame:
    """SMP-9: label sets from a description of features, as a hub gives it."""
    found = smp.infer_labels({
        "text": {"_type": "Value", "dtype": "string"},
        "quality": {"_type": "ClassLabel", "names": ["poor", "good"]},
        "tags": {"_type": "Sequence", "feature": {"_type": "ClassLabel", "names": ["clean", "toxic"]}},
    })
    q, t = smp.labelled(F.col("quality"), found["classification"]), smp.labelled(F.col("toxic"), found["entity_labeling"])
    rows = table(spark, d, "labels").select("doc_id", q.alias("q"), t.alias("t"))
    return rows.select("doc_id", "q.label_value", "q.label_name", F.col("t.label_value").alias("word_label"), F.col("t.label_name").alias("word_name"))


@query("select doc_id, 'quality' as name, cast(quality as double) as score from labels union all select doc_id, 'toxicity', cast(toxic as double) from labels")
def sentiment_scores_map(spark: SparkSession, d: str) -> DataFrame:
    scores = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxicity"), F.col("toxic").cast("double"))
    return table(spark, d, "labels").select("doc_id", F.explode(scores).alias("name", "score"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("box"))


def _four(df: DataFrame, box) -> DataFrame:
    return df.select("vec_id", *(F.get(box, F.lit(i)).alias(f"b{i}") for i in range(4)))


_E = "(select vec_id, list_transform(embedding[1:4], lambda v: cast(v as double)) as b from embeddings)"


@query(f"""
select vec_id, least(greatest(b[1] / 2e0, 0e0), 1e0) as b0, least(greatest(b[2] / 5e-1, 0e0), 1e0) as b1,
least(greatest(b[3] / 2e0, 0e0), 1e0) as b2, least(greatest(b[4] / 5e-1, 0e0), 1e0) as b3 from {_E}
""")
def bbox_normalize(spark: SparkSession, d: str) -> DataFrame:
    """GEO-1."""
    return _four(_boxes(spark, d), geo.normalize(F.col("box"), F.lit(2.0), F.lit(0.5)))


@query(f"select vec_id, b[1] * 2e0 as b0, b[2] * 5e-1 as b1, b[3] * 2e0 as b2, b[4] * 5e-1 as b3 from {_E}")
def bbox_unnormalize(spark: SparkSession, d: str) -> DataFrame:
    """GEO-2."""
    return _four(_boxes(spark, d), geo.unnormalize(F.col("box"), F.lit(2.0), F.lit(0.5)))


@query(f"select vec_id, b[1] as b0, b[2] as b1, b[3] - b[1] as b2, b[4] - b[2] as b3 from {_E}")
def bbox_switch_mode(spark: SparkSession, d: str) -> DataFrame:
    """GEO-3."""
    return _four(_boxes(spark, d), geo.switch_mode(F.col("box"), F.lit("xyxy")))


@query(f"select vec_id, b[1] as b0, b[2] as b1, b[3] - b[1] + b[1] as b2, b[4] - b[2] + b[2] as b3 from {_E}")
def bbox_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """GEO-3 twice."""
    df = _boxes(spark, d).withColumn("box", geo.switch_mode(F.col("box"), F.lit("xyxy")))
    return _four(df, geo.switch_mode(F.col("box"), F.lit("xywh")))


@query("""with s as (select p_partkey, cast(p_size * 37 as double) as w, cast(p_partkey % 997 + 1 as double) as h from part)
select p_partkey, case when greatest(w, h) <= 512 then cast(w as bigint) when w = greatest(w, h) then 512 else cast(floor(w * (512e0 / greatest(w, h))) as bigint) end as width,
case when greatest(w, h) <= 512 then cast(h as bigint) when h = greatest(w, h) then 512 else cast(floor(h * (512e0 / greatest(w, h))) as bigint) end as height from s""")
def resize_dims(spark: SparkSession, d: str) -> DataFrame:
    """GEO-6."""
    w, h = geo.fitted_size((F.col("p_size") * 37).cast("double"), (F.col("p_partkey") % 997 + 1).cast("double"), 512)
    return table(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("""
select doc_id, cast(len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')) as bigint) as n_words,
cast(len(string_split(text, chr(10))) as bigint) as n_lines from documents
""")
def words_from_text(spark: SparkSession, d: str) -> DataFrame:
    """ELM-1."""
    words = F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "")
    return _docs(spark, d).select("doc_id", F.size(elm.flat_words(words)).cast("long").alias("n_words"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


#: Element rows in DuckDB: page 0, lines from 1, words after them.
_ROWS = """with t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(1, len(ls) + 1)) as l, ls from t),
l2 as (select doc_id, l, len(ls) as n, list_filter(string_split(ls[l], ' '), lambda w: w <> '') as ws from l),
w as (select doc_id, l, n, unnest(range(1, len(ws) + 1)) as k, ws from l2),
e as (select doc_id, 0 as id, -1 as parent_id, 1 as level, 0e0 as x0, 0e0 as y0, cast(max(len(ws)) as double) as x1, cast(max(n) as double) as y1, '' as text from l2 group by doc_id
union all select doc_id, l, 0, 4, 0e0, cast(l - 1 as double), cast(len(ws) as double), cast(l as double), '' from l2
union all select doc_id, n + row_number() over (partition by doc_id order by l, k), l, 5, cast(k - 1 as double), cast(l - 1 as double), cast(k as double), cast(l as double), ws[k] from w)
"""


@query(_ROWS + "select doc_id, cast(level as bigint) as level, count(*) as n, cast(sum(id) as bigint) as ids, sum(x1) as x1, sum(y1) as y1 from e group by doc_id, level")
def elements_at_level(spark: SparkSession, d: str) -> DataFrame:
    """ELM-2."""
    rows = elm.element_rows(_docs(spark, d))
    return rows.groupBy("doc_id", F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("x1").alias("x1"), F.sum("y1").alias("y1"))


@query("select doc_id, md5(array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''), ' ')) as joined_md5 from documents")
def joined_text(spark: SparkSession, d: str) -> DataFrame:
    """ELM-6."""
    items = elm.flat_words(F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), ""))
    return _docs(spark, d).select("doc_id", F.md5(elm.joined_text(items).cast("binary")).alias("joined_md5"))


@query("""
select doc_id, cast(len(w) as bigint) as n, w[1] as first_word, w[-1] as last_word from (select doc_id,
list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') as w from documents)
""")
def word_texts(spark: SparkSession, d: str) -> DataFrame:
    """ELM-5."""
    w = F.transform(elm.at(elm.flat_words(F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "")), "word"), lambda e: e["text"])
    df = _docs(spark, d).select("doc_id", F.explode(F.array(w)).alias("w"))
    return df.select("doc_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"))


_PARENTS = _ROWS + """, p as (select c.doc_id, c.id, c.level, coalesce(p.x0, c.x0) as px0, coalesce(p.y0, c.y0) as py0, coalesce(p.x1, c.x1) as px1, coalesce(p.y1, c.y1) as py1 from e c left join e p on p.doc_id = c.doc_id and p.id = c.parent_id)
select doc_id, cast(level as bigint) as level, count(*) as n, sum(px0) as px0, sum(py0) as py0, sum(px1) as px1, sum(py1) as py1 from p """


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p{c}").alias(f"p{c}") for c in elm.BOX))


@query(_PARENTS + "group by doc_id, level")
def parent_bbox_join(spark: SparkSession, d: str) -> DataFrame:
    """ELM-3, IMP-1."""
    return _summed(elm.parent_boxes(elm.element_rows(_docs(spark, d)), elm.element_rows(_docs(spark, d), words=False)))


@query(_PARENTS + "where level = 4 group by doc_id, level")
def segment_bboxes(spark: SparkSession, d: str) -> DataFrame:
    """ELM-4."""
    inner = elm.element_rows(_docs(spark, d), words=False)
    return _summed(elm.segment_boxes(inner, "line", inner))


@query("select conv_id, cast(count(*) as bigint) as n, sum(cast(case when turn = 0 then turn else 0 end as double)) as x0 from conversations group by conv_id")
def parent_bbox_hof(spark: SparkSession, d: str) -> DataFrame:
    """ELM-3 within arrays: each conversation is a tree whose turns hang from turn 0."""
    e = F.struct("turn", F.col("turn").alias("id"), F.when(F.col("turn") == 0, -1).otherwise(0).cast("long").alias("parent_id"), F.array(F.col("turn").cast("double")).alias("bbox"))
    trees = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(e)).alias("items"))
    boxes = trees.select("conv_id", F.explode(F.array(elm.parent_boxes_hof(F.col("items")))).alias("b"))
    return boxes.select("conv_id", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(0))).alias("x0"))


@query(_ROWS + ", c as (select doc_id, id, case when id % 7 = 3 then id + 100000000 else parent_id end as parent_id from e) select doc_id, count(*) as n_bad from c where parent_id <> -1 and not exists (select 1 from e where e.doc_id = c.doc_id and e.id = c.parent_id) group by doc_id")
def validate_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """ELM-7, IMP-2: parents of some elements are broken first."""
    rows = elm.element_rows(_docs(spark, d))
    broken = rows.withColumn("parent_id", F.when(F.col("id") % 7 == 3, F.col("id") + 100_000_000).otherwise(F.col("parent_id")))
    return elm.dangling(broken).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_bad"))


@query("""
select doc_id, md5(case when doc_id % 3 = 0 then text else nullif(array_to_string(list_filter(string_split(replace(text, chr(10),
' '), ' '), lambda w: w <> ''), ' '), '') end) as content_md5 from documents
""")
def content_text_whole(spark: SparkSession, d: str) -> DataFrame:
    """ELM-10 over whole texts, as a digest."""
    own = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    items = elm.flat_words(F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), ""))
    return _docs(spark, d).select("doc_id", F.md5(elm.content_text(own, items).cast("binary")).alias("content_md5"))


_CENTRES = "(select user_id, event_id, value as cx, cast(event_id % 97 as double) as cy from events)"


@query(f"""
with l as (select generate_series as line_id, [cast(generate_series * 10 as double), cast(generate_series as double),
cast(generate_series * 10 + 60 as double), cast(generate_series + 50 as double)] as b from generate_series(0, 19))
select c.user_id, c.event_id as word_id, min(l.line_id) as line_id from {_CENTRES} c left
join l on cx between b[1] and b[3] and cy between b[2] and b[4] group by 1, 2
""")
def word_line_assign(spark: SparkSession, d: str) -> DataFrame:
    """EXT-3, IMP-3: point in box, first line wins."""
    ev = table(spark, d, "events").select("user_id", F.col("event_id").alias("word_id"), F.col("value").alias("cx"), (F.col("event_id") % 97).cast("double").alias("cy"))
    box = lambda i: F.array((i * 10).cast("double"), i.cast("double"), (i * 10 + 60).cast("double"), (i + 50).cast("double"))
    lines = spark.range(20).select(F.col("id").alias("line_id"), box(F.col("id")).alias("bbox"))
    pages = ev.select("user_id").distinct().crossJoin(F.broadcast(lines))
    return elm.first_line_of(ev, pages, ["user_id"])


@query("with r as (select doc_id // 50 as page, doc_id as id, 1 + doc_id % 5 as level from documents), c as (select *, " + ", ".join(f"last_value(case when level = {n} then id end ignore nulls) over (partition by page order by id rows between unbounded preceding and 1 preceding) as l{n}" for n in (1, 2, 3, 4)) + " from r) select page, id, cast(level as bigint) as level, coalesce(case level when 2 then l1 when 3 then l2 when 4 then l3 when 5 then l4 end, -1) as parent_id from c")
def ocr_parent_carry(spark: SparkSession, d: str) -> DataFrame:
    """EXT-4, IMP-4."""
    rows = _docs(spark, d).select(F.floor(F.col("doc_id") / 50).alias("page"), F.col("doc_id").alias("id"), (F.col("doc_id") % 5 + 1).alias("level"))
    return ext.carried_parents(rows, ["page"], "id")


@query("""select page_id, cast(len(a) as bigint) as n_links, a[1] as first_link from (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as a from pages)""")
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16."""
    df = table(spark, d, "pages").select("page_id", F.explode(F.array(ext.anchors(F.col("html")))).alias("a"))
    return df.select("page_id", F.size("a").cast("long").alias("n_links"), F.get("a", F.lit(0)).alias("first_link"))


@query("""
select cast(conv_id as varchar) as sample_id, count(*) as n_turns, string_agg(role, ',' order by turn) as roles,
md5(string_agg(text, chr(10) order by turn)) as text_md5 from conversations group by conv_id
""")
def conversation_build(spark: SparkSession, d: str) -> DataFrame:
    """CNV-6."""
    c = cnv.build(table(spark, d, "conversations"))
    part = lambda f: F.transform("turns", lambda t: t[f])
    return c.select("sample_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(part("role"), ",").alias("roles"), F.md5(F.array_join(part("text"), "\n").cast("binary")).alias("text_md5"))


@query("""
select cast(conv_id as varchar) as sample_id, count(*) filter (role = 'user') as n_turns, md5(coalesce(string_agg(text, chr(10)
order by turn) filter (role = 'user'), '')) as text_md5 from conversations group by conv_id
""")
def conversation_seed(spark: SparkSession, d: str) -> DataFrame:
    """CNV-1."""
    c = cnv.build(table(spark, d, "conversations")).withColumn("turns", cnv.seed(F.col("turns")))
    return c.select("sample_id", F.size("turns").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("turns", lambda t: t["text"]), "\n").cast("binary")).alias("text_md5"))


@query("select cast(conv_id as varchar) as sample_id, bool_and(role = 'user') as is_seed, true as seed_is_seed from conversations group by conv_id")
def seed_valid(spark: SparkSession, d: str) -> DataFrame:
    """CNV-2."""
    c = cnv.build(table(spark, d, "conversations"))
    return c.select("sample_id", cnv.is_seed(F.col("turns")).alias("is_seed"), cnv.is_seed(cnv.seed(F.col("turns"))).alias("seed_is_seed"))


@query("""
select conv_id, turn, case when turn % 2 = 0 then 'turn' else 'tool_result' end as type, role,
case when turn % 2 = 0 then text end as text, case when turn % 2 = 1 then text end as content from conversations
""")
def turn_codec(spark: SparkSession, d: str) -> DataFrame:
    """CNV-3: a missing tag means a turn."""
    even = F.col("turn") % 2 == 0
    js = F.when(even, F.to_json(F.struct("role", "text"))).otherwise(F.to_json(F.struct(F.lit("tool_result").alias("type"), "role", F.col("text").alias("content"))))
    df = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(cnv.decoded(js))).alias("t"))
    return df.select("conv_id", "turn", "t.type", "t.role", "t.text", "t.content")


@query("""select event_id, '{"name":"' || event_type || '","arguments":{"k":' || cast(json_extract(props, '$.k') as varchar) || ',"q":"two  words of ' || event_type || '"}}' as text from events""")
def tool_call_text(spark: SparkSession, d: str) -> DataFrame:
    """CNV-4: blanks between values go, blanks within them stay."""
    said = F.concat(F.lit('{ "k" : '), F.expr("try_variant_get(parse_json(props), '$.k', 'string')"), F.lit(' ,\n "q": "two  words of '), F.col("event_type"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", cnv.tool_call_text(F.col("event_type"), said).alias("text"))


@query("select conv_id, turn, case when turn % 3 = 1 then text when turn % 3 = 2 then '{\"name\":\"f\",\"arguments\":{\"a\":' || turn || '}}' else text end as said from conversations")
def turn_texts(spark: SparkSession, d: str) -> DataFrame:
    """CNV-4: what turns, calls and results say."""
    kind = F.when(F.col("turn") % 3 == 1, "tool_result").when(F.col("turn") % 3 == 2, "tool_call").otherwise("turn")
    args = F.concat(F.lit('{"a": '), F.col("turn").cast("string"), F.lit("}"))
    turn = F.struct(kind.alias("type"), "text", F.lit("f").alias("name"), args.alias("arguments"), F.col("text").alias("content"))
    return table(spark, d, "conversations").select("conv_id", "turn", cnv.turn_text(turn).alias("said"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SMP-4: metadata as VARIANT."""
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", F.struct(F.col("role").alias("role"), F.struct(F.col("text").alias("text"), F.length("text").alias("size")).alias("body")).alias("turn"), F.array(F.col("turn"), F.col("turn") + 1).alias("span"))


@query("""select conv_id, role as "turn.role", text as "turn.body.text", cast(length(text) as bigint) as "turn.body.size", '[' || turn || ',' || (turn + 1) || ']' as span from conversations""")
def flatten_columns(spark: SparkSession, d: str) -> DataFrame:
    """SCH-1."""
    return flt.flattened(_nested(spark, d)).withColumn("turn.body.size", F.col("`turn.body.size`").cast("long"))


@query("select conv_id, role, text, turn as lo, turn + 1 as hi from conversations")
def unflatten_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SCH-2."""
    df = _nested(spark, d)
    back = flt.unflattened(flt.flattened(df), StructType(df.schema.fields))
    return back.select("conv_id", "turn.role", "turn.body.text", F.get("span", F.lit(0)).alias("lo"), F.get("span", F.lit(1)).alias("hi"))


@query("select doc_id, quality, null as toxic from labels union all select doc_id, null, toxic from labels")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """SCH-4."""
    t = table(spark, d, "labels")
    return t.select("doc_id", "quality").unionByName(t.select("doc_id", "toxic"), allowMissingColumns=True)


@query("""select page_id, sha256(url) as url_hash, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as file_name, regexp_extract(url, '^([a-z]+)://', 1) as scheme from pages""")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18."""
    p = readers.url_paths(F.col("url"))
    return table(spark, d, "pages").select("page_id", *(p[k].alias(k) for k in ("url_hash", "file_name", "scheme")))


@query(r"""with n as (select p_partkey, 'https://h/' || replace(p_name, ' ', '_') || (case p_partkey % 4 when 0 then '.tar.gz' when 1 then '.zip.part' || p_partkey when 2 then '.csv' else '.zip' end) as u from part)
select p_partkey, p_partkey % 4 = 1 as is_part, p_partkey % 4 in (0, 3) as is_archive, regexp_extract(u, '\.([A-Za-z0-9]+)$', 1) as ext from n""")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18: parts and archives by name."""
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, ".tar.gz").when(k == 1, F.concat(F.lit(".zip.part"), F.col("p_partkey").cast("string"))).when(k == 2, ".csv").otherwise(".zip")
    p = readers.url_paths(F.concat(F.lit("https://h/"), F.replace("p_name", F.lit(" "), F.lit("_")), tail))
    return table(spark, d, "part").select("p_partkey", *(p[c].alias(c) for c in ("is_part", "is_archive", "ext")))


@query("""with r as (select doc_id, hex(encode(text)) as h, doc_id % 7 as o from documents where text is not null), s as (select *, length(h) // 2 as size from r),
m as (select doc_id, h, least(o, size) as o, greatest(size - least(o, size) - doc_id % 5, 0) as n from s) select doc_id, md5(substr(h, cast(2 * o + 1 as bigint), cast(2 * n as bigint))) as member_md5, n as n_bytes from m""")
def tar_byte_range(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: a range of each text's bytes, offset and length read from a URI; ranges vary by row."""
    size = F.octet_length("text").cast("long")
    lo = F.least(F.col("doc_id") % 7, size)
    n = F.greatest(size - lo - F.col("doc_id") % 5, F.lit(0))
    uri = F.concat(F.lit("archive?offset="), lo.cast("string"), F.lit("&length="), n.cast("string"))
    offset, length = readers.range_of(F.col("uri"))
    df = _docs(spark, d).where("text is not null").withColumn("uri", uri)
    member = readers.byte_range(F.encode("text", "UTF-8"), offset, length)
    return df.select("doc_id", F.md5(F.hex(member).cast("binary")).alias("member_md5"), length.alias("n_bytes"))


@query("""with n as (select distinct p_name from part), m as (select p_name, levenshtein(p_name, 'almond antique') as dist from n) select p_name, cast(dist as bigint) as dist from m where dist = (select min(dist) from m)""")
def close_match_hint(spark: SparkSession, d: str) -> DataFrame:
    """REG-1: nearest names by edit distance."""
    m = table(spark, d, "part").select("p_name").distinct().withColumn("dist", F.levenshtein("p_name", F.lit("almond antique")).cast("long"))
    best = m.agg(F.min("dist").alias("best"))
    return m.join(F.broadcast(best), F.col("dist") == F.col("best")).select("p_name", "dist")


@query("""
select doc_id, case when doc_id % 3 = 0 then 'lines' else 'words' end as layer,
cast(case when doc_id % 3 = 0 then len(string_split(text, chr(10))) else len(string_split(text, ' ')) end as bigint) as n
from documents
""")
def box_layer_choice(spark: SparkSession, d: str) -> DataFrame:
    """VIS-1, IMP-14."""
    words = F.when(F.col("doc_id") % 3 != 0, F.split("text", " "))
    df = _docs(spark, d).select("doc_id", F.explode(F.array(lay.chosen_boxes(words, F.split("text", "\n")))).alias("boxes"))
    return df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "lines").otherwise("words").alias("layer"), F.size("boxes").cast("long").alias("n"))


@query("select p_brand, cast((dense_rank() over (order by p_brand) - 1) % 7 as bigint) as colour from (select distinct p_brand from part)")
def label_palette(spark: SparkSession, d: str) -> DataFrame:
    """VIS, AGG-4."""
    return lay.palette(table(spark, d, "part"), "p_brand", 7)


@query("select cast(d.doc_id as varchar) || coalesce('_label=' || quality, '') as name from documents d left join labels l using (doc_id)")
def output_name(spark: SparkSession, d: str) -> DataFrame:
    """VIS-3."""
    df = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return df.select(lay.output_name(F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("name"))


@query("""select page_id, len(string_split(url, '/')) as n, cast(sum(i * 10 + 5 + page_id) as double) as right_edges, string_agg(p, ' ' order by i) as said
from (select page_id, url, unnest(string_split(url, '/')) as p, unnest(range(len(string_split(url, '/')))) as i from pages) group by page_id, url""")
def hocr_words(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: words, boxes and confidence of a page of recognised text, which is made of a URL's parts."""
    span = lambda p, i: F.concat(
        F.lit("<span class='ocrx_word' id='w"), i.cast("string"), F.lit("' title='bbox "), F.concat_ws(" ", (i * 10).cast("string"), F.lit("0"), (i * 10 + 5 + F.col("page_id")).cast("string"), F.lit("9")),
        F.lit("; x_wconf 9"), (i % 10).cast("string"), F.lit("'>"), p, F.lit("</span>"),
    )
    html = F.concat(F.lit("<html><div class='ocr_page'>"), F.array_join(F.transform(F.split("url", "/"), span), "\n"), F.lit("</div></html>"))
    df = table(spark, d, "pages").select("page_id", F.explode(F.array(ext.hocr_words(html))).alias("w"))
    edges = F.aggregate("w", F.lit(0.0), lambda a, w: a + w["x1"])
    return df.select("page_id", F.size("w").cast("long").alias("n"), edges.alias("right_edges"), F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("said"))


@query("select page_id as doc, cast(unnest(range(page_id % 4)) as bigint) as page, 'd' || page_id || '#' || unnest(range(page_id % 4)) as sample_id from pages")
def page_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: a row for each page of a document."""
    rows = dcm.page_fan_out(table(spark, d, "pages").select(F.col("page_id").alias("doc")), F.col("doc") % 4, F.concat(F.lit("d"), F.col("doc").cast("string")))
    return rows.select("doc", F.col("page_id").cast("long").alias("page"), "sample_id")


@query("""select cast(d.doc_id as varchar) as sample_id, cast(l.quality as bigint) as label_value, l.doc_id is null as none_at_all from documents d left join labels l using (doc_id)""")
def annotation_from_json(spark: SparkSession, d: str) -> DataFrame:
    """SMP-4, SMP-10: annotations written as JSON and read again; none at all is null."""
    a = _annotated(spark, d).select("sample_id", smp.to_json(F.col("annotations")).alias("json"))
    back = a.select("sample_id", "json", F.explode(F.array(smp.from_json(F.col("json")))).alias("annotations"))
    return back.select("sample_id", F.col("annotations.classification.label_value").alias("label_value"), F.col("json").isNull().alias("none_at_all"))
