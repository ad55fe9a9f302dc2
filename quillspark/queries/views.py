"""Views, shards, caches and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import shards as shd
from ..operators.views import POS, View, compose, with_positions
from ..plans import cache as cch
from ..plans.config import Config
from ..session import scratch, table
from ..sources import readers, sinks
from ..sources.datasets import ShardList, buffer_shuffled
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _view(spark: SparkSession, d: str) -> View:
    return View.of(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


_V = "(select doc_id, lang, n_chars, row_number() over (order by doc_id) - 1 as _pos from documents)"


@query(f"select * from {_V} where _pos < 50")
def view_limit(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-2: the limit is the operator."""
    return _view(spark, d).limit(50).frame


@query(f"select doc_id, lang, n_chars, cast((_pos - 10) // 3 as bigint) as _pos from {_V} where _pos >= 10 and _pos < 100 and (_pos - 10) % 3 = 0")
def view_slice(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-5."""
    return _view(spark, d)[10:100:3]


@query(f"""
select doc_id, lang, n_chars, cast((n - 2 - _pos) // 3 as bigint) as _pos
from {_V}, (select count(*) as n from documents)
where _pos <= n - 2 and (n - 2 - _pos) % 3 = 0
""")
def view_reverse_slice(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-5, backwards from the last row but one."""
    return _view(spark, d)[-2::-3]


@query(f"select * from {_V} where _pos = (select count(*) - 2 from documents)")
def view_negative_index(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-5."""
    return _view(spark, d)[-2]


@query(f"select doc_id, lang, n_chars, p as _pos from (select *, row_number() over (order by doc_id) - 1 as p from {_V} where lang = 'en') where p < 20")
def view_filter_then_limit(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-4 then VIEW-2."""
    return _view(spark, d).filter("lang = 'en'").limit(20).frame


@query(f"select doc_id, lang, n_chars, row_number() over (order by doc_id) - 1 as _pos from {_V} where _pos < 20 and lang = 'en'")
def view_limit_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-2 then VIEW-4."""
    return _view(spark, d).limit(20).filter("lang = 'en'").frame


@query("""
select doc_id as id, row_number() over (order by doc_id) - 1 as _pos from documents union all select item_id, (select count(*)
from documents) + row_number() over (order by item_id) - 1 from benchmark
""")
def view_concat(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-6, IMP-8."""
    a = View.of(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")
    b = View.of(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id")
    return View.concat([a, b]).frame


@query(f"select doc_id, n_chars, n_chars * 2 + 1 as y, _pos from {_V}")
def view_map_compose(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-1, VIEW-8, VIEW-9."""
    f = compose(lambda df: df.withColumn("y", F.col("n_chars") * 2), lambda df: df.withColumn("y", F.col("y") + 1))
    return _view(spark, d).with_transform(f).frame.select("doc_id", "n_chars", "y", POS)


@query()
def view_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-3 by hash: scales with the rows."""
    return _view(spark, d).shuffle(7).frame


@query()
def view_shuffle_numpy(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-3, numpy's permutation."""
    return _view(spark, d).shuffle(7, exact=True).frame


@query("""
select doc_id, case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split,
cast(row_number() over (order by doc_id) - 1 as bigint) // 128 + 1 as shard from documents
""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5."""
    return _view(spark, d).frame.select("doc_id", shd.split_of(F.col("doc_id")).alias("split"), (F.floor(F.col(POS) / 128) + 1).alias("shard"))


@query("""
with s as (select l_suppkey as shard, count(*) as n from lineitem group by 1), b as (select shard, sum(n)
over (order by shard) - n as lo, sum(n) over (order by shard) as hi from s), i as (select o_orderkey as idx from orders)
select idx, shard, cast(idx - lo as bigint) as inner from i join b on idx >= lo and idx < hi
""")
def shard_locate(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, IMP-5: global index to shard and place."""
    shards = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count(F.lit(1)).alias("nsamples"))
    return shd.locate(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), shards)


@query("""
select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split,
count(*) as nsamples, cast(sum(n_chars) as bigint) as nbytes from documents group by 1
""")
def split_info(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, AGG-2."""
    return shd.split_info(table(spark, d, "documents").withColumn("split", shd.split_of(F.col("doc_id"))), F.col("n_chars"))


@query("select doc_id, text from documents where doc_id % 10 = 9")
def split_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2."""
    rows = table(spark, d, "documents").withColumn("split", shd.split_of(F.col("doc_id")))
    return readers.split(rows, "test").select("doc_id", "text")


@query("""
with s as (select (row_number() over (order by doc_id) - 1) // 64 as b, n_chars from documents), t as (select b,
count(*) filter (n_chars > 3000) as n, coalesce(cast(sum(n_chars) filter (n_chars > 3000) as bigint), 0) as nbytes from s
group by b) select row_number() over (order by b) as shard, n as nsamples, nbytes from t where n > 0
""")
def finalized_shards(spark: SparkSession, d: str) -> DataFrame:
    """AGG-3."""
    v = _view(spark, d).frame
    shards = v.groupBy((F.floor(F.col(POS) / 64)).alias("shard")).agg(F.count(F.when(F.col("n_chars") > 3000, 1)).alias("nsamples"), F.coalesce(F.sum(F.when(F.col("n_chars") > 3000, F.col("n_chars"))), F.lit(0)).alias("nbytes"))
    return shd.renumbered(shards)


@query(f"select doc_id, lang, n_chars, _pos from {_V} where _pos in (5, 3, 17)")
def take_indices(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7, IMP-6: the index list is the operator's argument."""
    return _view(spark, d).take([5, 3, 17]).select("doc_id", "lang", "n_chars", POS)


@query("select doc_id, lang, n_chars from documents where doc_id = 77")
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5: the id is the operator's argument and reaches the scan."""
    return table(spark, d, "documents").where("doc_id = 77").select("doc_id", "lang", "n_chars")


@query("select o_custkey as key, count(*) as n from orders group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5, IMP-10."""
    return shd.duplicate_keys(table(spark, d, "orders"), F.col("o_custkey"))


@query("select sha256(text) as content_hash, min(doc_id) as first, count(*) as n from documents group by 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10, IMP-11."""
    return shd.content_dedup(table(spark, d, "documents"), F.col("text"), "doc_id")


@query("select page_id, sha256(html) as sha, substr(sha256(html), 1, 2) || '/' || sha256(html) as artifact, strlen(html) > 1500 as hoisted from pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """SNK-9, SNK-10: names of content-addressed artifacts, and what is hoisted."""
    df = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("path"))
    rows, _ = sinks.hoisted(df.withColumn("raw", F.col("content")), "content", "path", "a", 1500)
    sha = F.sha2("raw", 256)
    return rows.select("page_id", sha.alias("sha"), F.concat(F.substring(sha, 1, 2), F.lit("/"), sha).alias("artifact"), F.col("path").isNotNull().alias("hoisted"))


@query("""
with r as (select lang, doc_id // 1000 as run, count(*) as n, md5(coalesce(string_agg(md5(text), '' order by doc_id), '')) as h
from documents group by 1, 2) select lang, cast(sum(n) as bigint) as n_parts, md5(string_agg(h, '' order by run)) as merged from r
group by lang
""")
def merge_parts_whole(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17, IMP-13 over whole texts: digests of the parts in the order of their number, joined by runs of 1000 numbers and these in order."""
    part = F.struct(F.col("doc_id").alias("i"), F.md5(F.col("text").cast("binary")).alias("t"))
    ordered = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "").cast("binary"))
    runs = table(spark, d, "documents").groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("run")).agg(F.count(F.lit(1)).alias("n"), ordered(part).alias("h"))
    return runs.groupBy("lang").agg(F.sum("n").alias("n_parts"), ordered(F.struct("run", F.col("h").alias("t"))).alias("merged"))


@query("select event_id, case when event_id % 1000 <> 7 then user_id end as parsed, event_id % 1000 = 7 as failed from events")
def error_budget_split(spark: SparkSession, d: str) -> DataFrame:
    """GOV-2, SNK-7: a function that fails for some samples; they are told apart and the others go on."""

    def parse(row: dict) -> dict:
        return {"event_id": row["event_id"], "parsed": int(row["raw"])}

    raw = F.when(F.col("event_id") % 1000 == 7, "x").otherwise(F.col("user_id").cast("string"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    tried = sinks.tolerant(rows, parse, "event_id long, parsed long", keep=["event_id"])
    return tried.select("event_id", "parsed", F.col("error").isNotNull().alias("failed"))


@query("select conv_id, turn, role, text from conversations")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK-11, SRC-9."""
    df, path = table(spark, d, "conversations"), f"{scratch(spark)}/jsonl-{uuid.uuid4().hex}"
    sinks.write_jsonl(df, path)
    return readers.read_jsonl(spark, path, df.schema)


@query("""
select doc_id, split, text from (select doc_id, text,
case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split from documents)
""")
def split_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, SNK-2, SNK-13: each split is written apart and appears when whole."""
    root = f"{scratch(spark)}/splits-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("doc_id", "text", shd.split_of(F.col("doc_id")).alias("split"))
    out = None
    for name in ("train", "validation", "test"):
        sinks.write_split(rows.where(F.col("split") == name), root, name, 500)
        part = spark.read.parquet(f"{root}/{name}")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
select cast(doc_id as varchar) as sample_id, md5(text) as text_md5,
case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split from documents
""")
def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """CAC-1, CAC-2: whole texts of all splits are cached, then reopened; the second build reads what the first has published."""

    class Documents(cch.Dataset):
        class Config(Config):
            path: str

        name = "documents"

        def build(self, s: SparkSession, split: str) -> DataFrame:
            return table(s, self.config.path, "documents").where(shd.split_of(F.col("doc_id")) == split).select(F.col("doc_id").cast("string").alias("sample_id"), "text")

    root = f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    digest = lambda df: df.select("sample_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    for _ in range(2):
        made = cch.Builder(spark, root).load(Documents(Documents.Config(path=d))).cache().process(digest).build()
    out = None
    for name in ("train", "validation", "test"):
        part = cch.Cached(spark, made.folder).split(spark, name).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("""with p as (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as pos from documents), r as (select *, pos // 50 as run, sum(n_chars) over (partition by pos // 50 order by pos) as upto from p),
q as (select *, (upto - n_chars) // 20000 as part from r) select doc_id, cast(dense_rank() over (order by run, part) as bigint) as shard from q""")
def shard_by_size(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5: shards of at most 50 rows that close when they pass 20000 characters."""
    return sinks.sized_shards(_view(spark, d).frame, F.col("n_chars"), 50, 20_000).select("doc_id", "shard")


@query("""
select count(*) as n_shards, cast(sum(n) as bigint) as nsamples, cast(sum(b) as bigint) as nbytes from (select doc_id // 64 as s,
count(*) as n, sum(n_chars) as b from documents group by 1)
""")
def write_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5."""
    shards = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("shard")).agg(F.count(F.lit(1)).alias("nsamples"), F.sum("n_chars").alias("nbytes"))
    return shd.write_totals(shards)


@query("""
select doc_id || '_' || (i - 1) as key, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1,
len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
""")
def one_to_many(spark: SparkSession, d: str) -> DataFrame:
    """SNK-6, IMP-9: a transform that gives a list of samples."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("line")))
    return sinks.one_to_many(table(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string")), lines)


@query("select doc_id, row_number() over (order by doc_id) - 1 as _pos from documents")
def shard_list(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: files written in order, read as one sequence."""
    path = f"{scratch(spark)}/shards-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    rows.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return ShardList(spark, path).frame().select("doc_id", "_pos")


@query("select doc_id, md5(text) as text_md5 from documents")
def buffer_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: the shuffle of a stream keeps every row."""
    return buffer_shuffled(table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5")), 42, 100)


@query("select doc_id, row_number() over (order by n_chars, doc_id) - 1 as _pos from documents")
def dense_positions(spark: SparkSession, d: str) -> DataFrame:
    """VIEW-7: a dense order without a single-partition sort."""
    return with_positions(table(spark, d, "documents").select("n_chars", "doc_id"), "n_chars", "doc_id").select("doc_id", POS)
