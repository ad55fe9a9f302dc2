"""Benchmark decontamination by a distributed positional inverted index (operator 2). DataFrame operations only.

The index holds one row per training token whose word the benchmark uses: document key, position, term. It is written once to the shared folder.
A phrase (a window of benchmark words) starts from the posting lists of its rarest terms: each posting, moved back by the term's place in the
phrase, is a candidate start, and the lists of the RAREST rarest terms are intersected on it. What remains is compared word by word.
Proximity asks less: the same rarest terms within NEAR words of each other, in any order, which shows passages that were changed or cut. A window over
the lists' positions finds these places, one row after the other, so a term that is frequent in a long document makes no pairs.
Windows and terms are broadcast only while their counts stay under fixed bounds; beyond them the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column

from .common import ascii_lower, free_name, staged

WINDOW, RAREST, NEAR, BROADCAST_ROWS = 10, 3, 20, 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["dk", "th"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, which a benchmark and not the corpus bounds, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a key: rows that agree in id and text share it, which gives them equal results."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"))


def phrase_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wid, win), (wid, item_id) and (tid, term): the distinct windows, the items that have them, the terms in them."""
    items = benchmark.select(F.col("item_id"), F.explode(F.array(words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1)))
    cut = staged(items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win")), "cut")
    wins = staged(cut.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    owners = staged(cut.join(wins, "win").select("wid", "item_id").distinct(), "owners")
    terms = staged(wins.select(F.explode("win").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return wins, owners, terms


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: doc_id, dk, th, n_words, pos (from 1), tid; and for each document a row of pos 0 and tid -1."""
    none = docs.sparkSession.createDataFrame([("", -1)], "term string, tid long")
    listed = _small(staged(terms.select("term", "tid").unionByName(none), "listed"))
    rows = docs.select("doc_id", "dk", "th", F.explode(F.array(F.concat(F.array(F.lit("")), words_of(F.col("text"))))).alias("ws"))
    rows = rows.select("doc_id", "dk", "th", (F.size("ws") - 1).cast("long").alias("n_words"), F.posexplode("ws").alias("pos", "term"))
    return staged(rows.join(listed, "term").select("doc_id", "dk", "th", "n_words", "pos", "tid"), "postings")


def rarest_terms(index: DataFrame, wins: DataFrame, terms: DataFrame, rarest: int = RAREST) -> DataFrame:
    """wid, len, off, tid, rank, bit, full: the `rarest` places of each window whose terms are rarest, equals in order of the terms. bit stands for the
    term, full for all terms of these places. Windows with a term that the corpus lacks are left out."""
    df = staged(index.where("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    slots = wins.select("wid", F.size("win").alias("len"), F.posexplode("win").alias("off", "term")).join(terms, "term").join(df, "tid", "left")
    own, count = Window.partitionBy("wid"), F.coalesce(F.col("df"), F.lit(0))
    slots = slots.withColumns({"rank": F.row_number().over(own.orderBy(count, "term", "off")), "least": F.min(count).over(own)})
    slots = slots.where((F.col("rank") <= rarest) & (F.col("least") > 0)).withColumn("bit", F.expr("shiftleft(1, min(rank) over (partition by wid, tid) - 1)"))
    return staged(slots.select("wid", "len", "off", "tid", "rank", "bit", F.expr("bit_or(bit) over (partition by wid)").alias("full")), "chosen")


def phrase_matches(index: DataFrame, docs: DataFrame, wins: DataFrame, terms: DataFrame, rarest: int = RAREST, near: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(exact occurrences: dk, th, wid, start, stop, positions from 1, stop exclusive; with near: dk, th, wid of the windows whose rarest terms lie within
    `near` words somewhere in the document)."""
    chosen = rarest_terms(index, wins, terms, rarest)
    all_seen = f"seen = shiftleft(1, least(len, {int(rarest)})) - 1"
    inside = "start >= 1 and start + len - 1 <= n_words"
    close = None
    if near is None:
        moved = index.join(_small(chosen), "tid").withColumn("start", F.col("pos") - F.col("off")).where(inside)
        both = moved.groupBy(*KEY, "wid", "start", "len").agg(F.expr("bit_or(shiftleft(1, rank - 1)) as seen")).where(all_seen)
    else:
        # a row's small numbers travel as one: whether the start fits, the place in the window, its rank, bit, full and the window's length
        parts = {"fits": 1, "off": 8, "rank": 4, "bit": 8, "full": 8, "len": 8}
        fits = F.expr("cast(pos - off >= 1 and pos - off + len - 1 <= n_words as int)")
        packed, at = F.lit(0).cast("long"), 0
        opened = {}
        for name, width in parts.items():
            packed = packed + F.shiftleft((fits if name == "fits" else F.col(name)).cast("long"), at)
            opened[name] = F.shiftrightunsigned("packed", at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
            at += width
        rows = index.join(_small(chosen), "tid").select(*KEY, "wid", F.col("pos").cast("long").alias("pos"), packed.alias("packed"))
        rows = rows.repartition(*KEY, "wid").withColumns(opened)
        span = Window.partitionBy(*KEY, "wid").orderBy("pos").rangeBetween(1 - near, 0)
        rows = rows.withColumn("met", F.bit_or("bit").over(span) == F.col("full"))
        rows = rows.withColumn("start", F.when(F.col("fits") == 1, F.col("pos") - F.col("off")))
        found = rows.groupBy(*KEY, "wid", "start", "len").agg(F.expr("bit_or(shiftleft(1, rank - 1)) as seen"), F.max("met").alias("met"))
        found = staged(found.where(f"met or (start is not null and {all_seen})"), "found")
        both = found.where(f"start is not null and {all_seen}")
        close = found.where("met").select(*KEY, "wid").distinct()
    per_doc = both.groupBy(*KEY).agg(F.collect_list(F.struct("start", "len", "wid")).alias("at"))
    texts = docs.join(per_doc, KEY).select(*KEY, "at", F.explode(F.array(words_of(F.col("text")))).alias("ws"))
    said_at = lambda a: F.array_join(F.slice("ws", a.start.cast("int"), a.len), " ")
    phrase = F.transform("at", lambda a: F.struct(a.start.alias("start"), a.len.alias("len"), a.wid.alias("wid"), said_at(a).alias("phrase")))
    said = texts.select(*KEY, F.explode(phrase).alias("a")).select(*KEY, "a.*")
    want = _small(wins.select("wid", F.array_join("win", " ").alias("phrase")))
    exact = said.join(want, ["wid", "phrase"]).select(*KEY, "wid", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    return exact, close


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """queries (qid, tid), distinct terms each -> dk, th, qid, pos: places of a query's rarest term with each of its other terms within `slop` words before
    or behind. Places are compared with the last and the next place of each term, which two windows carry along, so no pairs are made.
    Null and empty texts have no places; a query with a term that the corpus lacks has none; equal rows share a key and so their places."""
    df = index.where("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.distinct().join(df, "tid")
    asked = asked.withColumns({"rank": F.row_number().over(Window.partitionBy("qid").orderBy("df", "tid")), "found": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    need = queries.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    asked = staged(asked.join(need, "qid").where("found = need"), "asked")
    # rows that agree in text and id have the same places: one of them speaks
    lists = index.join(_small(asked), "tid").select(*KEY, "qid", F.col("pos").cast("long").alias("pos"), "rank", "need").distinct()
    first = lists.where("rank = 1")
    # for each other term a copy of the first term's places, beside the term's own
    others = first.where("need > 1").withColumn("of", F.explode(F.sequence(F.lit(2), F.col("need").cast("int")))).withColumn("own", F.lit(0))
    both = others.unionByName(lists.where("rank > 1").withColumns({"of": F.col("rank"), "own": F.lit(1)})).select(*KEY, "qid", "pos", "need", "of", "own")
    order, hit = Window.partitionBy(*KEY, "qid", "of").orderBy("pos", F.desc("own")), F.when(F.col("own") == 1, F.col("pos"))
    both = both.withColumns({
        "before": F.last(hit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "behind": F.first(hit, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    near = both.where("own = 0").where((F.col("pos") - F.col("before") <= slop) | (F.col("behind") - F.col("pos") <= slop))
    near = near.groupBy(*KEY, "qid", "pos", "need").agg(F.count(F.lit(1)).alias("c")).where("c = need - 1")
    return first.where("need = 1").select(*KEY, "qid", "pos").unionByName(near.select(*KEY, "qid", "pos"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = None) -> DataFrame:
    """documents (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash; one row for
    each. With near also n_near: the number of windows whose rarest terms lie within `near` words somewhere in the document, whole phrases or not.

    Null and empty texts have no words and no hits; items without words are left out, and a null item_id counts for hits but not as an item.
    An empty benchmark finds nothing; empty documents give an empty result; repeated rows get equal results. Other columns are ignored.
    """
    docs = keyed(documents)
    wins, owners, terms = phrase_windows(benchmark, window)
    index = postings(docs, terms)
    exact, close = phrase_matches(index, docs, wins, terms, near=near)
    hits = staged(exact, "hits")
    before = F.max("stop").over(Window.partitionBy(*KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    words = hits.select(*KEY, "start", "stop").distinct().withColumn("fresh", fresh).groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = hits.select(*KEY, "wid").distinct().join(_small(owners), "wid").groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    found = words.join(items, KEY)
    if close is not None:
        found = found.join(close.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near")), KEY, "full")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return index.where("tid = -1").join(found, KEY, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *([] if close is None else [F.coalesce("n_near", F.lit(0)).alias("n_near")]),
        F.col("th").alias("text_hash"),
    )


_SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}')"
SQL = f"""
with i as (select item_id, {_TOKENS} as ws from benchmark),
iw as (select distinct item_id, least(len(ws), {WINDOW}) as l, array_to_string(list_slice(ws, s, s + {WINDOW - 1}), ' ') as p
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) as s from i where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, {_TOKENS} as ws from documents),
ls as (select distinct l from iw),
dw as (select rid, l, s, array_to_string(list_slice(ws, s, s + l - 1), ' ') as p from (select rid, l, ws, unnest(range(1, len(ws) - l + 2)) as s from d, ls where len(ws) >= l)),
h as (select distinct rid, l, s, item_id from dw join iw using (l, p)),
hw as (select rid, count(distinct x) as n_hit from (select rid, unnest(range(s, s + l)) as x from h) group by rid),
hi as (select rid, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct rid, item_id from h) group by rid),
tok as (select rid, unnest(ws) as term, unnest(range(1, len(ws) + 1)) as pos from d),
slot as (select p, unnest(string_split(p, ' ')) as term, unnest(range(len(string_split(p, ' ')))) as place from (select distinct p from iw)),
fr as (select term, count(*) as df from tok group by term),
rk as (select p, term, row_number() over (partition by p order by coalesce(df, 0), term, place) as r, min(coalesce(df, 0)) over (partition by p) as least from slot left join fr using (term)),
few as (select distinct p, term from rk where r <= {RAREST} and least > 0),
need as (select p, count(*) as n from few group by p),
occ as (select rid, p, pos, term from tok join few using (term)),
met as (select rid, p, count(distinct term) over (partition by rid, p order by pos range between {NEAR - 1} preceding and current row) as c from occ),
nr as (select rid, count(distinct p) as n_near from met join need using (p) where c = n group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near
from d left join hw using (rid) left join hi using (rid) left join nr using (rid)
"""


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without the rows whose text holds a benchmark window; all columns and all other rows stay, null and empty texts among them. An empty
    benchmark drops nothing; rows of one id and text share their fate; an empty table stays empty."""
    bad_id, bad_hash = free_name("_bad", documents), free_name("_hash", documents)
    bad = decontaminate(documents, benchmark, window).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNull())
    return documents.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (own == F.col(bad_hash)), "left_anti")
