"""Exact length histogram (operator 3).

Documents are aggregated by encoded length, within each task first; suffix sums over the histogram then answer, for every context limit, how many
documents and tokens reach it and what truncation to it leaves. The sums are two-level, over spans of lengths and within them, so no task sees all lengths.
A limit that is no document's length is answered by the sums of the next longer length that occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import lean, slices, staged, thin_batches
from .encoder import word_tokenizer

SPAN = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        counts: Counter = Counter()
        for batch in slices(batches, 0, 1 << 22):
            counts.update(tok.lengths(batch.column(0)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])

    return run


def length_histogram(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """documents (text, ...) -> length, n_docs: exact counts of documents by encoded length. Null and empty texts have length 0; repeated rows count
    each; texts of any length are encoded whole; an empty table gives an empty result. Other columns are ignored."""
    texts = thin_batches(documents).select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lean("tokens", _lengths(tokenizer_path)), "length long, n_docs long")
    return rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def _sums(histogram: DataFrame, span: int) -> DataFrame:
    """The histogram with suffix sums of documents and tokens (own length included), and the totals of both."""
    h = histogram.withColumns({"part": F.floor(F.col("length") / span), "tokens": F.col("length") * F.col("n_docs")})
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for every `span` lengths, so a single task holds these few
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("docs"),
        F.sum("t").over(whole).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(F.desc("length"))
    h = h.withColumns({"d_own": F.sum("n_docs").over(own), "t_own": F.sum("tokens").over(own)}).join(parts, "part")
    return h.select("length", "n_docs", (F.col("d_own") + F.col("d_after")).alias("reach"), (F.col("t_own") + F.col("t_after")).alias("tokens"), "docs", "total")


def context_limits(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """length, n_docs -> for each length taken as context limit: docs and tokens that reach it or exceed it, the total after truncation, and the
    share of documents that fit (an exact quantile table). One row per length that occurs; an empty histogram gives an empty result."""
    fit = F.col("docs") - F.col("reach") + F.col("n_docs")
    return _sums(histogram, span).select(
        F.col("length").alias("context_limit"),
        "n_docs",
        F.col("reach").alias("docs_at_least"),
        F.col("tokens").alias("tokens_at_least"),
        fit.alias("docs_that_fit"),
        (F.col("total") - F.col("tokens") + F.col("length") * F.col("reach")).alias("truncated_total"),
        "total",
        (fit / F.col("docs")).alias("quantile"),
    )


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """context_limits and any limits, whether or not a document has that length -> the same columns, a row for each distinct wanted limit.

    The next longer length that occurs answers docs and tokens at a limit, as no document lies between. The list is the caller's and short; each
    limit is an aggregate of its own over the table. Where no document exists there is no row."""
    rows = []
    for x in sorted(set(wanted)):
        here, above = F.col("context_limit") == x, F.col("context_limit") >= x
        # of the rows at or above the limit, that with the smallest length
        next_ = F.min(F.when(above, F.struct("context_limit", "docs_at_least", "tokens_at_least")))
        docs = F.max(F.col("docs_that_fit"))
        reach, tokens = F.coalesce(next_["docs_at_least"], F.lit(0)), F.coalesce(next_["tokens_at_least"], F.lit(0))
        n = F.coalesce(F.max(F.when(here, F.col("n_docs"))), F.lit(0))
        row = limits.agg(n.alias("n_docs"), reach.alias("docs_at_least"), tokens.alias("tokens_at_least"), docs.alias("docs"), F.max("total").alias("total"))
        fit = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
        rows.append(
            row.where("docs is not null").select(
                F.lit(x).cast("long").alias("context_limit"), "n_docs", "docs_at_least", "tokens_at_least", fit.alias("docs_that_fit"),
                (F.col("total") - F.col("tokens_at_least") + x * F.col("docs_at_least")).alias("truncated_total"), "total", (fit / F.col("docs")).alias("quantile"),
            )
        )
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def quantile(limits: DataFrame, share: float) -> int | None:
    """The least length that at least `share` of the documents do not exceed; None without documents."""
    row = limits.where(F.col("quantile") >= share).agg(F.min("context_limit")).first()
    return row[0]


USUAL = (512, 1024, 2048, 4096, 8192, 32768, 131072)


def token_counts(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """documents (text, ...) -> the rows of `context_limits` for every length that occurs, and of `at_limits` for usual limits that are no length.

    Null and empty texts have length 0; an empty table gives an empty result; other columns are ignored."""
    limits = staged(context_limits(staged(length_histogram(documents, tokenizer_path), "lengths")), "limits")
    return limits.unionByName(at_limits(limits, list(USUAL)).where("n_docs = 0"))
