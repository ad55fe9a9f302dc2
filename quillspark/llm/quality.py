"""Quality rules at host level (operator 4).

Each document gets counts and rule failures; failures are summed per host (documents of one host may be a third of all rows, so they are
pre-aggregated); the hosts' failure rates are shrunk towards a beta prior fitted to all hosts by moments; a host whose shrunk rate is high is
judged strictly: its documents go at the first failed rule, those of other hosts only when they fail several. Documents that fail no rule
are kept whatever their host.

Verdicts go back to documents in two ways: hosts with more than 1 / HOT_HOSTS of all documents, fewer than HOT_HOSTS by that bound, are broadcast, so
that no task gathers a large host's documents; documents of all other hosts meet their verdicts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices, staged, thin_batches

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STRICT_RATE, STRICT_FAILS, LENIENT_FAILS = 0.5, 1, 2
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0
HOT_HOSTS = 1000

_DROP = str.maketrans("", "", " \t\n\x0b\x0c\r")


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.translate(_DROP)] if n else []
    repeat = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        if len(seen) < 1 << 21:
            size = len(seen)
            grams = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
            grams = pairs[:-1] << 32 | ids[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeat = int(hit.sum())
    return n, len(text.translate(_DROP)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 1 << 21):
        counts = zip(*(text_counts(t or "") for t in batch.column(2).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "host", *COUNTS])


def rule_counts(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five counts, base_failed and n_failed (failed rules, base included) of each document."""
    docs = thin_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(lean("quality", _count), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    base = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)".replace("< 50", f"< {MIN_WORDS}").replace("> 50 *", f"> {MAX_REPEAT_PERCENT} *")
    rules = [base, "10 * n_symbols > n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words", "20 * n_dup_lines > n_words", "100 * n_repeat_words > 20 * n_words"]
    return counted.withColumns({"base_failed": F.expr(base), "n_failed": F.expr(" + ".join(f"cast({r} as int)" for r in rules))})


def host_verdicts(counted: DataFrame, strict_rate: float = STRICT_RATE) -> DataFrame:
    """host, host_docs, host_fails, host_rate (shrunk), host_strict. The prior: moments of the hosts' rates, its weight kept in a fixed range."""
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.when(F.col("n_failed") > 0, 1).otherwise(0)).alias("host_fails"))
    rate = F.col("host_fails") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(PRIOR_MOST))
    prior = prior.select("m", F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(PRIOR_LEAST), weight)).alias("w"))
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("host_fails") + F.col("m") * F.col("w")) / (F.col("host_docs") + F.col("w")))
    return shrunk.select("host", "host_docs", "host_fails", "host_rate", (F.col("host_rate") > strict_rate).alias("host_strict"))


def with_verdicts(counted: DataFrame, verdicts: DataFrame, hot_hosts: int = HOT_HOSTS) -> DataFrame:
    """counted (host, ...) and verdicts, a row for each of its hosts -> counted with host_rate and host_strict; null hosts are one host."""
    total = verdicts.agg(F.sum("host_docs")).first()[0] or 0
    is_hot, same = F.col("host_docs") * hot_hosts > total, F.col("host").eqNullSafe(F.col("of_host"))
    known = verdicts.withColumnRenamed("host", "of_host")
    hot, others = F.broadcast(known.where(is_hot)), known.where(~is_hot)
    cols = [*counted.columns, "host_rate", "host_strict"]
    rest = counted.join(hot.select("of_host"), same, "left_anti").join(others, same)
    return counted.join(hot, same).select(*cols).unionByName(rest.select(*cols))


def quality_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """documents (doc_id, text, host column, ...) -> doc_id, the five counts, base_failed, kept, n_failed, host_rate; one row for each row.

    Null and empty texts have counts of 0 and fail the base. Null hosts are one host. Other columns are ignored; repeated rows count each; an empty
    table gives an empty result. Counts and verdicts are written once to the shared folder, as both are read twice.
    """
    counted = staged(rule_counts(documents, host), "counts")
    judged = with_verdicts(counted, staged(host_verdicts(counted), "hosts"))
    enough = F.when(F.col("host_strict"), STRICT_FAILS).otherwise(LENIENT_FAILS)
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("n_failed") < enough)).alias("kept"), "n_failed", "host_rate")


_WORD = r"[^\x20\x09-\x0D]+"
#: The same in DuckDB. The prior is computed in doubles from integer counts.
SQL = rf"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select *, row_number() over () as rid, regexp_extract_all(text, '{_WORD}') as ws from t),
g as (select rid, len(ws) as n, unnest(range(1, greatest(len(ws) - 1, 1))) as i, ws from w where len(ws) > 2),
g2 as (select rid, i, count(*) over (partition by rid, ws[i], ws[i+1], ws[i+2]) as c from g),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i+1, i+2]) as p from g2 where c > 1) group by rid),
ln as (select rid, unnest(string_split(text, chr(10))) as line from w),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from ln where regexp_matches(line, '{_WORD}') group by rid),
b as (select w.rid, doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join rep using (rid) left join dup using (rid)),
f as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from b),
r as (select *, cast(base_failed as int) + cast(10 * n_symbols > n_words as int) + cast(word_chars < 2 * n_words or word_chars > 15 * n_words as int) + cast(20 * n_dup_lines > n_words as int)
  + cast(100 * n_repeat_words > 20 * n_words as int) as n_failed from f),
h as (select source, count(*) as docs, sum(case when n_failed > 0 then 1 else 0 end) as fails from r group by source),
m as (select avg(fails / docs) as m, var_pop(fails / docs) as v from h),
p as (select m, least({PRIOR_MOST}, greatest({PRIOR_LEAST}, case when v > 0 then m * (1 - m) / v - 1 else {PRIOR_MOST} end)) as w from m),
s as (select source, (fails + m * w) / (docs + w) > {STRICT_RATE} as strict from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_failed < (case when strict then {STRICT_FAILS} else {LENIENT_FAILS} end) as kept
from r left join s on r.source is not distinct from s.source
"""
