"""One-pass sources on Structured Streaming, and decoded images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming import windows as win
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return win.event_stream(spark, f"{d}/events.parquet")


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode over what is there."""
    return _text(win.drained(win.tumbling(_stream(spark, d), "1 day", "event_type")), "window_start").select("window_start", "event_type", "n")


@query("select event_id, user_id from events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return win.drained(win.deduplicated(_stream(spark, d), ["event_id"]).select("event_id", "user_id"), "append")


@query("""with o as (select user_id, ts, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, user_id, count(*) as n from s group by user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _text(win.drained(win.sessions(_stream(spark, d), "6 hours", "user_id")), "session_start").select("session_start", "user_id", "n")


@query("""with w as (select time_bucket(interval 6 hour, ts) - k * interval 6 hour as s, event_type, value from events, (select unnest([0, 1, 2, 3]) as k))
select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, max(value) as top from w group by 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that begin every six hours."""
    return _text(win.drained(win.sliding(_stream(spark, d), "1 day", "6 hours", "event_type")), "window_start").select("window_start", "event_type", "n", "top")


@query("select user_id, count(*) as n, max(value) as top from events group by 1")
def stream_stateful(spark: SparkSession, d: str) -> DataFrame:
    """State of a key, kept by a function: the last of its updates."""
    return win.drained(win.running(_stream(spark, d), "user_id", "value"), "update")
