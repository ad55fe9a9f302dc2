"""Relational operators beyond the samples engine: joins, windows, grouping, sets, sorting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import joins
from ..operators.aggregates import distinct_counts, medians
from ..session import table
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("""
select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, cast(max(l_extendedprice) as double) as max_price,
count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2
""")
def ext_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, count(*) as n_orders, count(distinct o_custkey) as n_customers from customer join orders on o_custkey = c_custkey group by 1")
def ext_inner_join(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def ext_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""
select c_custkey from customer where not exists (select 1 from orders
where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')
""")
def ext_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is finished."""
    urgent = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("select p_partkey, count(l_orderkey) as n from part left join lineitem on l_partkey = p_partkey group by 1")
def ext_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
select coalesce(c.k, s.k) as nation, coalesce(c.n, 0) as customers, coalesce(s.n, 0) as suppliers from (select c_nationkey as k,
count(*) as n from customer group by 1) c full join (select s_nationkey as k, count(*) as n from supplier
group by 1) s on c.k = s.k
""")
def ext_full_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("select r_name, n_name from region cross join nation")
def ext_cross_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(table(spark, d, "nation").select("n_name")))


@query("""with r as (select user_id, ts, max_by(value, event_id) as last_purchase from events where event_type = 'purchase' group by 1, 2)
select l.event_id, l.user_id, r.last_purchase from (select * from events where event_type <> 'purchase') l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def ext_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables: each event that is no purchase with the user's last purchase up to it."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("last_purchase"))
    return joins.as_of(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), bought, ["user_id"], "ts", "event_id", ["last_purchase"]).drop("ts")


@query("select p_brand, p_size, count(*) as n from part group by rollup (p_brand, p_size)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def ext_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.groupingSets([[t.o_orderstatus], [t.o_orderpriority], []], t.o_orderstatus, t.o_orderpriority).agg(F.count(F.lit(1)).alias("n"))


@query("""
select o_orderkey, rank() over w as r, dense_rank() over w as dr, row_number() over (partition by o_custkey order by o_orderdate,
o_orderkey) as rn, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders
window w as (partition by o_custkey order by o_orderdate)
""")
def ext_ranks(spark: SparkSession, d: str) -> DataFrame:
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.row_number().over(u).cast("long").alias("rn"), F.lag("o_orderkey").over(u).alias("prev"))


@query("""
select event_id, max(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as max3,
count(*) over (partition by user_id order by ts, event_id) as upto from events
""")
def ext_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.max("value").over(w.rowsBetween(-2, 0)).alias("max3"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def ext_top_k(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def ext_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 49")
def ext_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("select event_type, count(distinct user_id) as users, median(value) as middle from events group by 1")
def ext_distinct_and_median(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    middle = medians(events, "event_type", "value").select(F.col("event_type").alias("of"), F.col("median").alias("middle"))
    users = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return users.join(middle, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


@query("select cast(date_trunc('day', ts) as varchar)[1:10] as day, event_type, count(*) as n from events group by 1, 2")
def ext_date_trunc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select c_nationkey, max(c_acctbal) as m from customer group by 1) select n_name, m as top_balance from t
join nation on n_nationkey = c_nationkey where m > (select avg(c_acctbal) from customer)
""")
def ext_sql_subquery(spark: SparkSession, d: str) -> DataFrame:
    """SQL text with a common table expression and a scalar subquery."""
    return spark.sql(
        "with t as (select c_nationkey, max(c_acctbal) as m from {c} group by 1) select n_name, m as top_balance from t join {n} on n_nationkey = c_nationkey where m > (select avg(c_acctbal) from {c})",
        c=table(spark, d, "customer"), n=table(spark, d, "nation"),
    )


@query("select l_suppkey, count(*) as n, cast(sum(l_quantity) as double) as qty from lineitem group by 1")
def ext_salted_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A skewed group key in two steps: salted partial sums, then whole ones."""
    salt = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(16))
    part = table(spark, d, "lineitem").groupBy("l_suppkey", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return part.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query("select event_type, max(value) - min(value) as reach from events group by 1")
def ext_udaf(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate in pandas over partial results: Spark's own aggregates make two numbers of each group first, so that no task holds a group's rows."""

    @F.pandas_udf("double")
    def reach(low: pd.Series, high: pd.Series) -> float:
        return float(high.max() - low.min())

    part = table(spark, d, "events").groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return part.groupBy("event_type").agg(reach("low", "high").alias("reach"))


class _Letters:
    def eval(self, text: str):
        for i, c in enumerate(text or ""):
            yield i, c


@query("""
with n as (select n_nationkey, n_name, unnest(range(length(n_name))) as i from nation) select n_nationkey,
cast(i as bigint) as place, substr(n_name, cast(i + 1 as bigint), 1) as letter from n
""")
def ext_udtf(spark: SparkSession, d: str) -> DataFrame:
    """A table function in Python, beside each row of a table."""
    letters = F.udtf(_Letters, returnType="place long, letter string")
    spark.udtf.register("quill_letters", letters)
    return spark.sql("select n_nationkey, t.place, t.letter from {n}, lateral quill_letters(n_name) t", n=table(spark, d, "nation"))


@query("""select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(dayofweek(o_orderdate) as bigint) as dow,
strftime(last_day(o_orderdate), '%Y-%m-%d') as month_end, strftime(o_orderdate + interval 3 month, '%Y-%m-%d') as later, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as days from orders""")
def ext_dates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderdate")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(c).cast("long").alias("y"), F.quarter(c).cast("long").alias("q"), (F.dayofweek(c) - 1).cast("long").alias("dow"), day(F.last_day(c)).alias("month_end"),
        day(F.add_months(c.cast("date"), 3)).alias("later"), F.datediff(c.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"),
    )


@query("""
select l_returnflag, abs(approx - exact) <= 0.06 * exact as near from (select l_returnflag, count(distinct l_partkey) as approx,
count(distinct l_partkey) as exact from lineitem group by 1)
""")
def ext_approximate(spark: SparkSession, d: str) -> DataFrame:
    """A sketch of distinct values, whose error is held against the exact count."""
    t = distinct_counts(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", 0.02)
    return t.select("l_returnflag", (F.abs(F.col("approx") - F.col("exact")) <= 0.06 * F.col("exact")).alias("near"))
