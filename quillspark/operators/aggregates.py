"""Aggregates that need an order of a whole group, without a task that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median (double): the exact median of the values of each group, the mean of the middle two where their number is even.

    Equal values are counted first, so neither a hot group nor a hot value is one task's; distinct values are sorted over all tasks, and ranks are sums of
    the tasks' counts and those within them. Null values don't count, and groups without others are left out; a null group is a group."""
    values = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    counts = values.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("g", "v")
    rows = written(counts.withColumn("part", F.spark_partition_id()), "medians")
    parts = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("g", "part").agg(F.sum("c").alias("n"))
    sums = sums.select(F.col("g").alias("of_g"), F.col("part").alias("of_part"), before.alias("before"), F.sum("n").over(parts).alias("total"))
    own = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v"))
    ranked = rows.withColumn("own", own).join(sums, F.col("g").eqNullSafe(F.col("of_g")) & (F.col("part") == F.col("of_part")))
    ranked = ranked.withColumn("upto", F.col("before") + F.col("own"))
    holds = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    middle = ranked.where(holds(F.floor((F.col("total") - 1) / 2)) | holds(F.floor(F.col("total") / 2)))
    return middle.groupBy("g").agg(((F.min("v") + F.max("v")) / 2).alias("median")).withColumnRenamed("g", group)


def distinct_counts(df: DataFrame, group: str, value: str, error: float = 0.05) -> DataFrame:
    """group, approx, exact (long): the number of different values of each group, by a sketch with that relative standard deviation and as it is.

    Pairs of group and value are found first, as plain rows. Spark's own plan for both aggregates in one call keeps a sketch for each pair (3.3 KB at 0.02)
    and shuffles and spills those; here a task keeps one for each group. A sketch holds maxima of hashes, so that of the pairs is that of the rows. Null
    values don't count, though groups without others have a row; a null group is a group."""
    pairs = df.select(F.col(group).alias("g"), F.col(value).alias("v")).distinct()
    counts = pairs.groupBy("g").agg(F.approx_count_distinct("v", error).alias("approx"), F.count("v").alias("exact"))
    return counts.withColumnRenamed("g", group)
