"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right (by, at, tie, values) of the same group at or before its time; null where there is none. Of rows
    of one time that with the largest tie counts.

    Both tables go through one shuffle as a union, and a window carries the last right row forward; no row of left meets more than one of right."""
    own = [c for c in left.columns if c not in (*by, at)]
    marked = left.select(*by, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*own).alias("_row"), F.lit(None).alias("_value"))
    other = right.select(*by, at, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).alias("_row"), F.struct(*values).alias("_value"))
    both = marked.select(*by, at, "_side", "_tie", "_row", F.lit(None).cast(other.schema["_value"].dataType).alias("_value")).unionByName(
        other.select(*by, at, "_side", "_tie", F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), "_value")
    )
    order = Window.partitionBy(*by).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select(*by, at, "_row.*", *(F.col("_last")[v].alias(v) for v in values))
