"""Layers to draw: which boxes, which colours, what name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column


def chosen_boxes(words: Column, lines: Column) -> Column:
    """Word boxes where there are any, else line boxes."""
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, words).otherwise(lines)


def palette(labels: DataFrame, label: str, size: int) -> DataFrame:
    """label, colour: distinct labels in order take the colours in turn. Labels are few, the window runs over them alone."""
    distinct = labels.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("colour", ((F.dense_rank().over(Window.orderBy(label)) - 1) % size).cast("long"))


def output_name(sample_id: Column, label: Column) -> Column:
    return F.concat(sample_id, F.coalesce(F.concat(F.lit("_label="), label), F.lit("")))
