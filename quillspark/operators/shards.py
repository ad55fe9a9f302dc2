"""Shards, splits and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column


def split_of(number: Column) -> Column:
    """Buckets of ten: eight for training, one each for validation and test."""
    return F.when(number % 10 < 8, "train").when(number % 10 == 8, "validation").otherwise("test")


def shard_table(rows: DataFrame, per_shard: int, size: Column, pos: str = "_pos") -> DataFrame:
    """shard (from 1), nsamples, nbytes, first: rows dealt to shards in order; empty shards do not appear."""
    shard = (F.floor(F.col(pos) / per_shard) + 1).cast("long")
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("nsamples"), F.sum(size).alias("nbytes"), F.min(pos).alias("first"))


def renumbered(shards: DataFrame) -> DataFrame:
    """Empty shards dropped, the rest numbered from 1. Shards are few: the window runs over them, not over samples."""
    return shards.where("nsamples > 0").withColumn("shard", F.row_number().over(Window.orderBy("shard")).cast("long"))


def locate(indices: DataFrame, shards: DataFrame, width: int | None = None) -> DataFrame:
    """indices (idx) -> idx, shard, inner: running sums of the shards' sizes, then a range join made an equi-join: both sides go by blocks of `width`
    places (the mean size of a shard, if not told), so each index meets the few shards of its block. Indices outside all shards are left out."""
    upto = F.sum("nsamples").over(Window.orderBy("shard"))
    bounds = shards.where("nsamples > 0").select("shard", (upto - F.col("nsamples")).alias("lo"), upto.alias("hi"))
    if width is None:
        width = max(1, int(shards.agg(F.avg("nsamples")).first()[0] or 1))
    blocks = bounds.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    placed = indices.withColumn("_block", F.floor(F.col("idx") / width))
    found = placed.join(blocks, "_block").where((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
    return found.select("idx", "shard", (F.col("idx") - F.col("lo")).alias("inner"))


def write_totals(shards: DataFrame) -> DataFrame:
    """n_shards, nsamples, nbytes of what was written, empty shards left out."""
    return shards.where("nsamples > 0").agg(F.count(F.lit(1)).alias("n_shards"), F.coalesce(F.sum("nsamples"), F.lit(0)).alias("nsamples"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("nbytes"))


def split_info(rows: DataFrame, size: Column) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("nsamples"), F.sum(size).alias("nbytes"))


def duplicate_keys(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def content_dedup(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """content_hash, first, n: one row per distinct content, with the smallest `order` that has it."""
    return rows.groupBy(F.sha2(content.cast("binary"), 256).alias("content_hash")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
