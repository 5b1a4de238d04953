"""Rows of ``neighbors`` with the word of every row, where it is missing from the slice of its edge_pos in ``word_ptr``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.session import cut, read

SLICE = 1 << 18


def slice_owner(positions: DataFrame, word_ptr: DataFrame, pos: str = "edge_pos", width: int = SLICE) -> DataFrame:
    """positions with word_id (a column of that name is replaced): the word whose slice of the flat arrays holds ``pos``.

    An as-of lookup in buckets of ``width`` places: inside a bucket a window carries the last start forward, and what a bucket
    inherits is found on one row a bucket. Of words with the same start only the last has a slice that isn't empty. Positions
    before the first start get null, rows of word_ptr with a null are ignored.
    """
    ptr = word_ptr.select(F.col("word_id").alias("_w"), F.col("indptr").alias("_p")).dropna()
    starts = ptr.groupBy("_p").agg(F.max("_w").alias("_w")).withColumn("_b", F.floor(F.col("_p") / width))
    each = starts.groupBy("_b").agg(F.max_by("_w", "_p").alias("_last"))
    asked = positions.withColumn("_b", F.floor(F.col(pos) / width))
    every = each.unionByName(asked.select("_b").distinct().withColumn("_last", F.lit(None).cast("int"))).groupBy("_b").agg(F.max("_last").alias("_last"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each width places
    inherited = every.select("_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    names = [c for c in positions.columns if c != "word_id"]
    rows = asked.select("_b", F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_w"), F.struct(*names).alias("_row"))
    marks = starts.select("_b", F.col("_p").alias("_at"), F.lit(0).alias("_kind"), "_w", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("_own", F.last("_w", ignorenulls=True).over(upto)).filter(F.col("_kind") == 1)
    return found.join(inherited, "_b", "left").select("_row.*", F.coalesce("_own", "_carry").cast("int").alias("word_id"))


def resolved_neighbors(spark, sf_dir, keep=None) -> DataFrame:
    """(word_id, neighbor_id, score) of all rows of neighbors that satisfy ``keep``, a condition on neighbor_id and score."""
    n = read(spark, sf_dir, "neighbors")
    n = n.filter(keep) if keep is not None else n
    n = n.filter(F.col("neighbor_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    told = n.filter(F.col("word_id").isNotNull()).select("word_id", "neighbor_id", "score")
    lost = n.filter(F.col("word_id").isNull() & F.col("edge_pos").isNotNull()).select("edge_pos", "neighbor_id", "score")
    found = slice_owner(lost, read(spark, sf_dir, "word_ptr")).select("word_id", "neighbor_id", "score").dropna()
    return told.unionByName(cut(found))  # a small part of the rows, which callers read more than once


def owned_neighbors(spark, sf_dir) -> DataFrame:
    """neighbors with every column, and with the word of each row where word_ptr tells it."""
    n = read(spark, sf_dir, "neighbors")
    lost = n.filter(F.col("word_id").isNull() & F.col("edge_pos").isNotNull())
    return n.filter(F.col("word_id").isNotNull()).unionByName(cut(slice_owner(lost, read(spark, sf_dir, "word_ptr"))))
