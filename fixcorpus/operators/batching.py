"""Batches of examples of about equal length, so that filling them up to their longest wastes little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one block of the running count.
BLOCK = 1024


def _before(counts: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
    """``counts`` with ``name``: the sum of n in earlier rows of the same ``within``."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def length_batches(rows: DataFrame, length: Column, key: Column, size: int, digits: int = 2) -> DataFrame:
    """``rows`` with length, batch and slot (long): numbered in the order of length, then of a hash of ``key``, ``size`` to a batch.

    Rows are counted by range: a length and the first ``digits`` hexadecimal digits of the hash. A row's number is the count
    before its range and its place in it, so a length that most rows share falls into 16**digits ranges, and
    rows meet in no larger window. The counts before ranges are summed within lengths, then within blocks of ``BLOCK`` lengths;
    one row for each block goes through one task.

    A null length is 0; rows of a null or repeated key get numbers of their own, in any order; columns named like the new ones
    are replaced; an empty table gives an empty result.
    """
    if size < 1 or digits < 1:
        raise ValueError("size and digits must be positive")
    kept = [F.col(f"row.`{c}`").alias(c) for c in rows.columns if c.lower() not in ("length", "batch", "slot")]
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    marked = rows.select(F.struct("*").alias("row"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"), digest.alias("hash"), key.alias("key"))
    marked = marked.withColumn("head", F.substring("hash", 1, digits))
    ranges = marked.groupBy("length", "head").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("length") / BLOCK))
    lengths = ranges.groupBy("block", "length").agg(F.sum("n").alias("n"))
    blocks = lengths.groupBy("block").agg(F.sum("n").alias("n"))
    starts = _before(lengths, ["block"], "length", "in_block").join(_before(blocks, [], "block", "in_all").drop("n"), "block")
    starts = starts.select("length", (F.col("in_block") + F.col("in_all")).alias("start"))
    starts = _before(ranges, ["length"], "head", "in_length").join(starts, "length").select("length", "head", (F.col("in_length") + F.col("start")).alias("start"))
    place = F.row_number().over(Window.partitionBy("length", "head").orderBy("hash", "key"))
    number = F.col("start") + place - 1
    numbered = marked.join(starts, ["length", "head"]).withColumn("number", number)
    return numbered.select(*kept, "length", F.floor(F.col("number") / size).alias("batch"), (F.col("number") % size).alias("slot"))


def paddings(batched: DataFrame, multiple: int = 8, most: int | None = None) -> DataFrame:
    """(batch, n, width, used, wasted) of rows with batch and length: longer rows are cut to ``most``, if given, and the width of a
    batch is its longest row's, rounded up to ``multiple`` but not beyond ``most``, as ``workflow.padded`` fills it."""
    own = F.least(F.col("length"), F.lit(most)) if most else F.col("length")
    width = F.ceil(F.max(own) / multiple) * multiple
    width = (F.least(width, F.lit(most)) if most else width).cast("long")
    sums = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), width.alias("width"), F.sum(own).cast("long").alias("used"))
    return sums.withColumn("wasted", F.col("n") * F.col("width") - F.col("used"))
