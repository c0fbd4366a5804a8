"""Append-only logs of a workflow: ordered events written from a stream, and the state of each key folded from them.

An event has a key, a sequence number within it, the name of the log that it extends, and a value. Appending is idempotent:
a batch that runs again replaces its own folder, and an event that comes again in another batch, as after a lost
checkpoint, is one event still, since the first batch's row of each key and number counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("key", "seq", "log", "value")


def appender(at: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: events (key, seq, log, value) appended to the table at ``at``; each start of a stream has its own ``at`` or checkpoint.

    An event without a key or a number can't be told from its replay, so it stops the batch.
    """

    def append(batch: DataFrame, number: int) -> None:
        lacks = F.raise_error(F.lit("an event has no key or no number"))
        rows = batch.select(*COLUMNS).withColumn("seq", F.when(F.col("key").isNull() | F.col("seq").isNull(), lacks.cast("bigint")).otherwise(F.col("seq").cast("bigint")))
        rows.write.mode("overwrite").parquet(f"{at}/batch={number}")

    return append


def logged(spark: SparkSession, at: str, *more: str) -> DataFrame:
    """The events in the tables at ``at`` and ``more``, each once: of replays the row of the earlier table, then of the earlier batch.

    Equal numbers with different values in one batch are a fault of the source; the smallest log and value counts then.
    Rows of one key and number meet only, whatever the size of a key.
    """
    parts = [spark.read.option("basePath", place).parquet(place).withColumn("turn", F.lit(i)) for i, place in enumerate((at, *more))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = F.min(F.struct("turn", "batch", "log", "value")).alias("first")
    return rows.groupBy("key", "seq").agg(first).select("key", "seq", "first.log", "first.value")


def folded(events: DataFrame, logs: tuple[str, ...]) -> DataFrame:
    """A row for each key: n events, the first and the last number, how many numbers between them are missing, and of each log
    its length and its last value.

    Sums and extremes only, combined in each task, so a key may have any share of the events.
    """
    own = lambda log: F.col("log") == log
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.max("seq") - F.min("seq") + 1 - F.count(F.lit(1))).alias("missing")]
    for log in logs:
        aggregates += [F.count_if(own(log)).alias(f"n_{log}"), F.max(F.when(own(log), F.struct("seq", "value")))["value"].alias(f"last_{log}")]
    return events.groupBy("key").agg(*aggregates)


def lists(events: DataFrame, keys: DataFrame, logs: tuple[str, ...]) -> DataFrame:
    """(key, one array for each log): the whole logs of ``keys`` (key), in order; a key's logs must fit into a task."""
    own = events.join(keys.select("key").distinct(), "key", "left_semi")
    made = [F.transform(F.array_sort(F.collect_list(F.when(F.col("log") == log, F.struct("seq", "value")))), lambda x: x["value"]).alias(log) for log in logs]
    return own.groupBy("key").agg(*made)
