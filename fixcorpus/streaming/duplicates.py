"""Duplicates in a stream: the first pair of each fingerprint passes, or each pair is told its original."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fingerprint


def first_seen(pairs: DataFrame, strategy: str = "normalized", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Streaming ``pairs`` without later ones of an equal fingerprint.

    With an event time, fingerprints are remembered for ``delay``, so the state is bounded; without, for ever.
    """
    marked = pairs.withColumn("fingerprint", fingerprint(F.col("buggy_code"), F.col("fixed_code"), strategy))
    if time is None:
        return marked.dropDuplicates(["fingerprint"])
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


#: Groups that fingerprints are dealt into. A call of the state's Python function handles one group of a batch, since a call
#: for each fingerprint costs milliseconds. A checkpoint keeps to the number with which it began.
GROUPS = 4096


class Originals(StatefulProcessor):
    """For each fingerprint of a group, the order and id of its first pair; forgotten ``ttl`` milliseconds after it was seen last, or never."""

    def __init__(self, kinds: T.StructType, ttl: int | None):
        self.kinds, self.ttl = kinds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", T.StructType([T.StructField("fingerprint", T.StringType())]), self.kinds, self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one batch come in no order: the smallest of a fingerprint is looked for first, in what little is kept of each row
        parts = [part[["fingerprint", "ord", "bug_id"]] for part in rows]
        firsts: dict[str, Any] = {}
        for part in parts:
            for f, *own in zip(*(part[c].tolist() for c in part), strict=True):
                firsts[f] = min(firsts.get(f, own), own)
        kept = self.first.exists()
        for f, own in firsts.items():
            known = self.first.getValue((f,)) if kept else None
            if known is not None:
                firsts[f] = known
            if known is None or self.ttl is not None:
                self.first.updateValue((f,), tuple(firsts[f]))
        for part in parts:
            out = part[["ord", "bug_id"]].copy()
            found = map(firsts.__getitem__, part["fingerprint"].tolist())
            out["duplicate_of"] = [None if o == first[0] else first[1] for o, first in zip(part["ord"].tolist(), found, strict=True)]
            yield out

    def close(self) -> None:
        pass


def with_originals(pairs: DataFrame, strategy: str = "normalized", ttl: int | None = None) -> DataFrame:
    """(ord, bug_id, duplicate_of) of streaming ``pairs``: the id of the first pair with an equal fingerprint, null for itself.

    First is what came in an earlier batch, then what has the smallest order. State holds an order and an id for each
    fingerprint, looked up by fingerprint, and no text is shuffled. Needs the RocksDB state store; with a ``ttl`` (milliseconds), batches never end by
    themselves, so the trigger must be one of processing time. A pair with a null side is a copy of none; it
    is told by its id.
    """
    own = fingerprint(F.col("buggy_code"), F.col("fixed_code"), strategy)
    rows = pairs.select(F.coalesce(own, F.concat(F.lit("none "), F.col("bug_id").cast("string")), F.lit("none")).alias("fingerprint"), "ord", "bug_id")
    kinds = T.StructType([rows.schema["ord"], rows.schema["bug_id"]])
    out = T.StructType([*kinds.fields, T.StructField("duplicate_of", rows.schema["bug_id"].dataType)])
    return rows.withColumn("group", F.pmod(F.xxhash64("fingerprint"), F.lit(GROUPS))).groupBy("group").transformWithStateInPandas(statefulProcessor=Originals(kinds, ttl), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if ttl is not None else "None")
