"""Line differences. The opcodes come from one Arrow function; all else are expressions over them."""

from __future__ import annotations

import array
import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2")]]))


@F.arrow_udf(OPCODES)
def opcodes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edits that turn the lines ``a`` into ``b``: longest block first, earliest on ties.

    Only one row's lines are Python's at a time; those of the batch stay in Arrow's memory.
    """
    ends, missing, parts = array.array("i", [0]), [], [[], *(array.array("i") for _ in range(4))]
    for x, y in zip(a, b, strict=True):
        missing.append(not (x.is_valid and y.is_valid))
        if not missing[-1]:
            for edit in difflib.SequenceMatcher(None, x.as_py(), y.as_py(), autojunk=False).get_opcodes():
                for part, value in zip(parts, edit, strict=True):
                    part.append(value)
        ends.append(len(parts[0]))
    edits = pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), *(pa.array(np.asarray(p, "int32")) for p in parts[1:])], ["tag", "i1", "i2", "j1", "j2"])
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, "int32")), edits, mask=pa.array(missing, pa.bool_()))


def changes(ops: Column) -> Column:
    return F.filter(ops, lambda o: o["tag"] != "equal")


def changed_span(ops: Column) -> Column:
    """First and last changed line of the old side (1-based); an insertion counts for the line before it; null without change."""
    ch = changes(ops)
    low = F.array_min(F.transform(ch, lambda o: o["i1"]))
    high = F.array_max(F.transform(ch, lambda o: o["i2"]))
    at = F.greatest(F.lit(1), low)
    return F.when(F.size(ch) > 0, F.when(high <= low, F.struct(at.alias("start"), at.alias("end"))).otherwise(F.struct((low + 1).alias("start"), high.alias("end"))))


def diff_size(ops: Column) -> Column:
    return F.aggregate(changes(ops), F.lit(0), lambda a, o: a + o["i2"] - o["i1"] + o["j2"] - o["j1"])


def aligned(ops: Column, start: Column, end: Column, n_new: Column) -> Column:
    """Bounds of the old region on the new side (0-based, half open), and whether lines outside of it changed."""
    a, b = start - 1, end
    take = lambda which, value: F.get(F.transform(F.filter(ops, which), value), 0)
    low = F.coalesce(
        take(lambda o: (o["tag"] == "insert") & (o["i1"] == a), lambda o: o["j1"]),
        take(lambda o: (o["i1"] <= a) & (a < o["i2"]), lambda o: F.when(o["tag"] == "equal", o["j1"] + a - o["i1"]).otherwise(o["j1"])),
        n_new,
    )
    high = F.coalesce(
        take(lambda o: (o["tag"] == "insert") & (o["i1"] == b), lambda o: o["j2"]),
        take(lambda o: (o["i1"] < b) & (b <= o["i2"]), lambda o: F.when(o["tag"] == "equal", o["j1"] + b - o["i1"]).otherwise(o["j2"])),
        n_new,
    )
    outside = F.exists(changes(ops), lambda o: F.when(o["i1"] == o["i2"], ~o["i1"].between(a, b)).otherwise(~((o["i1"] >= a) & (o["i2"] <= b))))
    return F.struct(low.alias("start"), F.greatest(low, high).alias("end"), outside.alias("outside"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two lower-cased texts."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def unified(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Unified diff with a mark where the last line has no line end; empty if nothing changed."""
    def one(name: str, x: str, y: str) -> str:
        out = []
        for line in difflib.unified_diff(x.splitlines(keepends=True), y.splitlines(keepends=True), f"a/{name}", f"b/{name}"):
            out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
        return "".join(out)

    return pd.Series([None if x is None or y is None else one(p or "", x, y) for p, x, y in zip(path, a, b, strict=True)])
