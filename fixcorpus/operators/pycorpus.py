"""Training rows of Python bug fixes: changed region, prompt, target, and which rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diff
from ..functions.text import py_strip, split_lines

# Marks of a prompt.
MARK, FILL = "# BUGGY CODE", "<FILL_ME>"


def changed_region(ops: Column) -> Column:
    """(buggy_start, buggy_end, fixed_start, fixed_end), 0-based and half open, around all changes; null without one."""
    ch = diff.changes(ops)
    bound = lambda f, name: f(F.transform(ch, lambda o: o[name]))
    made = F.struct(bound(F.array_min, "i1").alias("buggy_start"), bound(F.array_max, "i2").alias("buggy_end"), bound(F.array_min, "j1").alias("fixed_start"), bound(F.array_max, "j2").alias("fixed_end"))
    return F.when(F.size(ch) > 0, made)


def _part(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start)


def prompt(lines: Column, region: Column) -> Column:
    """The whole file, its region commented out at column 0 below a mark, and the fill token."""
    a, z = region["buggy_start"], region["buggy_end"]
    marked = F.transform(_part(lines, a, z), lambda x: F.when(x == "", "#").otherwise(F.concat(F.lit("# "), x)))
    return F.array_join(F.concat(_part(lines, F.lit(0), a), F.array(F.lit(MARK)), marked, F.array(F.lit(FILL)), F.slice(lines, z + 1, F.size(lines))), "\n")


def target(lines: Column, region: Column) -> Column:
    return F.array_join(_part(lines, region["fixed_start"], region["fixed_end"]), "\n")


def reconstructed(buggy: Column, fixed: Column, region: Column) -> Column:
    """The buggy lines with the region replaced by the fixed one's."""
    new = _part(fixed, region["fixed_start"], region["fixed_end"])
    return F.array_join(F.concat(_part(buggy, F.lit(0), region["buggy_start"]), new, F.slice(buggy, region["buggy_end"] + 1, F.size(buggy))), "\n")


def rows(pairs: DataFrame, buggy: str = "buggy", fixed: str = "fixed") -> DataFrame:
    """``pairs`` with region, input, output, reconstruction_ok and skipped: no_change, blank_target or null.

    Null sources are empty. Skipped pairs stay as rows, so that ``summary`` is one aggregate; they have no input or output.
    """
    own = pairs.withColumns({"_a": split_lines(F.coalesce(buggy, F.lit(""))), "_b": split_lines(F.coalesce(fixed, F.lit("")))})
    own = own.withColumn("_ops", diff.opcodes("_a", "_b")).withColumn("region", changed_region(F.col("_ops")))
    own = own.withColumn("output", target(F.col("_b"), F.col("region")))
    own = own.withColumn("skipped", F.when(F.col("region").isNull(), "no_change").when(py_strip(F.col("output")) == "", "blank_target"))
    kept = F.col("skipped").isNull()
    same = py_strip(reconstructed(F.col("_a"), F.col("_b"), F.col("region"))) == py_strip(F.coalesce(fixed, F.lit("")))
    return own.withColumns({"input": F.when(kept, prompt(F.col("_a"), F.col("region"))), "output": F.when(kept, F.col("output")), "reconstruction_ok": F.when(kept, same)}).drop("_a", "_b", "_ops")


def summary(made: DataFrame) -> DataFrame:
    """(original, processed, skipped) of ``rows``; zeros for an empty table."""
    return made.agg(F.count(F.lit(1)).alias("original"), F.count_if(F.col("skipped").isNull()).alias("processed"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))
