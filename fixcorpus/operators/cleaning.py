"""Cleaning rules: one ordered decision for each pair."""

from __future__ import annotations

import bisect
import difflib
import functools
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import diff, java
from ..functions.text import looks_like_test, py_strip, split_lines


@dataclass(frozen=True)
class Rules:
    drop_identical: bool = True
    single_function: bool = True
    drop_tests: bool = True
    min_diff: int = 1
    max_diff: int = 50
    max_region: int | None = None

    def __post_init__(self):
        if self.min_diff < 0 or self.max_diff < self.min_diff or (self.max_region is not None and self.max_region < 1):
            raise ValueError("limits must be in order and positive")


def quick_reason(buggy: Column, fixed: Column, rules: Rules = Rules()) -> Column:
    """The rules that need no line differences."""
    reason = F.when((py_strip(buggy) == "") | (py_strip(fixed) == ""), "empty_source")
    if rules.drop_identical:
        reason = reason.when(buggy == fixed, "identical")
    return reason.when(split_lines(buggy) == split_lines(fixed), "no_change")


def clean(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pairs`` with stage, reason and detail of the first rule that fails; region and opcodes of the others.

    Pairs that a cheap rule rejects never reach the line differences.
    """
    named = pairs.withColumn("_quick", quick_reason(F.col("buggy_code"), F.col("fixed_code"), rules))
    lines = named.withColumns({"_a": F.when(F.col("_quick").isNull(), split_lines(F.col("buggy_code"))), "_b": F.when(F.col("_quick").isNull(), split_lines(F.col("fixed_code")))})
    rich = lines.withColumn("ops", diff.opcodes("_a", "_b"))
    if rules.single_function:
        rich = rich.withColumn("methods", java.methods(F.when(F.col("_quick").isNull(), F.col("buggy_code"))))
    start, end, total = F.col("suspicious_start"), F.col("suspicious_end"), F.size("_a")
    span = diff.changed_span(F.col("ops"))
    size = diff.diff_size(F.col("ops"))
    reason = F.when(F.col("_quick").isNotNull(), F.col("_quick"))
    reason = reason.when((start < 1) | (end < start) | (end > total), "invalid_region")
    if rules.max_region is not None:
        reason = reason.when(end - start + 1 > rules.max_region, "diff_too_large")
    reason = reason.when(size < rules.min_diff, "diff_too_small").when(size > rules.max_diff, "diff_too_large")
    if rules.drop_tests:
        reason = reason.when(looks_like_test(F.col("file_path"), F.col("buggy_code")), "test_only")
    detail = F.lit(None).cast("string")
    if rules.single_function:
        hit = F.filter("methods", lambda m: ~((span["end"] < m["start_line"]) | (span["start"] > m["end_line"])))
        reason = reason.when(F.size(hit) != 1, "not_single_function")
        detail = F.when(F.size(hit) > 1, F.array_join(F.transform(hit, lambda m: m["name"]), ", "))
    out = rich.withColumns({"reason": reason, "detail": detail, "_span": span})
    return out.withColumns(
        {
            "stage": F.when(F.col("reason").isNotNull(), "clean"),
            "detail": F.when(F.col("reason") == "not_single_function", F.col("detail")),
            "suspicious_start": F.coalesce("suspicious_start", "_span.start"),
            "suspicious_end": F.coalesce("suspicious_end", "_span.end"),
        }
    ).drop("_quick", "_a", "_b", "_span")


#: Queries of one block of ``similar_texts``.
BLOCK = 500


def similar_texts(queries: DataFrame, texts: DataFrame, k: int = 3) -> DataFrame:
    """(query, id, similarity, rank): the ``k`` most similar texts of each query (id, text), by ratio, then id.

    A stated query set against all rows, in blocks of at most ``BLOCK`` queries, each a pass over the texts. A task keeps the
    best ``k`` of each query, and compares in full only texts whose letters alone don't rule them out. Null texts are
    empty; two empty ones are alike. Repeated rows each count.
    """
    number = F.row_number().over(Window.orderBy("id")) - 1
    named = queries.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_n", number)
    blocks = max(1, -(-named.count() // BLOCK))
    parts = []
    for i in range(blocks):
        block = [(r["id"], r["text"].lower()) for r in named.where(F.col("_n").between(i * BLOCK, (i + 1) * BLOCK - 1)).collect()]
        parts.append(_best_of_tasks(block, queries.schema["id"].dataType, texts, k))
    scored = functools.reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_of_tasks(block: list[tuple], kind: T.DataType, texts: DataFrame, k: int) -> DataFrame:
    schema = T.StructType([T.StructField("query", kind), texts.schema["id"], T.StructField("similarity", T.DoubleType())])

    letters = [Counter(said) for _, said in block]

    def ranked(batches):
        kept = [[] for _ in block]
        for batch in batches:
            for own, text in zip(batch["id"], batch["text"], strict=True):
                low = (text or "").lower()
                have, matcher = Counter(low), None
                for best, (_, said), want in zip(kept, block, letters, strict=True):
                    least = -best[-1][0] if len(best) == k else 0.0
                    total = len(said) + len(low)
                    # what no order of the letters can exceed, as quick_ratio has it
                    if total and round(2.0 * min(len(said), len(low)) / total, 2) < least:
                        continue
                    if total and round(2.0 * sum(min(n, have[c]) for c, n in want.items() if c in have) / total, 2) < least:
                        continue
                    if matcher is None:
                        matcher = difflib.SequenceMatcher(None, "", low)
                    matcher.set_seq1(said)
                    bisect.insort(best, (-round(matcher.ratio(), 2), own))
                    del best[k:]
        rows = [(query, own, -score) for (query, _), best in zip(block, kept, strict=True) for score, own in best]
        yield pd.DataFrame(rows, columns=["query", "id", "similarity"])

    return texts.select("id", "text").mapInPandas(ranked, schema)


@F.pandas_udf(T.BooleanType())
def compiles(source: pd.Series) -> pd.Series:
    """Whether a text is a Python program."""
    def one(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            compile(text, "file", "exec")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return source.map(one)
