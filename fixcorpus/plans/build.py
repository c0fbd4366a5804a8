"""The whole build: clean, drop duplicates, render, limit lengths, split, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff, regions
from ..functions.text import split_lines
from ..operators import cleaning, corpus
from ..sources.records import Report

STAGES = ("clean", "duplicates", "represent", "lengths")


@dataclass(frozen=True)
class Settings:
    rules: cleaning.Rules = field(default_factory=cleaning.Rules)
    strategy: str = "normalized"
    options: regions.Options = field(default_factory=regions.Options)
    limits: corpus.Limits = field(default_factory=corpus.Limits)
    ratios: tuple[tuple[str, float], ...] = (("train", 0.9), ("validation", 0.05), ("test", 0.05))
    by_project: bool = True
    seed: int = 42
    strict: bool = True


def represented(pairs: DataFrame, options: regions.Options = regions.Options(), strict: bool = True) -> DataFrame:
    """``pairs`` (with opcodes) with input, output and, where they can't be rendered, error."""
    a, b = split_lines(F.col("buggy_code")), split_lines(F.col("fixed_code"))
    start, end = F.col("suspicious_start"), F.col("suspicious_end")
    rows = pairs.withColumns({"_a": a, "_b": b, "error": regions.region_error(a, start, end)})
    rows = rows.withColumn("_r", F.when(F.col("error").isNull(), diff.aligned(F.col("ops"), start, end, F.size("_b"))))
    if strict:
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("_r.outside"), "changed outside of the region")))
    target = F.array_join(F.slice("_b", F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start")), "\n")
    fine = F.col("error").isNull()
    return rows.withColumns({"input": F.when(fine, regions.render(F.col("_a"), start, end, F.col("file_path"), options)), "output": F.when(fine, target)}).drop("_a", "_b", "_r")


def build(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All pairs in one table: stage and reason of those removed; input, output, token counts and split of the others.

    A stage tags only rows that no earlier stage removed, so the counts of the report add up by construction. The rows
    with line differences, and the finished rows, are persisted, since later steps read them more than once.
    """
    cleaned = cleaning.clean(pairs, settings.rules).persist()
    alive = cleaned.where("reason IS NULL")
    twins = corpus.duplicates(alive.select("ord", "bug_id", "buggy_code", "fixed_code", "suspicious_start", "suspicious_end"), settings.strategy).select("ord", "duplicate_of")
    rows = cleaned.join(twins.where("duplicate_of IS NOT NULL"), "ord", "left")
    twin = F.col("reason").isNull() & F.col("duplicate_of").isNotNull()
    rows = rows.withColumns(
        {
            "stage": F.when(twin, "duplicates").otherwise(F.col("stage")),
            "detail": F.when(twin, F.concat(F.lit("duplicate of "), F.col("duplicate_of"), F.lit(f" ({settings.strategy})"))).otherwise(F.col("detail")),
            "reason": F.when(twin, "duplicate").otherwise(F.col("reason")),
        }
    )
    rows = represented(rows, settings.options, settings.strict)
    wrong = F.col("reason").isNull() & F.col("error").isNotNull()
    rows = rows.withColumns({"stage": F.when(wrong, "represent").otherwise(F.col("stage")), "detail": F.when(wrong, F.col("error")).otherwise(F.col("detail")), "reason": F.when(wrong, "representation_error").otherwise(F.col("reason"))})
    rows = corpus.measured(rows)
    long = F.when(F.col("reason").isNull(), corpus.length_reason(settings.limits))
    rows = rows.withColumns({"stage": F.when(long.isNotNull(), "lengths").otherwise(F.col("stage")), "reason": F.coalesce(long, "reason")})
    rows = rows.withColumn("group_key", corpus.group_key(F.col("project"), F.col("file_path"), F.col("bug_id"))).persist()
    kept = rows.where("reason IS NULL")
    ratios = dict(settings.ratios)
    split = corpus.split_groups(kept, "group_key", ratios, settings.seed) if settings.by_project else corpus.split_records(kept, "bug_id", ratios, settings.seed)
    return rows.join(split.select("ord", "split"), "ord", "left").drop("ops", "methods", "error", "duplicate_of")


def report(built: DataFrame, ratios: dict[str, float] = dict(Settings.ratios)) -> Report:
    """The report of a build; a few small aggregates."""
    out = Report()
    out.stages = [r.asDict() for r in corpus.funnel(built, STAGES).collect()]
    out.reasons = {r["reason"]: r["n"] for r in corpus.removed_by_reason(built).collect()}
    kept = built.where("reason IS NULL")
    out.splits = {r["split"]: r["n"] for r in corpus.split_counts(kept).collect()}
    # lengths are of all pairs that reached the limits, and of the inputs that were kept
    reached = built.where((F.col("stage") == "lengths") | F.col("reason").isNull())
    out.lengths = {r["series"]: r.asDict() for r in corpus.token_stats(corpus.token_series(reached), ["series"]).collect()}
    out.empty = [r["split"] for r in corpus.empty_splits(kept, ratios).collect()]
    return out
