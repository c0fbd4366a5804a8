"""Duplicates, lengths, statistics and splits of a corpus."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, token_count

SPLITS = ("train", "validation", "test")
#: Upper edges of the buckets of a length histogram (fixed values).
EDGES = (64, 128, 256, 512, 1024, 2048)


def group_key(project: Column, path: Column, bug_id: Column) -> Column:
    """Project, else path, else id; empty counts as missing."""
    return F.coalesce(F.nullif(project, F.lit("")), F.nullif(path, F.lit("")), bug_id)


def duplicates(pairs: DataFrame, strategy: str = "normalized", order: str = "ord", id_col: str = "bug_id") -> DataFrame:
    """``pairs`` with duplicate_of: the id of the first pair, by ``order``, with an equal fingerprint; null for the first itself.

    Only fingerprints and ids meet: the first pair of each fingerprint is an aggregate that combines in each task, so a
    fingerprint of very many copies is no large group; it is joined back by fingerprint. A pair with a null side is a
    copy of none.
    """
    optional = [F.col(c) if c in pairs.columns else None for c in ("suspicious_start", "suspicious_end")]
    # never null, so that no filter computes the fingerprint once more
    own = fingerprint(F.col("buggy_code"), F.col("fixed_code"), strategy, *optional)
    marked = pairs.withColumn("_fp", F.coalesce(own, F.concat(F.lit("none "), F.col(id_col).cast("string")), F.lit("none")))
    first = marked.select("_fp", order, id_col).groupBy("_fp").agg(F.min(F.struct(F.col(order), F.col(id_col))).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return marked.join(first, "_fp", "left").withColumn("duplicate_of", F.when(F.col(order) > F.col(f"_first.{order}"), F.col(f"_first.{id_col}"))).drop("_fp", "_first", "_n")


@dataclass(frozen=True)
class Limits:
    max_input: int | None = 1024
    max_output: int | None = 256
    max_total: int | None = None
    min_output: int = 0

    def __post_init__(self):
        if any(x is not None and x < 1 for x in (self.max_input, self.max_output, self.max_total)) or self.min_output < 0:
            raise ValueError("limits must be 1 or more")


def measured(records: DataFrame, counter=token_count) -> DataFrame:
    """Token counts of input and output; ``counter`` is a Column function, or an Arrow function of a Column."""
    return records.withColumns({"input_tokens": counter(F.col("input")), "output_tokens": counter(F.col("output"))})


def length_reason(limits: Limits = Limits()) -> Column:
    """The first limit that fails: input, output, too little output, total."""
    i, o = F.col("input_tokens"), F.col("output_tokens")
    never = F.lit(False)
    return (
        F.when(i > limits.max_input if limits.max_input else never, "input_too_long")
        .when(o > limits.max_output if limits.max_output else never, "output_too_long")
        .when(o < limits.min_output, "output_too_long")
        .when(i + o > limits.max_total if limits.max_total else never, "input_too_long")
    )


def token_stats(values: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """count, total, min, max, mean, median and nearest-rank p90, p95, p99 by group.

    Equal lengths are counted before they meet, and ranks come from running counts over the distinct lengths. A null counts
    as a row, ranks after all lengths, and is left out of total, min, max and median.
    """
    counted = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    known = F.sum(F.when(F.col(value).isNotNull(), F.col("c"))).over(whole)
    rows = counted.withColumns({"upto": F.sum("c").over(running), "all": F.sum("c").over(whole), "known": known})
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col(value)))
    rank = lambda f: F.bround(F.lit(f) * (F.col("all") - 1), 0).cast("long")
    return rows.groupBy(*by).agg(
        F.sum("c").alias("count"),
        F.sum(F.col(value) * F.col("c")).alias("total"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 2).alias("mean"),
        ((at(F.floor((F.col("known") - 1) / 2)) + at(F.floor(F.col("known") / 2))) / 2.0).alias("median"),
        *[at(rank(f)).alias(f"p{int(f * 100)}") for f in (0.90, 0.95, 0.99)],
    )


def histogram(values: DataFrame, value: str = "n", edges: tuple[int, ...] = EDGES) -> DataFrame:
    """(bucket, n): rows in (edge before, edge], zero counts included; a value of 0 lies in no bucket."""
    low = [0, *edges]
    names = [*(f"{a}-{b}" for a, b in zip(low, edges, strict=False)), f">{edges[-1]}"]
    bounds = [*zip(low, edges, strict=False), (edges[-1], None)]
    sums = [F.count_if((F.col(value) > a) & (F.col(value) <= b if b else F.lit(True))).alias(n) for n, (a, b) in zip(names, bounds, strict=True)]
    return values.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in names])))


def _greedy(ordered: Column, ratios: dict[str, float], total: Column) -> Column:
    """Each group, in order, to the split that it fills least: (size there so far + size) / wanted size, ties by name."""
    names = sorted(n for n, r in ratios.items() if r > 0)
    wanted = {n: F.greatest(F.lit(float(ratios[n])) * total, F.lit(1e-9)) for n in names}
    start = F.struct(*[F.lit(0).cast("long").alias(f"c_{n}") for n in names], F.array().cast("array<struct<key:string,split:string>>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        load = F.array_min(F.array(*[F.struct(((acc[f"c_{n}"] + g["size"]) / wanted[n]).alias("load"), F.lit(n).alias("split")) for n in names]))["split"]
        return F.struct(
            *[(acc[f"c_{n}"] + F.when(load == n, g["size"]).otherwise(F.lit(0))).alias(f"c_{n}") for n in names],
            F.concat(acc["out"], F.array(F.struct(g["key"].alias("key"), load.alias("split")))).alias("out"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def hash_order(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def check_ratios(ratios: dict[str, float]) -> None:
    if abs(sum(ratios.values()) - 1) > 1e-6 or min(ratios.values()) < 0 or not set(ratios) <= set(SPLITS):
        raise ValueError("ratios must be of train, validation and test, and add up to 1")


def split_groups(records: DataFrame, key: str, ratios: dict[str, float], seed: int = 42, shuffle: str = "hash") -> DataFrame:
    """``records`` with split; all rows of a key go to one split.

    Only keys and sizes are gathered: the largest first, then in an order by hash of the seed, or in Python's own order
    after ``random.Random(seed).shuffle`` for equal results with programs that use it. The fold runs over one row that
    holds all keys, which suits projects (up to about a million keys), not records.
    """
    check_ratios(ratios)
    sizes = records.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("size"))
    if shuffle == "python":
        rows = sorted((r["key"], r["size"]) for r in sizes.collect())
        random.Random(seed).shuffle(rows)
        sizes = records.sparkSession.createDataFrame([(k, s, f"{i:012d}") for i, (k, s) in enumerate(rows)], "key string, size long, place string")
    else:
        sizes = sizes.withColumn("place", hash_order(seed, F.col("key")))
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("big"), "place", "key", "size"))).alias("groups"), F.sum("size").alias("total"))
    chosen = ordered.select(F.inline(_greedy(F.col("groups"), ratios, F.col("total"))))
    return records.join(chosen.withColumnRenamed("key", "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def split_records(records: DataFrame, id_col: str, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """``records`` with split: in hash order, cut at round(ratio * n).

    Ranks come from a range partitioning by hash: rows are counted by the first digits of the hash, and a row's rank is
    the count before its digits and its place among them.
    """
    check_ratios(ratios)
    marked = records.withColumn("_h", hash_order(seed, F.col(id_col))).withColumn("_head", F.substring("_h", 1, 4))
    heads = marked.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = heads.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    ranked = marked.join(before.drop("_n"), "_head").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy("_h", id_col)))
    first = F.bround(F.lit(float(ratios.get("train", 0))) * F.col("_all"), 0)
    second = first + F.bround(F.lit(float(ratios.get("validation", 0))) * F.col("_all"), 0)
    split = F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_head", "_before", "_all", "_rank")


def split_counts(records: DataFrame) -> DataFrame:
    """(split, n, share) of all three splits, empty ones included."""
    sums = records.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count(F.lit(1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n"), (F.col(s) / F.greatest("all", F.lit(1))).alias("share")) for s in SPLITS])
    return sums.select(F.inline(rows))


def funnel(tagged: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(position, stage, received, kept, removed): one pass over rows tagged with the stage that rejected them, null if none."""
    sums = [F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("stage") == s).alias(f"r_{s}") for s in stages]]
    rows, received = [], F.col("all")
    for i, s in enumerate(stages):
        kept = received - F.col(f"r_{s}")
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), received.alias("received"), kept.alias("kept"), F.col(f"r_{s}").alias("removed")))
        received = kept
    return tagged.agg(*sums).select(F.inline(F.array(*rows)))


def removed_by_reason(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def total_tokens() -> Column:
    """Tokens of input and output together; null until both are known."""
    return F.col("input_tokens") + F.col("output_tokens")


def token_series(measured_rows: DataFrame) -> DataFrame:
    """(series, n): input, output and total of all rows, and input_kept of those without a reason; feeds ``token_stats``."""
    one = lambda name, value: F.struct(F.lit(name).alias("series"), value.alias("n"))
    kept = F.when(F.col("reason").isNull(), F.col("input_tokens"))
    series = F.array(one("input", F.col("input_tokens")), one("output", F.col("output_tokens")), one("total", total_tokens()), one("input_kept", kept))
    return measured_rows.select(F.inline(series)).where("n IS NOT NULL")


def truncations(prompt_tokens: Column, completion_tokens: Column, most: int) -> list[Column]:
    """Aggregates seen and truncated: examples, and those that exceed ``most`` with a token at each end."""
    return [F.count(F.lit(1)).alias("seen"), F.count_if(prompt_tokens + completion_tokens + 2 > most).alias("truncated")]


def empty_splits(records: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(split): splits with a positive share that no record is in; none of the shares depends on the records."""
    wanted = records.sparkSession.createDataFrame([(s,) for s in SPLITS if ratios.get(s, 0) > 0], "split string")
    return wanted.join(records.select("split").distinct(), "split", "left_anti")


def sampled(records: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` records, or all if there are fewer; a smaller one is a part of a larger one."""
    return records.orderBy(hash_order(seed, F.col(id_col).cast("string")), id_col).limit(n)


def trainable(records: DataFrame, most: int, fill: str = "<FILL_ME>") -> DataFrame:
    """Records whose input has a fill token and whose total length is at most ``most``; unmeasured ones are left out."""
    return records.where(F.col("input").contains(fill) & (total_tokens() <= most))
