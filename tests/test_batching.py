import hashlib

import pytest
from pyspark.sql import functions as F

from fixcorpus.operators.batching import length_batches, paddings


def _numbered(rows, size):
    digest = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[1] or 0, digest(r[0]), r[0]))
    return {k: (n or 0, i // size, i % size) for i, (k, n) in enumerate(order)}


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_every_row_has_one_place_in_order_of_length(spark, digits):
    rows = [(i, 7 if i % 3 == 0 else i * 37 % 5000) for i in range(900)] + [(900, None), (901, 0), (902, 1_000_000)]
    got = length_batches(spark.createDataFrame(rows, "id long, n int"), F.col("n"), F.col("id"), 32, digits)
    assert got.columns == ["id", "n", "length", "batch", "slot"]
    assert {r.id: (r.length, r.batch, r.slot) for r in got.collect()} == _numbered(rows, 32)


def test_repeated_and_null_keys_clashing_names_and_empty_tables(spark):
    rows = [(None, 3)] * 5 + [(1, 3)] * 5 + [(2, None)]
    df = spark.createDataFrame(rows, "key long, length int").withColumns({"hash": F.lit("h"), "head": F.lit(1), "batch": F.lit(9), "row": F.lit(2)})
    got = length_batches(df, F.col("length"), F.col("key"), 4)
    assert got.columns == ["key", "hash", "head", "row", "length", "batch", "slot"]
    assert sorted((r.batch, r.slot) for r in got.collect()) == [(i // 4, i % 4) for i in range(11)]
    assert {r.hash for r in got.collect()} == {"h"} and got.where("key = 2").head().length == 0
    assert length_batches(df.limit(0), F.col("length"), F.col("key"), 4).count() == 0
    with pytest.raises(ValueError):
        length_batches(df, F.col("length"), F.col("key"), 0)


def test_waste_is_less_than_in_any_order(spark):
    rows = spark.createDataFrame([(i, i * 7919 % 1000 + 1) for i in range(960)], "id long, n int")
    near = paddings(length_batches(rows, F.col("n"), F.col("id"), 32))
    mixed = paddings(rows.select((F.col("id") / 32).cast("long").alias("batch"), F.col("n").alias("length")))
    near, mixed = near.collect(), mixed.collect()
    assert sum(r.used for r in near) == sum(r.used for r in mixed) == sum(i * 7919 % 1000 + 1 for i in range(960))
    assert all(r.width % 8 == 0 and r.wasted == r.n * r.width - r.used for r in near)
    assert 10 * sum(r.wasted for r in near) < sum(r.wasted for r in mixed)
    cut = paddings(length_batches(rows, F.col("n"), F.col("id"), 32), most=100).collect()
    assert max(r.width for r in cut) == 100 and all(r.wasted >= 0 for r in cut)
