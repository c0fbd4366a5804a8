"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master, whose tasks run in this process, gets a temporary one; a cluster is
    refused, since executors on other machines couldn't read it.
    """
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if there:
        if known.isEmpty():
            context.setCheckpointDir(there)
        return there
    if not known.isEmpty():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fixcorpus-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder; its files go when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Each thread's own list, so that runs beside each other in one session don't delete each other's tables.
_given = threading.local()


def _tables() -> list[str]:
    """Places of tables given out to this thread by ``scratch`` and not yet dropped."""
    return _given.__dict__.setdefault("paths", [])


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _tables().append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back, so that its size is known to the planner."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def given_out() -> int:
    """How many places ``scratch`` has given out to this thread that aren't dropped."""
    return len(_tables())


def drop_stored(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables given out to this thread after the first ``since``, except for the last ``but``. Nothing still to be computed may read them."""
    for path in _tables()[since : len(_tables()) - but]:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete the table at ``path``. Nothing still to be computed may read it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _tables():
        _tables().remove(path)


#: Rows of one Arrow batch: documents are long, and a batch of them is held several times over on its way.
ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ROWS`` rows, if they may be larger, and the texts that describe plans to 100 KB.

    The driver keeps a plan's description for each query, and a literal rank map makes one of several MB.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.maxPlanStringLength", 100_000)):
        if not 0 < int(spark.conf.get(name).removesuffix("b")) <= most:
            spark.conf.set(name, str(most))


#: Bits of the filter that ``hinted`` broadcasts: 4 MB at most, however many keys there are.
FILTER_BITS = 1 << 25


def hinted(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only if ``key`` (long) isn't in the one column of ``wanted``.

    The keys become a bitmap of ``FILTER_BITS`` bits, so what is broadcast is bounded; with more keys than bits, more
    rows are true that needn't be.
    """
    place = lambda c: F.pmod(c, F.lit(FILTER_BITS)) + 1
    own = place(F.col(wanted.columns[0]))
    number, bits = fresh(rows, "_number"), fresh(rows, "_bits")
    maps = wanted.groupBy(F.bitmap_bucket_number(own).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(bits))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    true = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col(number), "left")
    return joined.withColumn(name, true).drop(number, bits)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


# -- words of many texts as arrays ---------------------------------------------------------------

#: Fixed random values, one for each byte, and an odd base: a word's hash is a polynomial over them, modulo 2**64.
_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tiles(texts: list[bytes], most: int = 1 << 18):
    """(first, end) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of all words, in order: 64-bit hash, number of the text, first byte in the text, end.

    Then, for each size in ``prefixes``, a hash of the word's first bytes, or 0 where the word isn't longer.
    Work arrays take about 40 bytes for each byte of ``texts``; callers hand over ``tiles``.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(1 << max(10, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    heads = [np.where(end - start > n, mix((total[np.minimum(start + n, end)] - total[start]) * inverse[start] + np.uint64(1000 + n)), np.uint64(0)) for n in prefixes]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, start, side="right") - 1
    return hashes, of, start - begins[of], end - begins[of], *heads


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def sliding_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i : i + len(out)]
    return mix(out)


def encoded(values) -> list[bytes]:
    """Texts as UTF-8; null is empty. Lone surrogates can't come out of Spark's strings."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") if isinstance(v, str) else bytes(v) for v in values]


def package_dir() -> str:
    return os.path.dirname(os.path.abspath(__file__))


def text_tiles(batch, column: str = "text", most: int = 1 << 18):
    """(first row, texts as UTF-8) of a record batch, about ``most`` bytes at a time; a null is empty."""
    yield from column_tiles(batch.column(column), most)


def column_tiles(column, most: int = 1 << 18):
    import pyarrow as pa

    values = column.cast(pa.binary())
    for at in range(0, len(values), 512):
        texts = [v or b"" for v in values.slice(at, 512).to_pylist()]
        for a, b in tiles(texts, most):
            yield at + a, texts[a:b]
