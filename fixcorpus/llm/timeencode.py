"""Time-ordered target encoding of a shop's sale lines.

A line's history is all lines of other folds that were sold earlier. Of them, those that share a value with the line are
counted (n), and those returned among them (s), for seven levels: all lines, the client's segment, the client, the
item's kind, the item, the vendor's nation and the vendor. A rate is smoothed towards that of the level above.

Method: lines are first summed up by sale, item and vendor, so that repeated lines of one sale meet as one row. All
seven levels then stand in one long table of (level, key, time, fold), sorted by ranges: a hot key, such as the level of
all lines, is cut by time, and a moment with very many rows by a hash. One pass of ``merge_asof`` goes over each
range in chunks of ``CHUNK`` rows; probes of one level, key, time and fold are made once, and running sums of the five
folds are carried from chunk to chunk. What came before a range in its first key is added afterwards from sums of the
ranges' last keys: a row for each range and fold, whose number is that of the partitions. The counts are then pivoted
back to a row for each sale, item and vendor.

Defined results: lines without a sale, or of a sale without a time, are dropped; null items and clients are -1, an
ordinary id; a null vendor is a value of its own; null and unknown kinds, nations and segments share one value. Repeated
lines count each. Of rows that repeat an id in ``sales``, the earliest counts (ties: the smallest client); of rows that
repeat an id in the other tables, the smallest value that isn't null. Empty tables give an empty result; further columns are
ignored. Counts are exact below 2**53 lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FOLDS = 5
#: Rows of one call of ``merge_asof``.
CHUNK = 250_000
#: Levels; those of ``BY_SALE`` depend on the sale only.
LEVELS = ("all", "segment", "client", "kind", "item", "nation", "vendor")
BY_SALE = 3


def micros(time: Column, kind: str) -> Column:
    """Microseconds since 1970; a time without a zone is taken as it stands."""
    if kind != "timestamp_ntz":
        return F.unix_micros(time)
    seconds = F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def fold_of(sale_id: Column) -> Column:
    return F.pmod(F.crc32(sale_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def keyed(table: DataFrame, id_: str, value: str, name: str) -> DataFrame:
    """(id, value as a number): each value is named by the smallest id that has it; stored, so that joins with it can be split."""
    one = table.where(F.col(id_).isNotNull()).groupBy(F.col(id_).cast("long").alias("id")).agg(F.min(value).alias("value")).where(F.col("value").isNotNull())
    first = one.groupBy("value").agg(F.min("id").alias(f"{name}_key"))
    one, first = stored(one, name), stored(first, name)
    return stored(one.join(first, "value").select(F.col("id").alias(f"{name}_of"), f"{name}_key"), name)


def facts(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """A row for each sale, item and vendor: n lines, s of them returned, the sale's time and fold, and the keys of all levels."""
    time = micros(F.col("sold_at"), dict(sales.dtypes)["sold_at"])
    sold = sales.where(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull()).select(
        F.col("sale_id").cast("long").alias("sale_id"), F.struct(time.alias("time"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id")).alias("first")
    )
    sold = stored(sold.groupBy("sale_id").agg(F.min("first").alias("first")).select("sale_id", "first.*"), "sold")
    segments = keyed(clients, "client_id", "segment", "segment")
    sold = sold.join(segments, F.col("client_id") == F.col("segment_of"), "left").drop("segment_of")
    sold = stored(sold.withColumn("fold", fold_of(F.col("sale_id"))), "sold")
    own = lines.where(F.col("sale_id").isNotNull()).select(
        F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), "flag"
    )
    own = own.groupBy("sale_id", "item_id", "vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    out = own.join(sold, "sale_id")
    out = out.join(keyed(items, "item_id", "kind", "kind"), F.col("item_id") == F.col("kind_of"), "left").drop("kind_of")
    out = out.join(keyed(vendors, "vendor_id", "nation_id", "nation"), F.col("vendor_id") == F.col("nation_of"), "left").drop("nation_of")
    return stored(out, "facts")


def unpivoted(rows: DataFrame) -> DataFrame:
    """The long table: (level, key, time, fold, n, s) with the sale and, for levels below it, the item and the vendor."""

    def entries(keys: dict[str, Column]) -> Column:
        # a missing key is told by the level's number, so that no number of a key stands for it
        return F.inline(F.array(*[F.struct((F.lit(2 * LEVELS.index(name)) + key.isNull().cast("int")).alias("level"), F.coalesce(key, F.lit(0)).cast("long").alias("key")) for name, key in keys.items()]))

    by_sale = rows.groupBy("sale_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *[F.min(c).alias(c) for c in ("time", "fold", "client_id", "segment_key")])
    none = F.lit(None).cast("long")
    upper = by_sale.select("sale_id", none.alias("item_id"), none.alias("vendor_id"), "time", "fold", "n", "s", entries({"all": F.lit(0), "segment": F.col("segment_key"), "client": F.col("client_id")}))
    lower = rows.select("sale_id", "item_id", "vendor_id", "time", "fold", "n", "s", entries({"kind": F.col("kind_key"), "item": F.col("item_id"), "nation": F.col("nation_key"), "vendor": F.col("vendor_id")}))
    return upper.unionByName(lower)


#: Of the pass: edge is 0 for rows of a range, 1 and 2 for those of its first key at the first time and later, ``FIRST``
#: and ``LAST`` for what it tells of its first and its last key.
FIRST, LAST = -1, -2
_PASSED = "sale_id long, item_id long, vendor_id long, level int, own_n long, own_s long, n long, s long, edge int, chunk int, fold int, key long, time long"


def _gathered(batches, most: int):
    import pyarrow as pa

    held, size = [], 0
    for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


class Running:
    """Sums of the folds in the last key met so far: before its last time, and at that time."""

    def __init__(self):
        self.key, self.time, self.before, self.at = None, 0, np.zeros((2, FOLDS), np.int64), np.zeros((2, FOLDS), np.int64)

    def counted(self, level, key, time, fold, n, s) -> tuple[np.ndarray, np.ndarray]:
        """n and s of the history of each row; rows come sorted by level, key and time, and go on where the last ones ended."""
        import pandas as pd

        new_key = np.concatenate([[True], (level[1:] != level[:-1]) | (key[1:] != key[:-1])])
        new_time = new_key | np.concatenate([[True], time[1:] != time[:-1]])
        moment = np.cumsum(new_time) - 1
        first = np.flatnonzero(new_time)
        group = (np.cumsum(new_key) - 1)[first]
        size = len(first) * FOLDS
        code = moment * FOLDS + fold
        at = np.stack([np.bincount(code, weights=x, minlength=size).astype(np.int64).reshape(-1, FOLDS) for x in (n, s)])
        base = np.zeros((2, FOLDS), np.int64)
        if self.key == (level[0], key[0]):
            if self.time == time[0]:
                base = self.before
                at[:, 0] += self.at
            else:
                base = self.before + self.at
        total = np.cumsum(at, axis=1)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        offset = np.concatenate([np.zeros((2, 1, FOLDS), np.int64), total[:, starts[1:] - 1]], axis=1)
        total = total - offset[:, group]
        total[:, group == 0] += base[:, None]

        asked = np.zeros(size, bool)
        asked[code] = True
        probes = np.flatnonzero(asked)
        where = (np.cumsum(asked) - 1)[code]
        times = time[first]
        right = pd.DataFrame({"time": times, "group": group, "moment": np.arange(len(first))}).sort_values("time", kind="stable")
        left = pd.DataFrame({"time": times[probes // FOLDS], "group": group[probes // FOLDS], "probe": probes}).sort_values("time", kind="stable")
        hits = pd.merge_asof(left, right, on="time", by="group", allow_exact_matches=False)
        found = np.full(len(probes), -1, np.int64)
        found[np.searchsorted(probes, hits["probe"].to_numpy())] = hits["moment"].fillna(-1).to_numpy().astype(np.int64)
        own = probes % FOLDS
        before = np.where((found >= 0)[None, :, None], total[:, found], np.where((group[probes // FOLDS] == 0)[None, :, None], base[:, None], 0))
        others = before.sum(axis=2) - np.take_along_axis(before, np.broadcast_to(own[None, :, None], (2, len(own), 1)), axis=2)[:, :, 0]

        self.key, self.time = (level[-1], key[-1]), time[-1]
        self.at, self.before = at[:, -1], total[:, -1] - at[:, -1]
        return others[0][where], others[1][where]


def _passing(most: int):
    def _pass(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        chunk = context.partitionId() if context else 0
        names = [x.split()[0] for x in _PASSED.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in _PASSED.split(", "))])
        running, begin = Running(), None
        for part in _gathered(batches, most):
            level, key, time, fold, own_n, own_s = (part.column(c).to_numpy() for c in ("level", "key", "time", "fold", "n", "s"))
            begin = begin or (level[0], key[0], time[0])
            n, s = running.counted(level, key, time, fold, own_n, own_s)
            edge = np.where((level == begin[0]) & (key == begin[1]), np.where(time == begin[2], 1, 2), 0)
            size = part.num_rows
            plain = {"level": level, "own_n": own_n, "own_s": own_s, "n": n, "s": s, "edge": edge, "fold": fold, "chunk": np.full(size, chunk)}
            columns = [part.column(c).combine_chunks() if c in ("sale_id", "item_id", "vendor_id") else pa.array(plain[c], schema.field(c).type) if c in plain else pa.nulls(size, pa.int64()) for c in names]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=50_000)
        if begin:
            last = {"level": running.key[0], "key": running.key[1], "time": running.time, "edge": LAST, "chunk": chunk}
            whole = running.before + running.at
            rows = [{"level": begin[0], "key": begin[1], "time": begin[2], "edge": FIRST, "chunk": chunk}]
            rows += [last | {"fold": f, "n": whole[0, f], "s": whole[1, f], "own_n": running.at[0, f], "own_s": running.at[1, f]} for f in range(FOLDS)]
            yield pa.RecordBatch.from_arrays([pa.array([None if x.get(c) is None else int(x[c]) for x in rows], schema.field(c).type) for c in names], schema=schema)

    return _pass


def _before(passed: DataFrame) -> DataFrame:
    """(chunk, edge, fold, add_n, add_s): what came before a range in its first key, in the other folds; ten rows for each range."""
    from pyspark.sql import Window

    lasts = passed.where(F.col("edge") == LAST).select("chunk", "level", "key", "time", "fold", "n", "s", "own_n", "own_s", F.lit(1).alias("last"))
    zero = F.lit(0).cast("long")
    firsts = passed.where(F.col("edge") == FIRST).select(
        "chunk", "level", "key", "time", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"), *[zero.alias(c) for c in ("n", "s", "own_n", "own_s")], F.lit(0).alias("last")
    )
    in_key = Window.partitionBy("level", "key", "fold").orderBy("chunk", "last").rowsBetween(Window.unboundedPreceding, 0)
    in_time = Window.partitionBy("level", "key", "time", "fold").orderBy("chunk", "last").rowsBetween(Window.unboundedPreceding, 0)
    sums = lasts.unionByName(firsts).select("chunk", "fold", "last", *[F.sum(c).over(in_key).alias(c) for c in ("n", "s")], *[F.sum(f"own_{c}").over(in_time).alias(f"at_{c}") for c in ("n", "s")])
    edges = sums.where("last = 0").select("chunk", "fold", F.inline(F.array(F.struct(F.lit(1).alias("edge"), (F.col("n") - F.col("at_n")).alias("n"), (F.col("s") - F.col("at_s")).alias("s")), F.struct(F.lit(2).alias("edge"), F.col("n"), F.col("s")))))
    all_folds = Window.partitionBy("chunk", "edge")
    return edges.select("chunk", "edge", "fold", *[(F.sum(c).over(all_folds) - F.col(c)).alias(f"add_{c}") for c in ("n", "s")])


def counted(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Of each row of the long table: n and s of its history at its level."""
    salt = F.hash("sale_id", "item_id", "vendor_id")
    sorted_ = rows.repartitionByRange("level", "key", "time", salt).sortWithinPartitions("level", "key", "time")
    passed = stored(sorted_.select("sale_id", "item_id", "vendor_id", "level", "key", "time", "fold", "n", "s").mapInArrow(_passing(chunk), _PASSED), "passed")
    own = passed.where(F.col("edge") >= 0)
    # a few rows for each partition
    added = own.join(F.broadcast(_before(passed)), ["chunk", "edge", "fold"], "left")
    more = lambda c: (F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c)
    return added.select("sale_id", "item_id", "vendor_id", F.expr("level div 2").cast("int").alias("level"), "own_n", "own_s", more("n"), more("s"))


def rate(n: Column, s: Column, prior: Column, weight: int = 50) -> Column:
    """Parts in a million, smoothed by ``weight`` lines at ``prior``."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", F.lit(1_000_000) * s + weight * prior, n + weight))


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(sale_id, item_id, vendor_id, n_lines, n_returned, item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate, all_rate)."""
    long = counted(unpivoted(facts(lines, sales, items, vendors, clients)), chunk)
    of = lambda name, c: F.max(F.when(F.col("level") == LEVELS.index(name), F.col(c))).alias(f"{name}_{c}")
    by_sale = long.where(F.col("level") < BY_SALE).groupBy("sale_id").agg(*[of(x, c) for x in LEVELS[:BY_SALE] for c in ("n", "s")])
    col = F.col
    by_sale = by_sale.withColumn("all_rate", rate(col("all_n"), col("all_s"), F.lit(500_000).cast("long")))
    by_sale = by_sale.select("sale_id", "client_n", rate(col("client_n"), col("client_s"), rate(col("segment_n"), col("segment_s"), col("all_rate"))).alias("client_rate"), "all_rate")
    by_sale = stored(by_sale, "sold")
    each = long.where(F.col("level") >= BY_SALE).groupBy("sale_id", "item_id", "vendor_id")
    each = each.agg(F.max("own_n").alias("n_lines"), F.max("own_s").alias("n_returned"), *[of(x, c) for x in LEVELS[BY_SALE:] for c in ("n", "s")])
    return each.join(by_sale, "sale_id").select(
        "sale_id", "item_id", "vendor_id", "n_lines", "n_returned",
        "item_n", rate(col("item_n"), col("item_s"), rate(col("kind_n"), col("kind_s"), col("all_rate"))).alias("item_rate"),
        "vendor_n", rate(col("vendor_n"), col("vendor_s"), rate(col("nation_n"), col("nation_s"), col("all_rate"))).alias("vendor_rate"),
        "client_n", "client_rate", "all_rate",
    )


def crc32_sql(bytes_: str) -> str:
    """CRC-32 of a list of bytes in DuckDB's SQL."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, i: {step}, xor(r, b))"
    return f"xor(list_reduce({bytes_}, lambda r, b: {byte}, 4294967295::BIGINT), 4294967295)"


def sql() -> str:
    """The contract in DuckDB's SQL: running sums by windows, those of the own fold taken off."""
    levels = {"a": "0", "g": "segment", "c": "client_id", "k": "kind", "i": "item_id", "t": "nation_id", "v": "vendor_id"}
    one = lambda c, of, by: f"coalesce(sum({of}) OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    sums = ", ".join(f"({one(c, of, by)} - {one(c, of, by + ', fold')})::BIGINT AS {c}_{of}" for c, by in levels.items() for of in ("n", "s"))
    rated = lambda n, s, p: f"(CASE WHEN {n} < 1 THEN {p} ELSE (1000000 * {s} + 50 * {p}) // ({n} + 50) END)"
    crc = crc32_sql("list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")
    return f"""WITH sold AS (SELECT sale_id, min({{'t': epoch_us(sold_at), 'c': coalesce(client_id, -1)}}) AS f FROM sales WHERE sale_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY sale_id),
folded AS (SELECT sale_id, f.t AS t, f.c AS client_id, {crc} % 5 AS fold FROM sold),
i AS (SELECT item_id, min(kind) AS kind FROM items GROUP BY item_id),
v AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id),
c AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY client_id),
own AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (flag = 'returned') AS s FROM sale_lines GROUP BY ALL),
facts AS (SELECT own.*, t, fold, client_id, kind, nation_id, segment FROM own JOIN folded USING (sale_id)
  LEFT JOIN i USING (item_id) LEFT JOIN v USING (vendor_id) LEFT JOIN c USING (client_id)),
counts AS (SELECT sale_id, item_id, vendor_id, n, s, {sums} FROM facts),
overall AS (SELECT *, {rated("a_n", "a_s", "500000")} AS all_rate FROM counts)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned,
  i_n AS item_n, {rated("i_n", "i_s", rated("k_n", "k_s", "all_rate"))}::BIGINT AS item_rate,
  v_n AS vendor_n, {rated("v_n", "v_s", rated("t_n", "t_s", "all_rate"))}::BIGINT AS vendor_rate,
  c_n AS client_n, {rated("c_n", "c_s", rated("g_n", "g_s", "all_rate"))}::BIGINT AS client_rate,
  all_rate::BIGINT AS all_rate
FROM overall"""
