"""Near-duplicates: MinHash signatures joined by a multi-index Hamming search, links confirmed on whole sets.

A document's set holds its distinct shingles of ``width`` words (all words as one shingle if there are fewer). Documents
with equal sets are one class. A class has a signature of ``SIZE`` 16-bit MinHash values; the distance of two signatures
is the number of values that differ. Sets of the wanted similarity s lie within ``reach`` of each other: the expected
distance SIZE * (1 - s) and five standard deviations.

A signature is split into more than ``reach / 2`` chunks, so of two signatures within reach some chunk has at most one
error. Keys enumerate the allowed errors: a chunk without its first value, without its second, and so on. Every pair
within reach meets in some key.

Pairs are never emitted, since those of a group grow with the square of its size. What is looked for are the components
of links, and a component needs one tree of them. So both steps search breadth-first, from a class to those not reached
yet (``linked``), and emit a class and the root of its tree:

1. ``clusters``: among the classes of a key, a step leads to signatures within reach (compared by their low bytes, which
   can only make them nearer) and of fitting set sizes. Trees that share a class make a cluster.
2. ``confirmed``: among the classes of a cluster, a step leads to sets of the wanted similarity, counted on the whole sets
   of the texts, which are sent once for each class.

A key or cluster larger than ``UNIT`` is dealt out in blocks, and some of its classes (``PIVOTS``) go to each block. Only
where that leaves a group in more than one tree, its largest tree is compared with the rest, block by block (``connected``).

Shingles are compared as 64-bit hashes. Defined results: a null or empty text has no shingles, is linked with nothing and
is its own component; repeated rows and rows that share an id are rows of their own, and each is kept if its id is its
component's smallest; null ids count last, and are kept only where the set is empty or no row of the component has an id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, distinct, hinted, mix, sliding_hash, stored, text_tiles, word_hashes
from .repeats import by_key

SIZE = 128
#: Classes of one group that a task compares with each other, and shingles in their sets; larger groups are dealt out.
UNIT = 4096
WEIGHT = 2_000_000
PIVOTS = 16
#: Groups of up to so many classes have all their signatures compared at once.
SMALL = 24
_FACTORS = np.random.default_rng(7).integers(1, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(8).integers(1, 2**63, SIZE, dtype=np.uint64)


def reach_of(similarity: float, size: int = SIZE) -> int:
    return int(size * (1 - similarity) + 5 * (size * similarity * (1 - similarity)) ** 0.5)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, of, _, _ = word_hashes(texts, lower=True)
    edge = np.searchsorted(of, np.arange(len(texts) + 1))
    grams = sliding_hash(words, width)
    out = []
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(distinct(grams[a : z - width + 1]))
        else:
            out.append(sliding_hash(words[a:z], z - a) if z > a else words[:0])
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit MinHash values for each set that isn't empty: the low bytes of all values, then the high ones."""
    values = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * SIZE), dtype=np.uint8)
    for i in range(SIZE):
        least = mix(np.minimum.reduceat(values * _FACTORS[i] + _SHIFTS[i], begin))
        out[:, i] = (least & np.uint64(0xFF)).astype(np.uint8)
        out[:, SIZE + i] = (least >> np.uint64(8) & np.uint64(0xFF)).astype(np.uint8)
    return out


def measured(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, n, digest, sig) of every row; digest identifies the set, and fp the text of the row."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, digests, sigs = [], [], []
            for _, texts in text_tiles(batch):
                sets = shingle_sets(texts, width)
                some = [s for s in sets if len(s)]
                rows = iter(signature(some)) if some else iter(())
                for s in sets:
                    row = next(rows) if len(s) else None
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(row.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fp"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "fp", "n", "digest", "sig"]
            )

    kinds = [docs.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    return docs.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(run, T.StructType(kinds))


def chunk_edges(reach: int) -> list[int]:
    chunks = reach // 2 + 1
    return [i * SIZE // chunks for i in range(chunks + 1)]


def keys_of(classes: DataFrame, reach: int) -> DataFrame:
    """(key, node): for each chunk of the signature and each value left out of it."""
    edges = chunk_edges(reach)
    keys = []
    for c, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
        for out in range(a, z):
            rest = [F.substring("sig", at + 1, to - at) for k in (0, SIZE) for at, to in ((k + a, k + out), (k + out + 1, k + z)) if to > at]
            keys.append(F.xxhash64(F.lit(c), F.lit(out - a), F.concat(*rest)))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "node")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key more than one class has.

    The rows of a key stream through one task in order; none but the last is held.
    """
    def run(batches):
        import pyarrow as pa

        def rows(key, node):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

        key, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            same = key[1:] == key[:-1]
            shared = np.concatenate([[before], same]) | np.concatenate([same, [False]])
            yield rows(key[:-1][shared[:-1]], node[:-1][shared[:-1]])
            key, node, before = key[-1:], node[-1:], bool(shared[-1])
        if before:
            yield rows(key, node)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def linked(label: np.ndarray, step: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (root, member) of trees over all rows, in which ``step(i, others)`` says which others i leads to.

    Rows of one label are of one tree from the start.
    """
    edges: list[tuple[int, int]] = []
    _, label = np.unique(label, return_inverse=True)
    apart = int(label.max()) + 1 == len(label)
    rest = np.arange(len(label))
    while len(rest):
        root = rest[0]
        if apart:
            queue, rest = [root], rest[1:]
        else:
            mates = label[rest] == label[root]
            queue, rest = rest[mates].tolist(), rest[~mates]
        while queue and len(rest):
            hit = step(int(queue.pop()), rest)
            if not hit.any():
                continue
            if not apart:
                hit = np.isin(label[rest], label[rest[hit]])
            found, rest = rest[hit], rest[~hit]
            edges += [(int(root), int(i)) for i in found.tolist()]
            queue += found.tolist()
    return edges


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that isn't the smallest of its component, for edges (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


_EDGES = "node long, other long"


def edges_in(units: DataFrame, pairs: Callable) -> DataFrame:
    """(node, other): trees over the rows of each unit (grp, block); ``pairs(columns, edge)`` finds the edges of some units.

    ``edge`` holds where each unit begins and ends. Trees of one task that share a node are made one, so that it sends
    a node once.
    """
    def run(batches):
        import pyarrow as pa

        def sent(found):
            node, root = forest(*map(np.concatenate, zip(*found, strict=True)))
            for at in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 50_000]), pa.array(root[at : at + 50_000])], names=["node", "other"])

        found, held = [], 0
        for batch in by_key(batches, ("grp", "block")):
            grp, block = batch.column("grp").to_numpy(), batch.column("block").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (block[1:] != block[:-1]), [True]]))
            for a, b in pairs(batch, edge):
                found.append((a, b))
                held += len(a)
            if held > 500_000:
                yield from sent(found)
                found, held = [], 0
        if held:
            yield from sent(found)

    return units.repartition("grp", "block").sortWithinPartitions("grp", "block", "node").mapInArrow(run, _EDGES)


def components(links: DataFrame) -> DataFrame:
    """(node, part): the smallest node that each linked node reaches.

    Each step takes the smallest label among the neighbours and then that label's own label.
    """
    both = cut(links.union(links.select("other", "node")).toDF("node", "other").distinct())
    parts = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("part")))
    while True:
        heard = both.join(parts.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("part").alias("heard"))
        moved = parts.join(heard, "node").select("node", "part", F.least("part", "heard").alias("new"))
        jump = parts.select(F.col("node").alias("new"), F.col("part").alias("jump"))
        after = cut(moved.join(jump, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("new"), "part"))
        parts = after.select("node", F.col("new").alias("part"))
        if after.where("new <> part").isEmpty():
            return parts


def connected(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], pairs: Callable) -> DataFrame:
    """(node, part): components of what ``pairs`` finds among the rows of each group.

    ``rows``: (grp, node, weight), weights adding up to 1 for what one task may compare. ``payload`` adds the columns that
    ``pairs`` needs.
    """
    heavy = stored(rows.groupBy("grp").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 1").withColumnRenamed("grp", "_grp"), "heavy")
    many = not heavy.isEmpty()
    units = rows.withColumn("block", F.lit(0).cast("long"))
    if many:
        dealt = rows.join(heavy, F.col("grp") == F.col("_grp"), "left")
        blocks = F.ceil(F.coalesce("total", F.lit(1.0))).cast("long")
        pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.col("n") / PIVOTS).cast("long")) == 0
        at = F.when((blocks > 1) & pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks)))
        units = dealt.select("grp", "node", F.explode(at).alias("block"))
    first = cut(edges_in(payload(units.select("grp", "block", "node").withColumn("part", F.col("node"))), pairs))
    parts = components(first)
    if not many:
        return parts
    # groups that are still in several trees: the largest against the rest, and the rest among themselves
    named = rows.join(heavy.select("_grp"), F.col("grp") == F.col("_grp")).join(parts, "node", "left").select("grp", "node", "weight", F.coalesce("part", "node").alias("part"))
    named = stored(named, "trees")
    sums = named.groupBy("grp", "part").agg(F.sum("weight").alias("w")).groupBy("grp").agg(F.max(F.struct("w", "part")).alias("m"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("trees"))
    sums = sums.where("trees > 1").select(F.col("grp").alias("_grp"), F.col("m.part").alias("_main"), F.ceil("m.w").cast("long").alias("_mains"), F.greatest(F.lit(1), F.ceil(F.col("w") - F.col("m.w"))).cast("long").alias("_rests"))
    sums = stored(sums, "sums")
    if sums.isEmpty():
        return parts
    split = named.join(sums, F.col("grp") == F.col("_grp"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("part") == F.col("_main"), F.col("_mains")).otherwise(F.col("_rests")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    unit = lambda kind, i, j: F.xxhash64(F.lit(kind), i, j)
    among = F.transform(upto(F.col("_rests")), lambda j: unit("rest", F.least(F.col("_own"), j), F.greatest(F.col("_own"), j)))
    at = F.when(F.col("part") == F.col("_main"), F.transform(upto(F.col("_rests")), lambda j: unit("main", F.col("_own"), j))).otherwise(
        F.concat(F.transform(upto(F.col("_mains")), lambda i: unit("main", i, F.col("_own"))), among)
    )
    units = split.withColumn("_own", own).select("grp", F.explode(at).alias("block"), "node", "part")
    second = cut(edges_in(payload(units), pairs))
    return components(first.union(second))


def clusters(classes: DataFrame, reach: int, similarity: float) -> DataFrame:
    """(node, part): components of signatures within reach, found among the classes of each key."""
    keys = stored(shared_keys(keys_of(classes, reach)).select(F.col("key").alias("grp"), "node", F.lit(1.0 / UNIT).alias("weight")), "keys")
    own = classes.select("node", F.col("n").cast("int").alias("n"), F.substring("sig", 1, SIZE).alias("low"))

    def pairs(batch, edge):
        node, part, n = (batch.column(c).to_numpy() for c in ("node", "part", "n"))
        low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, SIZE)
        fits = lambda x, y: np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
        near = lambda x, y: np.count_nonzero(low[x] != low[y], axis=-1) <= reach
        size = np.diff(edge)
        for k in range(2, SMALL + 1):
            begin = edge[:-1][size == k]
            i, j = np.triu_indices(k, 1)
            for at in range(0, len(begin), max(1, 50_000 // len(i))):
                own = begin[at : at + max(1, 50_000 // len(i)), None]
                x, y = (own + i).ravel(), (own + j).ravel()
                ok = fits(x, y)
                x, y = x[ok], y[ok]
                ok = near(x, y) & (part[x] != part[y])
                if ok.any():
                    yield node[x[ok]], node[y[ok]]
        for a, z in zip(edge[:-1][size > SMALL].tolist(), edge[1:][size > SMALL].tolist(), strict=True):
            def step(i, rest, a=a):
                out = fits(a + i, a + rest)
                out[out] = near(a + i, a + rest[out])
                return out

            found = np.array(linked(part[a:z], step), np.int64).reshape(-1, 2) + a
            if len(found):
                yield node[found[:, 0]], node[found[:, 1]]

    return connected(keys, lambda units: units.join(own, "node"), pairs)


def confirmed(docs: DataFrame, classes: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, part): components of 100 * intersection >= percent * union, counted on whole sets, among the classes of each cluster."""
    wanted = stored(parts.join(classes.select("node", "doc_id", "fp", "n"), "node"), "wanted")
    key = F.xxhash64("doc_id", "fp")
    own = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    own = hinted(own, key, wanted.select(key.alias("key")), "_wanted").where("_wanted").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "text")
    texts = stored(own.join(wanted.select("node", "doc_id", "fp"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_fp") == F.col("fp"))).groupBy("node").agg(F.first("text").alias("text")), "texts")
    rows = wanted.select(F.col("part").alias("grp"), "node", F.greatest(F.lit(1.0 / UNIT), F.col("n") / WEIGHT).alias("weight"))

    def pairs(batch, edge):
        node, part = batch.column("node").to_numpy(), batch.column("part").to_numpy()
        texts = batch.column("text")
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if z - a < 2:
                continue
            sets = [s for at in range(a, z, 64) for s in shingle_sets([t.encode() for t in texts.slice(at, min(64, z - at)).to_pylist()], width)]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            end = np.cumsum(size)
            begin = end - size
            mark = np.zeros(int(ids.max()) + 1, np.int64)

            def step(i, rest, size=size, ids=ids, begin=begin, end=end, mark=mark):
                out = 100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])
                some = rest[out]
                if len(some):
                    mark[ids[begin[i] : end[i]]] = 1
                    sizes = size[some]
                    ends = np.cumsum(sizes)
                    places = np.repeat(begin[some] - (ends - sizes), sizes) + np.arange(ends[-1])
                    both = np.add.reduceat(mark[ids[places]], ends - sizes)
                    mark[ids[begin[i] : end[i]]] = 0
                    out[out] = 100 * both >= percent * (size[i] + sizes - both)
                return out

            found = np.array(linked(part[a:z], step), np.int64).reshape(-1, 2) + a
            if len(found):
                yield node[found[:, 0]], node[found[:, 1]]

    return connected(rows, lambda units: units.join(texts, "node"), pairs)


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, kept) of every row of ``docs``."""
    similarity = percent / 100
    reach = reach_of(similarity)
    sets = stored(measured(docs, width).withColumn("row", F.monotonically_increasing_id()), "sets")
    some = sets.where("n > 0")
    chosen = some.groupBy("digest").agg(F.min("row").alias("row"))
    classes = stored(some.join(chosen.withColumnRenamed("digest", "_d"), "row").select(F.col("row").alias("node"), "doc_id", "fp", "n", "digest", "sig"), "classes")
    parts = confirmed(docs, classes, clusters(classes, reach, similarity), width, percent)

    named = classes.select("digest", "node").join(parts, "node", "left").select("digest", F.coalesce("part", "node").alias("part"))
    rows = some.select("digest", "doc_id").groupBy("digest").agg(F.min("doc_id").alias("least"))
    labels = named.join(rows, "digest")
    least = labels.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = labels.join(least, "part").select(F.col("digest").alias("_d"), "component_id")
    out = sets.join(labels, sets["digest"] == labels["_d"], "left")
    empty = F.col("n") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "fp", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
