"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of n words is found wherever a passage lies within floor(n * (1 - similarity)) word edits of it. With an
error budget of k, the item is split into k + 1 pieces; one of them must stand unchanged in any such passage. Exact
piece hits come from sorted hashes of word sequences; around each hit, Myers' bit-parallel distance decides.

Words are runs without white space, in lower case, compared as 64-bit hashes. An item of fewer than five words has no
budget at 0.8, so it is found exactly. Ids of items may be of any type. Defined results: null texts and items without
words match nothing; repeated item ids act as one item each; a document's row holds its id, null included, once for each
item; repeated document rows repeat; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_tiles, encoded, sliding_hash, text_tiles, word_hashes

#: Test items are matched this many at a time: what each task receives stays below a few MB however many there are.
BLOCK = 5_000


def myers(pattern_bits: dict[int, int], m: int, words: list[int]) -> tuple[int, int]:
    """Smallest distance of the pattern to a passage of ``words`` and where such a passage first ends."""
    mask, top = (1 << m) - 1, m - 1
    vp, vn, score, best, end = mask, 0, m, m, 0
    for at, word in enumerate(words, 1):
        eq = pattern_bits.get(word, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = (vn | ~(vp | d0)) & mask
        hn = vp & d0
        score += ((hp >> top) & 1) - ((hn >> top) & 1)
        x = (hp << 1) & mask
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & mask
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """Test items prepared for matching: pieces by length, and bit masks of each item's words."""

    def __init__(self, items: list[tuple[int, list[int]]], similarity: float):
        self.items = []
        pieces = defaultdict(list)
        for key, words in items:
            n = len(words)
            budget = int(n * (1 - similarity) + 1e-9)
            bits: dict[int, int] = defaultdict(int)
            for i, w in enumerate(words):
                bits[w] |= 1 << i
            number = len(self.items)
            self.items.append((key, n, budget, dict(bits)))
            edges = [i * n // (budget + 1) for i in range(budget + 2)]
            hashes = np.array(words, dtype=np.uint64)
            for a, b in zip(edges, edges[1:], strict=False):
                pieces[b - a].append((int(sliding_hash(hashes[a:b], b - a)[0]), number, a))
        self.pieces = {}
        for size, rows in pieces.items():
            rows.sort()
            self.pieces[size] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1:] for r in rows]))

    def matches(self, hashes: np.ndarray, of: np.ndarray, n_texts: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) for texts whose words stand in ``hashes`` and whose numbers stand in ``of``."""
        first = np.searchsorted(of, np.arange(n_texts + 1))
        windows = defaultdict(list)
        for size, (keys, rows) in self.pieces.items():
            found = sliding_hash(hashes, size)
            low = np.searchsorted(keys, found)
            low[low == len(keys)] = 0
            for at in np.flatnonzero(keys[low] == found).tolist():
                text = int(of[at])
                if of[at + size - 1] != text:
                    continue
                r = int(low[at])
                while r < len(keys) and keys[r] == found[at]:
                    item, offset = int(rows[r][0]), int(rows[r][1])
                    _, n, budget, _ = self.items[item]
                    start = at - offset - budget
                    windows[text, item].append((max(int(first[text]), start), min(int(first[text + 1]), start + n + 2 * budget)))
                    r += 1
        for (text, item), spans in sorted(windows.items()):
            _, n, budget, bits = self.items[item]
            best = None
            spans.sort()
            a, b = spans[0]
            for c, d in [*spans[1:], (1 << 62, 0)]:
                if c <= b:
                    b = max(b, d)
                    continue
                distance, end = myers(bits, n, hashes[a:b].tolist())
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, a + end - int(first[text])
                a, b = c, d
            if best:
                yield text, item, best[0], best[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, end_word) of every document and test item found in it.

    ``distance`` is the smallest number of word edits, ``end_word`` the number of words up to the first such passage's
    end. Documents pass once for each ``BLOCK`` test items; nothing is shuffled.
    """
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema[item_col], T.StructField("distance", T.LongType()), T.StructField("end_word", T.LongType())])
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    parts = [lowered.mapInArrow(_finder(m, item_col, schema), schema) for m in matchers(benchmark, similarity, item_col)]
    return functools.reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no test item is found. Only texts go to Python, and only decisions come back."""
    def free(matcher: Items):
        @F.arrow_udf("boolean")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                out = np.ones(len(column), bool)
                for at, texts in column_tiles(column):
                    hashes, of, _, _ = word_hashes(texts)
                    out[[at + m[0] for m in matcher.matches(hashes, of, len(texts))]] = False
                yield pa.array(out)

        return run

    out = docs
    for m in matchers(benchmark, similarity, item_col):
        out = out.where(free(m)(F.lower("text")))
    return out


def matchers(benchmark: DataFrame, similarity: float, item_col: str) -> Iterator[Items]:
    """All test items, at most about ``BLOCK`` at a time."""
    items = benchmark.select(item_col, F.lower("text").alias("text")).where(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // BLOCK))
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item_col, "text"), F.lit(blocks)) == i).distinct().collect()
        rows = sorted(((r[0], encoded([r[1]])) for r in rows), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))
        prepared = [(k, word_hashes(t)[0].tolist()) for k, t in rows]
        yield Items([(k, w) for k, w in prepared if w], similarity)


def _finder(matcher: Items, item_col: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(schema[item_col].dataType)

    def find(batches):
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for at, texts in text_tiles(batch):
                hashes, of, _, _ = word_hashes(texts)
                for text, item, distance, end in matcher.matches(hashes, of, len(texts)):
                    out.append((at + text, matcher.items[item][0], distance, end))
            out = list({(r[0], r[1]): r for r in sorted(out, key=lambda r: (r[0], -r[2]))}.values())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], item_type), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())],
                names=["doc_id", item_col, "distance", "end_word"],
            )

    return find
