"""Substring deduplication of words.

A word is removed if it lies in a window of ``size`` words whose sequence also starts in a document with a smaller id.
Candidates come from ``repeats``, which settles equal blocks by 128 bits of hash. The suffixes of the others are split by prefixes of varying length: a set of suffixes that is
larger than ``MEMORY`` is divided by its next word until it fits. Over each group a suffix tree grows from the top: a
node holds the suffixes that agree so far, its edge is as long as they agree, and its children differ in the next word.
Internal nodes ``size`` words deep or deeper are the repeats: their suffixes start with equal windows.

Defined results: a null or empty text has no words; texts shorter than ``size`` words stay; ids are ordered with null
last; rows with one id never remove words of each other; rows with one id and one text get equal results; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats

SIZE = 50
MEMORY = 100_000


def prefix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int, memory: int = MEMORY):
    """Parts of the suffixes (their numbers, and their groups): all that share a prefix stay together, ``memory`` in a part at most
    unless they agree in ``size`` words."""
    pending = [(np.arange(len(starts)), group, 0)]
    while pending:
        own, key, depth = pending.pop()
        order, named = repeats.regrouped(key, data[starts[own] + depth])
        own = own[order]
        edge = np.concatenate([np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]])), [len(named)]])
        a = 0
        while a < len(edge) - 1:
            z = a + 1
            while z < len(edge) - 1 and edge[z + 1] - edge[a] <= memory:
                z += 1
            part, names = own[edge[a] : edge[z]], named[edge[a] : edge[z]]
            if len(part) > memory and depth + 1 < size:
                pending.append((part, names, depth + 1))
            else:
                yield part, names
            a = z


def suffix_tree(data: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Deep internal nodes of the trees of all groups, as (suffix numbers, node of each); level by level from the top."""
    order, node = repeats.regrouped(group, np.zeros(len(starts), np.int64))
    deep, depth = [], np.zeros(len(starts), np.int64)
    while len(order):
        stays = (np.bincount(node) > 1)[node]
        order, node, depth = order[stays], node[stays], depth[stays]
        if not len(order):
            break
        reach = repeats.branching(data, starts[order], node, depth, size)
        done = reach >= size
        if done.any():
            deep.append((order[done], node[done]))
        order, node, reach = order[~done], node[~done], reach[~done]
        if len(order):
            again, child = repeats.regrouped(node, data[starts[order] + reach])
            order, node, depth = order[again], child, reach[again] + 1
    return deep


def _classes_of(size: int):
    def classes(texts: list[bytes], count: np.ndarray, group: np.ndarray) -> np.ndarray:
        number: dict[bytes, int] = {}
        lists = [[number.setdefault(w, len(number)) for w in t.split(b" ")] for t in texts]
        data = np.concatenate([np.array(x, dtype=np.int32) for x in lists])
        starts = repeats.windows_of(np.fromiter(map(len, lists), np.int64, len(lists)), count)
        out = np.arange(len(starts), dtype=np.int64)
        top = len(starts)
        for part, names in prefix_groups(data, starts, np.repeat(group, count), size):
            for suffixes, nodes in suffix_tree(data, starts[part], names, size):
                out[part[suffixes]] = top + nodes
                top += int(nodes.max()) + 1
        return out

    return classes


def removed(docs: DataFrame, size: int = SIZE, gram: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    kind = repeats.Kind(size, gram or max(1, size * 2 // 5), words=True, inside=False)
    spans = repeats.covered_spans(repeats.keyed(docs), kind, _classes_of(size))

    def use(text: bytes, covered: list[tuple[int, int]]):
        words, kept, at = text.split(), [], 0
        for a, z in covered:
            kept += words[at:a]
            at = z
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("kept_sha256", T.StringType())])
    return repeats.applied(docs, spans, use, schema)
