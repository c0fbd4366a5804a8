"""Suffix-array deduplication of bytes.

A byte is removed if it lies in a string of ``size`` bytes that also starts earlier: in a smaller document, or earlier
in the same one. Candidates come from ``repeats``, which settles equal
blocks by 128 bits of hash; the suffixes of the others are put in order by deep-shallow sorting. A multikey
quicksort, with 8 bytes as one character, orders them to a shallow depth. Groups that still agree there have long
common prefixes; a blind trie over each group, which keeps only branching depths and branching bytes, orders the rest.
Strings are judged to ``size`` bytes, so suffixes that agree so far are one class.

Defined results: a null text is empty and has nothing to remove; texts shorter than ``size`` bytes stay; ids are ordered
with null last; rows with one id but different texts are ordered by a hash of the text; rows with one id and one text
are one document and get equal results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats

SIZE = 100
SHALLOW = 24


def deep_shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` within their groups, compared to ``size`` bytes, and their classes in that order."""
    order, classes = repeats.regrouped(group, np.zeros(len(starts), np.int64))
    shallow = min(shallow, size) // 8 * 8
    for depth in range(0, shallow, 8):
        word = np.zeros(len(starts), np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | data[starts[order] + depth + i].astype(np.uint64)
        again, classes = repeats.regrouped(classes, word)
        order = order[again]
    # the blind tries: one level of all groups at a time
    open_ = np.flatnonzero((np.bincount(classes) > 1)[classes]) if len(classes) else np.zeros(0, np.int64)
    depth = np.full(len(open_), shallow)
    while len(open_):
        reach = repeats.branching(data, starts[order[open_]], classes[open_], depth, size)
        splits = reach < size
        open_, reach = open_[splits], reach[splits]
        if not len(open_):
            break
        byte = data[starts[order[open_]] + reach]
        old = classes[open_]
        again, new = repeats.regrouped(old, byte)
        order[open_] = order[open_[again]]
        # classes stay ascending: a group's members share its old number, apart by fractions until renumbered
        label = np.zeros(len(classes), np.int64)
        label[open_] = new + 1
        change = np.concatenate([[0], (classes[1:] != classes[:-1]) | (label[1:] != label[:-1])])
        classes = np.cumsum(change)
        stays = (np.bincount(classes) > 1)[classes[open_]]
        open_, depth = open_[stays], reach[stays] + 1
    return order, classes


def _classes(texts: list[bytes], count: np.ndarray, group: np.ndarray) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = repeats.windows_of(np.fromiter(map(len, texts), np.int64, len(texts)), count)
    order, classes = deep_shallow(data, starts, np.repeat(group, count), int(len(texts[0]) - count[0] + 1))
    out = np.empty(len(starts), np.int64)
    out[order] = classes
    return out


def removed(docs: DataFrame, size: int = SIZE, gram: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    kind = repeats.Kind(size, gram or max(1, size * 2 // 5), words=False, inside=True)
    spans = repeats.covered_spans(repeats.keyed(docs), kind, _classes)

    def use(text: bytes, covered: list[tuple[int, int]]):
        kept, at = [], 0
        for a, z in covered:
            kept.append(text[at:a])
            at = z
        kept.append(text[at:])
        return len(text), sum(z - a for a, z in covered), len(covered), hashlib.sha256(b"".join(kept)).hexdigest()

    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, long) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    return repeats.applied(docs, spans, use, schema)
