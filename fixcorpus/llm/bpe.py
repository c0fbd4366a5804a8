"""Byte-level BPE encoding and decoding.

Encoding: texts are cut into pieces by the tokenizer's pattern; the distinct pieces of some documents at a time become
arrays of byte tokens; a higher-order function folds over each array, merging the leftmost pair of lowest rank until no
pair has a rank. The rank map is a literal of the plan: a perfect hash, packed as two arrays of integers.

Common words are folded once: a dictionary is made beforehand of the words that a bounded sample of documents repeats
most (``SAMPLE`` documents, ``WORDS`` words), and goes to all tasks. The others are folded where they are found; a task
remembers up to ``REMEMBERED`` of them beside the dictionary.
So the documents aren't shuffled, and what is sent doesn't grow with the corpus. The tokens of a word don't depend on
where it is folded. Decoding concatenates the bytes of each token.

The cost of a piece grows with the square of its length in bytes; pieces are words, numbers or runs of symbols.

Defined results: a null text is the empty text, with no tokens and empty decoded bytes; repeated rows and null ids each
get their own row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import Counter, defaultdict
from itertools import chain, count
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, small_batches, stored

#: Documents from which the dictionary of common words is made, and words in it (about 20 bytes each): bounds of a cache,
#: on which no result depends.
SAMPLE = 64_000
WORDS = 600_000
REMEMBERED = 200_000
#: Documents handled at a time.
BATCH = 256


@functools.lru_cache(4)
def load(path: str) -> tuple[bytes, ...]:
    """Bytes of each token by its rank."""
    with open(path, "rb") as lines:
        ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, lines)}
    return tuple(ranks[i] for i in range(len(ranks)))


#: For a tokenizer's pattern, an equal one for the library's ``re``, where {L}, {N} and {S} list letters, numbers and white space. Its
#: branches differ in their first character, or in that after a blank.
_LISTED = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'(?:s|t|re|ve|m|ll|d)| ?(?:[{L}]++|[{N}]++|[^{S}{L}{N}]++)|[{S}]+(?![^{S}])|[{S}]+",
}


@functools.lru_cache(4)
def finder(pattern: str):
    """A function that gives all matches of ``pattern`` in a text, as ``regex`` finds them.

    ``re`` is several times as fast, but knows no classes of Unicode. So they are listed, as ``regex`` has them, up to U+FFFF;
    texts with characters beyond that are left to ``regex``.
    """
    import re

    import regex

    find = regex.compile(pattern).findall
    if pattern not in _LISTED:
        return find
    basic = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    runs = lambda kind: "".join(rf"\u{ord(x[0]):04x}-\u{ord(x[-1]):04x}" for x in regex.findall(kind, basic))
    listed = re.compile(_LISTED[pattern].format(L=runs(r"\p{L}+"), N=runs(r"\p{N}+"), S=runs(r"\s+"))).findall
    return lambda text: listed(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else find(text)


#: Stands before and after the symbols of a piece, and for a missing rank; no pair with it has a rank.
NONE = 65_535
#: Bits of a place in the hash's table, and of a bucket; together, those of a pair of tokens.
_PLACES, _BUCKETS = 17, 15


@functools.lru_cache(4)
def rank_table(path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """A perfect hash of all pairs of tokens that make a token: a factor, steps by bucket, and entries bucket << 16 | rank.

    A pair (a, b) is a << 16 | b. Its product with the odd factor, modulo 2**32, is a bijection: the upper bits are the
    bucket, and the lower ones, changed by the bucket's step, the place. So place and bucket tell the pair. Empty
    places hold ``NONE``.
    """
    rank = {t: i for i, t in enumerate(load(path))}
    keys, values = [], []
    for i, t in enumerate(load(path)):
        for cut in range(1, len(t)):
            a, b = rank.get(t[:cut]), rank.get(t[cut:])
            if a is not None and b is not None:
                keys.append(a << 16 | b)
                values.append(i)
    keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
    places, buckets = 1 << _PLACES, 1 << _BUCKETS
    assert 8 * len(keys) < 7 * places, "the table is too small for this vocabulary"
    for factor in (2_147_483_629, 1_999_999_973, 1_640_531_527, 1_500_450_271, 1_299_709_087):
        product = keys * factor & 0xFFFFFFFF
        bucket, first = product >> _PLACES, product & places - 1
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets + 1))
        groups = sorted((order[a:b] for a, b in zip(edges, edges[1:], strict=False)), key=len, reverse=True)
        entries, steps = np.full(places, NONE, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        taken = np.zeros(places, dtype=bool)
        for group in groups:
            for begin in range(0, places, 512):
                free = ~taken[first[group, None] ^ np.arange(begin, begin + 512)].any(axis=0)
                if free.any():
                    break
            else:
                break
            step = begin + int(free.argmax())
            at = first[group] ^ step
            taken[at] = True
            entries[at] = bucket[group] << 16 | values[group]
            steps[bucket[group[0]]] = step
        else:
            return factor, steps, entries
    raise ValueError("no factor gives a perfect hash")


def _literal(values: np.ndarray, kind: str) -> Column:
    """A constant array; the optimizer makes it a literal."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(kind)


#: A cell of the fold holds the rank of the pair that it begins, its place in the piece and its token, in this order of
#: bits, so the smallest cell is the leftmost pair of lowest rank.
_RANK, _PLACE = 46, 16
#: The cell before a piece; the one after it has the last place.
_EDGE = NONE << _RANK | NONE
_LAST = _EDGE | ((1 << _RANK - _PLACE) - 1) << _PLACE


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. Unlike ``let``, which copies the result, a fold over nothing hands it on."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def with_ranks(path: str, body) -> Column:
    """``body(cell)``, where cell(pair a << 16 | b, rest of a cell) is the cell with the rank of the token that the pair makes.

    The rank map is a literal that the plan holds once: lambda variables name it.
    """
    factor, steps, entries = rank_table(path)

    def cell(step_of: Column, entry_of: Column):
        def made(pair: Column, rest: Column) -> Column:
            def found(product: Column) -> Column:
                bucket = F.shiftright(product, _PLACES)
                place = product.bitwiseAND(F.lit((1 << _PLACES) - 1)).bitwiseXOR(F.get(step_of, bucket))
                # an entry of another pair differs above the rank's bits
                rank = F.least(F.lit(NONE).cast("bigint"), F.get(entry_of, place).bitwiseXOR(F.shiftleft(bucket, 16)))
                return F.shiftleft(rank, _RANK).bitwiseOR(rest)

            return bound((pair * factor).bitwiseAND(F.lit(0xFFFFFFFF)), found)

        return made

    return let(_literal(steps, "array<int>"), lambda s: let(_literal(entries, "array<int>"), lambda e: body(cell(s, e))))


#: Most cells of a piece whose places are the bits of one integer.
_SHORT = 62


def merged(cells: Column, cell) -> Column:
    """The fold: token ids of a piece after all merges, from its cells as ``_cells`` gives them. A merge renews two cells and drops one.

    Cells stand in the order of their places. In a piece of at most ``_SHORT`` cells an integer has the bits of the places that
    are dropped, so a cell comes after as many others as its place says, less the bits below it. Longer pieces look for the cell.
    """
    token = lambda c: c.bitwiseAND(F.lit(65_535))
    place = lambda c: c.bitwiseAND(F.lit((1 << _RANK) - (1 << _PLACE)))
    number = lambda c: F.shiftright(place(c), _PLACE)
    below = lambda c: c.bitwiseAND(F.lit((1 << _RANK) - 1))
    pair = lambda a, b: F.shiftleft(a, 16).bitwiseOR(b)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))

    def fold(c: Column, short: bool) -> Column:
        def with_best(cells: Column, gone: Column) -> Column:
            return bound(cells, lambda c: F.struct(c.alias("cells"), F.array_min(c).alias("best"), gone.alias("gone")))

        def one(state: Column, _: Column) -> Column:
            cells, best, gone = state["cells"], state["best"], state["gone"]
            new = F.shiftright(best, _RANK)

            def put(before: Column) -> Column:
                left, right = F.get(cells, before - 1), F.get(cells, before + 2)
                two = F.array(cell(pair(token(left), new), below(left)), cell(pair(new, token(right)), place(best).bitwiseOR(new)))
                rest = F.flatten(F.array(F.slice(cells, F.lit(1), before - 1), two, F.slice(cells, before + 3, F.size(cells))))
                return with_best(rest, gone.bitwiseOR(bit(number(F.get(cells, before + 1)))) if short else gone)

            if short:
                before = number(best).cast("int") - F.bit_count(gone.bitwiseAND(bit(number(best)) - 1))
            else:
                # array_position stops by an exception, which costs more than to look at the cells of a word
                before = F.when(F.size(cells) > 256, F.array_position(cells, best).cast("int") - 1).otherwise(F.size(F.filter(cells, lambda c: place(c) < place(best))))
            return F.when(best >= _EDGE, state).otherwise(bound(before, put))

        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - 3))
        return F.aggregate(steps, with_best(c, F.lit(0).cast("bigint")), one, lambda state: F.transform(F.slice(state["cells"], F.lit(2), F.size(state["cells"]) - 2), lambda x: token(x).cast("int")))

    return bound(cells, lambda c: F.when(F.size(c) <= _SHORT, fold(c, True)).otherwise(fold(c, False)))


class Known:
    """A dictionary: words (an Arrow array of bytes), the number of tokens of each, and all tokens one after the other."""

    def __init__(self, words, sizes: np.ndarray, tokens: np.ndarray):
        self.words, self.sizes, self.tokens = words, sizes, tokens


def dictionary(docs: DataFrame, path: str, pattern: str) -> Known:
    """The commonest words of a sample of the documents, each found twice at least, folded once for all tasks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(batches):
        find = finder(pattern)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 1024):
                counts = Counter(chain.from_iterable(find(t) for t in texts.slice(at, 1024).to_pylist() if t))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    share = min(1.0, SAMPLE / max(1, docs.count()))
    found = docs.select("text").sample(share, seed=1).mapInArrow(counted, "word string, n long")
    words = stored(found.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") < 256)), "words")
    often, total = 2, 0
    for n, k in words.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += k
        if total > WORDS:
            often = n + 1
            break
    start = _start(load(path))

    def cells(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), _cells(batch.column("word").cast(pa.binary()), start)], names=["word", "cells"])

    def packed(batches):
        for batch in batches:
            found = batch.column("word").cast(pa.binary())
            lists = batch.column("tokens")
            parts = [b"".join(found.to_pylist()), pc.binary_length(found).to_numpy().astype("<u1").tobytes(), pc.list_value_length(lists).to_numpy().astype("<u1").tobytes()]
            parts.append(lists.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["words", "bytes", "sizes", "tokens"])

    # stored, so that the plan with the rank map has no exchange and is planned only once
    made = words.where(F.col("n") >= often).select("word").repartition(words.sparkSession.sparkContext.defaultParallelism)
    made = stored(made.mapInArrow(cells, "word string, cells array<bigint>"), "cells")
    rows = made.select("word", with_ranks(path, lambda cell: merged(F.col("cells"), cell)).alias("tokens")).mapInArrow(packed, "words binary, bytes binary, sizes binary, tokens binary").collect()
    joint = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
    edges = np.concatenate([[0], np.cumsum(joint("bytes", "<u1"), dtype=np.int32)]).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(b"".join(bytes(r["words"]) for r in rows))])
    return Known(found, joint("sizes", "<u1"), joint("tokens", "<u2"))


def _folded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], known: Known) -> DataFrame:
    """Of each document: a struct of its ``keep`` columns, the numbers of its pieces' words, and the tokens of its new words.

    The ``known`` words have the first numbers, then those that the task has met since a row with ``anew``.
    """
    small_batches(docs.sparkSession)
    row = T.StructType([docs.schema[c] for c in keep])
    words = T.ArrayType(T.ArrayType(T.LongType()))
    found = docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(
        _distinct(_start(load(path)), known.words, pattern),
        T.StructType([T.StructField("row", row), T.StructField("anew", T.BooleanType()), T.StructField("index", T.BinaryType()), T.StructField("words", words)]),
    )
    tokens = with_ranks(path, lambda cell: F.transform("words", lambda w: merged(w, cell)))
    return found.select("row", "anew", "index", tokens.alias("tokens"))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ids, the token ids of the whole text."""
    known = dictionary(docs, path, pattern)
    own = known.sizes, known.tokens

    def run(batches):
        import pyarrow as pa

        for rows, ids, edges in _parts(batches, *own):
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in keep], lists], names=[*keep, "ids"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _folded(docs, path, pattern, keep, known).mapInArrow(run, schema)


class Start(NamedTuple):
    """What the fold starts from: the token of each byte, and the rank of each pair of bytes."""

    ids: np.ndarray
    ranks: np.ndarray


def _start(tokens: tuple[bytes, ...]) -> Start:
    ids, ranks = np.zeros(256, dtype=np.int64), np.full((256, 256), NONE, dtype=np.int64)
    for i, t in enumerate(tokens):
        if len(t) == 1:
            ids[t[0]] = i
        elif len(t) == 2:
            ranks[t[0], t[1]] = i
    return Start(ids, ranks)


def _cells(words, start: Start):
    """The cells of each word (an Arrow array of bytes): its byte tokens with the ranks of their pairs, between two edges."""
    import pyarrow as pa

    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    ranks = np.full(len(data), NONE, dtype=np.int64)
    ranks[:-1] = start.ranks[data[:-1], data[1:]]
    ranks[offsets[1:][sizes > 0] - 1] = NONE
    word = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(data)) - offsets[word] + 1
    edges = offsets + 2 * np.arange(len(offsets))
    cells = np.empty(len(data) + 2 * len(sizes), dtype=np.int64)
    cells[edges[:-1]], cells[edges[1:] - 1] = _EDGE, _LAST
    cells[edges[word] + places] = ranks << _RANK | places << _PLACE | start.ids[data]
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(cells, pa.int64()))


def _numbered(known):
    """A function that gives the numbers of words in ``known`` (an Arrow array of bytes), or -1; words are given as a list, and as bytes.

    A task holds a hash and a number for each known word: as a dict of texts they would take about ten times the memory, in each
    Python worker. Words of equal hash are compared; of known words with one hash, only the first is found.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    hashes = np.empty(len(known), np.int64)
    for first in range(0, len(known), 1 << 14):
        texts = known.slice(first, 1 << 14).cast(pa.string()).to_pylist()
        hashes[first : first + len(texts)] = np.fromiter(map(hash, texts), np.int64, len(texts))
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]

    def numbers(words: list[str], as_bytes) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        own = np.fromiter(map(hash, words), np.int64, len(words))
        at = np.searchsorted(hashes, own)
        may = np.flatnonzero(at < len(hashes))
        may = may[hashes[at[may]] == own[may]]
        found = order[at[may]]
        equal = pc.equal(known.take(pa.array(found)), as_bytes.take(pa.array(may))).to_numpy(zero_copy_only=False)
        out[may[equal]] = found[equal]
        return out

    return numbers


def _distinct(start: Start, known, pattern: str):
    def run(batches):
        import pyarrow as pa

        find = finder(pattern)
        numbers = _numbered(known)
        others = None  # numbers of the task's other words, in the order in which they were met

        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                anew = np.zeros(part.num_rows, bool)
                if others is None or len(others) > REMEMBERED:
                    others = defaultdict(count(len(known)).__next__)
                    anew[0] = True
                own = defaultdict(count().__next__)
                index, counts, upto = [], [0], [0]
                for text in part.column("text").to_pylist():
                    pieces = find(text or "")
                    index.append(np.fromiter(map(own.__getitem__, pieces), "<i4", len(pieces)))
                    counts.append(len(pieces))
                    upto.append(len(own))
                words = list(own)
                as_bytes = pa.array(words, pa.string()).cast(pa.binary())
                number, before = numbers(words, as_bytes), len(known) + len(others)
                for i in np.flatnonzero(number < 0).tolist():
                    number[i] = others[words[i]]
                new = np.flatnonzero(number >= before)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(anew),
                        pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * np.cumsum(counts)).astype(np.int32).tobytes()), pa.py_buffer(number[np.concatenate(index)].astype("<i4").tobytes())]),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(new, upto).astype(np.int32)), _cells(as_bytes.take(pa.array(new)), start)),
                    ],
                    names=["row", "anew", "index", "words"],
                )

    return run


def ragged(offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the values of the ``chosen`` lists, one list after the other."""
    sizes = offsets[chosen + 1] - offsets[chosen]
    ends = np.cumsum(sizes)
    return np.repeat(offsets[chosen] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _parts(batches, known_sizes: np.ndarray, known_tokens: np.ndarray):
    """(rows, ids, edges) of some documents at a time: document i has ids[edges[i]:edges[i + 1]]."""
    base, values = np.concatenate([[0], np.cumsum(known_sizes, dtype=np.int64)]), known_tokens.astype(np.int32)
    for batch in batches:
        anew = batch.column("anew").to_numpy(zero_copy_only=False)
        cuts = sorted({*range(0, batch.num_rows, BATCH), *np.flatnonzero(anew).tolist(), batch.num_rows})
        for a, z in zip(cuts, cuts[1:], strict=False):
            if anew[a]:
                base, values = base[: len(known_sizes) + 1], values[: len(known_tokens)]
            tokens = batch.column("tokens").slice(a, z - a).flatten()
            if len(tokens):
                base = np.concatenate([base, base[-1] + np.cumsum(np.diff(tokens.offsets.to_numpy()), dtype=np.int64)])
                values = np.concatenate([values, tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
            parts = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("index").slice(a, z - a)]
            pieces = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
            chosen = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum(base[chosen + 1] - base[chosen])])
            yield batch.column("row").slice(a, z - a), values[ragged(base, chosen)], ends[pieces]


def joined(tokens: tuple[bytes, ...], ids: list[int]) -> bytes:
    """Decoding: the bytes of the tokens one after the other."""
    return b"".join(map(tokens.__getitem__, ids))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with decoded, the bytes of all tokens in ``ids`` one after the other."""
    tokens = load(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [joined(tokens, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded from the ids, in one pass."""
    tokens = load(path)
    known = dictionary(docs, path, pattern)
    own = known.sizes, known.tokens

    def run(batches):
        import pyarrow as pa

        for rows, ids, edges in _parts(batches, *own):
            each = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.field("doc_id"),
                    pa.array([len(x) for x in each], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(joined(tokens, x.tolist())).hexdigest() for x in each], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _folded(docs, path, pattern, ("doc_id",), known).mapInArrow(run, schema)
