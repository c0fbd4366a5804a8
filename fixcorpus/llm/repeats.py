"""Long repeats across documents: the part that byte and word deduplication share.

A text is a sequence of symbols (bytes, or words), and a window is ``size`` consecutive symbols. Every window has an
anchor, the ``gram`` consecutive symbols with the smallest hash in it (the leftmost of equals), so equal windows have
equal anchors at equal offsets. Neighbouring windows with one anchor form a block. That leaves about two blocks for
each ``size - gram`` symbols, and all work is done on blocks:

1. ``blocks_of``: each task hashes its texts, keeps the first block of each content that it saw, and reports later
   ones as covered at once. What leaves a task is bounded by the distinct contents in it, however often one repeats.
2. ``resolved``: blocks meet by anchor. Equal blocks after the first are covered. Blocks of one anchor that differ are
   contenders: some of their windows may be equal.
3. ``contents`` fetches the contenders' symbols, and ``contests`` hands the windows of each anchor to a comparison (a
   suffix sort, or suffix trees) that names the classes of equal windows; later ones are covered. An anchor with very
   many contenders is dealt out by window offset.
4. ``applied`` joins the covered spans back to the texts.

Only texts that have contenders, or spans, are shuffled: a filter of bounded size tells most of the others.

Documents are ordered by id, null last; rows with one id are told apart by a hash of their text (31 bits), and rows with
one id and one text are one document. Block contents are compared as 128 bits of hash, windows symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _VALUES, _powers, hinted, mix, stored, text_tiles, word_hashes

LAST = (1 << 63) - 1
FLUSH = 500_000
#: Contenders of one anchor that one task compares; beyond it they are dealt out by window offset.
GROUP = 20_000
KEYS = ("doc", "fp")
#: What is shuffled by anchor, kept narrow: ``at`` is fp << 32 | p, and ``span`` the number of windows - 1, and the anchor's
#: offset: n << 15 | off. A covered span has -1 there, and its end for b.
_BLOCKS = "h long, b long, doc long, at long, span int"
_FOUND = "kind int, h long, doc long, fp long, p int, end int, off int, slices int"


@dataclass(frozen=True)
class Kind:
    """``words``: symbols are words, else bytes. ``inside``: repeats within one document count."""

    size: int
    gram: int
    words: bool
    inside: bool

    @property
    def spread(self) -> int:
        return self.size - self.gram + 1


def symbols(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all symbols, the text of each, and the place of each text's first symbol."""
    if words:
        values, of, _, _ = word_hashes(texts)
        return values, of, np.searchsorted(of, np.arange(len(texts)))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return _VALUES[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes


def sliding_first_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by minima from both ends of blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def find_blocks(values: np.ndarray, of: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Blocks as (anchor hash, content hash, first window's start, number of windows - 1, anchor's offset)."""
    n = len(values)
    if n < kind.size:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    power, inverse = _powers(1 << max(10, n.bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    grams = mix((total[kind.gram :] - total[: n - kind.gram + 1]) * inverse[: n - kind.gram + 1])
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_first_min(keys, kind.spread) & low).astype(np.int64)
    start = np.flatnonzero(of[: n - kind.size + 1] == of[kind.size - 1 :])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = anchor[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    a, z, m = start[first], start[last], anchor[first]
    content = mix((total[z + kind.size] - total[a]) * inverse[a] + ((m - a).astype(np.uint64) << np.uint64(32)) + (z - a).astype(np.uint64))
    return grams[m].view(np.int64), content.view(np.int64), a, z - a, m - a


def later(h: np.ndarray, b: np.ndarray, doc: np.ndarray, fp: np.ndarray, p: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by all five: which are covered by an earlier equal one, which repeat a row exactly, and group starts."""
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    if kind.inside:
        same = (doc == doc[first]) & (fp == fp[first]) & (p == p[first])
    else:
        same = doc == doc[first]
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (fp[1:] == fp[:-1]) & (p[1:] == p[:-1])
    return ~same, again & same, new


def union_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one key made one; sorted."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    shift = key.astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start[1:] + shift[1:] > reach[:-1]) | (key[1:] != key[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], (reach - shift)[last]


def _blocks(h, b, doc, fp, p, span):
    import pyarrow as pa

    at = fp.astype(np.int64) << 32 | p.astype(np.int64)
    columns = [*(pa.array(np.asarray(x, dtype=np.int64)) for x in (h, b, doc, at)), pa.array(np.asarray(span, dtype=np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "b", "doc", "at", "span"])


def _batch(kind, h, doc, fp, p, end, off=None, slices=None):
    import pyarrow as pa

    n = len(h)
    arrays = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (h, doc, fp))]
    arrays += [pa.array(np.zeros(n, np.int32) if x is None else np.asarray(x, dtype=np.int32)) for x in (p, end, off, slices)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "h", "doc", "fp", "p", "end", "off", "slices"])


def _sliced(batch, most: int = 50_000):
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    fp = F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF))
    return docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), fp.alias("fp"), F.col(text_col).alias("text"))


def blocks_of(docs: DataFrame, kind: Kind) -> DataFrame:
    """The first block of its content in a task, and spans that such blocks cover."""
    def flush(rows: list[tuple[np.ndarray, ...]]):
        h, b, doc, fp, p, n, off, row = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((p, fp, doc, b, h))
        h, b, doc, fp, p, n, off, row = (x[order] for x in (h, b, doc, fp, p, n, off, row))
        covered, again, _ = later(h, b, doc, fp, p, kind)
        keep = ~covered & ~again
        yield from _sliced(_blocks(h[keep], b[keep], doc[keep], fp[keep], p[keep], n[keep].astype(np.int64) << 15 | off[keep]))
        if covered.any():
            key, start, end = union_spans(row[covered], p[covered], p[covered] + n[covered] + kind.size)
            at = np.zeros(int(row.max()) + 1, np.int64)
            at[row] = np.arange(len(row))
            yield from _sliced(_blocks(mix(key.astype(np.uint64)).view(np.int64), end, doc[at[key]], fp[at[key]], start, np.full(len(key), -1)))

    def run(batches):
        rows, held, seen = [], 0, 0
        for batch in batches:
            doc, fp = batch.column("doc").to_numpy(), batch.column("fp").to_numpy()
            for at, texts in text_tiles(batch, most=1 << 19):
                values, of, begin = symbols(texts, kind.words)
                h, b, p, n, off = find_blocks(values, of, kind)
                if len(h):
                    row = of[p]
                    rows.append((h, b, doc[at + row], fp[at + row], p - begin[row], n, off, row + seen))
                    held += len(h)
                seen += len(texts)
                if held >= FLUSH:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)

    return docs.mapInArrow(run, _BLOCKS)


def by_key(batches, names: tuple[str, ...]) -> Iterator:
    """Record batches cut anew, so that rows with equal leading ``names`` stay together; input sorted by them."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in names:
            column = batch.column(name).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            if held and held[-1].column(name)[-1].as_py() != column[0]:
                change[0] = True
        where = np.flatnonzero(change)
        if not len(where):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, int(where[-1]))] if where[-1] else held
        if done and sum(x.num_rows for x in done):
            yield pa.Table.from_batches([x for x in done if x.num_rows]).combine_chunks().to_batches()[0]
        held = [batch.slice(int(where[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def resolved(found: DataFrame, kind: Kind) -> DataFrame:
    """Kind 1: covered spans. Kind 2: contenders, with the number of slices that their anchor is dealt out to."""
    def run(batches):
        for batch in by_key(batches, ("h",)):
            col = {n: batch.column(n).to_numpy() for n in ("h", "b", "doc", "span")}
            at = batch.column("at").to_numpy()
            col |= {"fp": at >> 32, "p": at & 0xFFFFFFFF}
            spans = col["span"] < 0
            if spans.any():
                x = {n: v[spans] for n, v in col.items()}
                yield from _sliced(_batch(1, x["h"], x["doc"], x["fp"], x["p"], x["b"]))
            x = {n: v[~spans] for n, v in col.items()}
            if not len(x["h"]):
                continue
            x |= {"end": x["p"] + (x["span"] >> 15), "off": x["span"] & 0x7FFF}
            covered, again, _ = later(x["h"], x["b"], x["doc"], x["fp"], x["p"], kind)
            if covered.any():
                yield from _sliced(_batch(1, *(x[n][covered] for n in ("h", "doc", "fp", "p")), x["end"][covered] + kind.size))
            x = {n: v[~covered & ~again] for n, v in x.items()}
            new = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
            group = np.cumsum(new) - 1
            rows = np.bincount(group)
            differs = np.concatenate([[False], (x["b"][1:] != x["b"][:-1]) & ~new[1:]])
            contends = (np.bincount(group, weights=differs) > 0)[group]
            if contends.any():
                slices = np.minimum(-(-rows // GROUP), kind.spread)[group]
                yield from _sliced(_batch(2, *(x[n][contends] for n in ("h", "doc", "fp", "p", "end", "off")), slices[contends]))

    return found.repartition("h").sortWithinPartitions("h", "b", "doc", "at").mapInArrow(run, _FOUND)


_CONTENT = "h long, slice int, doc long, fp long, p int, n int, off int, content binary"


def contents(docs: DataFrame, contenders: DataFrame, kind: Kind) -> DataFrame:
    """Symbols of each contender's windows: bytes, or words joined by one space; a row for each slice of offsets."""
    wanted = contenders.groupBy("doc", "fp").agg(F.collect_list(F.struct("h", "p", "end", "off", "slices")).alias("wanted"))
    asked = contenders.select(F.xxhash64(*KEYS).alias("key")).distinct()
    joined = hinted(docs, F.xxhash64(*KEYS), asked, "_asked").where("_asked").drop("_asked").join(wanted, [*KEYS])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                parts = text.split() if kind.words else text
                doc, fp = batch.column("doc")[i].as_py(), batch.column("fp")[i].as_py()
                out, seen = [], set()
                for w in batch.column("wanted")[i].as_py():
                    step = -(-kind.spread // w["slices"])
                    for s in range(w["slices"]):
                        # windows from p to end have offsets from off down to off - (end - p)
                        a = max(w["p"], w["p"] + w["off"] - (s + 1) * step + 1)
                        z = min(w["end"], w["p"] + w["off"] - s * step)
                        if a <= z and (w["h"], s, a) not in seen:
                            seen.add((w["h"], s, a))
                            piece = parts[a : z + kind.size]
                            out.append((w["h"], s, doc, fp, a, z - a, w["off"] - (a - w["p"]), b" ".join(piece) if kind.words else piece))
                for at in range(0, len(out), 2_000):
                    cols = list(zip(*out[at : at + 2_000], strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "slice", "doc", "fp", "p", "n", "off", "content"])

    return joined.mapInArrow(run, _CONTENT)


def contests(rows: DataFrame, kind: Kind, classes: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Covered spans among the windows of each anchor.

    ``classes`` gets contents, the number of windows in each and the group of each, and returns a class number for
    each window, equal for equal windows of one group only.
    """
    def run(batches):
        for batch in by_key(batches, ("h", "slice")):
            col = {n: batch.column(n).to_numpy() for n in batch.schema.names if n != "content"}
            group = np.cumsum(np.concatenate([[0], (col["h"][1:] != col["h"][:-1]) | (col["slice"][1:] != col["slice"][:-1])]))
            many = (np.bincount(group) > 1)[group]
            if not many.any():
                continue
            texts = [t for t, m in zip(batch.column("content").to_pylist(), many.tolist(), strict=True) if m]
            h, doc_of, fp_of, p_of, count = (col[n][many] for n in ("h", "doc", "fp", "p", "n"))
            count = count.astype(np.int64) + 1
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            named = classes(texts, count, group[many])
            doc, fp, p = doc_of[row], fp_of[row], p_of[row] + step
            order = np.lexsort((p, fp, doc, named))
            covered, _, _ = later(np.zeros(len(row), np.int64), named[order], doc[order], fp[order], p[order], kind)
            hit = order[covered]
            key, start, end = union_spans(row[hit], p[hit].astype(np.int64), p[hit].astype(np.int64) + kind.size)
            yield from _sliced(_batch(1, h[key], doc_of[key], fp_of[key], start, end))

    return rows.repartition("h", "slice").sortWithinPartitions("h", "slice").mapInArrow(run, _FOUND)


def windows_of(lengths: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Starts, in the contents one after the other, of the windows of each content."""
    begin = np.cumsum(lengths) - lengths
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def regrouped(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (group, key), and the new groups in that order."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    return order, np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])) if len(g) else g


def branching(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: np.ndarray, most: int) -> np.ndarray:
    """For suffixes in groups (sorted) that agree up to ``depth``: how far each suffix's whole group agrees, ``most`` at most."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    member = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    lead = starts[first][member]
    agree = np.empty(len(starts), np.int64)
    width = np.arange(most)
    for at in range(0, len(starts), 100_000):
        part = slice(at, at + 100_000)
        differs = data[starts[part, None] + width] != data[lead[part, None] + width]
        agree[part] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    return np.minimum.reduceat(agree, first)[member]


def covered_spans(docs: DataFrame, kind: Kind, classes) -> DataFrame:
    """(doc, fp, spans): the covered spans (p, end) of each document that has any."""
    if kind.size > 0x7FFF:
        raise ValueError("windows of so many symbols aren't supported")
    found = stored(resolved(blocks_of(docs, kind), kind), "found")
    more = contests(contents(docs, found.where("kind = 2"), kind), kind, classes)
    spans = found.where("kind = 1").select(*KEYS, "p", "end").unionByName(more.select(*KEYS, "p", "end"))
    return stored(spans.groupBy(*KEYS).agg(F.collect_list(F.struct("p", "end")).alias("spans")), "spans")


def applied(docs: DataFrame, spans: DataFrame, use, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``use(text, merged spans)`` of every row; rows that surely have no spans aren't shuffled."""
    key = F.xxhash64(*KEYS)
    own = hinted(keyed(docs, id_col, text_col, F.col(id_col).alias("_id")), key, spans.select(key.alias("key")), "_some")
    some = own.where("_some").join(spans, [*KEYS], "left").select("_id", "text", "spans")
    rest = own.where("not _some").select("_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for at, texts in text_tiles(batch):
                for i, text in enumerate(texts):
                    spans = batch.column("spans")[at + i]
                    merged = []
                    if spans.is_valid:
                        p, end = spans.values.field("p").to_numpy(), spans.values.field("end").to_numpy()
                        _, a, z = union_spans(np.zeros(len(p), np.int64), p.astype(np.int64), end.astype(np.int64))
                        merged = list(zip(a.tolist(), z.tolist(), strict=True))
                    out.append(use(text, merged))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in schema.fields[1:]]
            arrays = [batch.column("_id")]
            for c, f in zip(cols, schema.fields[1:], strict=True):
                arrays.append(pa.array(c, pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return some.union(rest).mapInArrow(run, schema)
