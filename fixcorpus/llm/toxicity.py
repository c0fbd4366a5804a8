"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its distinct words and word beginnings (4
and 6 bytes, for languages that build words from a stem); the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are used in training; afterwards the sentence scores say where the offence stands.

The training sample is bounded: at most ``SAMPLE`` labelled documents, taken by a hash of their ids, whose words one task
holds; ids must cast to long. Words count in lower case without ASCII punctuation and digits; sentences end at ``. ! ?``
and line ends.

Defined results: null and empty texts have no sentence and score 0; a null id is not held out; documents labelled
twice count as toxic if either label says so; of several texts of one id, the smallest is learned from; null labels are
left out; repeated rows each get the same score; without labels of both kinds, every score is 0; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_tiles, distinct, small_batches, text_tiles, word_hashes

SAMPLE = 5_000
BUCKETS = 1 << 20
PREFIXES = (4, 6)
#: Letters in lower case, sentence ends as line ends, other ASCII as spaces; bytes of other letters stay.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".!?\n\r" else 32 for c in range(256))


def sentence_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs as two arrays, and the text of each sentence; sentences without words don't count."""
    plain = [t.translate(_PLAIN) for t in texts]
    hashes, of, start, _, *heads = word_hashes(plain, prefixes=PREFIXES)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join(plain) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) + 1
    begins = np.cumsum(sizes) - sizes
    line = np.cumsum(data == 10)[start + begins[of]]
    sentence = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]]))
    text = np.zeros(int(sentence[-1]) + 1, dtype=np.int64)
    text[sentence] = of
    rows = [(sentence, hashes), *((sentence[h != 0], h[h != 0]) for h in heads)]
    pairs = distinct(np.concatenate([s * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for s, h in rows]))
    return pairs // BUCKETS, pairs % BUCKETS, text


class Model:
    """Weights of words, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_margins(self, sentence: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, weights=self.weights[feature], minlength=n)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; probability and text of each sentence with words."""
        sentence, feature, text = sentence_words(texts)
        margin = self.sentence_margins(sentence, feature, len(text))
        log_rest = np.bincount(text, weights=np.logaddexp(0, margin), minlength=len(texts))
        return -np.expm1(-log_rest), 1 / (1 + np.exp(-margin)), text


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 120, rate: float = 0.15, l1: float = 2e-4, least: int = 5) -> Model:
    """Gradient steps (Adam) on the noisy-or likelihood, with a pull of small weights to 0.

    ``bags``: for each document its sentence numbers (ascending) and features. Words of fewer than ``least`` documents get
    no weight. Beside the bags, memory is about 30 bytes for each (sentence, word) pair with a weight.
    """
    y = np.array(labels, dtype=float)
    model = Model(np.zeros(BUCKETS), -40.0)
    if not len(y) or y.min() == y.max():
        return model
    in_docs = np.zeros(BUCKETS, np.int32)
    for _, f in bags:
        in_docs[distinct(f)] += 1
    used = np.flatnonzero(in_docs >= least)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    counts = np.array([int(s[-1]) + 1 if len(s) else 0 for s, _ in bags])
    shift = np.cumsum(counts) - counts
    size = sum(int(np.count_nonzero(place[f] >= 0)) for _, f in bags)
    sentence, feature, at = np.empty(size, np.int32), np.empty(size, np.int32), 0
    for (s, f), k in zip(bags, shift.tolist(), strict=True):
        f = place[f]
        own = f >= 0
        n = int(np.count_nonzero(own))
        sentence[at : at + n], feature[at : at + n] = s[own] + k, f[own]
        at += n
    doc = np.repeat(np.arange(len(bags)), counts)
    w, bias = np.zeros(len(used)), -4.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        g = gradient(w, bias, sentence, feature, doc, y)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(m2[:-1] / (1 - 0.999**step)) + 1e-4), 0)
    model.weights[used] = w
    model.bias = float(bias)
    return model


def losses(w: np.ndarray, bias: float, sentence: np.ndarray, feature: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of log(1 + exp(margin)) over each document's sentences, which is -log(1 - score); at least 1e-12."""
    return np.maximum(np.bincount(doc, weights=np.logaddexp(0, _margins(w, bias, sentence, feature, len(doc))), minlength=len(y)), 1e-12)


def _margins(w, bias, sentence, feature, n, part: int = 1 << 20):
    margin = np.full(n, float(bias))
    for at in range(0, len(sentence), part):
        margin += np.bincount(sentence[at : at + part], weights=w[feature[at : at + part]], minlength=n)
    return margin


def gradient(w: np.ndarray, bias: float, sentence: np.ndarray, feature: np.ndarray, doc: np.ndarray, y: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """Of the mean negative log likelihood, by each weight and then by the bias."""
    margin = _margins(w, bias, sentence, feature, len(doc), part)
    total = np.maximum(np.bincount(doc, weights=np.logaddexp(0, margin), minlength=len(y)), 1e-12)
    pull = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) / len(y)
    d = pull[doc] / (1 + np.exp(-margin))
    g = np.zeros(len(w) + 1)
    for at in range(0, len(sentence), part):
        g[:-1] += np.bincount(feature[at : at + part], weights=d[sentence[at : at + part]], minlength=len(w))
    g[-1] = d.sum()
    return g


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents that are not held out: at most ``sample`` rows, fitted in one task; the driver gets the weights."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # one text for each id, however often it is repeated
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bags = texts.mapInArrow(_bags, "doc_id long, label int, sentence binary, feature binary")
    rows = bags.repartition(1).mapInArrow(_fitted, "feature binary, weight binary, bias double").collect()
    model = Model(np.zeros(BUCKETS), -40.0)
    for feature, weight, bias in rows:
        model.weights[np.frombuffer(feature, "<i4")] = np.frombuffer(weight, "<f8")
        model.bias = bias
    return model


def _fitted(batches):
    rows = []
    for batch in batches:
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
        parts = [[np.frombuffer(v.as_buffer(), "<i4") for v in batch.column(c)] for c in ("sentence", "feature")]
        rows += zip(ids, labels, *parts, strict=True)
    rows.sort(key=lambda r: r[0])
    model = fit([(s, f) for _, _, s, f in rows], [int(label > 0) for _, label, _, _ in rows])
    used = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([used.astype("<i4").tobytes()], pa.binary()), pa.array([model.weights[used].astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])], names=["feature", "weight", "bias"]
    )


def _bags(batches):
    for batch in batches:
        s_out, f_out = [], []
        for _, texts in text_tiles(batch):
            sentence, feature, text = sentence_words(texts)
            of = text[sentence] if len(text) else sentence
            begin = np.searchsorted(text, np.arange(len(texts)))
            edge = np.searchsorted(of, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                s_out.append((sentence[edge[i] : edge[i + 1]] - begin[i]).astype("<i4").tobytes())
                f_out.append(feature[edge[i] : edge[i + 1]].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(s_out, pa.binary()), pa.array(f_out, pa.binary())],
            names=["doc_id", "label", "sentence", "feature"],
        )


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and offending: (start, end, score) of sentences at 0.5 or more, in code points."""
    spans = "array<struct<start:int,end:int,score:double>>"
    fields = [docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("offending", T._parse_datatype_string(spans))]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scorer(model, keep), T.StructType(fields))


def harmless(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``. Only texts go to Python, and only scores come back."""
    used = np.flatnonzero(model.weights)
    weights, bias = model.weights[used], model.bias

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        whole = np.zeros(BUCKETS)
        whole[used] = weights
        own = Model(whole, bias)
        for texts in columns:
            yield pa.array(np.concatenate([np.zeros(0), *[own.scores(part)[0] for _, part in column_tiles(texts)]]))

    return docs.where(scored(F.col("text")) < threshold)


def _sentences(text: bytes) -> list[tuple[int, int]]:
    plain = text.translate(_PLAIN)
    out, at = [], 0
    for part in plain.split(b"\n"):
        if part.strip(b" "):
            a = at + len(part) - len(part.lstrip(b" "))
            out.append((len(text[:a].decode("utf-8", "replace")), len(text[: at + len(part.rstrip(b" "))].decode("utf-8", "replace"))))
        at += len(part) + 1
    return out


def _scorer(model: Model, keep: tuple[str, ...]):
    used = np.flatnonzero(model.weights)
    weights, bias = model.weights[used], model.bias

    def run(batches):
        whole = np.zeros(BUCKETS)
        whole[used] = weights
        own = Model(whole, bias)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out, spans = [], []
            for _, texts in text_tiles(batch):
                scores, p, of = own.scores(texts)
                out.append(scores)
                edge = np.searchsorted(of, np.arange(len(texts) + 1))
                bad = np.bincount(of[p >= 0.5], minlength=len(texts))
                for i, t in enumerate(texts):
                    if bad[i]:
                        mine = p[edge[i] : edge[i + 1]]
                        spans.append([{"start": a, "end": b, "score": float(q)} for (a, b), q in zip(_sentences(t), mine, strict=True) if q >= 0.5])
                    else:
                        spans.append([])
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*keep, "score", "offending"])

    return run
