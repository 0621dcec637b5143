"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: hashed words and pairs
of words, and hashed character n-grams (3 and 4 characters, word edges included, case kept). A softmax layer
over the mean gives the class. Vectors and layer are trained together by stochastic
gradient descent in numpy, each step on the means of whole texts: a batch is a matrix of
feature shares, so its means are one matrix product and its gradient another. Both parts are
linear, so scoring first folds the layer into one number per feature, and then averages
those over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tune

#: Feature buckets. A power of two.
BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, and n+1 bounds of each text's features among them."""
    n = len(texts)
    # Each text gets a blank on either side, so that n-grams see word edges and none spans two texts.
    code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    row = np.concatenate((np.zeros(1, np.int64), np.repeat(np.arange(n), size)))[: len(code)]
    blank = _SPACE[np.minimum(code, 255)] & (code < 256)
    code = np.where(blank, np.uint32(32), code).astype(np.uint64)
    inside = ~blank
    keys, rows = [], []
    gram, middle = code[:-1] << np.uint64(21) | code[1:], None  # a character has 21 bits
    for length in (3, 4):
        gram = (gram[:-1] * np.uint64(_BASE)) + code[length - 1 :]
        middle = inside[1:-1] if length == 3 else middle[:-1] & inside[2:-1]
        keep = np.flatnonzero(middle)
        keys.append(gram[keep] * np.uint64(2 * length + 1))
        rows.append(row[keep + 1])
    start = np.flatnonzero(inside[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & inside[:-1]) + 1
    # A word's hash: the polynomial of its characters, by prefix sums of character * base^position, brought back to position 0.
    power = _powers(len(code) + 1)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((code + np.uint64(1)) * power[: len(code)], dtype=np.uint64)))
    word = ((prefix[end] - prefix[start]) * _powers(len(code) + 1, True)[start]) + np.uint64(1 << 44)
    keys.append(word)
    rows.append(row[start])
    # A pair of words is a feature too.
    pair = np.flatnonzero(row[start[1:]] == row[start[:-1]]) if len(start) else np.zeros(0, np.int64)
    keys.append(word[pair] * np.uint64(_BASE) + word[pair + 1])
    rows.append(row[start[pair]])
    key, owner = np.concatenate(keys), np.concatenate(rows)
    bucket = (((key ^ (key >> np.uint64(32))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(n + 1))


_BASE = 0x5851F42D4C957F2D
_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or those of the base's inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.full(max(n, 1 << 16), np.uint64(base))
        have[0] = 1
        _POWERS[inverse] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class QualityModel:
    """One number for each feature bucket (log-odds of class 1) and the constant."""

    odds: np.ndarray
    constant: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bucket, bounds = features(texts)
        total = np.concatenate(([0.0], np.cumsum(self.odds[bucket], dtype=float)))
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.constant, -50, 50)))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 16, epochs: int = 10, rate: float = 1.0, batch: int = 32, seed: int = 1, least_steps: int = 250) -> QualityModel:
    """Train on each document's (buckets, how often each occurs), its whole text in a step; few documents take more rounds than ``epochs``, so that there are ``least_steps`` steps."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, int)
    share = (labels.sum() + 1) / (len(labels) + 2)
    constant = float(np.log(share / (1 - share)))
    use = [i for i, (s, _) in enumerate(samples) if len(s)]
    if not use or len(set(labels[use].tolist())) < 2:
        return QualityModel(np.zeros(1 << BITS, np.float32), constant)
    vectors = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.array([0.0, constant], np.float32)
    rounds = -(-len(use) // batch)
    epochs = max(epochs, -(-least_steps // rounds))
    steps, done = epochs * rounds, 0
    shares = np.zeros((batch, 1 << BITS), np.float32)
    for _ in range(epochs):
        order = rng.permutation(use)
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            now = rate * (1 - done / steps)
            part = shares[: len(some)]
            for k, i in enumerate(some):
                bucket, count = samples[i]
                part[k, bucket] = count / count.sum()
            mean = part @ vectors
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            vectors -= part.T @ (now * (p @ layer.T))
            for k, i in enumerate(some):
                part[k, samples[i][0]] = 0
            layer -= now / batch * (mean.T @ p) * 8
            bias -= now / batch * p.sum(0)
            done += 1
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def parts(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of texts of about ``limit`` characters; a longer one is a range of its own."""
    ends = np.cumsum([len(t) for t in texts])
    yield from slices(np.concatenate(([0], ends)), limit)


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``rows`` labelled documents (smallest hash of the id): the counts of all features of their whole texts.

    That is the bound on what reaches the driver: a text has at most 2^BITS buckets, of six bytes each.
    Labels that are null or neither 0 nor 1 are left out; an id labelled twice counts by its largest label.
    """
    rank = F.xxhash64(F.col(id_col), F.lit(11))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), rank.alias("rank"), F.col(label_col).cast("int").alias("label"))
    chosen = known.groupBy("doc_id", "rank").agg(F.max("label").alias("label")).orderBy("rank", "doc_id").limit(rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(F.broadcast(chosen), "doc_id").select("rank", "label", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts = [t or "" for t in got.column("text").to_pylist()]
            for a, b in parts(texts):
                bucket, bounds = features(texts[a:b])
                counted = [np.unique(bucket[x:y], return_counts=True) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                packed = [[pa.array([x[k].astype(kind).tobytes() for x in counted], pa.binary()) for k, kind in ((0, "<u2"), (1, "<u4"))]][0]
                yield pa.RecordBatch.from_arrays([got.column("rank").slice(a, b - a), got.column("label").slice(a, b - a), *packed], ["rank", "label", "ids", "counts"])

    got = joined.mapInArrow(sample, "rank long, label int, ids binary, counts binary").limit(rows).collect()
    got = sorted(got, key=lambda r: (r.rank, bytes(r.ids), bytes(r.counts)))
    return fit([(np.frombuffer(bytes(r.ids), "<u2").astype(np.int64), np.frombuffer(bytes(r.counts), "<u4").astype(np.float32)) for r in got], np.array([r.label for r in got], int))


def score(docs: DataFrame, model: QualityModel, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, with the columns of ``keep`` after them.

    Null and empty texts, and those of white space alone, get the score of the class
    shares alone. A null id is kept. Repeated rows give repeated results; long texts are
    read whole; a score of just ``threshold`` predicts 1; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast((model.odds, model.constant))  # 2^BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        for got in batches:
            texts = [t or "" for t in got.column("text_").to_pylist()]
            values = [own.scores(texts[a:b]) for a, b in parts(texts)]
            value = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([got.column("doc_id_"), got.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), *[got.column(f"kept_{i}") for i in range(len(keep))]], ["doc_id", "held_out", "score", "predicted", *[f"kept_{i}" for i in range(len(keep))]])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id_"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text_"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    kinds = ", ".join(["doc_id long, held_out boolean, score double, predicted int", *[f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]])
    return source.mapInArrow(run, kinds)
