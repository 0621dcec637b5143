"""Language identification by string kernels.

The kernel of two texts is the number of distinct n-grams (lengths 1 to 3, a blended
spectrum over letters and word edges) that both hold, divided by the root of the
product of their own numbers. Landmark texts span the Nystroem space, and one ridge
regression for each language, one against the rest, is fitted in it. Texts are scored
in batches by two matrix products: presence with landmarks, kernel with weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Hashed n-gram space. A power of two.
BITS = 13
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(one row of n-gram presence for each text, whether it has a letter). Case is ignored; no n-gram spans two words."""
    size = 1 << BITS
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(low), dtype=np.int64), np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    row = np.concatenate((row[:1], row)) * size if len(low) else row
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    found = np.zeros(len(low) * size, bool)
    shift = np.uint64(64 - BITS)

    def mark(key: np.ndarray, at: np.ndarray) -> None:
        found[at + ((key * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)] = True

    one = np.flatnonzero(letter)
    has = np.zeros(len(low), bool)
    has[row[one] >> BITS] = True
    mark(code[one] + np.uint64(1 << 60), row[one])
    pair = code[:-1] << np.uint64(20) | code[1:]
    two = np.flatnonzero(letter[:-1] | letter[1:])
    # A separator ends the text before it, so a pair that begins with one belongs to the letter after it.
    mark(pair[two] + np.uint64(1 << 61), np.where(letter[two], row[two], row[two + 1]))
    mark((pair[one - 1] << np.uint64(20) | code[one + 1]) + np.uint64(1 << 62), row[one])
    return found.reshape(len(low), size), has


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Normalized blended-spectrum presence kernel between rows of ``x`` and of ``z``."""
    a, b = np.maximum(x.sum(1), 1), np.maximum(z.sum(1), 1)
    return (x.astype(np.float32) @ z.astype(np.float32).T) / np.sqrt(np.outer(a, b)).astype(np.float32)


@dataclass
class LanguageModel:
    """Landmarks, weights of the kernel to them, and the languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    names: list[str]

    def scores(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 for one without a letter."""
        if not texts:
            return [], np.zeros(0)
        x, has = presence(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        f = kernel(x, self.landmarks) @ self.weights
        best = f.argmax(1)
        score = np.clip((f[np.arange(len(f)), best].astype(float) + 1) / 2, 0, 1)
        return [self.names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def fit(x: np.ndarray, langs: list[str], landmarks: int = 192, ridge: float = 1e-2) -> LanguageModel:
    """Fit on presence rows; landmarks are dealt evenly among the languages in row order."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel(np.zeros((0, 1 << BITS), bool), np.zeros((0, 0), np.float32), [])
    y = np.array([names.index(v) for v in langs])
    each = max(1, landmarks // len(names))
    z = x[np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])]
    value, vector = np.linalg.eigh(kernel(z, z).astype(float))
    root = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    phi = kernel(x, z).astype(float) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.bincount(y, minlength=len(names))[y]  # every language weighs the same
    weighed = phi * share[:, None]
    beta = np.linalg.solve(phi.T @ weighed + ridge * np.eye(phi.shape[1]) / len(names), weighed.T @ target)
    return LanguageModel(z, (root @ beta).astype(np.float32), names)


def train(labelled: DataFrame, rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``rows`` labelled rows, those with the smallest hash of their id; only their presence bits reach the driver."""
    rank = F.xxhash64(F.col(id_col), F.lit(7))
    use = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(rank.alias("rank"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ranks = use.select("rank").orderBy("rank").limit(rows).collect()
    if not ranks:
        return fit(np.zeros((0, 1 << BITS), bool), [])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                x, has = presence(some.column("text").to_pylist())
                keep = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([some.column("rank").take(pa.array(keep)), some.column("lang").take(pa.array(keep)), pa.array([r.tobytes() for r in np.packbits(x[keep], axis=1)], pa.binary())], ["rank", "lang", "bits"])

    got = use.where(F.col("rank") <= ranks[-1].rank).mapInArrow(bits, "rank long, lang string, bits binary").limit(rows).collect()
    got = sorted(got, key=lambda r: (r.rank, r.lang, bytes(r.bits)))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool) if got else np.zeros((0, 1 << BITS), bool)
    return fit(x, [r.lang for r in got])


def predict(docs: DataFrame, model: LanguageModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null text, and text without a letter, is UNKNOWN with score 0; so is every text
    when nothing was learned. A null id is kept. Repeated rows give repeated results,
    extra columns are ignored, and an empty table gives no rows. Of equal scores the
    language first by name wins.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast((np.packbits(model.landmarks, axis=1), model.weights, model.names))  # landmarks * 1 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, weights, names = shared.value
        own = LanguageModel(np.unpackbits(packed, axis=1).astype(bool) if len(packed) else np.zeros((0, 1 << BITS), bool), weights, names)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                lang, score = own.scores([t or "" for t in some.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
