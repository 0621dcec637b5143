"""Benchmark decontamination by item-sized SimHash windows.

Words are runs of letters and digits, case folded; shingles are five words. A window
has as many shingles as the item it is held against. Two such windows are 0.8 alike
(sum of smaller over sum of larger shingle counts) only if at least 8/9 of the window's
shingles are the item's, so windows with fewer shingles of any item of their size fingerprint; none that could qualify is left out. Which items a window may hold is
asked of its fingerprint alone: it has 256 bits, in 16 blocks of sixteen. Two that differ in
at most ``radius`` bits agree in some block up to radius // 16 bits, so the items that do so in some
block hold all within the radius. The radius depends on the size: windows 0.8 alike lie
beyond it with a probability of at most ``miss`` (see ``near_copies.reach``), 0.0005 unless
named, which gives a radius of about 60: three bits in a block, which a sixth of unlike items
pass. Items within the radius are verified on the words themselves.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, tune
from .near_copies import reach

SHINGLE = 5
#: Probability at most that windows just alike enough have fingerprints beyond the radius.
MISS = 0.0005
BLOCKS = 16
#: Bytes of a fingerprint.
BYTES = 32
FOUND = "doc_id long, item_id long, window_start long, n_words long, distance int, similarity double"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _powers(inverse: bool, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n+1 bounds of each text's words)."""
    low = [t.casefold() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    inside = _word_chars()[code]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    room = 1 << max(16, int(len(code)).bit_length())
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(7)) * _powers(False, room)[: len(code)], dtype=np.uint64)))
    word = _mix((prefix[end] - prefix[start]) * _powers(True, room)[start])
    return word, np.concatenate(([0], np.searchsorted(start, np.cumsum(size) + 1 - 1, side="left"))) if low else np.zeros(1, np.int64)


def window_hashes(word: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``length`` words, n+1 bounds of each text's runs)."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    at = ranges(first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = (out + word[at + k]) * _MIX
    return _mix(out + np.uint64(length)), np.concatenate(([0], np.cumsum(count)))


@lru_cache(maxsize=1)
def _lanes() -> np.ndarray:
    return np.arange(4, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)


def _prints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash [windows, 32 bytes] of each window of ``n`` shingles from ``starts``, by prefix sums of bits."""
    low = int(starts.min())
    span = hashes[low : int(starts.max()) + n]
    wide = _mix(span[:, None] + _lanes()[None, :])
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 8 * BYTES), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    ones = sums[starts - low + n] - sums[starts - low]
    return np.packbits(2 * ones > n, axis=1, bitorder="little")


def normal_words(text: str) -> list[str]:
    """The words of a text as this module compares them."""
    return "".join(c if c.isalnum() else " " for c in text.casefold()).split(" ")


def _words(text: str) -> list[str]:
    return [w for w in normal_words(text) if w]


def weighted_similarity(a: list[str], b: list[str]) -> float:
    """Sum of smaller over sum of larger shingle counts of two word sequences."""
    def shingles(words: list[str]) -> Counter:
        return Counter(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))) if words else Counter()

    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


class _Size:
    """The items of one number of shingles: the shingles that any of them has, and the multi-index of their fingerprints.

    The index has for each block its different values in order, and the items of each: about 100 bytes an item.
    """

    def __init__(self, items: list[int], hashes: list[np.ndarray], threshold: float, radius: int | None, miss: float):
        self.items, self.n = np.array(items, np.int32), len(hashes[0])
        self.known = np.unique(np.concatenate(hashes))
        self.need = threshold * 2 * self.n / (1 + threshold) - 1e-9
        limits = reach(threshold, miss)
        least = max(1, int(threshold * self.n))  # a text with fewer shingles than that has too few for the item
        self.radius = int(limits[min(least, len(limits) - 1)]) if radius is None else radius
        self.prints = np.concatenate([_prints(h, np.zeros(1, np.int64), self.n) for h in hashes])
        self.blocks = []
        for column in self.prints.view(np.uint16).T:
            order = np.argsort(column, kind="stable").astype(np.int32)
            value, start = np.unique(column[order], return_index=True)
            self.blocks.append((value, np.append(start, len(order)).astype(np.int32), order))

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        """Places of the items that agree with ``fp`` in some block up to radius // BLOCKS bits."""
        found = []
        for own, (value, start, order) in zip(fp.view(np.uint16), self.blocks, strict=True):
            hit = np.flatnonzero(np.bitwise_count(value ^ own) <= self.radius // BLOCKS)
            found.append(order[ranges(start[hit], start[hit + 1] - start[hit])])
        return np.unique(np.concatenate(found))

    def near(self, fp: np.ndarray) -> list[tuple[int, int]]:
        """(place among the items, distance) of every item whose fingerprint is within the radius of ``fp``."""
        found = self.candidates(fp)
        distance = np.bitwise_count(self.prints[found] ^ fp).sum(1, dtype=np.int64)
        return [(int(i), int(d)) for i, d in zip(found, distance, strict=True) if d <= self.radius]


class ItemIndex:
    """Benchmark items by the number of their shingles; items of fewer than five words by the hash of all their words."""

    def __init__(self, ids: list, texts: list[str], threshold: float, radius: int | None = None, miss: float = MISS):
        self.threshold = threshold
        self.ids, self.texts = ids, texts
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for a in range(0, len(texts), 1000):
            word, first = word_hashes(texts[a : a + 1000])
            for i in range(len(first) - 1):
                own = word[first[i] : first[i + 1]]
                if len(own) >= SHINGLE:
                    by_size[len(own) - SHINGLE + 1].append((a + i, window_hashes(own, np.array([0, len(own)]), SHINGLE)[0]))
                elif len(own):
                    self.short[len(own)][int(window_hashes(own, np.array([0, len(own)]), len(own))[0][0])].append(a + i)
        self.sizes = []
        for n in sorted(by_size):
            some = by_size.pop(n)
            self.sizes.append(_Size([i for i, _ in some], [h for _, h in some], threshold, radius, miss))
        # One in eight places of the filter is taken at most; hashes are cut to its size.
        self.shift = np.uint64(64 - max(20, (8 * sum(len(size.known) for size in self.sizes)).bit_length()))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        for size in self.sizes:
            self.filter[(size.known >> self.shift).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, distance, similarity) of the best window for each text and item, the first of equal ones."""
        word, first = word_hashes(texts)
        best: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        split: dict[int, list[str]] = {}
        asked: dict[int, list[str]] = {}

        def offer(t: int, i: int, start: int, size: int, distance: int) -> None:
            if t not in split:
                split[t] = _words(texts[t])
            if i not in asked:
                asked[i] = _words(self.texts[i])
            alike = weighted_similarity(split[t][start : start + size], asked[i])
            if alike >= self.threshold and ((t, i) not in best or alike > best[t, i][3]):
                best[t, i] = (start, size, distance, alike)

        for size, known in self.short.items():
            hashes, bounds = window_hashes(word, first, size)
            for at in np.flatnonzero(np.isin(hashes, np.array(list(known), np.uint64))).tolist():
                t = int(np.searchsorted(bounds, at, side="right")) - 1
                for i in known[int(hashes[at])]:
                    offer(t, i, at - int(bounds[t]), size, 0)
        hashes, bounds = window_hashes(word, first, SHINGLE)
        hits = self.filter[(hashes >> self.shift).astype(np.int64)] if len(hashes) else np.zeros(0, bool)
        sums = np.concatenate(([0], np.cumsum(hits)))
        for t in np.flatnonzero(sums[bounds[1:]] > sums[bounds[:-1]]).tolist():
            a, b = int(bounds[t]), int(bounds[t + 1])
            mine, count = hashes[a:b], int(sums[b] - sums[a])
            for some in self.sizes:
                if count < some.need * min(1, (b - a) / some.n):
                    continue
                self._windows(some, t, mine, hits[a:b], len(_words(texts[t])) if b - a < some.n else 0, offer)
        return [(t, i, *found) for (t, i), found in sorted(best.items())]

    def _windows(self, some: _Size, t: int, mine: np.ndarray, hits: np.ndarray, whole: int, offer) -> None:
        """Offer the windows of one text that may hold items of one size; a shorter text is one window of all its words."""
        n = min(some.n, len(mine))
        need = some.need if n == some.n else self.threshold * (n + some.n) / (1 + self.threshold) - 1e-9
        if need > n:
            return
        known = np.zeros(len(mine), np.int64)
        at = np.flatnonzero(hits)
        place = np.minimum(np.searchsorted(some.known, mine[at]), len(some.known) - 1)
        known[at] = some.known[place] == mine[at]
        sums = np.concatenate(([0], np.cumsum(known)))
        starts = np.flatnonzero(sums[n:] - sums[:-n] >= need)
        for k in range(0, len(starts), 4096):
            part = starts[k : k + 4096]
            for start, fp in zip(part.tolist(), _prints(mine, part, n), strict=True):
                for i, distance in some.near(fp):
                    offer(t, int(some.items[i]), start, whole or n + SHINGLE - 1, distance)


_HELD: dict[str, ItemIndex] = {}


def _index(key: str, shared, threshold: float, radius: int | None, miss: float) -> ItemIndex:
    """A worker's index of a block of items: built once, until another block's is asked for."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = ItemIndex([i for i, _ in shared.value], [t for _, t in shared.value], threshold, radius, miss)
    return _HELD[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int | None = None, miss: float = MISS, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item of which it holds a window: FOUND.

    The window with the highest similarity is given, the first of equal ones. Null
    and empty texts, and items without a word, have no rows. An item of fewer than five
    words is one shingle: it is found wherever its words stand together. A document with fewer
    shingles than the item is one window. Rows that share an id all appear, items that share
    one too; a null id is kept, extra columns are ignored, long texts are read whole, and an
    empty table on either side gives no rows. Items are broadcast in blocks of ``block_bytes``
    of text; each block is a pass over the documents, so benchmarks up to that size take one. A
    worker holds one block's index, about four times its text.
    """
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found: DataFrame | None = None

    def search(shared) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared, threshold, radius, miss)
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    part = batch.slice(a, 200)
                    rows = index.search([t or "" for t in part.column(1).to_pylist()])
                    if rows:
                        t, i, start, size, distance, alike = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array([index.ids[k] for k in i], pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(distance, pa.int32()), pa.array(alike, pa.float64())], [f.split()[0] for f in FOUND.split(", ")])

        return source.mapInArrow(run, FOUND)

    for block in _blocks(spark, benchmark, block_bytes, item_col, item_text_col):
        found = search(block) if found is None else found.union(search(block))
    return found


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int, item_col: str, item_text_col: str) -> Iterator:
    """Broadcasts of (id, text) lists of about ``block_bytes`` of text; one at least, if an empty one."""
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    block, held, sent = [], 0, False
    for row in items.orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text)
        if held >= block_bytes:
            yield spark.sparkContext.broadcast(block)
            block, held, sent = [], 0, True
    if block or not sent:
        yield spark.sparkContext.broadcast(block)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int | None = None, miss: float = MISS, block_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which ``contaminated`` has none, all columns as they are; nothing is shuffled."""
    tune(docs.sparkSession)
    place = docs.columns.index(text_col)

    def search(rows: DataFrame, shared) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared, threshold, radius, miss)
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    part = batch.slice(a, 200)
                    clean = np.ones(part.num_rows, bool)
                    clean[[row[0] for row in index.search([t or "" for t in part.column(place).to_pylist()])]] = False
                    yield part.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    for block in _blocks(docs.sparkSession, benchmark, block_bytes, item_col, item_text_col):
        docs = search(docs, block)
    return docs
