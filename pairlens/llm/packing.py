"""Best-fit packing of documents into fixed-size sequences by a grouping genetic algorithm.

Documents are dealt into blocks of about ``block_items`` pieces. Every block is
packed by several islands; an island keeps a population of packings, crosses them
by injecting whole well-filled sequences of one parent into the other, drops the
sequences that hold injected documents a second time, and puts the displaced
documents back by best fit, largest first. After each epoch an island's elite
moves to the next island of its block through a shuffle. An island stops as soon
as it needs no more sequences than the sum of lengths requires. The least filled
sequence of each block goes to the next level, which packs those in the same way,
until one block is left. A block holds tokens for four sequences at least, however
small its pieces are, so every level has at most a quarter of the tokens before it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, tune
from .tokens import token_cache

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
ISLAND = "block long, island int, lengths binary, elites array<binary>, bins int, fitness double"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: ids of its text, then the end id, cut only beyond ``capacity``. ``item`` numbers the rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, item = token_cache(tokenizer_path), TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                rows: list[list] = [[], [], [], [], [], []]
                for doc, code in zip(some.column(0).to_pylist(), cache.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    code = memoryview(code + end)
                    for k, at in enumerate(range(0, len(code), 4 * capacity)):
                        part = code[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), item), strict=True):
                            column.append(value)
                        item += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, PIECE)


def best_fit(order: list[int], sizes: list[int], free: list[tuple[int, int]], owner: np.ndarray, next_bin: int, capacity: int) -> int:
    """Put the items of ``order`` each into the fullest bin that takes it. ``free``: sorted (room, bin). Returns the next new bin."""
    for i in order:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, next_bin = capacity, next_bin, next_bin + 1
        owner[i] = b
        if room > size:
            insort(free, (room - size, b))
    return next_bin


class Island:
    """One population of packings of the same items."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int, size: int = 6):
        self.lengths, self.capacity, self.size = lengths.astype(np.int64), capacity, size
        self.sizes, self.rng = self.lengths.tolist(), np.random.default_rng(seed)
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.pop: list[tuple[int, float, np.ndarray]] = []

    def add(self, owner: np.ndarray) -> None:
        """Take in a packing, numbered anew; the best ones stay."""
        _, owner = np.unique(owner, return_inverse=True)
        fill = np.bincount(owner, self.lengths) / self.capacity if len(owner) else np.zeros(0)
        self.pop.append((len(fill), -float((fill**2).sum()), owner.astype(np.int32)))
        self.pop.sort(key=lambda x: x[:2])
        del self.pop[self.size :]

    def done(self) -> bool:
        return bool(self.pop) and self.pop[0][0] <= self.least

    def start(self) -> None:
        """Best fit decreasing, and the same in shaken orders."""
        for k in range(self.size):
            if self.done():
                return
            shaken = self.lengths * (1 + 0.15 * k * self.rng.random(len(self.lengths)))
            owner = np.zeros(len(self.lengths), np.int32)
            best_fit(np.argsort(-shaken, kind="stable").tolist(), self.sizes, [], owner, 0, self.capacity)
            self.add(owner)

    def _insert(self, owner: np.ndarray) -> None:
        """Best-fit the items without a bin (-1), largest first."""
        loose = np.flatnonzero(owner < 0)
        bins = int(owner.max(initial=-1)) + 1
        fill = np.bincount(owner[owner >= 0], self.lengths[owner >= 0], bins).astype(np.int64)
        used = np.bincount(owner[owner >= 0], minlength=bins) > 0
        free = sorted((self.capacity - f, b) for b, f in enumerate(fill.tolist()) if used[b] and f < self.capacity)
        best_fit(loose[np.argsort(-self.lengths[loose], kind="stable")].tolist(), self.sizes, free, owner, bins, self.capacity)

    def child(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` with a part of the well-filled bins of ``b`` injected whole."""
        fill = np.bincount(b, self.lengths)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        taken = np.zeros(len(fill), bool)
        taken[self.rng.permutation(good)[: max(1, len(good) // 2)]] = True
        moved = taken[b]
        gone = np.zeros(int(a.max()) + 1, bool)
        gone[a[moved]] = True  # bins that hold an injected item a second time
        out = np.where(moved, b + len(gone), np.where(gone[a], -1, a)).astype(np.int64)
        rest = np.flatnonzero(np.bincount(a, minlength=len(gone))[: len(gone)] * ~gone)
        if len(rest):  # mutation: open the emptiest bins that stay
            level = np.bincount(a, self.lengths, len(gone))[rest]
            out[np.isin(out, rest[np.argsort(level)[: 2 + len(rest) // 50]])] = -1
        self._insert(out)
        return out

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            if self.done() or len(self.pop) < 2:
                return
            i, j = self.rng.choice(len(self.pop), 2, replace=False)
            self.add(self.child(self.pop[i][2], self.pop[j][2]))


def pack_level(items: DataFrame, capacity: int, level: int, block_items: int, islands: int, epochs: int, generations: int) -> tuple[DataFrame, int]:
    """Pack stored pieces; returns them with sequence_id, offset and ``spare`` (in their block's emptiest sequence), and the number of blocks."""
    count, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    blocks = max(1, min(-(-count // block_items), tokens // (4 * capacity)))
    dealt = stored(items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("item", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("items")), "blocks")

    def evolve(epoch: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.itertuples():
                    lengths = np.frombuffer(row.lengths, "<i4") if epoch else np.asarray(row.sizes, "<i4")
                    isle = Island(lengths, capacity, zlib.crc32(f"{level}:{row.block}:{row.island}:{epoch}".encode()))
                    if epoch:
                        for elite in [*row.elites, *row.guests]:
                            isle.add(np.frombuffer(elite, "<i4"))
                    else:
                        isle.start()
                    isle.evolve(generations)
                    best = isle.pop[0]
                    out.append((row.block, row.island, lengths.tobytes(), [p[2].astype("<i4").tobytes() for p in isle.pop[:3]], best[0], best[1]))
                yield pd.DataFrame(out, columns=["block", "island", "lengths", "elites", "bins", "fitness"])

        return run

    state = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("sizes"))
    state = stored(state.mapInPandas(evolve(0), ISLAND), "islands")
    for epoch in range(1, epochs):
        guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.slice("elites", 1, 1).alias("guests"))
        fresh = stored(state.join(guests, ["block", "island"]).mapInPandas(evolve(epoch), ISLAND), "islands")
        drop_stored(state)
        state = fresh
    best = state.groupBy("block").agg(F.min(F.struct("bins", "fitness", "island", F.col("elites")[0].alias("owner"))).alias("best"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                owner = np.frombuffer(row.owner, "<i4")
                out = pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in row.items_], columns=["doc_id", "piece", "start", "length", "ids_crc32", "item"])
                order = np.argsort(owner, kind="stable")
                sizes = out["length"].to_numpy()[order]
                ends = np.cumsum(sizes)
                heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
                offset = np.empty(len(owner), np.int64)
                offset[order] = ends - sizes - np.repeat((ends - sizes)[heads], np.diff(np.append(heads, len(owner))))
                fill = np.bincount(owner, out["length"])
                out["sequence_id"] = (level << 56) + (int(row.block) << 20) + owner.astype(np.int64)
                out["offset"], out["spare"] = offset, owner == int(fill.argmin())
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    named = dealt.join(best, "block").select("block", F.col("best.owner").alias("owner"), F.col("items").alias("items_"))
    packed = stored(named.mapInPandas(place, PIECE + ", sequence_id long, offset long, spare boolean"), "packed")
    drop_stored(dealt)
    drop_stored(state)
    return packed, blocks


def pack_pieces(pieces: DataFrame, capacity: int, block_items: int = 2048, islands: int = 4, epochs: int = 2, generations: int = 12) -> DataFrame:
    """Sequence and offset for stored pieces (PIECE). A piece of full length is a sequence by itself."""
    full = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, parts = pieces.where(F.col("length") < capacity), 1, [full]
    while True:
        packed, blocks = pack_level(rest, capacity, level, block_items, islands, epochs, generations)
        if blocks == 1:
            return _union([*parts, packed.drop("spare")])
        parts.append(packed.where("not spare").drop("spare"))
        rest, level = packed.where("spare").select(*pieces.columns), level + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pack every document of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece, the end id alone. A null id is kept.
    Rows that share an id are documents of their own. Extra columns are ignored.
    An empty table gives no rows. Sequence numbers have no order.
    """
    tune(docs.sparkSession)
    pieces = stored(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, **options).drop("item")
