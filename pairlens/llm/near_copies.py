"""Near copies by shingle similarity: wide SimHash, tiled exact comparison, then the exact similarity.

Two sets of shingles that are 0.8 alike differ in about a seventh of their SimHash
bits. 64 bits would not tell them from unrelated texts, so a fingerprint here has
four lanes of 64. The radius depends on the sizes of the sets: beyond it a link lies
with a probability of at most 1e-9, reckoned exactly for small sets, whose ties
make more bits differ. Bit counts skip next to nothing at such radii, so fingerprints are
dealt to tiles by the least values of their shingles under ``ROWS`` multipliers for each
of ``BANDS`` bands: sets 0.8 alike share no tile with a probability of (1 - 0.8^ROWS)^BANDS,
7e-10. Large tiles are cut into chunks, which meet in pairs. Inside a task blocks of
fingerprints whose sizes are too far apart, or whose bit counts differ beyond the radius,
are skipped; the rest is compared in full by exclusive-or and bit counts. A task returns
a star for each group of near copies, around its smallest node, so groups never become all
pairs, and tiles with the same members return the same links. Chunks are settled alone first;
where two meet, their groups are nodes, so that a large group isn't linked again in each pair.

What these forests reach is a cloud: any two fingerprints within the radius are in one. Only
then do shingles move, each set once, to its cloud, which is cut into chunks again. Its
fingerprints are compared once more, and what is near and not yet of one group is held
against the shingles themselves. Only links that pass make groups, and none is left untried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_stored, stored, tune
from .simhash import _majority, _shingles, components

LANES = 4
BANDS, ROWS = 40, 4
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PRINT = [f"f{i}" for i in range(LANES)]


def radii(similarity: float) -> tuple[int, int]:
    """Distances at which large sets of ``similarity`` are surely and on average apart."""
    bits = 64 * LANES
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = 4 * math.sqrt(bits * part * (1 - part))
    mean = bits * part
    return max(0, int(mean - spread)), int(mean)


def flip(both: int, a: int, b: int) -> float:
    """Probability that a SimHash bit differs between sets with ``both`` shingles in common, and ``a`` and ``b`` of their own."""
    share = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    at = np.arange(both + 1)

    def high(own: int) -> np.ndarray:  # by the number of common shingles that have the bit
        over = np.append(np.cumsum(share(own)[::-1])[::-1], 0.0)
        return over[np.clip((both + own) // 2 + 1 - at, 0, own + 1)]

    x, y = high(a), high(b)
    return float((share(both) * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache
def reach(similarity: float, miss: float = 1e-9, most: int = 64) -> np.ndarray:
    """Radius by the size of the smaller set; the last one, that of 48 to ``most`` shingles, holds for all above.

    Sets of at least ``similarity`` lie beyond it with a probability of at most ``miss``.
    """
    bits = 64 * LANES
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) for k in range(bits + 1)])
    out = np.zeros(most + 1, np.int64)
    for n in range(1, most + 1):
        worst = 0.0
        for m in range(n, int(n / similarity + 1e-9) + 1):
            least = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            worst = max([worst, *(flip(c, n - c, m - c) for c in range(least, n + 1))])
        if worst:
            k = np.arange(bits + 1)
            beyond = np.cumsum(np.exp(ways + k * math.log(worst) + (bits - k) * math.log1p(-worst))[::-1])[::-1]
            out[n] = int(np.argmax(beyond <= miss)) - 1 if beyond[-1] <= miss else bits
    out[48:] = out[48:].max()
    return np.maximum.accumulate(out[::-1])[::-1]


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The tile of a set of shingles in each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[a : a + 1024, None] * _factors()).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(29)) ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))).view(np.int64).tolist()


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The number of shingles of a set, then the lanes of its SimHash (all zero without shingles)."""
    lanes = []
    for k in range(LANES):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX
        lanes.append(_majority(x ^ (x >> np.uint64(31))))
    return [len(hashes), *lanes]


class Tiles:
    """One tile against another, or against itself: blocks of fingerprints that may lie within the radius.

    Rows: lanes, size, node, group. Rows of one group are settled and no longer compared.
    """

    def __init__(self, own: np.ndarray, other: np.ndarray | None, similarity: float, block: int = 512):
        order = [np.argsort(x[:, LANES], kind="stable") for x in ([own] if other is None else [own, other])]
        self.order = np.concatenate((order[0], *[x + len(own) for x in order[1:]]))
        rows = (own if other is None else np.concatenate((own, other)))[self.order]
        self.prints, self.sizes = np.ascontiguousarray(rows[:, :LANES]).view(np.uint64), rows[:, LANES]
        self.nodes, self.groups = rows[:, LANES + 1], rows[:, LANES + 2]
        self.label = np.unique(self.groups, return_inverse=True)[1]
        self.counts = np.bitwise_count(self.prints).astype(np.int16)
        self.similarity, self.limits, self.alone = similarity, (*radii(similarity), 64 * LANES), other is None
        self.reach = reach(similarity)
        cut = [slice(x, min(x + block, len(own))) for x in range(0, len(own), block)]
        self.first = cut
        self.second = cut if other is None else [slice(x, min(x + block, len(rows))) for x in range(len(own), len(rows), block)]

    def partners(self, i: slice) -> list[slice]:
        """The blocks to compare with block ``i``; within one tile those from ``i`` on."""
        return [j for j in self.second if not (self.alone and j.start < i.start) and not self._far(i, j)]

    def _limit(self, i: slice, j: slice) -> int:
        """The radius of the smallest sets of two blocks, which is the largest."""
        return int(self.reach[min(self.sizes[i][0], self.sizes[j][0], len(self.reach) - 1)])

    def _far(self, i: slice, j: slice) -> bool:
        if min(self.sizes[i][-1], self.sizes[j][-1]) < self.similarity * max(self.sizes[i][0], self.sizes[j][0]):
            return True
        gap = np.maximum(self.counts[i].min(0) - self.counts[j].max(0), self.counts[j].min(0) - self.counts[i].max(0))
        return int(np.maximum(gap, 0).sum()) > self._limit(i, j)

    def compare(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """(distances, which pairs are of different groups, near enough and of like size)."""
        x, y = self.label[i], self.label[j]
        apart = np.zeros((len(x), len(y)), np.uint16)
        if x.min() == x.max() == y.min() == y.max():
            return apart, np.zeros(apart.shape, bool)
        for k in range(LANES):
            apart += np.bitwise_count(self.prints[i, k][:, None] ^ self.prints[j, k][None, :])
        near = apart <= self._limit(i, j)
        if near.any():
            a, b = self.sizes[i][:, None], self.sizes[j][None, :]
            near &= (x[:, None] != y[None, :]) & (np.minimum(a, b) >= self.similarity * np.maximum(a, b))
            if self.alone and i.start == j.start:
                near &= np.tri(len(x), k=-1, dtype=bool).T
        return apart, near

    def forest(self) -> list[tuple[int, int]]:
        """Links (nodes) that join all groups within the radius, nearer ones first."""
        links, todo = [], [(i, j) for i in self.first for j in self.partners(i)]
        for limit in self.limits:
            again = []
            for i, j in todo:
                apart, near = self.compare(i, j)
                while True:
                    near &= self.label[i][:, None] != self.label[j][None, :]
                    short = near & (apart <= limit)
                    at = np.flatnonzero(short.any(1))
                    if not len(at):
                        break
                    to = np.where(short[at], apart[at], 999).argmin(1)
                    for x, y in zip((at + i.start).tolist(), (to + j.start).tolist(), strict=True):
                        if self.label[x] != self.label[y]:
                            self.label[self.label == self.label[y]] = self.label[x]
                            links.append((int(self.nodes[x]), int(self.nodes[y])))
                if near.any():
                    again.append((i, j))
            todo = again
        return links

    def verified(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links (nodes) between groups that pass the exact similarity; ``sets`` has the shingles by node."""
        links = []
        for i in self.first:
            for j in self.partners(i):
                _, near = self.compare(i, j)
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(rows):
                    continue
                both = common([sets[k] for k in self.nodes[i][rows]], [sets[k] for k in self.nodes[j][columns]])
                total = self.sizes[i][rows][:, None] + self.sizes[j][columns][None, :] - both
                good = near[np.ix_(rows, columns)] & (both / np.maximum(total, 1) >= self.similarity)
                rows, columns = rows + i.start, columns + j.start
                while True:
                    good &= self.label[rows][:, None] != self.label[columns][None, :]
                    at = np.flatnonzero(good.any(1))
                    if not len(at):
                        break
                    for x, y in zip(rows[at].tolist(), columns[good[at].argmax(1)].tolist(), strict=True):
                        if self.label[x] != self.label[y]:
                            self.label[self.label == self.label[y]] = self.label[x]
                            links.append((int(self.nodes[x]), int(self.nodes[y])))
        return links


    def roots(self) -> np.ndarray:
        """By row, in the order given: the smallest of the groups that its group has been joined to, or its own."""
        least = np.full(len(self.label), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.groups)
        out = np.empty(len(self.label), np.int64)
        out[self.order] = least[self.label]
        return out


def common(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each set of ``one`` has in common with each of ``two``: products of their columns, ``width`` values at a time."""
    flat = [np.concatenate(some) for some in (one, two)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(one), len(two)), np.float32)
    if not len(shared):
        return out
    at = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
    row = [np.repeat(np.arange(len(some)), [len(x) for x in some]) for some in (one, two)]
    held = [shared[k] == x for k, x in zip(at, flat, strict=True)]
    for a in range(0, len(shared), width):
        parts = []
        for k, some in enumerate((one, two)):
            part = np.zeros((len(some), min(width, len(shared) - a)), np.float32)
            here = held[k] & (at[k] >= a) & (at[k] < a + width)
            part[row[k][here], at[k][here] - a] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def chunk_links(packed: DataFrame, key: str, table: Callable, join: Callable) -> DataFrame:
    """Stored links (a, b) between the rows of each key of a stored table (key, chunk, chunks, own).

    Chunks are joined alone first, then each meets every later one of its key, groups as nodes. Pairs are
    named first, so that no task holds all chunks of a key. ``table`` takes a value of ``own`` to its rows for
    ``Tiles`` (the last column: nodes) and what else ``join`` needs; ``join`` takes one or two of these and
    returns the roots of their rows. A group's links are a star around its smallest node.
    """

    def stars(roots: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
        links = np.unique(np.stack((roots, groups), 1)[roots != groups], axis=0)
        return [links] if len(links) else []

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, settled = [], []
            for k in range(batch.num_rows):
                own = table(batch.column("own")[k].values)
                roots = join(own, None)
                links += stars(roots, own[0][:, -1])
                if batch.column("chunks")[k].as_py() > 1:
                    settled.append((batch.column(key)[k].as_py(), batch.column("chunk")[k].as_py(), roots))
            if links:
                a, b = np.concatenate(links).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), t) for t in kinds]], names)
            if settled:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(settled), pa.int64())] * 2, *[pa.array(x, t) for x, t in zip(zip(*settled, strict=True), kinds, strict=True)]], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                own, other = (table(batch.column(c)[k].values) for c in ("own", "other"))
                groups = [np.asarray(batch.column(c)[k].values) for c in ("settled", "known")]
                for side, known in zip((own, other), groups, strict=True):
                    side[0][:, -1] = known
                links += stars(join(own, other), np.concatenate(groups))
            if links:
                a, b = np.concatenate(links).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    names, kinds = ["a", "b", key, "chunk", "settled"], (pa.int64(), pa.int32(), pa.list_(pa.int64()))
    found = stored(packed.select(key, "chunk", "chunks", "own").mapInArrow(alone, f"a long, b long, {key} long, chunk int, settled array<long>"), "alone")
    settled = found.where("settled is not null").select(key, "chunk", "settled")
    ends = settled.select(key, "chunk")
    pairs = ends.join(ends.withColumnRenamed("chunk", "guest"), key).where("chunk < guest")
    full = packed.where("chunks > 1").select(key, "chunk", "own").join(settled, [key, "chunk"])
    sides = pairs.join(full, [key, "chunk"]).join(full.toDF(key, "guest", "other", "known"), [key, "guest"])
    met = sides.select("own", "settled", "other", "known").mapInArrow(meet, "a long, b long")
    links = stored(found.where("settled is null").select("a", "b").union(met).distinct(), "links")
    drop_stored(found)
    return links


def candidate_links(classes: DataFrame, similarity: float, rows_per_tile: int = 8000) -> DataFrame:
    """Stored links (a, b) of ``classes`` (lanes, size, node, bands) that join, tile by tile, what is within the radius."""
    homes = classes.select(F.explode("bands").alias("tile"), "node")
    several = homes.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1").select("tile", F.ceil(F.col("n") / rows_per_tile).cast("int").alias("chunks"))
    homes = homes.join(several, "tile").select("tile", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", "chunks")
    rows = homes.join(classes.select("node", F.array(*_PRINT, "size", "node", "node").alias("row")), "node")
    packed = stored(rows.groupBy("tile", "chunk").agg(F.flatten(F.collect_list("row")).alias("own"), F.max("chunks").alias("chunks")), "tiles")

    def table(held: pa.Array) -> tuple[np.ndarray]:
        return (np.array(held).reshape(-1, LANES + 3),)

    def join(own: tuple, other: tuple | None) -> np.ndarray:
        tiles = Tiles(own[0], other and other[0], similarity)
        tiles.forest()
        return tiles.roots()

    links = chunk_links(packed, "tile", table, join)
    drop_stored(packed)
    return links


def sound_links(source: DataFrame, classes: DataFrame, links: DataFrame, words: int, similarity: float, rows_per_chunk: int = 1000, shingles_per_chunk: int = 500_000) -> DataFrame:
    """Stored links (a, b) that join, cloud by cloud of ``links``, what passes the exact similarity or is linked by rows that do."""
    clouds = components(links).withColumnRenamed("root", "cloud")
    members = stored(clouds.join(classes.select("node", "size", *_PRINT), "node"), "members")
    full = members.groupBy("cloud").agg(F.ceil(F.greatest(F.count("*") / rows_per_chunk, F.sum("size") / shingles_per_chunk)).cast("int").alias("chunks"))
    dealt = members.join(full, "cloud").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingles(t or b"", words, 42)).tobytes() for t in batch.column("text_").cast(pa.binary()).to_pylist()]
            names = ["cloud", "chunk", "chunks", "node", "size", *_PRINT]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sets, pa.binary())], [*names, "shingles"])

    kind = "cloud long, chunk int, chunks int, node long, size long, " + ", ".join(f"{c} long" for c in _PRINT) + ", shingles binary"
    text = source.select(F.col("uid").alias("node"), "text_")
    rows = dealt.hint("shuffle_hash").join(text, "node").mapInArrow(read, kind)
    packed = stored(rows.groupBy("cloud", "chunk").agg(F.collect_list(F.struct(*_PRINT, "size", "node", "shingles")).alias("own"), F.max("chunks").alias("chunks")), "clouds")

    def table(held: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        nodes = held.field("node").to_numpy()
        rows = np.stack([*[held.field(c).to_numpy() for c in (*_PRINT, "size")], np.arange(len(nodes)), nodes], 1)
        return rows, [np.frombuffer(x, np.uint64) for x in held.field("shingles").to_pylist()]

    def join(own: tuple, other: tuple | None) -> np.ndarray:
        (rows, sets), (more, guests) = own, other or (None, [])
        if more is not None:
            more[:, LANES + 1] += len(rows)  # places in both lists of sets
        tiles = Tiles(rows, more, similarity)
        tiles.verified(sets + guests)
        return tiles.roots()

    sound = chunk_links(packed, "cloud", table, join)
    drop_stored(members)
    drop_stored(packed)
    return sound


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, the first of rows that share it.

    Rows are linked where the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``similarity``; a group is what links reach. Words are runs
    without ASCII white space, A-Z lower-cased; a text with fewer words is one
    shingle, and all texts without words, null ones too, are copies of each other. A
    row without an id stays only if no row of its group has one. All columns come
    back, whatever their names; an empty table gives no rows; long texts are read whole.
    A link of 0.8 is missed if its sets share no tile (7e-10; less if they are more alike)
    or if its fingerprints lie beyond ``reach`` (at most 1e-9). ``docs`` must read the
    same rows in the same order each time, as tables do: rows are numbered.
    """
    tune(docs.sparkSession)
    names = docs.columns
    source = bucketed(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)]), "uid", "texts")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [np.unique(_shingles(t or b"", words, 42)) for t in part.column("text_").cast(pa.binary()).to_pylist()]
                same = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
                values = np.array([wide_fingerprint(x) for x in sets], np.uint64).reshape(-1, LANES + 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id_"), pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), *[pa.array(values[:, k].copy()) for k in range(LANES + 1)], pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))], ["uid", "id_", "s1", "s2", "size", *_PRINT, "bands"])

    id_type = source.schema["id_"].dataType.simpleString()
    marked = source.select("uid", "id_", "text_").mapInArrow(mark, f"uid long, id_ {id_type}, s1 long, s2 long, size long, " + ", ".join(f"{c} long" for c in _PRINT) + ", bands array<long>")
    first = F.min(F.struct(F.col("id_").isNull().alias("no_id"), "id_", "uid")).alias("first")
    same = marked.groupBy("s1", "s2").agg(first, F.first(F.struct("size", *_PRINT, "bands")).alias("p"))  # equal sets: all else is equal too
    classes = stored(same.select(F.col("first.uid").alias("node"), "first", "p.*"), "classes")

    links = candidate_links(classes, similarity)
    sound = sound_links(source, classes, links, words, similarity)
    roots = components(sound)
    roots = roots.withColumnRenamed("root", "known")
    whole = classes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("known", "node").alias("root")).agg(F.min("first").alias("first"))
    stays = whole.select(F.col("first.uid").alias("uid"))
    kept = stored(source.join(stays.hint("shuffle_hash"), "uid", "left_semi").select(*[f"kept_{i}" for i in range(len(names))]), "kept")
    for table in (source, classes, links, sound):
        drop_stored(table)
    return kept.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])
