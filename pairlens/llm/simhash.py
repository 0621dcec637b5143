"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints that differ in few bits also differ little in the bit counts of any
part of them: the sum over parts of the count differences never exceeds the
Hamming distance. Distinct fingerprints are dealt to tiles by the bit counts of
their two halves; a tile meets only tiles whose counts are within the radius,
and inside a task blocks of finer counts (eight bytes) are skipped by the same rule.
What is left is compared in full with exclusive-or and bit counts. A task returns
a spanning forest of its links, so groups of near copies never become all pairs.
Groups are the connected components, found by joins over stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, tune

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words (fewer words: of them all; none: no value)."""
    from xxhash import xxh64_intdigest

    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(joined, seed)], "<u8")
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(tokens) - words + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """64 bits: each set if it is set in over half the values; zero without values."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits: each set if it is set in over half the shingles' XXH64 values (repeats count); zero without words."""
    return _majority(_shingles(text, words, seed))


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, high: bool) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 32) if high else fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a-b (values), those that join trees so far apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _blocks(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints in blocks of like byte counts: (lowest and highest count by byte, members)."""
    if not len(fp):
        return []
    counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8))
    order = np.lexsort(counts.T)
    fp, counts = fp[order], counts[order].astype(np.int16)
    return [(np.stack([counts[a : a + 256].min(0), counts[a : a + 256].max(0)]), fp[a : a + 256]) for a in range(0, len(fp), 256)]


def tile_links(own: np.ndarray, other: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles of distinct fingerprints (or within one)."""
    left, right = _blocks(own), _blocks(own if same else other)
    links: list[tuple[int, int]] = []
    if not left or not right:
        return links
    bounds = np.stack([b for b, _ in right])
    for i, (mine, a) in enumerate(left):
        apart = np.maximum(0, np.maximum(mine[0] - bounds[:, 1], bounds[:, 0] - mine[1])).sum(1)
        for j in np.flatnonzero(apart <= radius):
            if same and j < i:
                continue
            b = right[j][1]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if same and i == j:
                keep = x < y
                x, y = x[keep], y[keep]
            if len(x):
                links += _forest(a[x].view(np.int64), b[y].view(np.int64))
    return _forest(*np.array(links, np.int64).T) if links else links


def near_links(distinct: DataFrame, radius: int, rows_per_tile: int = 20_000) -> DataFrame:
    """Stored links (a, b) between distinct fingerprints (column fp) within ``radius``: a spanning forest by pair of tiles."""
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    low, high = _half(F.col("fp"), False), _half(F.col("fp"), True)
    # Each fingerprint is at home in its tile and a guest in the tiles before it, packed by (tile, chunk) first.
    # A very full tile is cut by chunk; each chunk meets every chunk, as blocks.
    homes = distinct.select("fp", low.alias("lo"), high.alias("hi"))
    sizes = homes.groupBy("lo", "hi").agg(F.ceil(F.count("*") / rows_per_tile).cast("int").alias("chunks"))  # 33 * 33 rows at most
    homes = homes.join(F.broadcast(sizes), ["lo", "hi"])
    packed = homes.groupBy("lo", "hi", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    packed = stored(packed, "tiles")
    # Pairs of chunks are named first (a row each), so that the fingerprints of a full tile meet by chunk, in as many tasks as there are pairs.
    ends = packed.select("lo", "hi", "chunk")
    near = ends.select(F.explode(F.array(*[F.struct((F.col("lo") - i).alias("lo"), (F.col("hi") - j).alias("hi"), F.lit(int((i, j) == (0, 0))).alias("same")) for i, j in steps])).alias("t"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"), F.col("chunk").alias("guest"))
    met = ends.join(near.select("t.lo", "t.hi", "t.same", "glo", "ghi", "guest"), ["lo", "hi"]).where("same = 0 or chunk <= guest")
    guests = packed.select(F.col("lo").alias("glo"), F.col("hi").alias("ghi"), F.col("chunk").alias("guest"), F.col("fps").alias("other"))
    pairs = met.join(packed.select("lo", "hi", "chunk", F.col("fps").alias("own")), ["lo", "hi", "chunk"]).join(guests, ["glo", "ghi", "guest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, other = (np.asarray(batch.column(c)[row].values).view(np.uint64) for c in ("own", "other"))
                within = bool(batch.column("same")[row].as_py()) and batch.column("chunk")[row].as_py() == batch.column("guest")[row].as_py()
                links = tile_links(own, other, radius, within)
                if links:
                    a, b = np.array(links, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = stored(pairs.repartition("lo", "hi", "glo", "ghi", "chunk", "guest").mapInArrow(run, "a long, b long"), "links")
    drop_stored(packed)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of stored links (a, b): root is the smallest node reachable.

    Each round every node goes to its first neighbour's first neighbour (itself, where it is first), which never
    leaves its group, and the links between the nodes gone to, once each, are the next round's: a round reads
    only links that still join different nodes. First is the smallest, which takes up stars at once, and in
    every second round the least hash, which shortens any path. What nodes went to is followed at the end.
    """
    rounds: list[DataFrame] = []
    edges = links
    while not rounds or not edges.isEmpty():
        rank = (lambda c: F.xxhash64(c, F.lit(len(rounds)))) if len(rounds) % 2 else F.col
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near")
        first = both.groupBy("node").agg(F.min_by("near", rank("near")).alias("near"))
        heads = first.select("node", F.when(rank("near") < rank("node"), F.col("near")).otherwise(F.col("node")).alias("root"))
        onward = heads.toDF("root", "onward")
        rounds.append(stored(heads.join(onward, "root").select("node", F.col("onward").alias("root")), "heads"))
        x, y = (rounds[-1].toDF(c, f"to_{c}") for c in "ab")
        moved = edges.join(x, "a").join(y, "b").where("to_a <> to_b")
        left = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if edges is not links:
            drop_stored(edges)
        edges = left
    roots = rounds[-1]
    for heads in rounds[-2::-1]:  # fewer nodes each round
        roots = heads.join(roots.toDF("root", "onward"), "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
    labels = stored(roots, "labels")
    for table in (edges, *rounds):
        drop_stored(table)
    if len(rounds) > 1:
        reached = labels
        least = reached.groupBy("root").agg(F.min("node").alias("least"))
        labels = stored(reached.join(least, "root").select("node", F.col("least").alias("root")), "labels")
        drop_stored(reached)
    return labels


def simhash_groups(docs: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer
    than ``words`` words is one shingle; without words (null too) its fingerprint is
    zero and links like any other. component_id is the smallest non-null doc_id in
    reach (null where there is none). Rows that share an id all appear. Extra columns
    are ignored; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = near_links(classes.select("fp"), radius)
    if links.isEmpty():
        least = classes.select("fp", F.col("first").alias("component_id"))
    else:
        roots = components(links).withColumnsRenamed({"node": "fp"})
        grouped = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        first = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
        least = grouped.join(first, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(least, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")
