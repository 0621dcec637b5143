"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are divided by the largest
norm and given one more coordinate that makes all norms one; queries are made unit
vectors with a zero there. Each table hashes by ``hashes`` floors of shifted Gaussian
projections. A query visits its own bucket and perturbed ones: every projection's
distance to the neighbouring cells scores a step, and sets of steps are visited in
order of the sum of squared distances, the likeliest first. The candidates of all
tables are reranked by exact inner products in double precision.

A table's buckets are dealt to cells by hash, so many that a cell holds some ten thousand rows.
A row goes once to its bucket's cell in each table, and a query's vector once to each cell that holds
buckets it visits, with the list of these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, tune

FOUND = "query_id long, vec_id long, score double"


class Tables:
    """The hash functions, drawn from a seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, hashes))
        self.b = rng.random((tables, hashes)) * width
        self.width = width

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Real-valued cell positions [tables, rows, hashes] of augmented vectors."""
        return (np.einsum("nd,tdh->tnh", x, self.a) + self.b[:, None, :]) / self.width


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))])


def probes(cell: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """The ``count`` buckets to visit for one query in one table, likeliest first."""
    base = np.floor(cell).astype(int)
    low = cell - base
    # (cost, hash, step): the squared distance to the cell below or above; further cells cost further steps.
    moves = sorted((float(d * d), h, s) for h in range(len(cell)) for s, d in [(-k, low[h] + k - 1) for k in (1, 2, 3)] + [(k, k - low[h]) for k in (1, 2, 3)])
    out, heap = [tuple(base.tolist())], [(moves[0][0], (0,))]
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
        touched = [moves[i][1] for i in chosen]
        if len(set(touched)) == len(touched):  # one step for each hash
            step = base.copy()
            for i in chosen:
                step[moves[i][1]] += moves[i][2]
            out.append(tuple(step.tolist()))
    return out


def _key(cells: np.ndarray) -> np.ndarray:
    """One long for each row of integer cells."""
    key = np.zeros(len(cells), np.int64)
    for column in cells.T.astype(np.int64):
        key = key * np.int64(4096) + column + np.int64(2048)
    return key


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Cell:
    """The rows of a cell, those of a bucket together. Of rows that share an id and a bucket all are kept."""

    def __init__(self, bucket: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        self.ids, self.x, self.rough = ids[order], x[order], x[order].astype(np.float32)
        self.buckets, start = np.unique(bucket[order], return_index=True)
        self.bounds = np.append(start, len(order))
        self.reach = float(np.sqrt((x * x).sum(1).max()))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.repeats = len(np.unique(ids)) < len(ids)

    def rows_of(self, own: int) -> np.ndarray:
        low, high = (np.searchsorted(self.ids[self.by_id], own, side=s) for s in ("left", "right"))
        return self.by_id[low:high]

    def best(self, own: np.ndarray, q: np.ndarray, asked: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the ``k`` nearest that each query meets in the buckets it asks for, by exact inner product, ties to the smaller id; its own rows are left out.

        A bucket meets all its visitors at once, in single precision; what may be among the best by that is scored in double.
        """
        near = np.full((len(own), len(self.ids)), -np.inf, np.float32)
        at = [np.searchsorted(self.buckets, b) for b in asked]
        hits = [p[(p < len(self.buckets)) & (self.buckets[np.minimum(p, len(self.buckets) - 1)] == b)] for p, b in zip(at, asked, strict=True)]
        place, who = np.concatenate(hits), np.repeat(np.arange(len(own)), [len(h) for h in hits])
        order = np.argsort(place, kind="stable")
        place, who = place[order], who[order]
        rough = q.astype(np.float32)
        for group in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1) if len(place) else []:
            a, b, some = self.bounds[place[group[0]]], self.bounds[place[group[0]] + 1], who[group]
            near[some, a:b] = rough[some] @ self.rough[a:b].T
        for r in range(len(own)):
            near[r, self.rows_of(own[r])] = -np.inf
        n = near.shape[1]
        bar = np.partition(near, n - k, axis=1)[:, n - k] if n > k and not self.repeats else np.full(len(own), -np.inf, np.float32)
        slack = 1e-5 * self.reach * np.sqrt((q * q).sum(1))
        for r in range(len(own)):
            at = np.flatnonzero((near[r] >= bar[r] - slack[r]) & (near[r] > -np.inf))
            if len(at):
                score, ids = (self.x[at] * q[r]).sum(1), self.ids[at]
                order = np.lexsort((ids, -score))
                if self.repeats:
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
                yield own[r], ids[order[:k]], score[order[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, hashes: int = 3, width: float = 0.6, visits: int = 90, cell_rows: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product) of each query's ``k`` nearest other rows.

    Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids and vectors of another length than the longest valid one's. A
    query with no candidate has no rows; one with fewer than ``k`` found by its
    visits is searched against all rows, in blocks. Ties go to the smaller id. Rows
    that share an id count once each as candidates but once in a result, with their
    best score. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)

    floats = all(dict(df.dtypes)[vector_col] == "array<float>" for df in (vectors, queries))
    kept = "array<float>" if floats else "array<double>"  # floats are half as much to shuffle; scores are doubles

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast(kept).alias("v"))

    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = valid(vectors)
    about = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("square")).orderBy(F.desc("dim")).limit(1).collect()
    if not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, norm = about[0].dim, float(np.sqrt(about[0].square))
    if not np.isfinite(norm) or norm == 0:
        raise ValueError("vector norms leave the range of doubles")
    rows, asked = rows.where(F.size("v") == dim), valid(queries).where(F.size("v") == dim)
    hasher = Tables(dim, tables, hashes, width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(hasher.cells(augmented(_vectors(batch.column(1)), norm)))
                for t in range(tables):
                    yield batch, t, _key(cells[t])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, key in keys(batches):
            bucket, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), t, np.int32)), pa.array(bucket), pa.array(n)], ["t", "bucket", "n"])

    # Buckets of more than half a cell are cut by id, and their visitors go to every part: tables * 2 * rows / cell_rows of them at most.
    half = max(1, cell_rows // 2)
    full = rows.mapInArrow(count, "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > half)
    parts = {(r.t, r.bucket): -(-r.n // half) for r in full.toLocalIterator()}
    cells = max(1, -(-rows.count() // cell_rows))
    dealt = _Dealer(parts, cells)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t, key in keys(batches):
            cell = dealt.of_rows(t, key, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(cell), pa.array(np.zeros(len(key), np.int32)), batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(len(key) + 1, dtype=np.int32), pa.array(key))], _MET)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                x = _vectors(some.column(1))
                q = np.hstack([x / np.sqrt((x**2).sum(1, keepdims=True)), np.zeros((len(x), 1))])
                at = hasher.cells(q)
                for t in range(tables):
                    who, cell, visited = [], [], []
                    for k_, c in enumerate(at[t]):
                        for where, buckets in dealt.of_visits(t, _key(np.array(probes(c, visits)))):
                            who.append(k_)
                            cell.append(where)
                            visited.append(buckets)
                    bounds = np.concatenate(([0], np.cumsum([len(v) for v in visited]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int32)), pa.array(np.array(cell, np.int64)), pa.array(np.ones(len(who), np.int32)), some.column(0).take(pa.array(who)), some.column(1).take(pa.array(who)), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(visited)))], _MET)

    kind = f"t int, cell long, visitor int, id long, v {kept}, buckets array<long>"
    met = rows.mapInArrow(index, kind).union(asked.mapInArrow(ask, kind)).repartition("t", "cell").sortWithinPartitions("t", "cell", "visitor")
    found = stored(met.mapInArrow(_scorer(k), FOUND), "found")
    final = _ranked(found, k)
    # Queries whose visits brought fewer than k candidates meet all rows, in blocks.
    total = rows.select("id").distinct().count()
    got = final.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.join(got.withColumnRenamed("query_id", "id"), "id", "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select("id", "v")
    short = stored(short, "short")
    if short.isEmpty():
        drop_stored(short)
        return final
    rest = _all_rows(rows, short, k, cell_rows)
    kept = final.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return kept.union(_ranked(rest, k))


def _all_rows(rows: DataFrame, short: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """Exact search for a few queries: blocks of rows against blocks of queries."""
    cells, blocks = max(1, -(-rows.count() // cell_rows)), max(1, -(-short.count() // 2000))
    one = F.array(F.lit(0).cast("long"))
    homes = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("t"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"), F.lit(0).alias("visitor"), "id", "v", one.alias("buckets"))
    visitors = short.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.lit(1).alias("visitor"), "id", "v", one.alias("buckets"))
    met = homes.union(visitors).repartition("t", "cell").sortWithinPartitions("t", "cell", "visitor")
    return met.mapInArrow(_scorer(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Dealer:
    """Which cell of a table a row or a visit belongs to: by the bucket's hash, and for a bucket in parts by the part's."""

    def __init__(self, parts: dict[tuple[int, int], int], cells: int):
        self.parts, self.cells = parts, cells
        self.full = {t: np.array(sorted(b for s, b in parts if s == t), np.int64) for t in {t for t, _ in parts}}

    def _cell(self, t: int, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = (bucket.view(np.uint64) + np.uint64(t << 40)) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.cells)).astype(np.int64)

    def of_rows(self, t: int, bucket: np.ndarray, ids: np.ndarray) -> np.ndarray:
        part = np.zeros(len(bucket), np.int64)
        for k in np.flatnonzero(np.isin(bucket, self.full[t])).tolist() if t in self.full else []:
            part[k] = (int(ids[k]) * 0x9E3779B97F4A7C15 >> 20) % self.parts[t, int(bucket[k])]
        return self._cell(t, bucket, part)

    def of_visits(self, t: int, bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(cell, buckets there) of the buckets that a query visits."""
        more = np.flatnonzero(np.isin(bucket, self.full[t])) if t in self.full else np.zeros(0, np.int64)
        every, part = [bucket], [np.zeros(len(bucket), np.int64)]
        for k in more.tolist():
            n = self.parts[t, int(bucket[k])] - 1
            every.append(np.full(n, bucket[k]))
            part.append(np.arange(1, n + 1))
        bucket = np.concatenate(every)
        cell = self._cell(t, bucket, np.concatenate(part))
        pair = np.unique(np.stack([cell, bucket], 1), axis=0)
        heads = np.flatnonzero(np.concatenate(([True], pair[1:, 0] != pair[:-1, 0])))
        return [(int(pair[a, 0]), pair[a:b, 1]) for a, b in zip(heads, [*heads[1:], len(pair)], strict=True)]


_MET = ["t", "cell", "visitor", "id", "v", "buckets"]


def _scorer(k: int):
    """Over rows sorted by cell, homes before visitors: the k best that each visitor finds in its buckets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            vec, own, visited = _vectors(batch.column(4)), batch.column(3).to_numpy(zero_copy_only=False), batch.column(5)
            bounds, buckets = visited.offsets.to_numpy() - visited.offsets[0].as_py(), visited.flatten().to_numpy()
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if (here := tuple(key[a, :2].tolist())) != where:
                    where, held, cell = here, [], None
                if key[a, 2] == 0:
                    held.append((buckets[bounds[a] : bounds[b]], own[a:b], vec[a:b]))
                    continue
                if not held:
                    continue
                if cell is None:
                    cell, held = Cell(*(np.concatenate(c) for c in zip(*held, strict=True))), held[:1]
                for c in range(a, b, 64):
                    d = min(b, c + 64)
                    out += cell.best(own[c:d], vec[c:d], [buckets[bounds[r] : bounds[r + 1]] for r in range(c, d)], k)
            for a in range(0, len(out), 500):
                some = out[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, *_ in some], np.int64), [len(f[1]) for f in some])), pa.array(np.concatenate([f[1] for f in some])), pa.array(np.concatenate([f[2] for f in some]))], ["query_id", "vec_id", "score"])

    return run
