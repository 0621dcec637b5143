"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of ``length`` bytes holds an anchor: the gram of ``gram`` bytes with the
smallest hash in it. Equal strings hold equal anchors at equal places, so only anchors
are shuffled: first the hashes alone, to find those that occur again, then the anchors
that have one of these, each with a digest of its context, the bytes that strings
through it can reach. Contexts of one digest (BLAKE2b, 128 bits) are equal, and go
whole. Where one gram has several different contexts, one of each goes to the gram's
task, which sorts the suffixes that begin at the anchors, and likewise the reversed
prefixes that end there: a mergesort whose comparisons find the common extension by
binary search on prefix polynomial hashes. Neighbours are then compared byte by byte,
which gives exact common lengths and shows a hash collision, after which the plain
bytes are sorted. Strings through the anchor are equal where both orders hold two
contexts together for long enough.

A gram of more contexts than a task should hold is dealt out first: the places that a
string can take around the anchor are halved, and of each half the bytes that all its
strings share choose the group. What is alone in its group has no equal; contexts
that agree in all bytes which the half's strings can reach are covered there, and one of
them stands for all. So groups shrink until they can be sorted, or until one place is left.

Texts are stored in buckets by row number, so that joins with them move only what joins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_stored, slices, stored, text_bytes, tune
from .tokens import token_cache

_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time: their arrays stay in a core's cache.
_PIECE = 1 << 15


#: Powers kept in a table; those of longer arrays are products of two tables.
_TABLE = 1 << 16


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> np.ndarray:
    out = np.full(_TABLE, np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def _back(at: np.ndarray) -> np.ndarray:
    """The inverse of the base to the power of each place."""
    low = _powers(True)
    step = pow(_BASE, -_TABLE, 1 << 64)
    high = np.array([pow(step, k, 1 << 64) for k in range((int(at.max(initial=0)) // _TABLE) + 1)], np.uint64)
    return low[at % _TABLE] * high[at // _TABLE]


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """One odd-looking 64-bit value for each byte."""
    return np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def _prefix(code: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base^position."""
    out = np.zeros(len(code) + 1, np.uint64)
    for a in range(0, len(code), _TABLE):
        part = _values()[code[a : a + _TABLE]]
        part *= _powers(False)[: len(part)]
        np.cumsum(part, out=part)
        part *= np.uint64(pow(_BASE, a, 1 << 64))
        part += out[a]
        out[a + 1 : a + 1 + len(part)] = part
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = pick(x[:-span], x[span:]), 2 * span
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``body``, gram hashes) of all anchors of texts given by offsets."""
    width = length - gram + 1
    ends = np.asarray(offsets)[1:]
    places, hashes = [], []
    for a in range(0, len(body) - length + 1, _PIECE):
        code = body[a : a + _PIECE + length - 1]
        p = _prefix(code)
        key = p[gram:] - p[:-gram]
        key *= _powers(True)[: len(key)] if len(key) <= _TABLE else _back(np.arange(len(key)))
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        low = _sliding(key, width, np.minimum)
        begin = np.arange(a, a + len(low))
        low[ends[np.searchsorted(ends, begin, side="right")] < begin + length] = 0  # strings across two texts
        padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
        at = np.flatnonzero((_sliding(padded, width, np.maximum) == key) & (key > 0))
        places.append(at + a)
        hashes.append(key[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


class Suffixes:
    """Suffixes of one byte array, each with its own end, compared by hashes; sorted within groups that stand together."""

    def __init__(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None):
        self.code, self.start, self.size = code, start.astype(np.int64), (end - start).astype(np.int64)
        self.p = _prefix(code)
        self.back = _back(self.start)
        n = len(start)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if group is not None and n else np.zeros(min(n, 1), np.int64)
        count = np.diff(np.append(heads, n))
        self.heads, self.longest = heads, int(count.max(initial=0))
        self.first, self.last = np.repeat(heads, count), np.repeat(heads + count, count)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes i and j, by binary search on hashes."""
        a, b = self.start[i], self.start[j]
        pa0, pb0, ba, bb = self.p[a], self.p[b], self.back[i], self.back[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = (self.p[a + middle] - pa0) * ba == (self.p[b + middle] - pb0) * bb
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j when ``n`` bytes are common; a beginning sorts before what it begins."""
        si, sj = self.size[i], self.size[j]
        x = np.where(n < si, self.code[np.minimum(self.start[i] + n, len(self.code) - 1)].astype(np.int16), -1)
        y = np.where(n < sj, self.code[np.minimum(self.start[j] + n, len(self.code) - 1)].astype(np.int16), -1)
        return x < y

    def order(self) -> np.ndarray:
        """Mergesort of each group from runs of one; every element finds its rank in the sibling run by binary search."""
        n = len(self.start)
        run, width = np.arange(n), 1
        place = np.arange(n)
        while width < self.longest:
            block = (place - self.first) // width
            sibling = self.first + (block ^ 1) * width
            begin, high = np.minimum(sibling, self.last), np.minimum(sibling + width, self.last)
            low, left = begin.copy(), (block & 1) == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                me, other = run[open_], run[middle]
                common = self.extension(me, other)
                # Of equal suffixes the left run's go first.
                before = np.where(left[open_], self.less(other, me, common), ~self.less(me, other, common))
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = np.empty(n, np.int64)
            merged[np.where(left, place, place - width) + low - begin] = run
            run, width = merged, 2 * width
        return run

    def bytes_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact common length of suffixes i and j."""
        reach = int(self.size.max(initial=0))
        out = np.zeros(len(i), np.int64)
        for a in range(0, len(i), 2000):
            x, y = i[a : a + 2000], j[a : a + 2000]
            step = np.arange(reach)
            limit = np.minimum(self.size[x], self.size[y])
            top = len(self.code) - 1
            same = self.code[np.minimum(self.start[x][:, None] + step, top)] == self.code[np.minimum(self.start[y][:, None] + step, top)]
            same &= step < limit[:, None]
            out[a : a + 2000] = np.where(same.all(1), reach, (~same).argmax(1)) if reach else 0
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, exact common length of each with the one before it, 0 for the first of a group)."""
        order = self.order()
        common = np.concatenate(([0], self.bytes_common(order[:-1], order[1:])))
        common[self.heads] = 0
        wrong = self.less(order[1:], order[:-1], common[1:]) & (self.first[1:] == self.first[:-1])
        if wrong.any():  # a hash collision misled the sort
            raw = self.code.tobytes()
            order = np.array(sorted(range(len(order)), key=lambda k: (self.first[k], raw[self.start[k] : self.start[k] + self.size[k]])))
            common = np.concatenate(([0], self.bytes_common(order[:-1], order[1:])))
            common[self.heads] = 0
        return order, common


def repeated_spans(code: np.ndarray, end: np.ndarray, left: np.ndarray, group: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans covered by strings that another context of the group holds at the same place: context, first byte and end, from the anchor.

    Contexts lie in ``code`` one after the other up to ``end``, each with ``left`` bytes before its anchor.
    """
    n, leads = len(end), length - gram + 1
    begin = np.concatenate(([0], end[:-1])).astype(np.int64)
    anchor, total = begin + left, len(code)
    right, right_common = Suffixes(code, anchor, end, group).sorted()
    back, back_common = Suffixes(np.ascontiguousarray(code[::-1]), total - anchor, total - begin, group).sorted()
    heads = np.zeros(n, bool)
    heads[Suffixes(code[:0], left, left, group).heads] = True
    covered = np.zeros((n, leads + 2), np.int8)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for lead in range(leads):  # bytes of the string before the anchor
        after[right] = np.cumsum(heads | (right_common < length - lead))
        before[back] = np.cumsum(back_common < lead) if lead else 0
        key = after * (n + 1) + before
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        covered[order[same], lead + 1] = covered[order[same + 1], lead + 1] = 1
    step = np.diff(covered, axis=1)
    who, low = np.nonzero(step > 0)
    high = np.nonzero(step < 0)[1]
    return who, 1 - high, length - low


def repeated_anchors(docs: DataFrame, length: int, gram: int, most_known: int) -> DataFrame:
    """(uid, pos, gram, c1, c2) of every anchor whose gram is another's too; c1, c2: digest of its context."""
    spark, reach = docs.sparkSession, length - gram

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(uids, text bytes, row bounds, anchors, their hashes), some texts at a time."""
        token_cache.cache_clear()  # what packing left in a worker would stand beside this
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 4 << 20):
                part, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                yield batch.column(0).slice(a, b - a), part, bounds, *anchors(part, bounds, length, gram)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, key in every(batches):
            one, count = np.unique(key.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(count > 1)], ["gram", "again"])

    again = docs.mapInArrow(hashes, "gram long, again boolean").groupBy("gram").agg((F.max("again") | (F.count("*") > 1)).alias("again")).where("again").select("gram")
    again = stored(again, "grams")
    # Up to most_known hashes (8 bytes each) go to every task; beyond that the anchors are shuffled to them.
    small = again.count() <= most_known
    shared = spark.sparkContext.broadcast(np.sort(again.toArrow().column(0).to_numpy())) if small else None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, part, bounds, at, key in every(batches):
            key = key.view(np.int64)
            if shared is not None:
                known = shared.value
                keep = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                at, key = at[keep], key[keep]
            if not len(at):
                continue
            row = np.searchsorted(bounds, at, side="right") - 1
            low, high = np.maximum(bounds[row], at - reach), np.minimum(bounds[row + 1], at + length)
            raw = part.tobytes()
            digest = b"".join([_digest(b"%d " % z, raw[x:y]) for x, y, z in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)])
            pair = np.frombuffer(digest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([uids.take(pa.array(row)), pa.array(at - bounds[row]), pa.array(key), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["uid", "pos", "gram", "c1", "c2"])

    marked = docs.mapInArrow(mark, "uid long, pos long, gram long, c1 long, c2 long")
    marked = stored(marked if small else marked.join(again, "gram", "left_semi").select("uid", "pos", "gram", "c1", "c2"), "anchors")
    drop_stored(again)
    return marked


def _digest(kind: bytes, body: bytes) -> bytes:
    return hashlib.blake2b(kind + body, digest_size=16).digest()


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())


_CONTEXT = "uid long, pos long, single boolean, lead int, body binary"
_SPAN = "uid long, start long, end long"


def _sorter(length: int, gram: int, batch_contexts: int = 4000):
    """Over rows (key, then _CONTEXT) sorted by key: spans of contexts marked single, by the sort of each key's contexts."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, pos, lead = (rows.column(c).to_numpy() for c in ("key", "pos", "lead"))
        code, bounds = text_bytes(rows.column("body"))
        who, a, b = repeated_spans(code, bounds[1:], lead.astype(np.int64), key, length, gram)
        keep = rows.column("single").to_numpy()[who].astype(bool)
        who, a, b = who[keep], a[keep], b[keep]
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("uid").to_numpy()[who]), pa.array(pos[who] + a), pa.array(pos[who] + b)], ["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            at = 0
            cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for cut in [0, *cuts] if held and held[-1].column("key")[-1].as_py() != key[0] else cuts:
                if count + cut - at >= batch_contexts:  # groups of a key stay whole
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    if held:
                        yield from flush(held)
                    held, count, at = [], 0, cut
            held.append(batch.slice(at))
            count += batch.num_rows - at
        if held:
            yield from flush(held)

    return run


def _sorted_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """_SPAN rows of ``contexts`` (key and _CONTEXT), each key's contexts sorted in one task."""
    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorter(length, gram), _SPAN)


def _halves(length: int):
    """Rows (key, low, high, _CONTEXT) to two rows each: the half's low and high, digests of what its strings share and reach."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    names = ["key", "low", "high", "first", "last", "uid", "pos", "single", "lead", "body", "k1", "k2", "e1", "e2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            core, ext = [], []
            for key, low, high, uid, pos, single, lead, body in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "uid", "pos", "single", "lead", "body")), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(a, length - (len(body) - lead)), min(b, lead)
                    if a <= b and first <= last:
                        part = body[lead - last : lead + length - first]
                        for column, value in zip(out, (key, a, b, first, last, uid, pos, single, last, part), strict=True):
                            column.append(value)
                        core.append(_digest(b"%d %d %d " % (key, a, b), body[lead - a : lead + length - b]))
                        ext.append(_digest(b"%d %d " % (first, last), part))
            yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in zip(out, kinds, strict=True)], *_longs(core), *_longs(ext)], names)

    return run, "key long, low int, high int, first int, last int, uid long, pos long, single boolean, lead int, body binary, k1 long, k2 long, e1 long, e2 long"


def _dealt_spans(contexts: DataFrame, length: int, gram: int, most: int) -> list[DataFrame]:
    """Stored _SPAN tables for ``contexts`` (key and _CONTEXT) of grams that have over ``most`` contexts."""
    found, level = [], contexts.select("*", F.lit(0).alias("low"), F.lit(length - gram).alias("high"))
    while True:
        run, kind = _halves(length)
        halves = stored(level.mapInArrow(run, kind), "halves")
        same = halves.groupBy("k1", "k2", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("rep"))
        same = stored(same, "reached")
        covered = halves.where("single").join(same.where("n > 1").select("k1", "k2", "e1", "e2"), ["k1", "k2", "e1", "e2"])
        found.append(stored(covered.select("uid", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") + length - F.col("first")).alias("end")), "covered"))
        groups = same.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("k1", "k2", "m")
        reps = same.join(groups, ["k1", "k2"]).select("k1", "k2", F.col("rep.uid").alias("uid"), F.col("rep.pos").alias("pos"), (F.col("n") == 1).alias("alone"), "m")
        rest = halves.join(reps, ["k1", "k2", "uid", "pos"]).withColumn("single", F.col("single") & F.col("alone"))
        rest = stored(rest.select(F.col("k1").alias("key"), "low", "high", "uid", "pos", "single", "lead", "body", "m"), "rest")
        found.append(stored(_sorted_spans(rest.where(F.col("m") <= most), length, gram), "spans"))
        drop_stored(halves)
        drop_stored(same)
        level = rest.where(F.col("m") > most).drop("m")
        if level.isEmpty():
            return found


def repeated_ranges(docs: DataFrame, length: int, gram: int, most_contexts: int, most_known: int) -> DataFrame:
    """(uid, found), stored: for ``docs`` (uid, text) in buckets of uid, the ranges of bytes (start, end) in repeated strings; they overlap."""
    reach = length - gram
    marked = repeated_anchors(docs, length, gram, most_known)
    kinds = stored(marked.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("at")), "contexts")
    several = kinds.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("gram", "m")
    several = stored(several, "several")  # so that the join below is one of two exchanges, whose large keys Spark splits
    wanted = kinds.join(several, "gram").select(F.col("at.uid").alias("uid"), F.struct(F.col("at.pos").alias("pos"), "gram", (F.col("n") == 1).alias("single"), (F.col("m") > most_contexts).alias("many")).alias("a"))
    asked = wanted.groupBy("uid").agg(F.collect_list("a").alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            rows = batch.column("asked")
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False))
            a = rows.flatten()
            pos, key, single, many = (a.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            lead = np.minimum(pos, reach)
            low, high = offsets[owner] + pos - lead, np.minimum(offsets[owner] + pos + length, offsets[owner + 1])
            uids = batch.column("uid").to_numpy()[owner]
            for x in range(0, len(pos), 5000):
                y = min(x + 5000, len(pos))
                raw = [body[p:q].tobytes() for p, q in zip(low[x:y].tolist(), high[x:y].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[x:y]), pa.array(uids[x:y]), pa.array(pos[x:y]), pa.array(single[x:y], pa.bool_()), pa.array(lead[x:y].astype(np.int32)), pa.array(raw, pa.binary()), pa.array(many[x:y], pa.bool_())], ["key", "uid", "pos", "single", "lead", "body", "many"])

    contexts = stored(docs.join(asked.hint("shuffle_hash"), "uid").select("uid", "text", "asked").mapInArrow(cut, f"key long, {_CONTEXT}, many boolean"), "texts")
    parts = [stored(_sorted_spans(contexts.where("not many").drop("many"), length, gram), "spans")]
    many = contexts.where("many").drop("many")
    if not many.isEmpty():
        parts += _dealt_spans(many, length, gram, most_contexts)
    drop_stored(contexts)
    whole = marked.join(kinds.where("n > 1").select("c1", "c2", "gram"), ["gram", "c1", "c2"])
    ranges = whole.select("uid", F.struct(F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + length).alias("end")).alias("range"))
    for part in parts:
        ranges = ranges.unionByName(part.select("uid", F.struct("start", "end").alias("range")))
    found = stored(ranges.groupBy("uid").agg(F.collect_list("range").alias("found")), "found")
    for table in (marked, kinds, several, *parts):
        drop_stored(table)
    return found


def kept_bytes(offsets: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which bytes of the texts at ``offsets`` stay, if ranges of their ``owner`` rows go."""
    step = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(step, offsets[owner] + start, 1)
    np.add.at(step, np.minimum(offsets[owner] + end, offsets[owner + 1]), -1)
    return np.cumsum(step[:-1], out=step[:-1]) == 0


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 50, most_contexts: int = 50_000, most_known: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what stays; of a character cut in half, nothing) and the columns of ``keep`` (as kept_0 ...) of every row.

    Each byte in a string of ``length`` bytes that also starts anywhere else, in the
    same text or another, is removed; strings are judged on the input and never cross
    texts. Null text counts as empty. Repeated rows are each other's repeats, a null id
    is kept, other columns are ignored, an empty table gives no rows. A text shorter
    than ``length`` stays whole; long ones are read whole. ``docs`` must read the same
    rows in the same order each time, as tables do: rows are numbered.

    A task sorts up to ``most_contexts`` contexts at once; larger groups are cut first.
    Hashes of grams that occur again are broadcast up to ``most_known`` (8 bytes each);
    beyond that anchors are shuffled to them. Neither changes the result.
    """
    tune(docs.sparkSession)
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    source = bucketed(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *kept), "uid", "texts")
    found = repeated_ranges(source.select("uid", "text"), length, gram, most_contexts, most_known)
    names = [f"kept_{i}" for i in range(len(keep))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            hits = batch.column("found")
            size = pa.compute.fill_null(pa.compute.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
            flat = hits.flatten()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            stays = kept_bytes(offsets, np.repeat(np.arange(batch.num_rows), size), start, end)
            n_bytes = np.diff(offsets)
            edge = np.flatnonzero(~stays & np.concatenate(([True], stays[:-1])))  # a run's first byte
            begins = offsets[:-1][n_bytes > 0]
            begins = begins[~stays[begins]]
            runs = np.bincount(np.searchsorted(offsets, np.union1d(edge, begins), side="right") - 1, minlength=batch.num_rows)
            rest = [body[a:b] if not k else body[a:b][stays[a:b]] for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), size.tolist(), strict=True)]
            left = np.fromiter(map(len, rest), np.int64, len(rest))
            shown = [x.tobytes() for x in rest]
            texts = [x.decode("utf-8", "ignore") for x in shown]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_bytes - left), pa.array(runs.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string()), pa.array(texts, pa.string()), *[batch.column(c) for c in names]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *names])

    types = "".join(f", {n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.join(found.hint("shuffle_hash"), "uid", "left").drop("uid").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + types)
