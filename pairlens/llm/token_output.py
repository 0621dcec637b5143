"""Token-ID output: shards of ids compressed by Re-Pair grammars, decodable from any position.

A shard is one binary value (its head is little endian)::

    magic 'RP02' | uint32 first_symbol | uint32 n_rules | uint32 n_symbols
    | uint64 n_tokens | uint32 n_docs | uint8 bits of a value in each part that follows
    | rules (left, right) | expansion length of each rule | doc lengths | symbols
    each part as bits, highest first, filled up to a byte

Rules replace a pair of symbols; a rule refers to ids and earlier rules only. The
expansion lengths give the token position of every symbol, so a range of tokens is
decoded from the symbols that cover it. Shards lie in a Parquet table in the
shared folder, one row each, committed by Spark, so lost executors only repeat
their own shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, slices, stored, tune
from .tokens import token_cache

_HEAD = struct.Struct("<4sIIIQIBBBB")
#: Ids read back at a time, from the symbols that cover them.
READ = 1 << 16
#: Pieces a writing worker keeps in each of its two generations; it holds little else but a shard.
PIECES = 800_000
SHARD_SCHEMA = "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, shard binary"


def repair(ids: np.ndarray, least: int = 8, bits: int = 18) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules [n, 2] and the first rule's symbol for one shard of ids.

    Each round counts the adjacent pairs in a table of 2^bits slots, each of which stands for
    one of its pairs, counted exactly; another hash in the next round lets the others have
    their turn. A place is replaced if its pair is more frequent than those it overlaps, and a
    pair replaced at half of ``least`` places or more becomes a rule. Pairs never grow more frequent, so
    one found rare is not looked at again; new ones arise beside what was replaced. Rounds go on
    until no pair occurs ``least`` times, by an exact count: the most frequent one always wins its places.
    """
    seq = ids.astype(np.uint32)
    first = symbol = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    factor = 0x9E3779B97F4A7C15
    maybe = np.arange(max(len(seq) - 1, 0))  # places whose pair may be frequent
    while len(seq) > least:
        key = seq[maybe].astype(np.uint64)
        key <<= np.uint64(32)
        key |= seq[maybe + 1]
        slot = key * np.uint64(factor)
        slot >>= np.uint64(64 - bits)
        slot = slot.view(np.int64)
        factor = (factor * 0x5851F42D4C957F2D + 2) & (1 << 64) - 1 | 1
        often = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])
        maybe, part, where = maybe[often], key[often], slot[often]
        if not len(maybe):
            break
        stands = np.zeros(1 << bits, np.uint64)
        stands[where] = part
        mine = np.flatnonzero(stands[where] == part)
        at, where = maybe[mine], where[mine]
        count = np.bincount(where, minlength=1 << bits)
        if count.max() < least:  # the slots' pairs are rare; are others of theirs not?
            if np.unique(part, return_counts=True)[1].max() < least:
                break
            continue
        slots = np.flatnonzero(count >= least)
        slots = slots[np.argsort(count[slots], kind="stable")]
        rank = np.zeros(1 << bits, np.int32)  # the most frequent highest, 0 where the pair is too rare
        rank[slots] = np.arange(1, len(slots) + 1, dtype=np.int32)
        here = np.zeros(len(seq) + 1, np.int32)
        mid = rank[where]
        here[at + 1] = mid
        some = np.flatnonzero(mid)
        places, mid = at[some] + 1, mid[some]
        left, right = here[places - 1], here[places + 1]
        # Where a pair overlaps itself, as in aaaa, every second place of the run counts.
        same = mid == left
        taken = (mid >= left) & (mid >= right)
        if same.any():
            run = np.maximum.accumulate(np.where(same, 0, places))
            taken &= ((places - run) & 1) == 0
        taken = np.flatnonzero(taken)
        taken, mid = places[taken] - 1, mid[taken]
        uses = np.bincount(mid, minlength=len(slots) + 1)
        good = uses >= max(2, least // 2)
        taken, mid = taken[good[mid]], mid[good[mid]]
        pair = stands[slots[np.flatnonzero(good) - 1]]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        name = (np.cumsum(good) - 1 + symbol).astype(np.uint32)
        seq[taken] = name[mid]
        open_ = np.zeros(len(seq), bool)
        open_[maybe] = True
        open_[taken] = open_[taken[taken > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        seq, open_, symbol = seq[keep], open_[keep][:-1], symbol + int(good.sum())
        maybe = np.flatnonzero(open_)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


def pack_bits(values: np.ndarray) -> tuple[int, bytes]:
    """(bits a value, the values' bits one after the other)."""
    width = max(1, int(values.max(initial=0)).bit_length())
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return width, np.packbits(bits.ravel()).tobytes()


def unpack_bits(blob: bytes, at: int, count: int, width: int) -> tuple[np.ndarray, int]:
    """(``count`` values that begin at byte ``at``, the byte after them)."""
    size = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=count * width).reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, 32 - width :] = bits
    return np.packbits(whole, axis=1).view(">u4").ravel().astype(np.uint32), at + size


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    return lengths


def pack_shard(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """One shard of whole documents in the format of this module."""
    seq, rules, first = repair(ids)
    parts = [pack_bits(x) for x in (rules.ravel(), expansions(rules, first), doc_lengths, seq)]
    head = _HEAD.pack(b"RP02", first, len(rules), len(seq), len(ids), len(doc_lengths), *[width for width, _ in parts])
    return head + b"".join(body for _, body in parts)


class Shard:
    """Random access to one packed shard."""

    def __init__(self, blob: bytes):
        magic, self.first, n_rules, n_symbols, self.n_tokens, n_docs, *widths = _HEAD.unpack_from(blob)
        if magic != b"RP02":
            raise ValueError("not a token shard")
        at, parts = _HEAD.size, []
        for count, width in zip((2 * n_rules, n_rules, n_docs, n_symbols), widths, strict=True):
            values, at = unpack_bits(blob, at, count, width)
            parts.append(values)
        self.rules, self.lengths, self.doc_lengths, self.symbols = parts[0].reshape(-1, 2), parts[1], parts[2].astype(np.int64), parts[3]
        self._ends: np.ndarray | None = None
        self._flat: np.ndarray | None = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        rule = np.flatnonzero(seq >= self.first) if len(self.rules) else np.zeros(0, np.int64)
        if not len(rule):
            return seq.astype(np.uint32)
        if self._flat is None:  # every rule written out, by way of the rules before it
            ids = self.rules.astype("<u4").tobytes()
            done: list[bytes] = []
            for k, (a, b) in enumerate(self.rules.tolist()):
                left = done[a - self.first] if a >= self.first else ids[8 * k : 8 * k + 4]
                done.append(left + (done[b - self.first] if b >= self.first else ids[8 * k + 4 : 8 * k + 8]))
            self._flat = np.frombuffer(b"".join(done), "<u4")
            self._begin = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        size = np.ones(len(seq), np.int64)
        which = seq[rule].astype(np.int64) - self.first
        size[rule] = self.lengths[which]
        out = np.repeat(seq.astype(np.uint32), size)
        at = (np.cumsum(size) - size)[rule]
        out[ranges(at, self.lengths[which])] = self._flat[ranges(self._begin[which], self.lengths[which])]
        return out

    def all(self) -> np.ndarray:
        """Every id of the shard."""
        return self._expand(self.symbols)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, decoded from the symbols that cover them."""
        if self._ends is None:
            size = np.ones(len(self.symbols), np.int64)
            rule = self.symbols >= self.first
            size[rule] = self.lengths[self.symbols[rule] - self.first] if len(self.rules) else 1
            self._ends = np.cumsum(size)
        start, stop = max(0, start), min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self._ends, start, side="right")), int(np.searchsorted(self._ends, stop, side="left")) + 1
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every text and write packed shards in ascending id order; returns the stored table (SHARD_SCHEMA).

    Null text counts as empty: its ids are the end id alone. Rows that share an id
    keep one another's company, ordered by text; a null id comes first. Extra
    columns are ignored. An empty table gives no shard. A shard closes once it has
    ``shard_tokens`` ids; a longer document makes a longer shard.
    """
    tune(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = token_cache(tokenizer_path, PIECES), TaskContext.get().partitionId()
        seq = first = held = 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_ids: list = []

        def close() -> pa.RecordBatch:
            nonlocal seq, first, held, ids, lengths, doc_ids
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            row = [[part], [seq], [first], [len(flat)], [doc_ids], [pack_shard(flat, sizes)]]
            seq, first, held, ids, lengths, doc_ids = seq + 1, first + len(flat), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "seq", "first_token", "n_tokens", "doc_ids", "shard"])

        for batch in batches:
            docs, (codes, counts) = batch.column(0).to_pylist(), cache.encode_column(batch.column(1))
            codes = np.insert(codes, np.cumsum(counts), end_id)
            counts = counts + 1
            ends = np.concatenate(([0], np.cumsum(counts)))
            a, n = 0, len(docs)
            while a < n:
                b = min(n, int(np.searchsorted(ends, ends[a] + shard_tokens - held)))  # the document that fills the shard is its last
                ids.append(codes[ends[a] : ends[b]])
                lengths.append(counts[a:b])
                doc_ids += docs[a:b]
                held += int(ends[b] - ends[a])
                a = b
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(make, SHARD_SCHEMA), "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of stored shards: doc_id, start, n_tokens, ids_crc32, in no order; ids are decoded from the files."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(blob)
                ends = np.cumsum(shard.doc_lengths)
                begins = ends - shard.doc_lengths
                crc: list[int] = []
                for a, b in slices(np.concatenate(([0], ends)), READ):
                    ids = memoryview(shard.slice(int(begins[a]), int(ends[b - 1])).astype("<u4").tobytes())
                    crc += [zlib.crc32(ids[4 * (x - begins[a]) : 4 * (y - begins[a])]) for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start), pa.array(shard.doc_lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(base), "part").select(  # as many rows as there were writing tasks
        (F.col("base") + F.col("first_token")).alias("start"), "doc_ids", "shard"
    )
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` as token shards and return what reading them back gives (see ``write_shards``, ``read_shards``)."""
    return read_shards(write_shards(docs, tokenizer_path, end_id, **options))


__all__ = ["Shard", "pack_shard", "read_shards", "repair", "token_output", "write_shards"]
