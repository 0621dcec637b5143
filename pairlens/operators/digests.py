"""Digests over ordered listings of any length: rows are sorted, and a hash runs over them from batch to batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], entry: Column, between: str = ",", opening: str = "", closing: str = "", total: Column | None = None, together: bool = False) -> DataFrame:
    """keys, n_entries, total and digest: for each listing the SHA-256 of ``opening``, its entries in order with ``between`` between them, and ``closing``.

    A listing is never one value: its rows come to one task, sorted (on disk where memory
    ends), and only the state of the hash is carried from one batch to the next. Null keys are
    a listing of their own, null entries count as empty, entries alike in ``order`` are
    ordered by themselves; without rows there is no listing. ``total`` is summed up on the way (0 without
    one). ``together``: the rows of each listing already stand in one partition, in order, and stay there.
    """
    named = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(entry.cast("string"), F.lit("")).alias("entry"), F.coalesce((F.lit(0) if total is None else total).cast("long"), F.lit(0)).alias("total"))
    held = [f"k{i}" for i in range(len(keys))]
    if not together:
        named = named.repartition(*held) if held else named.repartition(1)
        named = named.sortWithinPartitions(*held, *[f"o{i}" for i in range(len(order))], "entry")
    named = named.select(*held, "entry", "total")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in named.schema if f.name in held], "n_entries long", "total long", "digest string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, count, whole = None, None, 0, 0
        kinds = None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, kinds[i] if i < len(held) else None) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(arrays, [*held, "n_entries", "total", "digest"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in held]
            entries, sizes = batch.column("entry").to_pylist(), batch.column("total").to_pylist()
            groups = list(zip(*[batch.column(k).to_pylist() for k in held], strict=True)) if held else [()] * len(entries)
            out, at = [], 0
            while at < len(entries):
                group, end = groups[at], at + 1
                while end < len(entries) and groups[end] == group:
                    end += 1
                if state is None or group != now:
                    if state is not None:
                        state.update(closing.encode())
                        out.append((*now, count, whole, state.hexdigest()))
                    now, state, count, whole = group, hashlib.sha256(opening.encode()), 0, 0
                elif count:
                    state.update(between.encode())
                state.update(between.join(entries[at:end]).encode())
                count, whole = count + end - at, whole + sum(sizes[at:end])
                at = end
            if out:
                yield done(out)
        if state is not None:
            state.update(closing.encode())
            yield done([(*now, count, whole, state.hexdigest())])

    return named.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_entries", "total", "digest")
