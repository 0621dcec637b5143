"""Sinks: Parquet by split, JSON lines, CSV with the union of columns, small JSON reports."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollout_lines import opened
from .shared import stored

#: Bytes of a file that are moved at a time.
PIECE = 8 << 20


def write_splits(records: DataFrame, path: str) -> None:
    """One folder for each split, its rows in the order of their places over its files; the id comes first.

    ``records``: see ``protocol.split_records``.
    """
    records.repartitionByRange("split", "pos").sortWithinPartitions("split", "pos").write.partitionBy("split").parquet(path)


def write_schedule(schedule: DataFrame, path: str) -> None:
    """A schedule (see ``protocol.schedule``) in the order of its updates and slots."""
    schedule.repartitionByRange("schedule_update", "schedule_slot").sortWithinPartitions("schedule_update", "schedule_slot").write.parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines; Spark commits them as a whole."""
    rows.write.json(path)


def write_documents(rows: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """One file under ``folder`` for each row, with a text or JSON of its own; returns (path, bytes, sha256) of what was written, stored.

    Tasks write through their file system under another name and then move the whole file into
    place, so a task that runs again changes nothing. Names must differ; a null text is an empty file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for batch in batches:
            done = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (body or "").encode()
                target = f"{root}/{path}"
                system.create_dir(os.path.dirname(target), recursive=True)
                made = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
                with system.open_output_stream(made) as stream:
                    stream.write(raw)
                system.move(made, target)
                done.append((path, len(raw), hashlib.sha256(raw).hexdigest()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "sha256"])

    return stored(rows.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(write, "path string, bytes long, sha256 string"), "written")


def write_steps(rows: DataFrame, folder: str, step: str, order: list[str]) -> DataFrame:
    """One file of JSON lines for each step, named by it, its rows in order; returns (path, bytes, sha256), stored.

    A step may be of any size: its rows are dealt to tasks by ranges of their order, each task writes
    its part of a step line by line, and the parts are put one after the other, a piece at a time.
    Only parts of tasks that ended count, so a task that runs again changes nothing. A row without a
    step has no file and raises.
    """
    parts_folder = f"{folder.rstrip('/')}_parts_{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*rows.columns))
    keyed = rows.select(F.col(step).alias("_step"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], line.alias("_line"))
    by = ["_step", *[f"_{i}" for i in range(len(order))], "_line"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(parts_folder)
        system.create_dir(root, recursive=True)
        task, name, stream, done = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for own, lines in groupby(zip(names, batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                if own is None:
                    raise ValueError("a row has no step")
                if own != name:
                    if stream:
                        stream.close()
                    name, made = own, uuid.uuid4().hex
                    stream = system.open_output_stream(f"{root}/{made}")
                    done.append((own, task, made))
                stream.write("".join(f"{text}\n" for _, text in lines).encode())
        if stream:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["name", "part", "made"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (source, root), (system, target) = opened(parts_folder), opened(folder)
        system.create_dir(target, recursive=True)
        for batch in batches:
            done = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, size, made = hashlib.sha256(), 0, f"{target}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(made) as out:
                    for part in parts:
                        with source.open_input_stream(f"{root}/{part['made']}") as stream:
                            while piece := stream.read(PIECE):
                                out.write(piece)
                                digest.update(piece)
                                size += len(piece)
                system.move(made, f"{target}/{name}.jsonl")
                done.append((f"{name}.jsonl", size, digest.hexdigest()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "sha256"])

    sorted_rows = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col("_step").cast("string").alias("name"), "_line")
    parts = stored(sorted_rows.mapInArrow(write, "name string, part long, made string"), "parts")
    listed = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "made"))).alias("parts"))  # a part a task at most
    written = stored(listed.mapInArrow(join, "path string, bytes long, sha256 string"), "written")
    system, root = opened(parts_folder)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        system.delete_dir(root)
    return written


def document(fields: list[Column]) -> Column:
    """A small document (manifest, plan, command, identity) as JSON, its keys sorted, nulls kept; NaN and infinity come as texts, which no reader takes for numbers."""
    return F.to_json(F.try_parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def write_json(path: str, value: object) -> None:
    """A small document (manifest, plan, command, identity) on the driver, with sorted keys; NaN is an error. It is moved into place whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as handle:
        json.dump(value, handle, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
        handle.write("\n")
    os.replace(f"{path}.tmp", path)


def write_config(path: str, config: dict) -> None:
    """A merged configuration as YAML, keys in their order."""
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        yaml.safe_dump(config, handle, sort_keys=False, allow_unicode=True)


def write_surface(rows: DataFrame, folder: str, panel: str, metric: str, band: float) -> dict[str, str]:
    """A surface as JSON and as CSV, with the names of both files. A surface has a row for each branch point of a plan.

    JSON leaves out what a row lacks; the header of the CSV has the keys of all rows in order of first appearance.
    """
    found = []
    for line in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).collect():
        row = json.loads(line.j)
        found.append({k: v for k, v in row.items() if k != "signals"} | (row.get("signals") or {}))
    names = {"json": os.path.join(folder, "handoff_surface.json"), "csv": os.path.join(folder, "handoff_surface.csv")}
    write_json(names["json"], {"schema_version": 2, "panel": panel, "metric": metric, "equivalence_band": band, "rows": found})
    with open(names["csv"], "w", encoding="utf-8", newline="") as handle:
        writer = csv.DictWriter(handle, list(dict.fromkeys(k for row in found for k in row)))
        writer.writeheader()
        writer.writerows(found)
    return names


def copy_exact(source: str, target: str, sha256: str) -> str:
    """Copy a file byte by byte on the driver, and hash what arrived; another digest raises."""
    if os.path.realpath(source) != os.path.realpath(target):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        shutil.copyfile(source, target)
    with open(target, "rb") as handle:
        got = hashlib.file_digest(handle, "sha256").hexdigest()
    if got != sha256:
        raise ValueError(f"{target}: SHA-256 {got}, not {sha256}")
    return got


def write_csv(parts: list[DataFrame], path: str) -> None:
    """All rows under one header: the columns of all parts in order of first appearance; missing values are empty."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.write.option("header", True).option("nullValue", "").csv(path)


def report(row: DataFrame) -> str:
    """A one-row table as JSON with sorted keys; NaN is an error."""
    got = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(got) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json.loads(got[0].j), sort_keys=True, indent=2, allow_nan=False)
