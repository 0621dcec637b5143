"""Rollout logs as a Spark data source: JSON lines read once, with file, line, key presence and the numbers of their files."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: JSON keys, the columns they fill, and their kinds.
FIELDS = {
    "step": ("step", pa.int32()), "input": ("input", pa.string()), "gts": ("gts", pa.string()), "output": ("output", pa.string()), "score": ("score", pa.float64()), "true_reward_score": ("token_rewards", pa.list_(pa.float64())),
    "verifier_reward": ("scalar_reward", pa.float64()), "response_length": ("response_length", pa.int64()), "response_token_count": ("response_token_count", pa.int64()),
}
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.list_(pa.float64()): "array<double>", pa.bool_(): "boolean"}
COLUMNS = {"file": pa.string(), "file_number": pa.int64(), "line": pa.int64()} | dict(FIELDS.values()) | {f"has_{name}": pa.bool_() for name, _ in FIELDS.values()}
#: Rows of one Arrow batch, and characters of lines after which it is given out earlier.
ROWS, CHARS = 2000, 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(parts.path) if parts.scheme and "%" in parts.path else parts.path if parts.scheme else uri)
    return fs.FileSystem.from_uri(uri)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _value(name: str, kind: pa.DataType, row: dict) -> object:
    value = row.get(name)
    if kind == pa.string():
        if name not in row or value is None and name == "output":
            return None
        text = value if isinstance(value, str) and name == "output" else canonical(value)
        return text.encode("utf-8", "replace").decode()
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [None if x is None else float(x) for x in value]
    return float(value) if kind == pa.float64() else int(value)


class _File(InputPartition):
    def __init__(self, uri: str, path: str, name: str, number: int | None):
        self.uri, self.path, self.name, self.number = uri, path, name, number


def file_number(name: str) -> int | None:
    stem = name.rsplit(".", 1)[0]
    return int(stem) if stem.isascii() and stem.isdigit() else None


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_File]:
        """One file each, those with numbers first and by number, then the others by name."""
        system, path = opened(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.endswith(".jsonl")]
        if not found:
            raise ValueError(f"no rollout files in {self.folder}")
        files = [_File(self.folder, i.path, i.base_name, file_number(i.base_name)) for i in found]
        return sorted(files, key=lambda f: (f.number is None, f.number or 0, f.name))

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        system, _ = opened(part.uri)
        rows: list[tuple] = []
        chars = 0
        with system.open_input_stream(part.path) as raw, io.TextIOWrapper(raw, encoding="utf-8") as lines:
            for number, line in enumerate(lines, 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                    values = [_value(key, kind, row) for key, (_, kind) in FIELDS.items()]
                except json.JSONDecodeError as error:
                    raise ValueError(f"invalid JSON in {part.path}:{number}") from error
                except (AttributeError, TypeError, ValueError, OverflowError) as error:
                    raise ValueError(f"no rollout in {part.path}:{number}: {error}") from error
                rows.append((part.name, part.number, number, *values, *[key in row for key in FIELDS]))
                chars += len(line)
                if len(rows) >= ROWS or chars >= CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], list(COLUMNS))


class RolloutLines(DataSource):
    """``*.jsonl`` of one folder, any file system that Arrow opens; option path."""

    @classmethod
    def name(cls) -> str:
        return "rollout_lines"

    def schema(self) -> str:
        return ", ".join(f"{n} {_DDL[k]}" for n, k in COLUMNS.items())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
