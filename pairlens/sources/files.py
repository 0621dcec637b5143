"""Sources: rollout logs, JSON objects, Parquet with required columns, file trees and their hashes."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.identity import MODEL_FILES, missing_files, model_files
from .rollout_lines import RolloutLines, canonical, opened


def read_rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``*.jsonl`` in a folder, with file, file_number and line, the canonical keys input and gts, and a has_ flag for each field.

    A flag tells whether a line has the key at all: an explicit null is there, but null. Blank
    lines are skipped. Files are read once, in the order of their numbers; a line that is no
    rollout fails the read with its file and number, and so does a folder without such files.
    """
    spark.dataSource.register(RolloutLines)
    return spark.read.format("rollout_lines").option("path", folder).load()


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows by file: those with numbers first, by number, then the others by name."""
    return rows.orderBy(F.asc_nulls_last("file_number"), "file")


def _documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, v): each file as one variant; a file that is no JSON raises."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    bad = whole.where("v is null").select("path").limit(1).collect()
    if bad:
        raise ValueError(f"invalid JSON in {bad[0].path}")
    return whole


def read_json_objects(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """One row for each file, which must hold one JSON object, with its path and folder."""
    whole = _documents(spark, paths)
    other = whole.where(~F.schema_of_variant("v").startswith("OBJECT<")).select("path").limit(1).collect()
    if other:
        raise TypeError(f"expected a JSON object: {other[0].path}")
    return whole.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.from_json(F.to_json("v"), schema).alias("o")).select("path", "folder", "o.*")


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of a file that must hold a JSON list of objects, with its place."""
    whole = _documents(spark, path)
    other = whole.where(~F.schema_of_variant("v").startswith("ARRAY<")).select("path").limit(1).collect()
    if other:
        raise TypeError(f"expected a JSON list: {other[0].path}")
    items = whole.select(F.posexplode(F.col("v").cast("array<variant>")).alias("index", "v"))
    return items.select(F.col("index").cast("long").alias("index"), F.from_json(F.to_json("v"), schema).alias("o")).select("index", "o.*")


def read_parquet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A Parquet table that must have the named columns."""
    df = spark.read.parquet(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


#: Files that identities are kept in are no part of what they identify.
SIDECARS = ("identity.json", ".identity.json")
#: Larger files are hashed piece by piece instead of as one value.
PIECE = 8 << 20


def tree(spark: SparkSession, folder: str, include: str = ".*", sidecars: tuple[str, ...] = SIDECARS) -> DataFrame:
    """path (from the folder on), bytes and sha256 of every file under a folder whose path matches ``include``, without its own sidecars."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    inside = F.expr("substring(full, instr(full, root) + length(root))")
    named = files.withColumn("uri", F.col("path")).withColumn("full", F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?/", "/")).withColumn("root", root).withColumn("inside", inside)
    kept = named.where(F.col("inside").rlike(include) & ~F.substring_index("inside", "/", -1).isin(*sidecars))
    small = kept.where(F.col("length") < PIECE).select(F.col("inside").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = kept.where(F.col("length") >= PIECE).select(F.col("inside").alias("path"), F.col("length").alias("bytes"), F.col("uri").alias("at"))
    return small.unionByName(large.mapInPandas(_hash_large, "path string, bytes long, sha256 string"))


def _hash_large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files read piece by piece as streams of their file system, of any size."""
    for frame in frames:
        digests = []
        for uri in frame["at"]:
            digest = hashlib.sha256()
            system, path = opened(uri)
            with system.open_input_stream(path) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield frame[["path", "bytes"]].assign(sha256=digests)


def model_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a model that its manifest lists; one without its settings or its tokenizer raises."""
    files = tree(spark, folder)
    lacking = missing_files(files.withColumn("folder", F.lit(folder)), "folder", "path", MODEL_FILES).first()
    if lacking or files.isEmpty():
        raise ValueError(f"{folder} lacks {lacking.missing if lacking else 'all files'}")
    return model_files(files, "path")


def normalized_text_hash(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of text files with every line end as a line feed."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.sha2(F.regexp_replace("value", "\r\n?", "\n"), 256).alias("sha256"))


@F.pandas_udf(StringType())
def _yaml_json(texts: pd.Series) -> pd.Series:
    """YAML as JSON with sorted keys; a text that is no YAML fails the query."""
    import yaml

    return texts.map(lambda t: None if t is None else canonical(yaml.safe_load(t)))


def read_configs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, config) of YAML configurations, each as canonical JSON; see ``plans.experiments.opened``, and ``config_violations``, which tells of other schema versions."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), _yaml_json("value").alias("config"))


def checkout_commit(folder: str, expected: str | None = None) -> str:
    """The commit that a folder has checked out; another one than expected raises."""
    got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    commit = got.stdout.strip()
    if got.returncode or expected is not None and commit != expected:
        raise ValueError(f"{folder}: " + (f"commit {commit}, not {expected}" if not got.returncode else "no readable checkout"))
    return commit
