"""Locks of identity groups: the first run of a group writes what it starts from, all others must start from the same."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import DIGESTS, NUMBERS, differing


def _publish(spark: SparkSession, made, target) -> bool:
    """Give a whole file its name if no file has it; False if one has. Of many at once one succeeds."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if target.getFileSystem(conf).getUri().getScheme() == "file":
        try:
            os.link(made.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        return True
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf).rename(made, target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def claim(spark: SparkSession, folder: str, group: str, payload: dict) -> dict:
    """What holds for a group: ``payload`` if nothing did, else what was claimed first.

    The file is written under another name and then takes the group's, which fails if that is
    taken: by a link on a local disk, by a rename without overwriting elsewhere (atomic on HDFS; on an
    object store only as far as its renames are). So two runs at once can't both be first,
    and nobody reads half a file.
    """
    if not group or "/" in group:
        raise ValueError(f"no name of a group: {group!r}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{group}.json")
    made = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{group}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        system.mkdirs(target.getParent())
        stream = system.create(made, False)
        stream.write(bytearray(json.dumps(payload, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()))
        stream.close()
        try:
            _publish(spark, made, target)
        finally:
            system.delete(made, False)
    stream = system.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def locks(spark: SparkSession, folder: str) -> DataFrame:
    """(group, and the parts of an identity) of all groups claimed in a folder."""
    kinds = ", ".join([f"{n} long" for n in NUMBERS] + [f"{d} string" for d in DIGESTS])
    return spark.read.schema(f"identity_group string, {kinds}").option("pathGlobFilter", "[!.]*.json").json(folder)


def lock_groups(identities: DataFrame, folder: str, group: str, order: str, key: str) -> DataFrame:
    """(key, group, fields) of rows that differ from what their group is locked to; groups without a lock are claimed by their first row.

    The claims are made here and now, one for each group (a branch point of a plan); rows without a group are free.
    """
    spark = identities.sparkSession
    some = identities.where(F.col(group).isNotNull())
    parts = [*NUMBERS, *DIGESTS]
    first = some.groupBy(F.col(group).cast("string").alias("identity_group")).agg(F.min_by(F.struct(*parts), F.struct(order, key)).alias("i")).select("identity_group", "i.*")
    for row in first.toLocalIterator():
        claim(spark, folder, row.identity_group, row.asDict())
    held = some.withColumn("_group", F.col(group).cast("string")).alias("own").join(locks(spark, folder).alias("locked"), F.col("_group") == F.col("locked.identity_group"))
    return held.select(F.col(f"own.{key}").alias(key), F.col(f"own.{group}").alias(group), F.array_join(differing("locked", "own"), ",").alias("fields")).where("fields <> ''")
