"""Step files as a stream: each complete file is one micro-batch, and what the dataset as a whole decides is decided anew as files come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import audit, check, dataset_facts, resolve

#: Where no length field is on every row.
NO_FIELD = "none"


def _decision(facts: DataFrame) -> tuple[str, bool]:
    """(length field, whether dialects are mixed) of all batches whose facts these are."""
    one = facts.agg(F.bool_and("every_response_length").alias("a"), F.bool_and("every_response_token_count").alias("b"), F.bool_and("every_token").alias("t"), F.bool_or("some_token").alias("s")).first()
    return "response_length" if one.a else "response_token_count" if one.b else NO_FIELD, bool(one.s and not one.t)


def audit_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, n: int, cap: int) -> StreamingQuery:
    """Audit new step files as they come; see ``stream_audit`` for the result.

    Rows are kept by batch, with their facts (one row a batch): which length field every row has,
    and which dialect. The field is chosen for all rows so far, as for a dataset read at once. Where a
    new file changes the choice, all rows so far are audited again with the new one, which can happen
    twice at most; else only the new rows are. Dialects that differ between files fail the
    stream as they fail a dataset. Everything is written by batch number, so a repeated batch replaces itself.
    """
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)

    def each(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        new = own.read.parquet(f"{out}/rows/batch={number}")
        dataset_facts(new).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        facts = own.read.parquet(f"{out}/facts").where(F.col("batch") <= number)
        field, mixed = _decision(facts)
        if mixed:
            raise ValueError(f"mixed dialects from batch {number} on")
        before = facts.where(F.col("batch") < number)
        whole = before.isEmpty() or _decision(before)[0] != field
        rows = own.read.parquet(f"{out}/rows").where(F.col("batch") <= number).drop("batch") if whole else new
        rows = resolve(rows, supplied=field) if field != NO_FIELD else resolve(rows)
        check(rows, n, cap)
        done = audit(rows, cap).where("step is not null").withColumn("whole", F.lit(whole))
        done.write.mode("overwrite").parquet(f"{out}/audits/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_audit(spark: SparkSession, out: str) -> DataFrame:
    """The audit by step of all batches so far: from the last that was audited as a whole on."""
    audits = spark.read.parquet(f"{out}/audits")
    last = audits.where("whole").agg(F.max("batch").alias("_last"))
    return audits.join(F.broadcast(last), F.col("batch") >= F.col("_last")).drop("_last", "whole", "batch")  # one row
