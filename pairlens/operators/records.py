"""Source rows against native training records: mapping, coercion, comparison by place; rendering and token lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rollout_lines import opened

# The instruction after each problem, and the columns of a native record in order.
INSTRUCTION = " Please reason step by step, and put your final answer within \\boxed{}."
NATIVE = ("prompt", "level", "id", "data_source", "ability", "reward_model", "extra_info")
SOURCE = ("prompt", "answer", "level", "id")


def _message(role: Column, content: Column) -> Column:
    return F.array(F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))).alias("prompt")


def _pair(first: str, a: Column, second: str, b: Column) -> Column:
    return F.struct(a.cast("string").alias(first), b.cast("string").alias(second))


def native_records(source: DataFrame, index: str, data_source: str = "MATH", ability: str = "math", split: str = "train") -> DataFrame:
    """Native records of source rows (prompt, answer, level, id), with ``index``: each row's place, from 0."""
    lacking = sorted(set(SOURCE) - set(source.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return source.select(
        F.col(index).cast("long").alias("_index"),
        _message(F.lit("user"), F.concat(F.col("prompt").cast("string"), F.lit(INSTRUCTION))),
        F.col("level").cast("int").alias("level"),
        F.col("id").cast("string").alias("id"),
        F.lit(data_source).alias("data_source"),
        F.lit(ability).alias("ability"),
        _pair("ground_truth", F.col("answer"), "style", F.lit("rule")).alias("reward_model"),
        _pair("index", F.concat(F.lit(f"{data_source}-"), F.col(index).cast("string")), "split", F.lit(split)).alias("extra_info"),
    )


def coerced_records(native: DataFrame, index: str) -> DataFrame:
    """Native records with every part in its type; prompt is null unless it is one message."""
    one = F.col("prompt")
    return native.select(
        F.col(index).cast("long").alias("_index"),
        F.when(F.size(one) == 1, _message(one[0]["role"], one[0]["content"])).alias("prompt"),
        F.col("level").cast("int").alias("level"),
        *[F.col(c).cast("string").alias(c) for c in ("id", "data_source", "ability")],
        _pair("ground_truth", F.col("reward_model.ground_truth"), "style", F.col("reward_model.style")).alias("reward_model"),
        _pair("index", F.col("extra_info.index"), "split", F.col("extra_info.split")).alias("extra_info"),
    )


def column_drift(native: DataFrame) -> list[str]:
    """What is wrong with the columns of native records: their names and their order are fixed."""
    return [] if tuple(native.columns) == NATIVE else [f"columns are {native.columns}"]


def native_violations(source: DataFrame, native: DataFrame) -> DataFrame:
    """(rule, found, wanted) where native records have other columns, another order of them, or another number of rows than their source."""
    names = ",".join(native.columns)
    columns = native.sparkSession.createDataFrame([] if tuple(native.columns) == NATIVE else [("columns", names, ",".join(NATIVE))], "rule string, found string, wanted string")
    have, want = (df.agg(F.count("*").cast("string").alias(c)).withColumn("rule", F.lit("rows")) for df, c in ((native, "found"), (source, "wanted")))
    return columns.unionByName(have.join(want, "rule").where("found <> wanted"))


def mapping_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(row, fields) of places where the two differ, or where one of them has no row."""
    x, y = expected.alias("x"), actual.alias("y")
    lone = F.col("x._index").isNull() | F.col("y._index").isNull()
    differ = F.filter(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), c) for c in NATIVE]), lambda c: c.isNotNull())
    both = x.join(y, F.col("x._index") == F.col("y._index"), "full_outer")
    return both.select(F.coalesce("x._index", "y._index").alias("row"), F.when(lone, "no row").otherwise(F.array_join(differ, ",")).alias("fields")).where("fields <> ''")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with _index: their place, from 0, in files read in order. Counts of each partition come first (one row a partition)."""
    from pyspark.sql import Window

    marked = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    starts = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = starts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return marked.join(F.broadcast(starts), "_part").withColumn("_index", F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_base")


def rendered(messages: Column, opening: str = "<|im_start|>", closing: str = "<|im_end|>", ask: str = "assistant") -> Column:
    """A prompt as text: each message between marks, its role on the first line, and the mark of the answer to come."""
    shown = F.transform(messages, lambda m: F.concat(F.lit(opening), m["role"], F.lit("\n"), m["content"], F.lit(f"{closing}\n")))
    return F.concat(F.array_join(shown, ""), F.lit(f"{opening}{ask}\n"))


def token_lengths(rows: DataFrame, text: str, tokenizer_path: str, name: str = "n_tokens") -> DataFrame:
    """Rows with the number of ids of a text, without special ids; null counts as empty. The tokenizer file lies in any file system that Arrow opens; each task reads it once."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        system, path = opened(tokenizer_path)
        with system.open_input_stream(path) as stream:
            tokenizer = Tokenizer.from_str(stream.read().decode())
        for texts in batches:
            sizes = []
            for a in range(0, len(texts), 64):
                sizes += [len(e.ids) for e in tokenizer.encode_batch(texts.iloc[a : a + 64].fillna("").tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return rows.withColumn(name, count(F.col(text)))
