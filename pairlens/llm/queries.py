"""One query per corpus operator, applied to its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import twins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(column: str, by: int) -> Column:
    """crc32 of an id's decimal text, modulo ``by``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import predict, train

    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    return predict(docs, train(docs.where(~held)), held)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    return score(docs, train(docs, table(spark, sf_dir, "labels").where(~held)), held)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), radius=3, words=3)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_windows, read_windows

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_windows(chat_windows(turns.unionByName(more)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), length=200).drop("text")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import base_spans, count_of, find_secrets, shown

    rows = find_secrets(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(shown(base_spans(F.col("spans"))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.digests import ordered_digest
    from .repair import damaged, line, repair

    found, turns = repair(damaged(table(spark, sf_dir, "conversations")), copies="copies")
    digests = ordered_digest(turns, ["conv_id"], ["place"], line(F.col("role"), F.col("text")), between="\n", together=True).select(F.col("conv_id").alias("_id"), "digest")
    rows = found.join(digests, found["conv_id"].eqNullSafe(F.col("_id")), "left")
    return rows.select(*found.columns, F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restored

    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_classifier,
        op3_token_output,
        op4_nearest_neighbours,
        op5_simhash_near_dedup,
        op6_benchmark_decontamination,
        op7_chat_formatting,
        op8_best_fit_packing,
        op9_html_extraction,
        op10_suffix_array_dedup,
        op11_secret_scan,
        op12_conversation_repair,
        op13_fill_in_middle,
    )
}
#: DuckDB twins of those that SQL can express; tests/llm holds the others against plain Python.
ORACLE_SQL: dict[str, str] = dict(twins.SQL)
