"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import stored
from pairlens.llm.decontaminate import drop_contaminated
from pairlens.llm.near_copies import drop_near_copies
from pairlens.llm.packing import best_fit_packing
from pairlens.llm.quality import score, train
from pairlens.llm.queries import remainder, table, tokenizer
from pairlens.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL twin: training and packing are not SQL. tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the model learns as in op2. Null ids and texts are scored like any other."""
    held = remainder("doc_id", 5) == 0
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    scored = score(docs, model, held, keep=COLUMNS)
    return scored.where("predicted = 1").select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(COLUMNS)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity of 0.8 or more): see drop_near_copies."""
    return drop_near_copies(docs).select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text without the bytes of strings of 200 bytes that start more than once; every document stays.

    A character cut in half at an edge of a removed run goes with it. n_chars is counted anew.
    """
    cut = suffix_dedup(docs, length=200, keep=COLUMNS)
    text = F.when(F.col("kept_1").isNotNull(), F.col("text"))
    return cut.select(F.col("kept_0").alias("doc_id"), text.alias("text"), F.col("kept_2").alias("lang"), F.col("kept_3").alias("source"), F.length(text).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by its text alone, whatever its id."""
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens; a null text is the end id alone, repeated rows are documents of their own."""
    return best_fit_packing(docs, tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
