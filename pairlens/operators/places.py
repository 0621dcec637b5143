"""Tables joined by place: the k-th row of one with the k-th of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def placed(rows: DataFrame, order: list[str], name: str = "_index") -> DataFrame:
    """Rows with their place, from 0, in the order of some columns (which should leave no ties), without one big window.

    The sorted rows are stored, range by range; a row's place is what the files before its own hold, and its place in that.
    """
    table = stored(rows.orderBy(*order), "ordered")
    marked = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts = marked.groupBy("_file").agg(F.count("*").alias("_n"))  # a row for each file
    starts = starts.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_base"))
    return marked.join(starts, "_file").select(*rows.columns, (F.col("_base") + F.col("_row")).alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "place") -> DataFrame:
    """place and the columns of both sides, row by row in their orders; tables of different lengths raise. Their columns must differ in name."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be joined with {m} by place")
    return placed(left, left_order, name).join(placed(right, right_order, name), name)


def sampled(panel: DataFrame, outputs: DataFrame, panel_order: list[str], outputs_order: list[str], samples: str) -> DataFrame:
    """One row for each sample of the outputs that stand at a panel row's place: the panel's columns, place, n_samples, sample_index (from 0) and sample."""
    rows = zipped(panel, outputs, panel_order, outputs_order)
    return rows.select(*panel.columns, "place", F.size(samples).cast("long").alias("n_samples"), F.posexplode(samples).alias("sample_index", "sample")).withColumn("sample_index", F.col("sample_index").cast("long"))


def with_supplied_lengths(rows: DataFrame, lengths: DataFrame, rows_order: list[str], lengths_order: list[str], length: str) -> DataFrame:
    """Rows with a length that another table supplies, one for each row in the same order; another number of them raises."""
    given = lengths.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(lengths_order)], F.col(length).alias("supplied_length"))
    return zipped(rows, given, rows_order, [f"_o{i}" for i in range(len(lengths_order))]).select(*rows.columns, "supplied_length")
