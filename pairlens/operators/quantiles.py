"""Exact quantiles of many groups and columns, by ranges: only rows of the ranges that hold a wanted rank are moved and sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Ranges of a group's values; a power of two.
PIECES = 64


def piece_of(edges: Column, x: Column, pieces: int = PIECES) -> Column:
    """How many of ``pieces`` - 1 sorted edges are below a value, by binary search."""
    widths = F.array(*[F.lit(pieces >> k) for k in range(1, pieces.bit_length())])
    return F.aggregate(widths, F.lit(0), lambda i, w: F.when(F.element_at(edges, i + w) < x, i + w).otherwise(i))


def exact_quantiles(rows: DataFrame, keys: list[str], columns: dict[str, Column], levels: list[float]) -> DataFrame:
    """keys, name, level and value: linearly interpolated quantiles of each column (by name) in each group; nulls take no part.

    Keys are compared null-safely. Three passes over ``rows``, which must give the same rows each
    time: a sketch of bounded size for each group and column cuts its values into ranges; the
    rows of each range are counted; the counts name the few ranges that hold a wanted
    rank, and only values in these leave their partition, equal ones counted beforehand. Ranks
    inside a range are running counts, so no task holds a group. The results of the first two
    passes (a row for each group) are stored, so Spark broadcasts them where their size allows.
    The result does not depend on the sketch.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    names = list(columns)
    held = rows.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values())])

    def beside(table: DataFrame) -> DataFrame:
        right = table.withColumnsRenamed({k: f"{k}_" for k in ks})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ks]) if ks else F.lit(True)
        return held.join(right, same).drop(*[f"{k}_" for k in ks])

    cuts = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    edges = stored(held.groupBy(*ks).agg(F.array(*[F.percentile_approx(f"_x{i}", cuts, F.lit(1000)) for i in range(len(names))]).alias("_edges")), "edges")
    placed = lambda i: F.struct(F.lit(i).alias("c"), piece_of(F.col("_edges")[i], F.col(f"_x{i}")).alias("piece"), F.col(f"_x{i}").alias("x"))
    parts = F.array(*[F.when(F.col(f"_x{i}").isNotNull(), placed(i)) for i in range(len(names))])

    counts = beside(edges).select(*ks, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).groupBy(*ks, F.col("p.c").alias("c"), F.col("p.piece").alias("piece")).agg(F.count("*").alias("t"))
    column = Window.partitionBy(*ks, "c")
    based = counts.withColumn("base", F.sum("t").over(column.orderBy("piece")) - F.col("t")).withColumn("n", F.sum("t").over(column))

    def ends(q: Column) -> Column:
        h = (F.col("n") - 1) * q
        return F.array(*[F.struct(q.alias("level"), h.alias("h"), F.lit(side).alias("low"), r.cast("long").alias("rank")) for side, r in ((True, F.floor(h)), (False, F.ceil(h)))])

    asked = F.filter(F.flatten(F.transform(F.array(*[F.lit(float(q)) for q in levels]), ends)), lambda e: (e["rank"] >= F.col("base")) & (e["rank"] < F.col("base") + F.col("t")))
    wanted = based.select(*ks, "c", "piece", "base", asked.alias("asked")).where(F.size("asked") > 0)
    wanted = wanted.groupBy(*ks).agg(F.collect_list(F.struct("c", "piece", "base", "asked")).alias("_wanted"))  # two for each column and level at most
    joined = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in ks]) if ks else F.lit(True)
    wanted = stored(edges.alias("e").join(wanted.alias("w"), joined).select(*[f"e.{k}" for k in ks], "_edges", "_wanted"), "wanted")

    some = F.filter(parts, lambda p: p.isNotNull() & F.exists(F.col("_wanted"), lambda w: (w["c"] == p["c"]) & (w["piece"] == p["piece"])))
    values = beside(wanted).select(*ks, F.explode(some).alias("p")).groupBy(*ks, "p").agg(F.count("*").alias("t")).select(*ks, "p.*", "t")
    upto = F.sum("t").over(Window.partitionBy(*ks, "c", "piece").orderBy("x"))
    ranked = values.withColumn("last", upto)
    ask = wanted.select(*ks, F.explode("_wanted").alias("w")).select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("w.c").alias("c_"), F.col("w.piece").alias("piece_"), F.col("w.base").alias("base"), F.col("w.asked").alias("asked"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ks] + [F.col("c") == F.col("c_"), F.col("piece") == F.col("piece_")])
    here = F.filter("asked", lambda e: (e["rank"] < F.col("base") + F.col("last")) & (e["rank"] >= F.col("base") + F.col("last") - F.col("t")))
    found = ranked.join(ask, on).select(*ks, "c", "x", F.explode(here).alias("e")).select(*ks, "c", "x", "e.*")
    both = found.groupBy(*ks, "c", "level").agg(F.max(F.when(F.col("low"), F.col("x"))).alias("a"), F.max(F.when(~F.col("low"), F.col("x"))).alias("b"), F.max("h").alias("h"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)
    return both.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], name.alias("name"), "level", value.alias("value"))


def quantile_columns(found: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row for each group: a column for each (name, level) of ``wanted``."""
    at = lambda name, level: F.max(F.when((F.col("name") == name) & (F.col("level") == level), F.col("value")))
    return found.groupBy(*keys).agg(*[at(*w).alias(c) for c, w in wanted.items()])
