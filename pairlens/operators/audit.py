"""Rollout audit: validation, exact-n groups, and summaries by step and in total.

Rows: step, input, gts, output, score and optionally token_rewards, scalar_reward,
response_length, response_token_count. Group keys are strings; groups are never
collected, so everything is partial aggregation and one shuffle on the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import boxed, finite, token_outcome
from .quantiles import exact_quantiles, quantile_columns

GROUP = ["step", "input", "gts"]


def pearson(a: str, b: str) -> Column:
    """Correlation; null below two rows or where a side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count("*") >= 2) & (spread != 0), F.covar_pop(a, b) / spread)


OPTIONAL = {"token_rewards": "array<double>", "scalar_reward": "double", "response_length": "long", "response_token_count": "long"}


def _complete(rows: DataFrame) -> DataFrame:
    """Rows with every optional column, and with has_ flags; without a flag a null counts as absent."""
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
        if f"has_{name}" not in rows.columns:
            rows = rows.withColumn(f"has_{name}", F.col(name).isNotNull())
    return rows


def resolve(rows: DataFrame, tolerance: float = 1e-8, supplied: str | None = None) -> DataFrame:
    """Adds outcome (token dialect first), success, length and disagrees; optional columns may be absent.

    The length column is chosen for the whole dataset: ``supplied`` if it is named, else the
    first of the two that every row has; one aggregate of a single row decides, when the query runs.
    """
    rows = _complete(rows)
    token = token_outcome(F.col("token_rewards"))
    outcome = F.coalesce(token, F.col("scalar_reward"))
    differs = F.coalesce(F.abs(token - F.col("scalar_reward")) > tolerance, F.lit(False))
    if supplied:
        length = F.col(supplied)
    else:
        chosen = rows.agg(F.bool_and("has_response_length").alias("_first"), F.bool_and("has_response_token_count").alias("_second")).withColumn("_one", F.lit(1))
        rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(chosen), "_one")  # one row
        length = F.when(F.col("_first"), F.col("response_length")).when(F.col("_second"), F.col("response_token_count"))
    out = rows.select("*", outcome.alias("outcome"), (outcome > 0.5).alias("success"), length.cast("long").alias("length"), differs.alias("disagrees"))
    return out.drop("_one", "_first", "_second")


def dataset_facts(rows: DataFrame) -> DataFrame:
    """One row: whether every row has each length field, whether every row and some row has token rewards, and how many rows there are."""
    every = lambda name: F.coalesce(F.bool_and(f"has_{name}"), F.lit(True))
    return _complete(rows).agg(every("response_length").alias("every_response_length"), every("response_token_count").alias("every_response_token_count"), every("token_rewards").alias("every_token"), F.coalesce(F.bool_or("has_token_rewards"), F.lit(False)).alias("some_token"), F.count("*").alias("n_rows"))


REQUIRED = ("step", "input", "gts", "output", "score")


def missing_fields(rows: DataFrame, fields: tuple[str, ...] = REQUIRED) -> Column:
    """Sorted names of required fields that a row lacks: by its has_ flag, or else a null."""
    absent = [F.when(~F.col(f"has_{f}") if f"has_{f}" in rows.columns else F.col(f).isNull() if f in rows.columns else F.lit(True), f) for f in sorted(fields)]
    return F.filter(F.array(*absent), lambda x: x.isNotNull())


def violations(rows: DataFrame, n: int) -> DataFrame:
    """(rule, n_bad) over resolved rows, for every rule that some row or group breaks."""
    scalar = F.col("has_scalar_reward") & ~finite(F.col("scalar_reward"))
    rules = {
        "missing field": F.size(missing_fields(rows)) > 0,
        "non-finite score": (F.col("has_score") if "has_score" in rows.columns else F.col("score").isNotNull()) & ~finite(F.col("score")),
        "no finite outcome": F.col("outcome").isNull() | ~finite(F.col("outcome")) | (F.col("has_token_rewards") & token_outcome(F.col("token_rewards")).isNull()) | scalar,
        "length not positive": F.coalesce(F.col("length"), F.lit(0)) <= 0,
        "outcomes disagree": F.col("disagrees"),
    }
    broken = F.filter(F.array(*[F.when(test, name) for name, test in rules.items()]), lambda r: r.isNotNull())
    by_row = rows.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n_bad"))
    by_group = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") != n).agg(F.count("*").alias("n_bad")).where("n_bad > 0")
    token = F.col("has_token_rewards")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(token) & ~F.bool_and(token), F.lit(False)).alias("mixed"))
    over_all = whole.select(F.explode(F.array(F.when(F.col("mixed"), "mixed dialects"), F.when(F.col("n") == 0, "no rows"))).alias("rule")).where("rule is not null")
    return by_row.union(by_group.select(F.lit("group size").alias("rule"), "n_bad")).union(over_all.select("rule", F.lit(1).cast("long").alias("n_bad")))


def check(rows: DataFrame, n: int, cap: int = 1) -> None:
    """Raise on the first broken rules."""
    if n < 2 or cap <= 0:
        raise ValueError("n must be at least 2" if n < 2 else "the cap must be positive")
    bad = violations(rows, n).orderBy("rule").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n_bad}" for r in bad))


def groups(rows: DataFrame) -> DataFrame:
    """One row for each (step, input, gts): n and successes."""
    return rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count_if("success").alias("successes"))


def wrong_sizes(rows: DataFrame, n: int, preview: int = 3) -> DataFrame:
    """The first groups whose size is not n."""
    return groups(rows).where(F.col("n") != n).orderBy(*GROUP).limit(preview)


def spanning_groups(rows: DataFrame, by: str) -> DataFrame:
    """Groups with rows in several files (or other parts): pooled, they would be counted once."""
    return rows.groupBy(*GROUP).agg(F.count_distinct(by).alias("parts")).where("parts > 1")


def group_rates(table: DataFrame, by: str = "step") -> DataFrame:
    """By ``by`` and in total (null): groups and the rates of all-fail, mixed, all-correct."""
    rate = lambda test: F.avg(test.cast("double"))
    fail, full = F.col("successes") == 0, F.col("successes") == F.col("n")
    return table.groupingSets([[by], []], by).agg(
        F.count("*").alias("n_groups"), rate(fail).alias("all_fail_rate"), rate(~fail & ~full).alias("mixed_rate"), rate(full).alias("all_correct_rate"), rate(fail | full).alias("zero_contrast_rate")
    )


def row_metrics(rows: DataFrame, cap: int, by: str = "step", lengths_exact: bool = True) -> DataFrame:
    """By ``by`` and in total (null): pass, cap and boxed rates, length and score summaries, correlations of scores with length.

    Scores are summed up only where every row speaks the token dialect; ``lengths_exact``
    tells whether lengths were counted or only estimated by encoding the output again.
    """
    token = F.col("has_token_rewards")
    use = rows.select(by, F.col("success").cast("double").alias("ok"), F.col("length").cast("double").alias("length"), F.col("score").cast("double").alias("score"), (F.col("score") / F.col("length")).alias("per_token"), boxed(F.col("output")).cast("double").alias("boxed"), token.alias("token"), "input", F.when(token, F.size("token_rewards")).alias("width"), "step" if by != "step" else F.col("step").alias("_step"))
    step = "step" if by != "step" else "_step"
    said = lambda c: F.when(F.bool_and("token"), c)
    plain = use.groupingSets([[by], []], by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ok") == 1).alias("n_correct"),
        F.count_distinct("input").alias("unique_input_count"),
        F.array_sort(F.collect_set(step)).alias("steps"),
        said(F.array_sort(F.collect_set("width"))).alias("padded_widths"),
        F.avg("ok").alias("pass_rate"),
        F.avg("boxed").alias("boxed_rate"),
        F.avg((F.col("length") >= cap).cast("double")).alias("cap_rate"),
        F.lit(lengths_exact).alias("length_exact"),
        F.avg("length").alias("mean_length"),
        F.max("length").alias("max_length"),
        F.bool_and("token").alias("_token"),
        said(F.avg("score")).alias("mean_score"),
        said(F.avg(F.abs("score"))).alias("mean_abs_score"),
        said(F.avg("per_token")).alias("mean_score_per_token"),
        said(F.avg(F.abs("per_token"))).alias("mean_abs_score_per_token"),
        said(pearson("score", "length")).alias("raw_score_length_pearson"),
        said(pearson("per_token", "length")).alias("per_token_score_length_pearson"),
    )
    both = use.select(by, "length", "score", "per_token", F.explode(F.array(F.lit(False), F.lit(True))).alias("total")).withColumn(by, F.when(~F.col("total"), F.col(by)))
    names = {"length": (0.5, 0.95, 0.99), "score": (0.05, 0.5, 0.95), "per_token": (0.05, 0.5, 0.95)}
    found = exact_quantiles(both, [by, "total"], {n: F.col(n) for n in names}, [0.05, 0.5, 0.95, 0.99])
    suffix = {"length": "length", "score": "score", "per_token": "score_per_token"}
    wide = quantile_columns(found, [by, "total"], {f"p{round(100 * q):02d}_{suffix[n]}": (n, q) for n, qs in names.items() for q in qs})
    # The total has a null key, as a group without a key would: groups of null keys are not split from it.
    joined = plain.join(wide.where(F.col("total") | F.col(by).isNotNull()).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by", "total")
    only = [c for c in wide.columns if c.endswith(("score", "per_token"))]
    return joined.select(*[F.when(F.col("_token"), F.col(c)).alias(c) if c in only else F.col(c) for c in joined.columns if c != "_token"])


def audit(rows: DataFrame, cap: int, by: str = "step", lengths_exact: bool = True) -> DataFrame:
    """Row metrics and group rates together, by ``by`` (step or file) and in total; ``by`` must have no null."""
    table = groups(rows) if by == "step" else rows.groupBy(*GROUP, by).agg(F.count("*").alias("n"), F.count_if("success").alias("successes"))
    left, right = row_metrics(rows, cap, by, lengths_exact), group_rates(table, by)
    return left.join(right.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def success_histogram(rows: DataFrame, n: int) -> DataFrame:
    """Number of groups with each number of successes, zeros included."""
    have = groups(rows).groupBy("successes").agg(F.count("*").alias("found"))
    return rows.sparkSession.range(n + 1).withColumnRenamed("id", "successes").join(F.broadcast(have), "successes", "left").select("successes", F.coalesce("found", F.lit(0)).cast("long").alias("n_groups"))  # at most n + 1 rows


def outcome_source(rows: DataFrame, *by: str) -> DataFrame:
    """Which dialect the dataset (or each of several, ``by`` columns) speaks, in the names that reports use; null if neither is spoken by all."""
    rows = _complete(rows).groupBy(*by)
    token, scalar = F.bool_and("has_token_rewards"), F.bool_and("has_scalar_reward")
    return rows.agg(F.when(token & scalar, "true_reward_score+verifier_reward_validated").when(token, "true_reward_score").when(scalar & ~F.bool_or("has_token_rewards"), "verifier_reward").alias("outcome_source"), F.count("*").alias("n_rows"))


def centred_rewards(rewards: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """Rows with advantage: the reward less its group's mean."""
    mean = F.avg(reward).over(Window.partitionBy(*keys))  # groups have n rows
    return rewards.withColumn("advantage", F.col(reward) - mean)


def reward_signals(rewards: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """One row over groups of rewards: pass and group rates, mean distance from the group mean, mean sample variance."""
    pairs = centred_rewards(rewards, keys, reward).groupBy(*keys).agg(F.sum(F.abs("advantage")).alias("spread"), F.var_samp(reward).alias("v"), F.count_if(F.col(reward) > 0.5).alias("k"), F.count("*").alias("n"))
    rate = lambda test: F.avg(test.cast("double"))
    return pairs.agg((F.sum("k") / F.sum("n")).alias("pass_rate"), rate(F.col("k") == 0).alias("all_fail_rate"), rate((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("mixed_rate"), rate(F.col("k") == F.col("n")).alias("all_correct_rate"), (F.sum("spread") / F.sum("n")).alias("mean_abs_centred"), F.avg("v").alias("mean_variance"))


def unmasked(rows: DataFrame, values: str, mask: str, key: str) -> DataFrame:
    """(key, x) of the values that an array of masks selects; a value may be an array itself, which its mask selects whole."""
    nested = rows.schema[values].dataType.elementType.typeName() == "array"
    pairs = rows.select(key, F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("p")).where("p.m")
    return pairs.select(key, F.explode("p.v").alias("x")) if nested else pairs.select(key, F.col("p.v").alias("x"))


def masked_stats(values: DataFrame, value: str, mask: str) -> DataFrame:
    """Mean and quantiles of absolute values, and sign rates, where the mask holds; n_values 0 (and nulls) where it selects nothing."""
    x, size = F.col(value), F.abs(F.col(value))
    rows = values.where(F.col(mask))
    rate = lambda test: F.avg(test.cast("double"))
    plain = rows.agg(F.count(x).alias("n_values"), F.avg(size).alias("mean_abs"), rate(x > 0).alias("positive_rate"), rate(x < 0).alias("negative_rate"), rate(x == 0).alias("zero_rate")).withColumn("_one", F.lit(1))
    levels = (0.5, 0.95, 0.99)
    found = exact_quantiles(rows.withColumn("_one", F.lit(1)), ["_one"], {"x": size}, list(levels))
    wide = quantile_columns(found, ["_one"], {f"p{round(100 * q)}_abs": ("x", q) for q in levels})
    return plain.join(F.broadcast(wide), "_one", "left").drop("_one")  # one row


def endpoint_summary(samples: DataFrame, prompt: str, score: str, tokens: str, cap: int) -> DataFrame:
    """One row over sampled answers: any non-zero score counts as passed."""
    per = samples.groupBy(prompt).agg(F.avg(score).alias("a"), F.bool_or(F.col(score) != 0).alias("some"), F.bool_and(F.col(score) != 0).alias("every"), F.sum(tokens).alias("t"), F.count_if(F.col(tokens) >= cap).alias("c"), F.count("*").alias("n"), F.sum(score).alias("s"))
    rate = lambda test: F.avg(test.cast("double"))
    return per.agg(F.count("*").alias("n_prompts"), F.sum("n").alias("trajectory_count"), (F.sum("s") / F.sum("n")).alias("avg_at_n"), rate(F.col("some")).alias("pass_at_n"), rate(~F.col("some")).alias("all_fail_rate"), rate(F.col("every")).alias("all_correct_rate"), rate(F.col("some") & ~F.col("every")).alias("nondegenerate_group_rate"), (F.sum("t") / F.sum("n")).alias("mean_tokens"), (F.sum("c") / F.sum("n")).alias("cap_hit_rate"))


def format_rate(samples: DataFrame, field: str) -> DataFrame:
    """Share of answers whose format score is above zero; null unless every answer has one."""
    return samples.agg(F.when(F.bool_and(F.col(field).isNotNull()), F.avg((F.col(field) > 0).cast("double"))).alias("format_rate"), F.count("*").alias("n_rows"))


def sample_index(samples: DataFrame, prompt: str, order: str) -> DataFrame:
    """Rows with sample_index: their place, from 0, among their prompt's answers."""
    return samples.withColumn("sample_index", (F.row_number().over(Window.partitionBy(prompt).orderBy(order)) - 1).cast("long"))


def wrong_sample_counts(samples: DataFrame, panel: DataFrame, prompt: str, n: int) -> DataFrame:
    """Prompts of the panel that do not have exactly ``n`` answers, and answers to prompts that it lacks."""
    have = samples.groupBy(prompt).agg(F.count("*").alias("have"))
    want = panel.select(F.col(prompt), F.lit(n).cast("long").alias("want"))
    return have.join(want, prompt, "full_outer").select(prompt, F.coalesce("have", F.lit(0)).cast("long").alias("have"), F.coalesce("want", F.lit(0)).cast("long").alias("want")).where("have <> want")


def branch_result_violations(results: DataFrame, key: str) -> DataFrame:
    """(key, rule) of branch results that cannot be: steps, digests, token counts, seconds."""
    negative = lambda *names: F.least(*[F.col(c).cast("double") for c in names]) < 0
    rules = {
        "step": (F.col("checkpoint") < 0) | (F.col("horizon") <= 0),
        "checkpoint_identity_hash": ~F.coalesce(F.length("checkpoint_identity_hash") == 64, F.lit(False)),
        "prompt_queue_hash": ~F.coalesce(F.length("prompt_queue_hash") == 64, F.lit(False)),
        "generated_tokens": negative("generated_tokens_opd", "generated_tokens_rl"),
        "wall_seconds": negative("wall_seconds_opd", "wall_seconds_rl"),
    }
    broken = F.filter(F.array(*[F.when(test, name) for name, test in rules.items()]), lambda r: r.isNotNull())
    return results.select(key, F.explode(broken).alias("rule"))


def seeded(rows: DataFrame, seeds: dict[str, int], phase: str) -> DataFrame:
    """Rows with rollout_seed: the seed of their phase, null for a phase without one."""
    known = F.coalesce(*[F.when(F.col(phase) == name, F.lit(seed)) for name, seed in seeds.items()], F.lit(None).cast("int"))
    return rows.withColumn("rollout_seed", known.cast("long"))
