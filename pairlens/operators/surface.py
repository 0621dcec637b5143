"""Comparison of paired endpoints: matched fields, deltas, labels, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import branch_label, is_sha256, let

# What both arms of a comparison must have been evaluated with, and the measures of an endpoint.
MATCHED = ("dataset_sha256", "rows", "n", "temperature", "top_p", "top_k", "repetition_penalty", "max_tokens", "max_prompt_length", "max_model_len", "seed", "enable_thinking", "verifier", "evaluation_protocol_sha256")
ENDPOINT = ("avg_at_n", "pass_at_n", "all_fail_rate", "all_correct_rate", "nondegenerate_group_rate", "format_rate", "mean_tokens", "cap_hit_rate", "generation_seconds")


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field list) of pairs that differ in a matched field; missing on both sides is equal."""
    both = left.alias("l").join(right.alias("r"), key)
    names = F.filter(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    return both.select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")


def surface(comparisons: DataFrame, endpoints: DataFrame, metric: str, band: float) -> DataFrame:
    """(branch_point, opd_model_id, rl_model_id) with both scores, their difference and label, by branch point; a missing endpoint gives nulls."""
    side = lambda arm: endpoints.select(F.col("model_id").alias(f"{arm}_model_id"), F.col(metric).alias(f"{arm}_score"))
    rows = comparisons.join(side("opd"), "opd_model_id", "left").join(side("rl"), "rl_model_id", "left")
    rows = rows.select("branch_point", "opd_model_id", "rl_model_id", "opd_score", "rl_score", (F.col("rl_score") - F.col("opd_score")).alias("delta"), F.when(F.col("rl_score").isNotNull() & F.col("opd_score").isNotNull(), branch_label(F.col("rl_score"), F.col("opd_score"), band)).alias("label"))
    return rows.orderBy("branch_point")


def _with(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``rows`` with null columns for those of ``fields`` that it lacks."""
    return rows.select("*", *[F.lit(None).cast(kind).alias(f) for f, kind in fields.items() if f not in rows.columns])


def evaluation_index(specs: DataFrame, panel: str) -> DataFrame:
    """The specifications of one panel."""
    return specs.where(F.col("panel") == panel)


def duplicate_evaluations(specs: DataFrame) -> DataFrame:
    """(panel, model_id, n) that are specified more than once."""
    return specs.groupBy("panel", "model_id").agg(F.count("*").alias("n")).where("n > 1")


def attach_summaries(specs: DataFrame, summaries: DataFrame, root: str) -> DataFrame:
    """Each specification with found (whether its folder has a summary) and summary (a struct of all its columns).

    A specification's output_dir is a path, or relative to ``root``; summaries have theirs as ``folder``.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:(//)?", ""), "/+$", "")
    where = F.when(F.col("output_dir").startswith("/"), F.col("output_dir")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("output_dir")))
    held = summaries.select(clean(F.col("folder")).alias("_folder"), F.struct(*[c for c in summaries.columns if c != "folder"]).alias("summary"))
    return specs.withColumn("_folder", clean(where)).join(held, "_folder", "left").withColumn("found", F.col("summary").isNotNull()).drop("_folder")


def _same_as_json(expected: Column, value: Column) -> Column:
    """Whether a value of a JSON document (as text) equals a column's: numbers as doubles, all else as canonical text."""
    number = expected.try_cast("double") == value.try_cast("double")
    return F.coalesce(number, expected.eqNullSafe(value))


def summary_violations(attached: DataFrame) -> DataFrame:
    """(panel, model_id, field) where a summary is missing or differs from its specification; what a specification leaves out is free.

    ``attached``: see ``attach_summaries``. evaluation_protocol is JSON text; the summary's verifier is JSON text too.
    """
    fields = {f.name: f.dataType.simpleString() for f in attached.schema["summary"].dataType}
    rows = _with(attached, {"model_path": "string", "model_identity_sha256": "string", "dataset": "string", "dataset_sha256": "string", "evaluation_protocol": "string", "evaluation_protocol_sha256": "string"})
    got = lambda f: F.col(f"summary.{f}").cast("string") if f in fields else F.lit(None).cast("string")
    tests = [F.when(~F.col("found"), "summary")]
    tests += [F.when(F.col("found") & ~got(f).eqNullSafe(F.col(f).cast("string")), f) for f in ("panel", "model_id")]
    tests += [F.when(F.col("found") & F.col(f).isNotNull() & ~got(f).eqNullSafe(F.col(f).cast("string")), f) for f in ("model_path", "model_identity_sha256", "dataset", "dataset_sha256", "evaluation_protocol_sha256")]
    tests += [F.when(F.col("found") & ~is_sha256(got(f)), f"{f} malformed") for f in ("model_identity_sha256", "evaluation_protocol_sha256")]
    # What the locked protocol names, whatever it names, is asked for in the summary.
    plan = F.from_json("evaluation_protocol", "map<string,string>")
    told = F.from_json(F.to_json(F.col("summary"), {"ignoreNullFields": "true"}), "map<string,string>")
    canonical = lambda x: F.coalesce(F.to_json(F.try_parse_json(x)), x)
    differ = F.transform(F.filter(F.map_entries(plan), lambda e: ~_same_as_json(canonical(e["value"]), canonical(told[e["key"]]))), lambda e: e["key"])
    named = F.when(F.col("found"), F.coalesce(differ, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    broken = F.array_distinct(F.concat(F.filter(F.array(*tests), lambda x: x.isNotNull()), named))
    return rows.select("panel", "model_id", F.explode(broken).alias("field"))


def pair_violations(comparisons: DataFrame, attached: DataFrame) -> DataFrame:
    """(branch_point, field) where the arms of a comparison have no specification, or differ in a matched field; missing on both sides is equal."""
    sides = _sides(comparisons, attached)
    fields = {f.name for f in attached.schema["summary"].dataType}
    tests = [F.when(F.col(f"{arm}_found").isNull(), f"{arm} specification") for arm in ("opd", "rl")]
    both = F.coalesce(F.col("opd_found") & F.col("rl_found"), F.lit(False))
    text = lambda arm, f: F.col(f"{arm}.{f}")
    tests += [F.when(both & ~text("opd", f).eqNullSafe(text("rl", f)), f) for f in MATCHED if f in fields]
    return sides.select("branch_point", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("field"))


def _sides(comparisons: DataFrame, attached: DataFrame) -> DataFrame:
    side = lambda arm: attached.select(F.col("model_id").alias(f"{arm}_model_id"), F.col("found").alias(f"{arm}_found"), F.col("summary").alias(arm))
    return comparisons.join(side("opd"), "opd_model_id", "left").join(side("rl"), "rl_model_id", "left")


def full_surface(comparisons: DataFrame, attached: DataFrame, panel: str, metric: str, band: float, horizon: int = 0, signals: DataFrame | None = None) -> DataFrame:
    """One row for each comparison whose two summaries have the metric, by branch point.

    ``signals``: (branch_point, name, value) as text, text, double; they come as a map, null
    where a branch point has none. An endpoint field is given only where both arms have it.
    """
    if band < 0:
        raise ValueError("the band must not be negative")
    rows = _with(_sides(comparisons, attached), {"horizon": "int", "target_step": "int"})
    fields = {f.name for f in attached.schema["summary"].dataType}
    opd, rl = F.col(f"opd.{metric}").cast("double"), F.col(f"rl.{metric}").cast("double")
    pairs = []
    for f in ENDPOINT:
        if f in fields:
            a, b = F.col(f"opd.{f}").cast("double"), F.col(f"rl.{f}").cast("double")
            pairs += [F.when(b.isNotNull(), a).alias(f"opd_{f}"), F.when(a.isNotNull(), b).alias(f"grpo_{f}")]
    point = F.col("branch_point")
    out = rows.where(opd.isNotNull() & rl.isNotNull()).select(
        point, F.coalesce("horizon", F.lit(horizon)).alias("horizon"), F.coalesce(F.col("target_step"), point).alias("target_step"), F.lit(panel).alias("panel"), F.lit(metric).alias("metric"),
        "opd_model_id", F.col("rl_model_id").alias("grpo_model_id"), opd.alias("opd_endpoint"), rl.alias("grpo_endpoint"), (rl - opd).alias("grpo_minus_opd"),
        F.lit(float(band)).alias("equivalence_band"), branch_label(rl, opd, float(band)).alias("preferred_arm"),
        F.col("opd.model_identity_sha256").alias("opd_model_identity_sha256"), F.col("rl.model_identity_sha256").alias("grpo_model_identity_sha256"), F.col("opd.evaluation_protocol_sha256").alias("evaluation_protocol_sha256"), *pairs,
    )
    if signals is not None:
        held = signals.groupBy(F.col("branch_point").cast("string").alias("_point")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("signals"))
        out = out.join(held, F.col("branch_point").cast("string") == F.col("_point"), "left").drop("_point")
    return out.orderBy("branch_point")


def check_surface(comparisons: DataFrame, specs: DataFrame, attached: DataFrame, metric: str) -> None:
    """Raise on the first things that make the arms no fair pair: specifications twice or not at all, summaries that differ from the plan, arms that differ."""
    if comparisons.isEmpty():
        raise ValueError("no comparisons")
    used = comparisons.select(F.explode(F.array("opd_model_id", "rl_model_id")).alias("model_id")).distinct()
    found = [f"{r.model_id}: specified {r.n} times on {r.panel}" for r in duplicate_evaluations(specs).limit(20).collect()]
    found += [f"{r.model_id}: {r.field}" for r in summary_violations(attached.join(used, "model_id", "left_semi")).limit(20).collect()]
    found += [f"branch point {r.branch_point}: {r.field}" for r in pair_violations(comparisons, attached).limit(20).collect()]
    if metric not in attached.schema["summary"].dataType.names:
        found.append(f"no summary has {metric}")
    elif not found:
        rows = _sides(comparisons, attached).where(F.col(f"opd.{metric}").isNull() | F.col(f"rl.{metric}").isNull())
        found += [f"branch point {r.branch_point}: {metric} is absent" for r in rows.limit(20).collect()]
    if found:
        raise ValueError("; ".join(sorted(found)[:20]))


def flatten_signals(rows: DataFrame, key: str, json: str, prefix: str = "signal") -> DataFrame:
    """(key, name, value) of every finite number or truth value in nested objects; names are joined by underscores.

    Of two signals of one name the last in the text counts. Each row is opened by itself,
    level by level, as often as its text has braces: no recursion over the table, no shuffle,
    and no limit of levels or rows. A variant sorts its keys, so the text gives their order.
    """
    kind = F.schema_of_variant
    leaf = "array<struct<name:string,v:variant,said:string>>"
    is_object = lambda v: kind(v).startswith("OBJECT<")

    def opened(x):
        def inner(parts):
            values, texts = parts["values"], parts["texts"]
            return F.transform(F.json_object_keys(x["said"]), lambda k: F.struct(F.concat_ws("_", x["name"], k).alias("name"), values[k].alias("v"), texts[k].alias("said")))

        parts = F.struct(x["v"].cast("map<string,variant>").alias("values"), F.from_json(x["said"], "map<string,string>").alias("texts"))
        return F.when(is_object(x["v"]), let(parts, inner)).otherwise(F.array(x))

    def step(held, _):
        return F.when(F.exists(held, lambda x: is_object(x["v"])), F.flatten(F.transform(held, opened)).cast(leaf)).otherwise(held)

    def number(x):
        numeric = kind(x["v"]).isin("BIGINT", "DOUBLE", "FLOAT") | kind(x["v"]).startswith("DECIMAL")
        value = F.when(kind(x["v"]) == "BOOLEAN", F.try_variant_get(x["v"], F.lit("$"), "boolean").cast("double")).when(numeric, F.try_variant_get(x["v"], F.lit("$"), "double"))
        return F.struct(x["name"].alias("name"), value.alias("value"))

    def last_of_each(backwards):
        names = F.transform(backwards, lambda x: x["name"])
        return let(names, lambda all_: F.transform(F.array_distinct(all_), lambda n: F.element_at(backwards, F.array_position(all_, n).cast("int"))))

    braces = F.length(json) - F.length(F.replace(F.col(json), F.lit("{"), F.lit("")))
    start = F.array(F.struct(F.lit(prefix).alias("name"), F.try_parse_json(F.col(json)).alias("v"), F.col(json).alias("said"))).cast(leaf)
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(braces, F.lit(1))), start, step)
    found = F.filter(F.transform(whole, number), lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) < float("inf")))
    rows = rows.where(is_object(F.try_parse_json(F.col(json))))
    return rows.select(F.col(key), F.explode(let(F.reverse(found), last_of_each)).alias("s")).select(key, "s.name", "s.value")


def signal_columns(table: DataFrame, names: list[str]) -> DataFrame:
    """A surface with its signals as columns, in the order of ``names``."""
    return table.select(*[c for c in table.columns if c != "signals"], *[F.col("signals")[n].alias(n) for n in names])


def vocabulary_diff(left: DataFrame, right: DataFrame, token: str, number: str) -> DataFrame:
    """Tokens whose numbers differ or that one side lacks."""
    both = left.select(token, F.col(number).alias("left_id")).join(right.select(token, F.col(number).alias("right_id")), token, "full_outer")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def expected_hashes(found: DataFrame, upstream: DataFrame, patches: DataFrame, path: str, sha: str) -> DataFrame:
    """Files whose hash is neither the patch's (if there is one) nor else the upstream one."""
    named = lambda df, name: df.select(path, F.col(sha).alias(name))
    rows = found.join(named(upstream, "upstream_sha"), path, "left").join(named(patches, "patch_sha"), path, "left")
    return rows.withColumn("expected_sha", F.coalesce("patch_sha", "upstream_sha")).where(~F.col(sha).eqNullSafe(F.col("expected_sha"))).select(path, sha, "expected_sha")


def first_vocabulary_diffs(left: DataFrame, right: DataFrame, token: str, number: str, preview: int = 20) -> DataFrame:
    """The first tokens, in order, whose numbers differ."""
    return vocabulary_diff(left, right, token, number).orderBy(token).limit(preview)


def file_status(found: DataFrame, upstream: DataFrame, patches: DataFrame, path: str, sha: str) -> DataFrame:
    """Each file with expected_sha (the patch's if there is one, else the upstream one), its status and whether it has drifted."""
    named = lambda df, name: df.select(path, F.col(sha).alias(name))
    rows = found.join(named(upstream, "upstream_sha"), path, "left").join(named(patches, "patch_sha"), path, "left")
    expected = F.coalesce("patch_sha", "upstream_sha")
    return rows.select(path, sha, expected.alias("expected_sha"), F.when(F.col("patch_sha").isNotNull(), "permitted-local-patch").otherwise("exact-upstream-text").alias("status"), (~F.col(sha).eqNullSafe(expected)).alias("drifted"))
