"""Tables of planned experiments: from a table of configurations to runs, stages, evaluations, comparisons, commands and budgets.

A configuration is one row of JSON text; any number of experiments are planned, checked and
looked up at once, with generators and joins over their rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import evaluation_id, run_id, safe_identifier

# Estimators that no plan may name, how arms of a pair must resume, and the names of phases, arms and stages.
FORBIDDEN = ("token_reward_direct_plus_grpo",)
COUNTERFACTUAL = "fork_resumed_opd"
TRUNK, BRANCH, VALIDATION = "discovery_trunk", "discovery_branch", "validation"
FIRST_STAGE, LATER_STAGE = "initial_t0_endpoint", "post_t0_continuation"
# Verifier settings that stand for those left out.
VERIFIER = {"label": "configured-verifier", "module": "verl.utils.reward_score.ttrl_math", "function": "compute_score", "score_field": "score", "format_field": "format_score"}

#: Columns of an opened configuration: where each value stands, and its type.
SETTINGS = {
    "protocol_id": ("project.protocol_id", "string"), "output_dir": ("project.output_dir", "string"),
    "student_model": ("paths.student_model", "string"), "teacher_model": ("paths.teacher_model", "string"), "datasets": ("paths.external_eval", "array<string>"),
    "batch": ("data.prompt_batch_size", "int"), "n": ("rollout.n", "int"), "prompt_cap": ("rollout.max_prompt_length", "int"), "response_cap": ("rollout.max_response_length", "int"), "thinking": ("rollout.enable_thinking", "boolean"),
    "discovery_seed": ("rollout.seeds.discovery", "long"), "validation_seed": ("rollout.seeds.validation", "long"),
    "opd_estimator": ("training.opd_estimator", "string"), "rl_estimator": ("training.rl_estimator", "string"), "forbidden": ("training.forbidden_estimators", "array<string>"), "mode": ("training.counterfactual_mode", "string"),
    "trunk_updates": ("training.trunk_updates", "int"), "points": ("training.branch_points", "array<int>"), "horizon": ("training.branch_horizon", "int"), "saved": ("training.checkpoint_updates", "array<int>"), "frequency": ("training.checkpoint_frequency", "int"),
    "first_stop": ("training.staged_trunk_initial_stop", "int"), "reuse_trunk": ("training.reuse_fresh_trunk_t0", "boolean"), "mini_batch": ("training.ppo_mini_batch_size", "int"), "epochs": ("training.ppo_epochs", "int"), "validation_updates": ("training.validation_updates", "int"),
    "panel": ("evaluation.primary_panel", "string"), "panels": ("evaluation.external_panels", "array<string>"), "primary_n": ("evaluation.primary_n", "int"), "external_n": ("evaluation.external_n", "int"), "evaluation_cap": ("evaluation.max_response_length", "int"),
    "temperature": ("evaluation.temperature", "double"), "top_p": ("evaluation.top_p", "double"), "top_k": ("evaluation.top_k", "int"), "repetition_penalty": ("evaluation.repetition_penalty", "double"), "evaluation_seed": ("evaluation.seed", "long"), "band": ("evaluation.equivalence_band", "double"),
    "gpus": ("runtime.n_gpus_per_node", "int"), "memory_share": ("runtime.rollout_gpu_memory_utilization", "double"), "context": ("runtime.max_model_len", "int"), "schema_version": ("schema_version", "int"),
}
#: What a plan can't do without; all but the last few of the settings above.
NEEDED = [name for name in SETTINGS if name not in ("forbidden", "mode", "saved", "frequency", "first_stop", "reuse_trunk", "mini_batch", "epochs", "validation_updates", "external_n", "thinking", "discovery_seed", "validation_seed", "temperature", "top_p", "top_k", "repetition_penalty", "evaluation_seed", "band", "context")]


def opened(configs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, v, and a column for each of SETTINGS) of configurations kept as JSON; what is absent or of another type is null."""
    rows = configs.select(F.col(key), F.try_parse_json(text).alias("v"))
    return rows.select(key, "v", *[F.try_variant_get("v", f"$.{path}", kind).alias(name) for name, (path, kind) in SETTINGS.items()])


def config_violations(plans: DataFrame, key: str) -> DataFrame:
    """(key, rule, detail) of what is wrong in opened configurations; where something needed is missing, that alone is told."""
    whole = lambda c: F.coalesce(c, F.lit(False))
    points, saved, panels = F.col("points"), F.coalesce("saved", F.array().cast("array<int>")), F.col("panels")
    last = F.array_max("points") + F.col("horizon")
    unsaved = F.array_except(F.filter("points", lambda p: p > 0), saved)
    banned = F.concat(F.coalesce("forbidden", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in FORBIDDEN]))
    stop, mini = F.col("first_stop"), F.coalesce("mini_batch", "batch")
    rules: dict[str, tuple[Column, Column]] = {
        "schema": (F.col("schema_version") == 1, F.col("schema_version")),
        "protocol id": (safe_identifier(F.col("protocol_id")), F.col("protocol_id")),
        "samples": (F.col("n") >= 2, F.col("n")),
        "batch": (F.col("batch") >= 1, F.col("batch")),
        "response cap": (F.col("response_cap") >= 1, F.col("response_cap")),
        "caps of training and evaluation": (F.col("response_cap") == F.col("evaluation_cap"), F.col("evaluation_cap")),
        "no branch point": (F.size(points) > 0, F.lit(None)),
        "order of branch points": ((points == F.array_sort(F.array_distinct(points))) & (F.coalesce(F.array_min(points), F.lit(0)) >= 0), F.to_json(points)),
        "horizon": (F.col("horizon") >= 1, F.col("horizon")),
        "endpoint beyond the trunk": ((F.size(points) == 0) | (last <= F.col("trunk_updates")), last),
        "branch point without checkpoint": (F.size(unsaved) == 0, F.to_json(unsaved)),
        "forbidden estimator": (~F.arrays_overlap(F.array("opd_estimator", "rl_estimator"), banned), F.concat_ws(",", F.array_intersect(F.array("opd_estimator", "rl_estimator"), banned))),
        "one estimator for both arms": (F.col("opd_estimator") != F.col("rl_estimator"), F.col("rl_estimator")),
        "counterfactual mode": (F.col("mode").isNull() | (F.col("mode") == COUNTERFACTUAL), F.col("mode")),
        "mini-batch": (F.expr("batch * n") % mini == 0, mini),
        "first stage": (stop.isNull() | ((stop == F.col("horizon")) & (stop < F.col("trunk_updates")) & (F.coalesce(stop % F.col("frequency"), F.lit(0)) == 0)), stop),
        "endpoint between checkpoints": (F.forall(points, lambda p: F.coalesce((p + F.col("horizon")) % F.col("frequency"), F.lit(0)) == 0), F.col("frequency")),
        "context": (F.col("context").isNull() | (F.col("context") >= F.col("prompt_cap") + F.col("response_cap")), F.col("context")),
        "gpus": (F.col("gpus") >= 1, F.col("gpus")),
        "memory share": ((F.col("memory_share") > 0) & (F.col("memory_share") <= 1), F.col("memory_share")),
        "panels and datasets": (F.size(panels) == F.size("datasets"), F.size(panels)),
        "panel twice": (F.size(F.array_distinct(panels)) == F.size(panels), F.to_json(panels)),
        "primary panel": (F.array_contains(panels, F.col("panel")), F.col("panel")),
        "samples of the primary panel": (F.col("primary_n") >= 1, F.col("primary_n")),
        "band": (F.coalesce("band", F.lit(0.0)) >= 0, F.col("band")),
    }
    told = lambda name, detail: F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
    lacking = F.filter(F.array(*[F.when(F.col(name).isNull(), told("missing", F.lit(SETTINGS[name][0]))) for name in NEEDED]), lambda x: x.isNotNull())
    broken = F.filter(F.array(*[F.when(~whole(holds), told(name, detail)) for name, (holds, detail) in rules.items()]), lambda x: x.isNotNull())
    return plans.select(key, lacking.alias("lacking"), broken.alias("broken")).select(key, F.inline(F.when(F.size("lacking") > 0, F.col("lacking")).otherwise(F.col("broken"))))


def check_configs(plans: DataFrame, key: str) -> None:
    """Raise on the first things that are wrong."""
    found = config_violations(plans, key).orderBy(key, "rule", "detail").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r[0]}: {r.rule} {r.detail}".rstrip() for r in found))


def _root() -> Column:
    """The folder beside a plan's own."""
    return F.regexp_replace(F.regexp_replace("output_dir", "/+$", ""), "/?[^/]*$", "")


def _checkpoint(run: Column, step: Column | None = None) -> Column:
    folder = F.concat(_root(), F.lit("/runs/"), run, F.lit("/checkpoint"))
    return folder if step is None else F.concat(folder, F.lit("/global_step_"), step.cast("string"))


def _named(*parts) -> Column:
    """An id of the protocol: its name and the parts, with underscores between."""
    return run_id(F.col("protocol_id"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _at(point: Column) -> Column:
    return F.concat(F.lit("t"), point.cast("string"))


def _dosed(runs: DataFrame) -> DataFrame:
    """Runs with what their updates cost."""
    rows = F.col("updates").cast("long") * F.col("batch") * F.col("n")
    return runs.withColumns({"prompts": F.col("updates").cast("long") * F.col("batch"), "trajectories": rows, "optimizer_steps": (F.floor(rows / F.coalesce("mini_batch", "batch")) * F.coalesce("epochs", F.lit(1))).cast("long"), "token_upper_bound": rows * F.col("response_cap")})


RUN = ("run_id", "phase", "arm", "estimator", "start_step", "updates", "target_step", "branch_point", "resume_from", "paired_run_id", "identity_group", "rollout_seed", "checkpoint_dir", "prompts", "trajectories", "optimizer_steps", "token_upper_bound")


def run_table(plans: DataFrame, key: str) -> DataFrame:
    """Every run of opened configurations: the trunk, the arms of each branch point, and two validation arms where they have updates.

    At the start an arm that distils is the trunk itself, if the plan reuses that; both arms of a
    point resume from the trunk's checkpoint there, and share an identity group.
    """
    arms = F.explode(F.array(F.lit("opd"), F.lit("rl"))).alias("arm")
    estimator = F.when(F.col("arm") == "opd", F.col("opd_estimator")).otherwise(F.col("rl_estimator"))
    none, trunk = F.lit(None).cast("string"), _named(TRUNK, "opd")
    point, zero = F.col("branch_point"), F.lit(0)
    first = plans.select("*", F.lit("opd").alias("arm")).select("*", trunk.alias("run_id"), F.lit(TRUNK).alias("phase"), zero.alias("start_step"), F.col("trunk_updates").alias("updates"), F.lit(None).cast("int").alias("branch_point"), none.alias("resume_from"), none.alias("paired_run_id"), none.alias("identity_group"), F.col("discovery_seed").alias("rollout_seed"))
    forks = plans.select("*", F.explode("points").alias("branch_point")).select("*", arms)
    skipped = (point == 0) & (F.col("arm") == "opd") & F.coalesce("reuse_trunk", F.lit(False))
    fork = lambda arm: _named("branch", _at(point), arm)
    other = F.when(F.col("arm") == "opd", fork("rl")).when(point == 0, trunk).otherwise(fork("opd"))
    forks = forks.where(~skipped).select("*", fork(F.col("arm")).alias("run_id"), F.lit(BRANCH).alias("phase"), point.alias("start_step"), F.col("horizon").alias("updates"), F.when(point > 0, _checkpoint(trunk, point)).alias("resume_from"), other.alias("paired_run_id"), _named("branch", _at(point)).alias("identity_group"), F.col("discovery_seed").alias("rollout_seed"))
    last = plans.where("validation_updates is not null").select("*", arms).select("*", _named("validation_always", F.col("arm")).alias("run_id"), F.lit(VALIDATION).alias("phase"), zero.alias("start_step"), F.col("validation_updates").alias("updates"), F.lit(None).cast("int").alias("branch_point"), none.alias("resume_from"), none.alias("paired_run_id"), none.alias("identity_group"), F.col("validation_seed").alias("rollout_seed"))
    every = first.unionByName(forks).unionByName(last).withColumns({"estimator": estimator, "target_step": F.col("start_step") + F.col("updates"), "checkpoint_dir": _checkpoint(F.col("run_id"))})
    return _dosed(every).select(key, *RUN)


def of_phase(runs: DataFrame, phase: str) -> DataFrame:
    """Runs of all phases, of those that begin with discovery, or of the validation."""
    if phase not in ("all", "discovery", VALIDATION):
        raise ValueError(f"no phase: {phase}")
    return runs if phase == "all" else runs.where(F.col("phase").startswith(phase))


def stage_table(runs: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """What is executed in which order: place, execution_id, scientific_run_id, stage and steps.

    A trunk is cut in two at its plan's first stop; the reinforcement arm from the start runs between the parts, all others after them.
    """
    settings = plans.select(F.col(key).alias("_key"), "first_stop", "protocol_id")
    rows = runs.join(settings, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    stop, trunk = F.col("first_stop"), F.col("phase") == TRUNK
    part = lambda name, a, b, place: F.struct(F.lit(name).alias("stage"), a.cast("int").alias("from_step"), b.cast("int").alias("to_step"), F.lit(place).alias("rank"))
    cut = F.array(part(FIRST_STAGE, F.lit(0), stop, 0), part(LATER_STAGE, stop, F.col("target_step"), 2))
    whole = F.array(F.when(F.col("run_id") == _named("branch_t0_rl"), part(None, F.col("start_step"), F.col("target_step"), 1)).otherwise(part(None, F.col("start_step"), F.col("target_step"), 3)))
    staged = rows.select("*", F.inline(F.when(trunk & stop.isNotNull(), cut).otherwise(whole)))
    name = F.when(F.col("stage").isNotNull(), F.concat_ws("_", "run_id", _at(F.col("from_step")), _at(F.col("to_step")))).otherwise(F.col("run_id"))
    resume = F.when(F.col("stage") == LATER_STAGE, F.concat("checkpoint_dir", F.lit("/global_step_"), F.col("from_step").cast("string"))).otherwise(F.col("resume_from"))
    group = F.when(F.col("stage") == FIRST_STAGE, _named("branch_t0")).otherwise(F.col("identity_group"))
    order = Window.partitionBy(key).orderBy("rank", F.col("phase") == VALIDATION, "branch_point", "arm")  # a plan's stages
    return staged.select(key, (F.row_number().over(order) - 1).alias("place"), name.alias("execution_id"), F.col("run_id").alias("scientific_run_id"), "stage", F.col("from_step").alias("start_step"), F.col("to_step").alias("target_step"), resume.alias("resume_from"), group.alias("identity_group"))


def first_specs(wanted: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Each wanted id with the first specification that has it, by execution_id or else by run_id: (key, source from 0, specification as JSON); null where none has.

    ``sources`` may have different columns.
    """
    ids = lambda df: F.coalesce(*[F.col(c) for c in ("execution_id", "run_id") if c in df.columns])
    held = [df.select(ids(df).alias("_id"), F.lit(k).alias("source"), F.to_json(F.struct(*df.columns)).alias("spec")) for k, df in enumerate(sources)]
    first = reduce(DataFrame.unionByName, held).groupBy("_id").agg(F.min(F.struct("source", "spec")).alias("f"))
    return wanted.select(key).join(first, F.col(key) == F.col("_id"), "left").select(key, "f.source", "f.spec")


def comparison_table(plans: DataFrame, key: str) -> DataFrame:
    """One row for each branch point: horizon, target_step and the models of both arms; from the start on the trunk is the distilling arm."""
    points = plans.select("*", F.explode("points").alias("branch_point"))
    target = F.col("branch_point") + F.col("horizon")
    opd = F.when(F.col("branch_point") == 0, _named("trunk_opd", _at(target))).otherwise(_named("branch", _at(F.col("branch_point")), "opd", _at(target)))
    return points.select(key, "branch_point", "horizon", target.alias("target_step"), opd.alias("opd_model_id"), _named("branch", _at(F.col("branch_point")), "rl", _at(target)).alias("rl_model_id"))


def model_table(plans: DataFrame, key: str) -> DataFrame:
    """The models to evaluate: student and teacher as they are, and both arms of each branch point, which are merged first."""
    comparisons = comparison_table(plans.withColumnRenamed(key, "_key"), "_key")
    held = plans.select(F.col(key).alias("_own"), "protocol_id", "output_dir", F.array_max("points").alias("last_point"))
    ends = comparisons.join(held, F.col("_key").eqNullSafe(F.col("_own")))
    arm = lambda name, shown: F.struct(F.lit(shown).alias("arm"), F.col(f"{name}_model_id").alias("model_id"), F.when((F.lit(name) == "opd") & (F.col("branch_point") == 0), _named(TRUNK, "opd")).otherwise(_named("branch", _at(F.col("branch_point")), name)).alias("run"))
    ends = ends.select("*", F.inline(F.array(arm("opd", "opd"), arm("rl", "grpo"))))
    ends = ends.select(F.col("_key").alias(key), "model_id", "arm", "branch_point", "target_step", F.concat(_root(), F.lit("/merged/"), F.col("model_id")).alias("model_path"), F.concat(_checkpoint(F.col("run"), F.col("target_step")), F.lit("/actor")).alias("actor_dir"), (F.col("branch_point") == F.col("last_point")).alias("last"))
    plain = F.array(*[F.struct(F.lit(i).alias("model_id"), F.lit(a).alias("arm"), F.col(p).alias("model_path")) for i, a, p in (("student_base", "baseline", "student_model"), ("teacher_reference", "teacher_reference", "teacher_model"))])
    whole = plans.select(key, F.inline(plain)).select(key, "model_id", "arm", F.lit(None).cast("int").alias("branch_point"), F.lit(None).cast("int").alias("target_step"), "model_path", F.lit(None).cast("string").alias("actor_dir"), F.lit(False).alias("last"))
    return whole.unionByName(ends)


def locked_protocol(samples: Column, verifier_sha256: Column) -> Column:
    """What an evaluation must be run with, as canonical JSON; over an opened configuration and its variant."""
    source = {"module": "eval_module", "function": "eval_function"}
    verifier = [F.coalesce(F.try_variant_get("v", f"$.verifier.{source.get(k, k)}", "string"), F.lit(d)).alias(k) for k, d in VERIFIER.items()]
    parts = [F.col("temperature"), F.col("top_p"), F.col("top_k"), F.col("repetition_penalty"), F.col("evaluation_seed").alias("seed"), samples.cast("int").alias("n"), F.col("evaluation_cap").alias("max_tokens"), F.col("prompt_cap").alias("max_prompt_length"), (F.col("prompt_cap") + F.col("evaluation_cap")).alias("max_model_len"), F.col("thinking").alias("enable_thinking"), F.struct(*verifier, verifier_sha256.alias("source_sha256")).alias("verifier")]
    return F.to_json(F.parse_json(F.to_json(F.struct(*parts))))


def evaluation_table(plans: DataFrame, key: str, verifier_sha256: str) -> DataFrame:
    """Every evaluation: each model on the primary panel, the models of the last branch on all others too; panels and datasets go together by place."""
    panels = plans.select(F.col(key).alias("_key"), "v", *[c for c in SETTINGS if c not in ("points", "panels", "datasets")], F.inline(F.arrays_zip(F.col("panels").alias("on"), F.col("datasets").alias("dataset"))))
    rows = model_table(plans, key).join(panels, F.col(key).eqNullSafe(F.col("_key")))
    primary = F.col("on") == F.col("panel")
    rows = rows.where(primary | F.col("last")).withColumn("samples", F.when(primary, F.col("primary_n")).otherwise(F.col("external_n")))
    rows = rows.withColumn("eval_id", evaluation_id(F.col("model_id"), F.col("on"))).withColumn("evaluation_protocol", locked_protocol(F.col("samples"), F.lit(verifier_sha256)))
    return rows.select(key, "eval_id", "model_id", F.col("on").alias("panel"), "model_path", "dataset", F.col("samples").alias("n"), F.concat(_root(), F.lit("/evaluations/"), F.col("eval_id")).alias("output_dir"), "evaluation_protocol", F.sha2("evaluation_protocol", 256).alias("evaluation_protocol_sha256"))


def shell(argv: Column) -> Column:
    """A command as a line for a shell: what is more than plain letters stands in quotes."""
    quoted = lambda a: F.when(a.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), a).otherwise(F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    return F.array_join(F.transform(argv, quoted), " ")


def settings_argv(module: str, settings: dict[str, Column], truths: dict[str, Column]) -> Column:
    """A training command from settings by key, truth values as True and False; nothing for what is null."""
    told = {k: v.cast("string") for k, v in settings.items()} | {k: F.initcap(v.cast("string")) for k, v in truths.items()}
    shown = [F.concat(F.lit(f"{k}="), v) for k, v in told.items()]
    return F.filter(F.array(F.lit("python"), F.lit("-m"), F.lit(module), *shown), lambda a: a.isNotNull())


def merge_commands(models: DataFrame, key: str) -> DataFrame:
    """(key, model_id, argv, shell) that make one model of each actor's checkpoint."""
    argv = F.array(*[F.lit(a) for a in ("python", "-m", "verl.model_merger", "merge", "--backend", "fsdp", "--local_dir")], F.col("actor_dir"), F.lit("--target_dir"), F.col("model_path"), F.lit("--use_cpu_initialization"))
    return models.where("actor_dir is not null").select(key, "model_id", argv.alias("argv")).withColumn("shell", shell(F.col("argv")))


def budget_projection(plans: DataFrame, seconds: Column, arms: Column, overhead: float = 0.25) -> DataFrame:
    """Opened configurations with the updates and hours of the whole experiment: two arms for each branch point, ``arms`` validation arms."""
    discovery = F.col("trunk_updates") + 2 * F.size("points") * F.col("horizon")
    validation = F.coalesce(arms * F.col("validation_updates"), F.lit(0))
    hours = (discovery + validation) * seconds / 3600.0
    return plans.withColumns({"discovery_updates": discovery.cast("double"), "planned_validation_updates": validation.cast("double"), "total_updates": (discovery + validation).cast("double"), "core_gpu_hours": hours, "gpu_hours_with_overhead": hours * (1.0 + overhead)})


def leaves(configs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, value) of every plain value in nested objects, values as JSON; an empty object is a plain value."""
    leaf = "array<struct<path:array<string>,v:variant>>"
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>")
    opened_ = lambda x: F.when(is_object(x["v"]), F.transform(F.map_entries(x["v"].cast("map<string,variant>")), lambda e: F.struct(F.concat(x["path"], F.array(e["key"])).alias("path"), e["value"].alias("v")))).otherwise(F.array(x))
    step = lambda held, _: F.when(F.exists(held, lambda x: is_object(x["v"])), F.flatten(F.transform(held, opened_)).cast(leaf)).otherwise(held)
    braces = F.length(text) - F.length(F.replace(F.col(text), F.lit("{"), F.lit("")))
    start = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.parse_json(F.col(text)).alias("v"))).cast(leaf)
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(braces, F.lit(1))), start, step)
    return configs.select(*keys, F.inline(whole)).select(*keys, "path", F.to_json("v").alias("value"))


def merged_leaves(fragments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, path, value) of the configurations that fragments make: of one path the last fragment by ``order`` counts; an object that others fill is no value."""
    every = leaves(fragments, [key, order], text).groupBy(key, "path").agg(F.max_by("value", order).alias("value"))
    above = every.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")).distinct()
    return every.join(above.withColumn("_filled", F.lit(True)), [key, "path"], "left").where(~(F.coalesce("_filled", F.lit(False)) & (F.col("value") == "{}"))).select(key, F.array_join("path", ".").alias("path"), "value")


def merge_clashes(fragments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, path) where one fragment has an object and another a plain value."""
    every = leaves(fragments, [key, order], text)
    plain = every.where("value <> '{}'").select(key, "path").distinct()
    inner = every.where("size(path) > 1").select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path"))
    objects = inner.unionByName(every.where("value = '{}'").select(key, "path")).distinct()
    return plain.join(objects, [key, "path"]).select(key, F.array_join("path", ".").alias("path"))
