"""Queries of planned experiments: every supplier is the owner of one, its settings made of its number; each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files, sinks
from ..sources.shared import shared_root
from . import experiments as X
from .registry import query, rounded, table

def config_texts(spark, sf_dir, planted: bool = False):
    """(s_suppkey, config): JSON of a configuration; ``planted``: some with something wrong."""
    K = F.col("s_suppkey")
    some = lambda test, wrong, right: F.when(test, wrong).otherwise(right) if planted else right
    trunk = (8 + 4 * (K % 3)).cast("int")
    part = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items() if v is not None])
    whole = part(
        schema_version=F.lit(1), project=part(protocol_id=F.concat(F.lit("p"), K.cast("string")), output_dir=F.concat(F.lit("/out/p"), K.cast("string"), F.lit("/plan/"))),
        paths=part(student_model=F.lit("/m/s"), teacher_model=F.lit("/m/t"), external_eval=F.array(F.lit("/d/a"), F.lit("/d/b"))), data=part(prompt_batch_size=F.lit(4)),
        rollout=part(n=some(K % 7 == 3, F.lit(1), F.lit(4)), max_prompt_length=F.lit(128), max_response_length=F.lit(512), enable_thinking=F.lit(False), seeds=part(discovery=F.lit(7), validation=F.lit(8))),
        training=part(opd_estimator=F.lit("a"), rl_estimator=some(K % 13 == 4, F.lit("token_reward_direct_plus_grpo"), F.lit("b")), counterfactual_mode=F.lit("fork_resumed_opd"), trunk_updates=trunk, branch_points=F.sequence(F.lit(0), trunk - 4, F.lit(4)), branch_horizon=F.lit(4), checkpoint_updates=some(K % 5 == 1, F.array(F.lit(4)), F.sequence(F.lit(4), trunk, F.lit(4))), checkpoint_frequency=F.lit(4), staged_trunk_initial_stop=F.when(K % 2 == 0, 4), reuse_fresh_trunk_t0=K % 2 == 0, ppo_mini_batch_size=F.lit(8), ppo_epochs=(1 + K % 2).cast("int"), validation_updates=F.when(K % 4 == 0, 3)),
        evaluation=part(primary_panel=some(K % 19 == 6, F.lit("P9"), F.lit("P1")), external_panels=F.array(F.lit("P1"), F.lit("P2")), primary_n=F.lit(4), external_n=F.lit(2), max_response_length=some(K % 11 == 5, F.lit(9), F.lit(512)), temperature=F.lit(0.7), top_p=F.lit(0.95), top_k=F.lit(-1), repetition_penalty=F.lit(1.0), seed=F.lit(1), equivalence_band=F.lit(0.01)),
        runtime=part(n_gpus_per_node=F.when(K % 17 != 2, 1) if planted else F.lit(1), rollout_gpu_memory_utilization=some(K % 23 == 8, F.lit(1.5), F.lit(0.5))),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(whole).alias("config"))


def plans(spark, sf_dir, planted: bool = False):
    return X.opened(config_texts(spark, sf_dir, planted), "s_suppkey", "config")


P = "WITH s AS (SELECT s_suppkey, 'p' || s_suppkey AS p, CAST(8 + 4 * (s_suppkey % 3) AS INTEGER) AS trunk, s_suppkey % 2 = 0 AS reuse, '/out/p' || s_suppkey AS root FROM supplier), "
RUNS = """r AS (SELECT s_suppkey, p, root, reuse, p || '_discovery_trunk_opd' AS run_id, 'discovery_trunk' AS phase, 'opd' AS arm, 0 AS start_step, trunk AS updates, CAST(NULL AS INTEGER) AS t, 7 AS seed FROM s
 UNION ALL SELECT s_suppkey, p, root, reuse, p || '_branch_t' || t || '_' || arm, 'discovery_branch', arm, CAST(t AS INTEGER), 4, CAST(t AS INTEGER), 7 FROM s, range(0, 16, 4) g(t), (VALUES ('opd'), ('rl')) a(arm) WHERE t <= trunk - 4 AND NOT (t = 0 AND arm = 'opd' AND reuse)
 UNION ALL SELECT s_suppkey, p, root, reuse, p || '_validation_always_' || arm, 'validation', arm, 0, 3, NULL, 8 FROM s, (VALUES ('opd'), ('rl')) a(arm) WHERE s_suppkey % 4 = 0),
 x AS (SELECT s_suppkey, run_id, phase, arm, CASE arm WHEN 'opd' THEN 'a' ELSE 'b' END AS estimator, start_step, updates, start_step + updates AS target_step, t AS branch_point, CASE WHEN t > 0 THEN root || '/runs/' || p || '_discovery_trunk_opd/checkpoint/global_step_' || t END AS resume_from,
 CASE WHEN t IS NULL THEN NULL WHEN arm = 'opd' THEN p || '_branch_t' || t || '_rl' WHEN t = 0 THEN p || '_discovery_trunk_opd' ELSE p || '_branch_t' || t || '_opd' END AS paired_run_id, CASE WHEN t IS NOT NULL THEN p || '_branch_t' || t END AS identity_group, CAST(seed AS BIGINT) AS rollout_seed, root || '/runs/' || run_id || '/checkpoint' AS checkpoint_dir,
 CAST(updates * 4 AS BIGINT) AS prompts, CAST(updates * 16 AS BIGINT) AS trajectories, CAST(updates * 2 * (1 + s_suppkey % 2) AS BIGINT) AS optimizer_steps, CAST(updates * 16 * 512 AS BIGINT) AS token_upper_bound FROM r) """


@query(P + RUNS + "SELECT * FROM x")
def planned_runs(spark, sf_dir):
    return X.run_table(plans(spark, sf_dir), "s_suppkey")


@query(P + RUNS + "SELECT s_suppkey, run_id FROM x WHERE phase LIKE 'discovery%'")
def discovery_runs(spark, sf_dir):
    return X.of_phase(X.run_table(plans(spark, sf_dir), "s_suppkey"), "discovery").select("s_suppkey", "run_id")


STAGES = """, y AS (SELECT x.*, p, 2 * CAST(s_suppkey % 2 = 0 AS INTEGER) AS two FROM x JOIN s USING (s_suppkey)), z AS (
 SELECT s_suppkey, run_id || '_t0_t4' AS execution_id, run_id, 'initial_t0_endpoint' AS stage, 0 AS a, 4 AS b, NULL AS resume_from, p || '_branch_t0' AS identity_group, 0 AS rank, phase, branch_point, arm FROM y WHERE phase = 'discovery_trunk' AND two = 2
 UNION ALL SELECT s_suppkey, run_id || '_t4_t' || target_step, run_id, 'post_t0_continuation', 4, target_step, checkpoint_dir || '/global_step_4', identity_group, 2, phase, branch_point, arm FROM y WHERE phase = 'discovery_trunk' AND two = 2
 UNION ALL SELECT s_suppkey, run_id, run_id, NULL, start_step, target_step, resume_from, identity_group, CASE WHEN run_id = p || '_branch_t0_rl' THEN 1 ELSE 3 END, phase, branch_point, arm FROM y WHERE NOT (phase = 'discovery_trunk' AND two = 2)) """


@query(P + RUNS + STAGES + "SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, phase = 'validation', branch_point NULLS FIRST, arm) - 1 AS place, execution_id, run_id AS scientific_run_id, stage, a AS start_step, b AS target_step, resume_from, identity_group FROM z")
def staged_runs(spark, sf_dir):
    every = plans(spark, sf_dir)
    return X.stage_table(X.run_table(every, "s_suppkey"), every, "s_suppkey").withColumn("place", F.col("place").cast("long"))


@query(P + RUNS + STAGES + "SELECT w.id, CASE WHEN z.execution_id IS NOT NULL THEN 0 WHEN x.run_id IS NOT NULL THEN 1 END AS source, coalesce(z.b, x.target_step) AS target_step FROM (SELECT unnest([p || '_discovery_trunk_opd_t0_t4', p || '_branch_t4_rl', p || '_discovery_trunk_opd']) AS id FROM s) w LEFT JOIN z ON z.execution_id = w.id LEFT JOIN x ON x.run_id = w.id")
def found_specs(spark, sf_dir):
    every = plans(spark, sf_dir)
    runs = X.run_table(every, "s_suppkey")
    p = F.col("protocol_id")
    wanted = every.select(F.explode(F.array(F.concat(p, F.lit("_discovery_trunk_opd_t0_t4")), F.concat(p, F.lit("_branch_t4_rl")), F.concat(p, F.lit("_discovery_trunk_opd")))).alias("id"))
    return X.first_specs(wanted, "id", X.stage_table(runs, every, "s_suppkey"), runs).select("id", "source", F.get_json_object("spec", "$.target_step").cast("int").alias("target_step"))


COMPARED = "c AS (SELECT s_suppkey, p, root, trunk, CAST(t AS INTEGER) AS t, CASE WHEN t = 0 THEN p || '_trunk_opd_t4' ELSE p || '_branch_t' || t || '_opd_t' || (t + 4) END AS o, p || '_branch_t' || t || '_rl_t' || (t + 4) AS g FROM s, range(0, 16, 4) r(t) WHERE t <= trunk - 4) "


@query(P + COMPARED + "SELECT s_suppkey, t AS branch_point, 4 AS horizon, t + 4 AS target_step, o AS opd_model_id, g AS rl_model_id FROM c")
def planned_comparisons(spark, sf_dir):
    return X.comparison_table(plans(spark, sf_dir), "s_suppkey")


PROTOCOL = """'{"enable_thinking":false,"max_model_len":640,"max_prompt_length":128,"max_tokens":512,"n":' || n || ',"repetition_penalty":1,"seed":1,"temperature":0.7,"top_k":-1,"top_p":0.95,"verifier":{"format_field":"format_score","function":"compute_score","label":"configured-verifier","module":"verl.utils.reward_score.ttrl_math","score_field":"score","source_sha256":"v"}}'"""


@query(P + COMPARED + f""", m AS (SELECT s_suppkey, root, 'student_base' AS m, '/m/s' AS path, false AS last FROM s UNION ALL SELECT s_suppkey, root, 'teacher_reference', '/m/t', false FROM s UNION ALL SELECT s_suppkey, root, unnest([o, g]) AS m, root || '/merged/' || unnest([o, g]), t = trunk - 4 FROM c),
 e AS (SELECT s_suppkey, root, m, path, 'P1' AS panel, '/d/a' AS dataset, 4 AS n FROM m UNION ALL SELECT s_suppkey, root, m, path, 'P2', '/d/b', 2 FROM m WHERE last)
 SELECT s_suppkey, m || '__' || lower(panel) AS eval_id, m AS model_id, panel, path AS model_path, dataset, n, root || '/evaluations/' || m || '__' || lower(panel) AS output_dir, sha256({PROTOCOL}) AS evaluation_protocol_sha256 FROM e""")
def planned_evaluations(spark, sf_dir):
    return X.evaluation_table(plans(spark, sf_dir), "s_suppkey", "v").drop("evaluation_protocol")


@query(P + COMPARED + """, m AS (SELECT s_suppkey, root, CASE WHEN t = 0 THEN p || '_discovery_trunk_opd' ELSE p || '_branch_t' || t || '_opd' END AS run, o AS m, t FROM c UNION ALL SELECT s_suppkey, root, p || '_branch_t' || t || '_rl', g, t FROM c)
 SELECT s_suppkey, m AS model_id, 'python -m verl.model_merger merge --backend fsdp --local_dir ' || root || '/runs/' || run || '/checkpoint/global_step_' || (t + 4) || '/actor --target_dir ' || root || '/merged/' || m || ' --use_cpu_initialization' AS shell FROM m""")
def merge_commands(spark, sf_dir):
    return X.merge_commands(X.model_table(plans(spark, sf_dir), "s_suppkey"), "s_suppkey").drop("argv")


@query("""SELECT s_suppkey, 'python -m trainer ' || chr(39) || 'data.file=' || replace(s_name, 'Supplier', 'the "file"') || chr(39) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' trainer.steps=' || s_suppkey END || ' trainer.resume=' || CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS shell FROM supplier""")
def launch_commands(spark, sf_dir):
    K = F.col("s_suppkey")
    settings = {"data.file": F.replace("s_name", F.lit("Supplier"), F.lit('the "file"')), "trainer.steps": F.when(K % 3 != 0, K)}
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.shell(X.settings_argv("trainer", settings, {"trainer.resume": K % 2 == 0})).alias("shell"))


@query(P + """w AS (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 17 = 2 THEN [{'rule': 'missing', 'detail': 'runtime.n_gpus_per_node'}] ELSE list_filter([
 CASE WHEN s_suppkey % 7 = 3 THEN {'rule': 'samples', 'detail': '1'} END, CASE WHEN s_suppkey % 11 = 5 THEN {'rule': 'caps of training and evaluation', 'detail': '9'} END, CASE WHEN s_suppkey % 13 = 4 THEN {'rule': 'forbidden estimator', 'detail': 'token_reward_direct_plus_grpo'} END,
 CASE WHEN s_suppkey % 7 = 3 THEN {'rule': 'mini-batch', 'detail': '8'} END, CASE WHEN s_suppkey % 19 = 6 THEN {'rule': 'primary panel', 'detail': 'P9'} END, CASE WHEN s_suppkey % 23 = 8 THEN {'rule': 'memory share', 'detail': '1.5'} END,
 CASE WHEN s_suppkey % 5 = 1 AND trunk > 8 THEN {'rule': 'branch point without checkpoint', 'detail': CASE trunk WHEN 12 THEN '[8]' ELSE '[8,12]' END} END], lambda x: x IS NOT NULL) END) AS u FROM s) SELECT s_suppkey, u.rule AS rule, u.detail AS detail FROM w""")
def config_errors(spark, sf_dir):
    return X.config_violations(plans(spark, sf_dir, planted=True), "s_suppkey")


@query("SELECT s_suppkey, round(CAST(8 + 4 * (s_suppkey % 3) + 8 * (2 + s_suppkey % 3) AS DOUBLE), 6) AS discovery_updates, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 6 ELSE 0 END AS DOUBLE) AS planned_validation_updates, CAST(8 + 4 * (s_suppkey % 3) + 8 * (2 + s_suppkey % 3) + CASE WHEN s_suppkey % 4 = 0 THEN 6 ELSE 0 END AS DOUBLE) AS total_updates, round((8 + 4 * (s_suppkey % 3) + 8 * (2 + s_suppkey % 3) + CASE WHEN s_suppkey % 4 = 0 THEN 6 ELSE 0 END) * 90 / 3600.0::DOUBLE, 6) AS core_gpu_hours, round((8 + 4 * (s_suppkey % 3) + 8 * (2 + s_suppkey % 3) + CASE WHEN s_suppkey % 4 = 0 THEN 6 ELSE 0 END) * 90 / 3600.0::DOUBLE * 1.25, 6) AS gpu_hours_with_overhead FROM supplier")
def budget_projection(spark, sf_dir):
    found = X.budget_projection(plans(spark, sf_dir), F.lit(90.0), F.lit(2))
    return rounded(found.select("s_suppkey", "discovery_updates", "planned_validation_updates", "total_updates", "core_gpu_hours", "gpu_hours_with_overhead"))


def fragments(spark, sf_dir):
    """Three fragments of a configuration for each supplier; every fifth has an object against a plain value."""
    K, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    text = lambda i, j: F.struct(F.lit(i).alias("part"), j.alias("json"))
    k = K.cast("string")
    first = F.concat(F.lit('{"a":{"b":1,"c":{"d":0},"e":3},"f":{},"h":'), k, F.lit("}"))
    second = F.concat(F.lit('{"a":{"c":{"d":['), k, F.lit(',2]}},"g":"y"}'))
    third = F.when(K % 5 == 0, F.lit('{"a":{"e":{"x":1}},"h":null}')).otherwise(F.lit('{"a":{"e":4},"g":"x","f":{}}'))
    return rows.select("s_suppkey", F.inline(F.array(text(0, first), text(1, second), text(2, third))))


@query("""SELECT s_suppkey, path, value FROM (SELECT s_suppkey, unnest([{'path': 'a.b', 'value': '1'}, {'path': 'a.c.d', 'value': '[' || s_suppkey || ',2]'}, {'path': 'f', 'value': '{}'}, {'path': 'a.e', 'value': CASE WHEN s_suppkey % 5 = 0 THEN '3' ELSE '4' END}, {'path': 'g', 'value': CASE WHEN s_suppkey % 5 = 0 THEN '"y"' ELSE '"x"' END},
 {'path': 'h', 'value': CASE WHEN s_suppkey % 5 = 0 THEN 'null' ELSE CAST(s_suppkey AS VARCHAR) END}, {'path': CASE WHEN s_suppkey % 5 = 0 THEN 'a.e.x' END, 'value': '1'}], recursive := true) FROM supplier) WHERE path IS NOT NULL""")
def merged_config(spark, sf_dir):
    return X.merged_leaves(fragments(spark, sf_dir), "s_suppkey", "part", "json")


@query("SELECT s_suppkey, 'a.e' AS path FROM supplier WHERE s_suppkey % 5 = 0")
def merge_clashes(spark, sf_dir):
    return X.merge_clashes(fragments(spark, sf_dir), "s_suppkey", "part", "json")


@query("SELECT s_suppkey, '{\"owner\":{\"name\":\"' || s_name || '\",\"points\":[0,' || s_suppkey || ']},\"schema_version\":' || CASE WHEN s_suppkey % 6 = 5 THEN 2 ELSE 1 END || '}' AS config FROM supplier")
def config_files(spark, sf_dir):
    K = F.col("s_suppkey")
    folder = f"{shared_root(spark)}/configs_{uuid.uuid4().hex}"
    text = F.concat(F.lit("# made by a plan\nschema_version: "), F.when(K % 6 == 5, "2").otherwise("1"), F.lit("\nowner:\n  points: [0, "), K.cast("string"), F.lit("]\n  name: "), "s_name", F.lit("\n"))
    sinks.write_documents(table(spark, sf_dir, "supplier").select(F.concat(K.cast("string"), F.lit(".yaml")).alias("path"), text.alias("text")), folder, "path", "text")
    return files.read_configs(spark, folder).select(F.regexp_extract("path", "/([0-9]+)[.]yaml$", 1).cast("long").alias("s_suppkey"), "config")
