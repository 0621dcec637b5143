"""Audit engine: catalogue against DuckDB, and small cases of validation, splits, queues, surfaces, sources, streams."""

import glob
import hashlib
import json
import math

import duckdb
import pytest
from pairlens.functions import scalars
from pairlens.operators import audit, digests, identity, places, protocol, quantiles, records, surface
from pairlens.plans import catalogue_experiments, catalogue_models, catalogue_records, catalogue_sources, catalogue_surface, experiments, registry  # noqa: F401
from pairlens.sources import files, locks, sinks
from pairlens.streaming import steps
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
ROWS = "step int, input string, gts string, output string, score double, token_rewards array<double>, response_length long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {path.split('/')[-1][:-8]} as select * from read_parquet('{path}')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "~" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_catalogue_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.columns, got.collect()) == plain(columns, want.fetchall())


def rollouts(spark):
    lengths, scores = [2, 4, 4, 6, 2, 4, 6, 8], [-4.0, -4, -8, -6, -2, -8, -12, -8]
    rows = [(1, "ab"[k // 4], "x", "\\boxed{1}" if k == 1 else "no", float(scores[k]), [0.0, float(k == 1)], lengths[k]) for k in range(8)]
    return spark.createDataFrame(rows, ROWS)


def test_audit_of_two_groups(spark):
    rows = audit.resolve(rollouts(spark))
    audit.check(rows, 4)
    total = audit.audit(rows, 8).where("step is null").first()
    assert (total.n_rows, total.n_groups, total.pass_rate, total.all_fail_rate, total.mixed_rate) == (8, 2, 0.125, 0.5, 0.5)
    assert (total.mean_length, total.cap_rate, total.boxed_rate, total.zero_contrast_rate) == (4.5, 0.125, 0.125, 0.5)
    assert [r.n_groups for r in audit.success_histogram(rows, 4).orderBy("successes").collect()] == [1, 1, 0, 0, 0]
    same = audit.resolve(rollouts(spark).withColumn("score", F.lit(0.1)))
    assert audit.audit(same, 8).where("step is null").first().raw_score_length_pearson is None


def test_audit_rejects(spark):
    with pytest.raises(ValueError, match="group size"):
        audit.check(audit.resolve(rollouts(spark).limit(3)), 4)
    with pytest.raises(ValueError, match="no finite outcome"):
        audit.check(audit.resolve(rollouts(spark).withColumn("token_rewards", F.array(F.lit(0.0), F.lit(math.nan)))), 4)
    with pytest.raises(ValueError, match="outcomes disagree"):
        audit.check(audit.resolve(rollouts(spark).withColumn("scalar_reward", F.lit(0.5))), 4)
    with pytest.raises(ValueError, match="length not positive"):
        audit.check(audit.resolve(rollouts(spark).drop("response_length")), 4)


def test_lengths_prefer_the_first_field_for_the_whole_dataset(spark):
    both = rollouts(spark).withColumn("response_token_count", F.lit(7).cast("long"))
    assert audit.resolve(both).agg(F.avg("length")).first()[0] == 4.5
    part = both.withColumn("response_length", F.when(F.col("input") == "a", F.col("response_length")))
    assert audit.resolve(part).agg(F.avg("length")).first()[0] == 7


def test_dedup_split_queue(spark):
    rows = spark.createDataFrame([(0, "A", "1"), (1, "A", "1"), (2, "B", "x"), (3, "B", "y"), (4, "C", "1")], "k long, pid string, ans string")
    assert sorted(r.first_row for r in protocol.retained(rows, "pid", "ans", "k").collect()) == [0, 4]
    one = protocol.dedup_audit(rows, "pid", "ans", "k").first()
    assert (one.n_duplicates, one.n_conflict_groups, one.n_conflict_rows) == (1, 1, 2)
    ids = spark.range(40).select(F.col("id").cast("string").alias("pid"))
    cut = protocol.split(ids, "pid", {"signal": 5, "eval": 7}, 11)
    assert {r["split"]: r["count"] for r in cut.groupBy("split").count().collect()} == {"signal": 5, "eval": 7, "train_trunk": 28}
    assert protocol.leakage(cut, "pid").isEmpty() and not protocol.leakage(cut.union(cut), "pid").isEmpty()
    queue = protocol.prompt_queue(ids.limit(20), "pid", 20, 10, 3, 2)
    assert queue.count() == 30 and {r.update for r in protocol.branch_window(queue, 4, 3).collect()} == {4, 5, 6}
    assert protocol.prompt_queue(ids.limit(2), "pid", 2, 3, 5, 2).count() == 6


def test_labels_and_mismatches(spark):
    rows = spark.createDataFrame([(0.51, 0.50, 0.02), (0.6, 0.5, 0.02), (0.4, 0.5, 0.02), (0.51, 0.50, 0.01)], "rl double, opd double, band double")
    got = [r[0] for r in rows.select(scalars.branch_label(F.col("rl"), F.col("opd"), F.lit(0.02))).collect()]
    assert got == ["indistinguishable", "rl", "opd", "indistinguishable"]
    assert rows.select(scalars.branch_label(F.col("rl"), F.col("opd"), F.lit(0.01))).collect()[3][0] == "rl"
    pair = lambda a, b: spark.createDataFrame([(1, a, b)], "k long, seed long, hash string")
    assert surface.mismatches(pair(1, None), pair(2, None), "k", ["seed", "hash"]).first().fields == "seed"


def test_nested_signals(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 1, "c": true, "d": "x"}, "e": [1], "f": null, "g": 0.5}'), (2, None), (3, "[1]")], "k long, j string")
    assert sorted((r.name, r.value) for r in surface.flatten_signals(rows, "k", "j").collect()) == [("signal_a_b", 1.0), ("signal_a_c", 1.0), ("signal_g", 0.5)]


def test_nested_signals_of_many_rows_and_levels(spark):
    many = spark.range(600_000).selectExpr("id k", """'{"k": 1}' j""")
    got = surface.flatten_signals(many, "k", "j")
    assert got.count() == got.select("k").distinct().count() == 600_000
    deep = spark.createDataFrame([(1, '{"a":' * 110 + "2" + "}" * 110)], "k long, j string")
    assert [(r.name, r.value) for r in surface.flatten_signals(deep, "k", "j").collect()] == [("signal" + "_a" * 110, 2.0)]


def test_steps_written_by_several_tasks(spark, tmp_path, monkeypatch):
    kept = {}
    monkeypatch.setattr(sinks, "stored", lambda df, label, real=sinks.stored: kept.setdefault(label, real(df, label)))
    rows = spark.range(20_000).selectExpr("cast(id % 2 as int) step", "named_struct('q', (id * 7919) % 5000) input", "id * 0.5 score", "if(id % 3 = 0, null, 'é') output")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = {r.path: r for r in sinks.write_steps(rows, str(tmp_path / "steps"), "step", ["input", "score"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept["parts"].groupBy("name").count().where("count > 1").count() > 0  # no task holds all of such a step
    assert sorted(p.name for p in (tmp_path / "steps").iterdir()) == ["0.jsonl", "1.jsonl"] and [p.name for p in tmp_path.iterdir()] == ["steps"]
    for step in range(2):
        raw = (tmp_path / "steps" / f"{step}.jsonl").read_bytes()
        want = sorted(((i * 7919) % 5000, i * 0.5, i) for i in range(step, 20_000, 2))
        lines = [json.loads(x) for x in raw.decode().split("\n")[:-1]]
        assert lines == [{"step": step, "input": {"q": q}, "score": x} | ({"output": "é"} if i % 3 else {}) for q, x, i in want]
        assert (written[f"{step}.jsonl"].bytes, written[f"{step}.jsonl"].sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    with pytest.raises(Exception, match="no step"):
        sinks.write_steps(rows.selectExpr("nullif(step, 1) step", "score"), str(tmp_path / "null"), "step", ["score"])


def test_sources_sinks_and_stream(spark, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    for step in (1, 2, 10):
        lines = [json.dumps({"step": step, "input": {"q": "a"}, "gts": 1, "output": "o", "score": k, "verifier_reward": float(k == 0), "response_length": 3}) for k in range(4)]
        (folder / f"{step}.jsonl").write_text("\n\n".join(lines) + "\n")
    rows = files.read_rollouts(spark, str(folder))
    assert [r.file_number for r in rows.select("file_number").distinct().orderBy("file_number").collect()] == [1, 2, 10]
    total = audit.audit(audit.resolve(rows), 8).where("step is null")
    assert json.loads(sinks.report(total))["n_groups"] == 3
    for text, line in (("{broken\n", 1), ('{"step": 1, "output": null}\n\n{broken\n', 3)):
        (folder / "3.jsonl").write_text(text)
        with pytest.raises(Exception, match=f"invalid JSON in .*3.jsonl:{line}"):
            files.read_rollouts(spark, str(folder)).count()
    (folder / "3.jsonl").write_text('{"score": "high"}\n')
    with pytest.raises(Exception, match="no rollout in .*3.jsonl:1"):
        files.read_rollouts(spark, str(folder)).count()
    (folder / "3.jsonl").write_text('{"step": 1, "output": null, "input": null, "gts": {"b": 1.5, "a": "\u00e9"}, "x": 0}\n')
    flags = files.read_rollouts(spark, str(folder)).where("file_number = 3").first()
    assert flags.has_output and flags.output is None and not flags.has_score and flags.line == 1
    assert (flags.input, flags.gts) == ("null", '{"a":"é","b":1.5}')
    assert [r.file for r in files.in_file_order(files.read_rollouts(spark, folder.as_uri()).select("file", "file_number").distinct()).collect()] == ["1.jsonl", "2.jsonl", "3.jsonl", "10.jsonl"]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no rollout files"):
        files.read_rollouts(spark, str(tmp_path / "none")).count()
    assert files.tree(spark, str(folder)).count() == 4
    sinks.write_csv([spark.range(1).toDF("id"), spark.range(1).toDF("id").withColumn("b", F.lit(2))], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "b"]


def run_stream(spark, path, name):
    steps.audit_stream(spark, str(path / "in"), str(path / name), str(path / f"{name}_check"), f"{ROWS}, response_token_count long", 4, 8).awaitTermination(120)
    return steps.stream_audit(spark, str(path / name))


def test_stream_of_steps(spark, tmp_path):
    for step in (1, 2):
        rollouts(spark).withColumn("step", F.lit(step)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    done = run_stream(spark, tmp_path, "out")
    assert sorted(r.step for r in done.collect()) == [1, 2]


def test_stream_decides_as_the_dataset_does(spark, tmp_path):
    """The second file lacks the field that the first one has, the third has it again."""
    both = rollouts(spark).withColumn("response_token_count", F.lit(7).cast("long"))
    for step in (1, 2, 3):
        rows = both.withColumn("step", F.lit(step))
        (rows.drop("response_length") if step == 2 else rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = run_stream(spark, tmp_path, "out").orderBy("step").collect()
    whole = audit.audit(audit.resolve(spark.read.schema(f"{ROWS}, response_token_count long").json(str(tmp_path / "in"))), 8)
    assert got == whole.where("step is not null").select(*got[0].__fields__).orderBy("step").collect()
    assert [r.mean_length for r in got] == [7, 7, 7]
    rollouts(spark).withColumn("step", F.lit(4)).drop("token_rewards").withColumn("scalar_reward", F.lit(1.0)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="mixed dialects"):
        run_stream(spark, tmp_path, "out")


def digest(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def config(**changes):
    """A small valid configuration, with dotted keys (dots as two underscores) changed."""
    made = {
        "schema_version": 1, "project": {"protocol_id": "demo_1", "output_dir": "/out/demo/plan"},
        "paths": {"student_model": "/m/s", "teacher_model": "/m/t", "external_eval": ["/d/a", "/d/b"]},
        "data": {"prompt_batch_size": 4}, "rollout": {"n": 4, "max_prompt_length": 128, "max_response_length": 512, "enable_thinking": False, "seeds": {"discovery": 7, "validation": 8}},
        "training": {"opd_estimator": "a", "rl_estimator": "b", "trunk_updates": 12, "branch_points": [0, 4, 8], "branch_horizon": 4, "checkpoint_updates": [4, 8, 12], "checkpoint_frequency": 4, "staged_trunk_initial_stop": 4, "counterfactual_mode": "fork_resumed_opd", "reuse_fresh_trunk_t0": True, "ppo_mini_batch_size": 8, "validation_updates": 3},
        "evaluation": {"primary_panel": "P1", "external_panels": ["P1", "P2"], "primary_n": 4, "external_n": 2, "max_response_length": 512, "temperature": 0.7, "top_p": 0.95, "top_k": -1, "repetition_penalty": 1.0, "seed": 1, "equivalence_band": 0.01},
        "runtime": {"n_gpus_per_node": 1, "rollout_gpu_memory_utilization": 0.5},
    }
    for key, value in changes.items():
        at, names = made, key.split("__")
        for name in names[:-1]:
            at = at[name]
        at[names[-1]] = value
    return made


def plans(spark, *configs):
    return experiments.opened(spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(configs)], "k int, c string"), "k", "c")


def test_planned_runs_and_stages(spark):
    one = plans(spark, config(), config(training__reuse_fresh_trunk_t0=False, training__staged_trunk_initial_stop=None, training__validation_updates=None))
    runs = experiments.run_table(one, "k")
    named = lambda k: sorted(r.run_id for r in runs.where(F.col("k") == k).collect())
    discovery = ["branch_t0_rl", "branch_t4_opd", "branch_t4_rl", "branch_t8_opd", "branch_t8_rl", "discovery_trunk_opd"]
    assert named(0) == [f"demo_1_{x}" for x in (*discovery, "validation_always_opd", "validation_always_rl")]
    assert named(1) == sorted(f"demo_1_{x}" for x in (*discovery, "branch_t0_opd"))
    first = runs.where("k = 0 and run_id = 'demo_1_branch_t0_rl'").first()
    assert (first.paired_run_id, first.resume_from, first.token_upper_bound, first.optimizer_steps) == ("demo_1_discovery_trunk_opd", None, 4 * 16 * 512, 8)
    assert experiments.of_phase(runs, "validation").count() == 2 and experiments.of_phase(runs, "all").count() == 15
    with pytest.raises(ValueError):
        experiments.of_phase(runs, "other")
    stages = experiments.stage_table(runs, one, "k").where("k = 0").orderBy("place").collect()
    assert [s.execution_id for s in stages[:4]] == ["demo_1_discovery_trunk_opd_t0_t4", "demo_1_branch_t0_rl", "demo_1_discovery_trunk_opd_t4_t12", "demo_1_branch_t4_opd"]
    assert stages[2].resume_from == "/out/demo/runs/demo_1_discovery_trunk_opd/checkpoint/global_step_4" and stages[0].identity_group == "demo_1_branch_t0"


def test_planned_evaluations(spark):
    one = plans(spark, config(training__branch_points=[0, 7], training__branch_horizon=5))
    assert [r.target_step for r in experiments.comparison_table(one, "k").orderBy("branch_point").collect()] == [5, 12]
    made = experiments.evaluation_table(one, "k", "3").collect()
    assert sorted(r.model_id for r in made if r.panel == "P2") == ["demo_1_branch_t7_opd_t12", "demo_1_branch_t7_rl_t12"]
    assert len(made) == 8 and all(json.loads(r.evaluation_protocol)["max_model_len"] == 640 and r.evaluation_protocol_sha256 == hashlib.sha256(r.evaluation_protocol.encode()).hexdigest() for r in made)
    assert experiments.merge_commands(experiments.model_table(one, "k"), "k").count() == 4
    assert experiments.budget_projection(one, F.lit(60.0), F.lit(2)).first().total_updates == 12 + 2 * 2 * 5 + 6


WRONG = {
    "endpoint beyond the trunk": {"training__branch_horizon": 5}, "branch point without checkpoint": {"training__branch_points": [0, 6]}, "samples": {"rollout__n": 1}, "caps of training and evaluation": {"evaluation__max_response_length": 9},
    "one estimator for both arms": {"training__rl_estimator": "a"}, "forbidden estimator": {"training__forbidden_estimators": ["a"]}, "primary panel": {"evaluation__primary_panel": "P9"}, "memory share": {"runtime__rollout_gpu_memory_utilization": 1.5},
    "order of branch points": {"training__branch_points": [4, 4]}, "panels and datasets": {"evaluation__external_panels": ["P1"]}, "mini-batch": {"training__ppo_mini_batch_size": 7}, "protocol id": {"project__protocol_id": "a/b"}, "counterfactual mode": {"training__counterfactual_mode": "x"},
    "first stage": {"training__staged_trunk_initial_stop": 8}, "endpoint between checkpoints": {"training__checkpoint_frequency": 3}, "context": {"runtime__max_model_len": 1}, "schema": {"schema_version": 2}, "missing": {"data__prompt_batch_size": None}, "no branch point": {"training__branch_points": []}, "band": {"evaluation__equivalence_band": -1.0},
}


def test_rules_of_configurations(spark):
    every = plans(spark, config(), *[config(**change) for change in WRONG.values()])
    got: dict = {}
    for r in experiments.config_violations(every, "k").collect():
        got.setdefault(r.k, {})[r.rule] = r.detail
    assert sorted(got) == list(range(1, len(WRONG) + 1))
    for k, rule in enumerate(WRONG, 1):
        assert rule in got[k]
        if rule == "missing":
            assert got[k] == {"missing": "data.prompt_batch_size"}
    experiments.check_configs(plans(spark, config()), "k")
    with pytest.raises(ValueError, match="0: samples 1"):
        experiments.check_configs(plans(spark, config(rollout__n=1)), "k")


def test_commands(spark):
    import shlex

    argv = ["python", "a b", "it's", "x=1", ""]
    assert spark.createDataFrame([(argv,)], "a array<string>").select(experiments.shell(F.col("a"))).first()[0] == shlex.join(argv)


SUMMARY = "folder string, model_id string, panel string, model_identity_sha256 string, evaluation_protocol_sha256 string, temperature double, seed long, avg_at_n double"


def endpoints(spark, **changes):
    """(comparisons, specifications, summaries) of two points; ``changes`` of summaries by model and field."""
    sha = "a" * 64
    points = spark.createDataFrame([(20, "o20", "r20"), (0, "o0", "r0")], "branch_point int, opd_model_id string, rl_model_id string")
    plan = spark.createDataFrame([(m, "main", f"ev/{m}", '{"temperature": 0.7}') for m in ("o0", "r0", "o20", "r20")], "model_id string, panel string, output_dir string, evaluation_protocol string")
    scores = {"o0": 0.42, "r0": 0.38, "o20": 0.51, "r20": 0.58}
    rows = []
    for m, score in scores.items():
        row = {"folder": f"/x/ev/{m}", "model_id": m, "panel": "main", "model_identity_sha256": sha, "evaluation_protocol_sha256": sha, "temperature": 0.7, "seed": 1, "avg_at_n": score}
        rows.append(tuple((row | changes.get(m, {})).values()))
    return points, plan, surface.attach_summaries(plan, spark.createDataFrame(rows, SUMMARY), "/x")


def test_surface_of_two_points(spark, tmp_path):
    points, plan, held = endpoints(spark)
    surface.check_surface(points, plan, held, "avg_at_n")
    signals = spark.createDataFrame([("20", "signal_a_b", 0.5)], "branch_point string, name string, value double")
    table = surface.full_surface(points, held, "main", "avg_at_n", 0.01, signals=signals)
    got = table.collect()
    assert [(r.branch_point, round(r.grpo_minus_opd, 6), r.preferred_arm) for r in got] == [(0, -0.04, "opd"), (20, 0.07, "rl")]
    assert got[0].signals is None and got[1].signals == {"signal_a_b": 0.5}
    names = sinks.write_surface(table, str(tmp_path), "main", "avg_at_n", 0.01)
    written = json.loads(open(names["json"]).read())
    assert written["schema_version"] == 2 and "signal_a_b" not in written["rows"][0] and written["rows"][1]["signal_a_b"] == 0.5
    assert open(names["csv"]).readline().strip().endswith(",signal_a_b")


@pytest.mark.parametrize(("change", "named"), [({"r20": {"seed": 2}}, "seed"), ({"r0": {"model_id": "o0"}}, "model_id"), ({"o0": {"temperature": 0.1}}, "temperature"), ({"o0": {"temperature": 0.1}, "r0": {"temperature": 0.1}}, "temperature"), ({"o0": {"evaluation_protocol_sha256": "short"}}, "malformed"), ({"o0": {"panel": "x"}}, "panel"), ({"o20": {"folder": "/y"}}, "summary"), ({"o20": {"avg_at_n": None}}, "avg_at_n is absent")])
def test_surface_rejects(spark, change, named):
    points, plan, held = endpoints(spark, **change)
    with pytest.raises(ValueError, match=named):
        surface.check_surface(points, plan, held, "avg_at_n")


def test_surface_needs_both_specifications(spark):
    points, plan, held = endpoints(spark)
    with pytest.raises(ValueError, match="rl specification"):
        surface.check_surface(points, plan, held.where("model_id <> 'r0'"), "avg_at_n")
    with pytest.raises(ValueError, match="specified 2 times"):
        surface.check_surface(points, plan.union(plan.limit(1)), held, "avg_at_n")
    with pytest.raises(ValueError, match="no comparisons"):
        surface.check_surface(points.limit(0), plan, held, "avg_at_n")
    with pytest.raises(ValueError, match="band"):
        surface.full_surface(points, held, "main", "avg_at_n", -1.0)


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=5001), "b": np.repeat([1.0, 2.0], [3, 9]), "c": np.array([7.5])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), (None, 3.0)], "k string, x double")
    got = {(r.k, r.level): r.value for r in quantiles.exact_quantiles(rows, ["k"], {"x": F.col("x")}, [0.0, 0.05, 0.5, 0.99, 1.0]).collect()}
    for k, v in values.items():
        for q in (0.0, 0.05, 0.5, 0.99, 1.0):
            assert got[k, q] == pytest.approx(np.quantile(v, q), abs=1e-12)
    assert got[None, 0.5] == 3.0


def test_audit_by_file_and_dialects(spark):
    rows = audit.resolve(rollouts(spark).withColumn("file", F.lit("1.jsonl")))
    total = audit.audit(rows, 8, "file", lengths_exact=False).where("file is null").first()
    assert (total.steps, total.padded_widths, total.unique_input_count, total.length_exact, total.n_correct) == ([1], [2], 2, False, 1)
    assert audit.spanning_groups(rows, "file").isEmpty()
    assert not audit.spanning_groups(rows.withColumn("file", F.col("score").cast("string")), "file").isEmpty()
    scalar = audit.resolve(rollouts(spark).drop("token_rewards").withColumn("scalar_reward", F.lit(1.0)))
    audit.check(scalar, 4)
    plain = audit.audit(scalar, 8).where("step is null").first()
    assert plain.mean_score is None and plain.p50_score_per_token is None and plain.p50_length is not None
    assert audit.outcome_source(scalar).first().outcome_source == "verifier_reward"
    assert audit.outcome_source(rows).first().outcome_source == "true_reward_score"
    supplied = audit.resolve(rollouts(spark).withColumn("mine", F.lit(2)), supplied="mine")
    assert supplied.agg(F.avg("length")).first()[0] == 2
    with pytest.raises(ValueError, match="mixed dialects"):
        audit.check(audit.resolve(rollouts(spark).withColumn("token_rewards", F.when(F.col("response_length") > 2, F.col("token_rewards"))).withColumn("scalar_reward", F.col("token_rewards")[1])), 4)
    for n, cap in ((1, 8), (4, 0)):
        with pytest.raises(ValueError):
            audit.check(rows, n, cap)
    with pytest.raises(ValueError, match="no rows"):
        audit.check(rows.limit(0), 4)


def test_messages(spark):
    rows = spark.createDataFrame([(1, '[{"role": " user ", "content": " a \\u001c b\\u3000"}]'), (2, "[{'role': 'user', 'content': 'a b'}]"), (3, "[]"), (4, "no list"), (5, '[{"role": "", "content": "x"}]'), (6, None), (7, '["a"]'), (8, '{"role": "user"}')], "k long, p string")
    ids = {r.k: r.i for r in rows.select("k", scalars.messages_id(scalars.parse_messages(F.col("p"))).alias("i")).collect()}
    assert ids[1] == ids[2] == digest({"prompt": [{"role": "user", "content": "a b"}]})
    assert all(ids[k] is None for k in range(3, 9))


def test_lengths_of_rendered_prompts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([(1, [("user", "a b a")]), (2, [("system", "b"), ("user", "a")])], "k long, m array<struct<role:string,content:string>>")
    shown = rows.withColumn("text", records.rendered(F.col("m"), "<", ">"))
    assert shown.where("k = 1").first().text == "<user\na b a>\n<assistant\n"
    sized = records.token_lengths(shown, "text", str(tmp_path / "t.json"))
    assert sorted((r.k, r.n_tokens) for r in sized.collect()) == [(1, 5), (2, 5)]
    assert protocol.length_audit(sized, "n_tokens", 4).first().n_overlong == 2 and protocol.length_filter(sized, "n_tokens", 5).count() == 2


def test_mapping_of_records(spark):
    source = spark.createDataFrame([("What?", "4", 3, "i1")], "prompt string, answer string, level int, id string")
    made = records.native_records(records.numbered(source), "_index")
    assert records.mapping_drift(made, made).isEmpty()
    other = made.withColumn("prompt", F.transform("prompt", lambda m: m.withField("content", F.lit("changed"))))
    assert [(r.row, r.fields) for r in records.mapping_drift(made, other).collect()] == [(0, "prompt")]
    assert records.column_drift(made.drop("_index")) == [] and records.column_drift(made)
    with pytest.raises(ValueError, match="answer"):
        records.native_records(source.drop("answer"), "level")
    many = records.numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0"))
    assert [r._index for r in many.orderBy("id").collect()] == list(range(334))


def test_identities(spark):
    rows = spark.createDataFrame([(1, "g", 5, *["a" * 64] * 7, 42), (2, "g", 5, *["a" * 64] * 7, 43), (3, None, 5, *["b" * 64] * 6, "x", 42)], "k long, grp string, global_step long, " + ", ".join(f"{f} string" for f in identity.DIGESTS) + ", rollout_seed long")
    assert [(r.k, r.fields) for r in identity.lock_violations(rows, "grp", "k", "k").collect()] == [(2, "rollout_seed")]
    assert [(r.k, r.field) for r in identity.identity_violations(rows, "k").collect()] == [(3, "trainer_state_hash")]
    same = identity.with_identity(rows).where("k = 1").first()
    assert same.identity_sha256 == digest({f: same[f] for f in (*identity.NUMBERS, *identity.DIGESTS)})


def test_files_of_models_and_checkpoints(spark, tmp_path):
    folder = tmp_path / "model"
    (folder / "sub").mkdir(parents=True)
    for name in ("config.json", "tokenizer.json", "w.safetensors", "w.partial.json", "sub/a.json", "identity.json"):
        (folder / name).write_text(name)
    (folder / "big.txt").write_bytes(b"x" * (files.PIECE + 1))
    got = {r.path: (r.bytes, r.sha256) for r in files.model_folder(spark, str(folder)).collect()}
    assert sorted(got) == ["big.txt", "config.json", "tokenizer.json", "w.safetensors"]
    assert got["big.txt"] == (files.PIECE + 1, hashlib.sha256(b"x" * (files.PIECE + 1)).hexdigest())
    listed = {p: {"bytes": b, "sha256": s} for p, (b, s) in got.items()}
    made = identity.digest_of_set(files.model_folder(spark, str(folder)).withColumn("m", F.lit(1)), ["m"], "path", "bytes", "sha256").first().digest
    assert made == digest(listed)
    (folder / "config.json").unlink()
    with pytest.raises(ValueError, match="config.json"):
        files.model_folder(spark, str(folder))
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\rc")
    assert files.normalized_text_hash(spark, str(tmp_path / "t.txt")).first().sha256 == hashlib.sha256(b"a\nb\nc").hexdigest()


def test_documents_and_configs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "l.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "bad.json").write_text("{")
    one = files.read_json_objects(spark, str(tmp_path / "a.json"), "x int").first()
    assert one.x == 1 and one.folder.endswith(tmp_path.name)
    assert [(r["index"], r.x) for r in files.read_json_list(spark, str(tmp_path / "l.json"), "x int").orderBy("index").collect()] == [(0, 1), (1, 2)]
    with pytest.raises(TypeError):
        files.read_json_objects(spark, str(tmp_path / "l.json"), "x int")
    with pytest.raises(TypeError):
        files.read_json_list(spark, str(tmp_path / "a.json"), "x int")
    with pytest.raises(ValueError, match="bad.json"):
        files.read_json_list(spark, str(tmp_path / "bad.json"), "x int")
    sinks.write_config(str(tmp_path / "c" / "c.yaml"), {"schema_version": 1, "a": "é"})
    (tmp_path / "c" / "old.yaml").write_text("schema_version: 0  # old\nlist: [1, {b: 2}]\n")
    assert sorted(r.config for r in files.read_configs(spark, str(tmp_path / "c")).collect()) == ['{"a":"é","schema_version":1}', '{"list":[1,{"b":2}],"schema_version":0}']
    with pytest.raises(ValueError):
        files.checkout_commit(str(tmp_path))
    table = files.read_parquet(spark, f"{FOLDER}/nation.parquet", ["n_name"])
    with pytest.raises(ValueError, match="zzz"):
        files.read_parquet(spark, f"{FOLDER}/nation.parquet", ["zzz"])
    assert table.count() == 25
    sha = sinks.copy_exact(f"{FOLDER}/nation.parquet", str(tmp_path / "n.parquet"), files.tree(spark, FOLDER, "^nation").first().sha256)
    with pytest.raises(ValueError):
        sinks.copy_exact(f"{FOLDER}/region.parquet", str(tmp_path / "r.parquet"), sha)


def test_splits_and_schedules_are_written_in_order(spark, tmp_path):
    ids = spark.range(60).select(F.col("id").cast("string").alias("pid"), (F.col("id") * 2).alias("v"))
    cut = protocol.split(ids.select("pid"), "pid", {"signal": 5, "eval": 7}, 11)
    sinks.write_splits(protocol.split_records(cut, ids, "pid"), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns[0] == "pid" and back.where("split = 'eval'").count() == 7
    schedule = protocol.schedule(protocol.prompt_queue(ids.select("pid"), "pid", 60, 30, 4, 2), ids, "pid")
    sinks.write_schedule(schedule, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 120
    sinks.write_lines(schedule, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 120
    with pytest.raises(ValueError):
        protocol.branch_window(schedule, 28, 5, 30)
    assert {r.rule for r in protocol.split_violations(ids.union(ids), "pid", {"a": 200}).collect()} == {"duplicate id", "nothing left for the trunk"}
    assert protocol.split_violations(ids, "pid", {"a": 5}).isEmpty()
    with pytest.raises(ValueError, match="both sides"):
        protocol.check_overlap(ids, ids.limit(1), "pid")
    protocol.check_overlap(ids, ids.limit(0), "pid")


def test_masks_and_totals(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.0], [True, False]), (2, [99.0], [False])], "k long, v array<double>, m array<boolean>")
    one = audit.masked_stats(audit.unmasked(rows, "v", "m", "k").withColumn("on", F.lit(True)), "x", "on").first()
    assert (one.n_values, one.mean_abs, one.positive_rate, one.zero_rate) == (1, 1.0, 1.0, 0.0)
    nested = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [True, False])], "k long, v array<array<double>>, m array<boolean>")
    assert sorted(r.x for r in audit.unmasked(nested, "v", "m", "k").collect()) == [1.0, 2.0]
    none = audit.masked_stats(rows.select(F.lit(1.0).alias("x"), F.lit(False).alias("on")), "x", "on").first()
    assert none.n_values == 0 and none.p50_abs is None


def test_values_are_bound_once(spark):
    docs = spark.createDataFrame([(1, [("user", "a e")]), (2, [("user", "x"), ("user", "y")]), (3, []), (4, None)], "k long, m array<struct<role:string,content:string>>")
    contract = protocol.message_contract(docs, "k", "m", ["e"], ["b"])
    assert contract._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 6
    assert [(r.k, r.broken) for r in contract.collect()] == [(2, "not one user message"), (3, "not one user message"), (4, "not one user message")]
    ids = docs.select(scalars.messages_id(F.col("m")).alias("i"))
    assert ids._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3


def test_log_probabilities_of_a_real_vocabulary(spark):
    import numpy as np

    logits = np.random.default_rng(4).normal(0, 30, (12, 50_000))
    logits[1, 7] = -np.inf
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(logits)], "k long, x array<double>").repartition(4)
    x = F.col("x")
    got = rows.select("k", scalars.log_probability(x, F.lit(5)).alias("p"), scalars.entropy(x).alias("h"), scalars.top_log_probabilities(x, 3).alias("t"), scalars.gathered_log_probabilities(x, F.array(F.lit(0), F.lit(9))).alias("g")).orderBy("k").collect()
    for r, v in zip(got, logits, strict=True):
        total = v.max() + np.log(np.exp(v - v.max()).sum())
        weight = np.exp(v - total)
        assert r.p == pytest.approx(v[4] - total) and r.g == pytest.approx([v[0] - total, v[9] - total])
        assert r.h == pytest.approx(total - (weight * np.where(weight > 0, v, 0)).sum(), abs=1e-9)
        assert [t.id for t in r.t] == np.argsort(-v, kind="stable")[:3].tolist()
    odd = spark.createDataFrame([(1, [float("-inf"), 1.0]), (2, [math.nan, 1.0]), (3, [None, 1.0]), (4, []), (5, [float("-inf")])], "k long, x array<double>")
    total = {r.k: r.t for r in odd.select("k", scalars.log_total(F.col("x"))["total"].alias("t")).collect()}
    assert total[1] == 1.0 and math.isnan(total[2]) and total[3] is None and total[4] == total[5] == float("-inf")


def test_digest_of_a_long_listing(spark):
    """400 MB of entries: more than any one value should be, and in no order."""
    rows = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_000).alias("at"))
    entry = F.repeat(F.lpad(F.col("at").cast("string"), 8, "0"), 250)
    got = digests.ordered_digest(rows.withColumn("k", F.lit(None).cast("string")), ["k"], ["at"], entry, opening="[", closing="]", total=F.col("at")).collect()
    want = hashlib.sha256(b"[")
    for k in range(200_000):
        want.update((b"," if k else b"") + b"%08d" % k * 250)
    want.update(b"]")
    assert [(r.k, r.n_entries, r.total, r.digest) for r in got] == [(None, 200_000, sum(range(200_000)), want.hexdigest())]
    some = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 1, "z")], "k string, o long, e string")
    found = {r.k: r.digest for r in digests.ordered_digest(some, ["k"], ["o"], F.col("e"), between="-").collect()}
    assert found == {"a": hashlib.sha256(b"-y").hexdigest(), "b": hashlib.sha256(b"z").hexdigest()}


def test_one_of_many_writers_locks_a_group(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = tmp_path.as_uri() + "/locks"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: locks.claim(spark, folder, "t0", {"identity_group": "t0", "global_step": k}), range(24)))
    assert len({g["global_step"] for g in got}) == 1
    assert [p.name for p in (tmp_path / "locks").iterdir() if not p.name.endswith(".crc")] == ["t0.json"]
    assert locks.locks(spark, folder).first().global_step == got[0]["global_step"]
    with pytest.raises(ValueError):
        locks.claim(spark, folder, "../x", {})


def test_later_runs_must_match_the_lock(spark, tmp_path):
    sha = "a" * 64
    row = lambda run, group, seq, actor: (run, group, seq, 0, 7, sha, sha, sha, actor, sha, sha, sha)
    kind = "run string, grp string, seq int, global_step long, rollout_seed long, config_hash string, dataloader_hash string, optimizer_hash string, actor_hash string, prompt_window_hash string, source_manifest_hash string, trainer_state_hash string"
    folder = str(tmp_path / "locks")
    first = spark.createDataFrame([row("opd", "t0", 1, sha), row("rl", "t0", 2, sha), row("free", None, 3, "x")], kind)
    assert locks.lock_groups(first, folder, "grp", "seq", "run").isEmpty()
    later = spark.createDataFrame([row("drift", "t0", 0, "b" * 64), row("new", "t4", 1, sha)], kind)
    assert [(r.run, r.fields) for r in locks.lock_groups(later, folder, "grp", "seq", "run").collect()] == [("drift", "actor_hash")]


def test_tables_by_place(spark):
    left = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("a"))
    right = spark.range(0, 1000, 1, 3).select(((F.col("id") * 91) % 1000 * 2).alias("b"))
    got = places.zipped(left, right, ["a"], ["b"]).collect()
    assert sorted((r.place, r.a, r.b) for r in got) == [(k, k, 2 * k) for k in range(1000)]
    with pytest.raises(ValueError, match="1000 rows can't be joined with 999"):
        places.zipped(left, right.limit(999), ["a"], ["b"])
    with pytest.raises(ValueError, match="by place"):
        places.with_supplied_lengths(left, right.limit(3), ["a"], ["b"], "b")
    assert places.zipped(left.limit(0), right.limit(0), ["a"], ["b"]).count() == 0


def test_hash_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large file.bin", "wb") as handle:
        handle.truncate(size - 3)
        handle.seek(size - 3)
        handle.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"abc")
    want, zero = hashlib.sha256(), bytes(1 << 24)
    for k in range(0, size - 3, 1 << 24):
        want.update(zero[: min(1 << 24, size - 3 - k)])
    want.update(b"end")
    got = {r.path: (r.bytes, r.sha256) for r in files.tree(spark, tmp_path.as_uri()).collect()}
    assert got == {"large file.bin": (size, want.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}
    (tmp_path / "large file.bin").unlink()


def test_signals_of_one_name(spark):
    points, _, held = endpoints(spark)
    rows = spark.createDataFrame([("0", '{"a_b": 1, "a": {"b": 2, "c": true}}'), ("20", '{"a": {"b": 2}, "a_b": 1, "x": "1"}')], "branch_point string, j string")
    table = surface.full_surface(points, held, "main", "avg_at_n", 0.01, signals=surface.flatten_signals(rows, "branch_point", "j"))
    assert {r.branch_point: r.signals for r in table.collect()} == {0: {"signal_a_b": 2.0, "signal_a_c": 1.0}, 20: {"signal_a_b": 1.0}}


CHATML = "{% for message in messages %}{{'<|' + message['role'] + '|>\n' + message['content'] + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|assistant|>\n' }}{% endif %}"


def test_chat_templates(spark):
    from pairlens.functions.templates import TemplateError, rendered_by
    from pairlens.plans.catalogue_models import INSTRUCTED, MARKED

    rows = spark.createDataFrame([(1, [("system", " S "), ("user", " q "), ("assistant", "a"), ("user", "r")]), (2, [("user", "q"), ("assistant", " a ")]), (3, None), (4, [])], "k long, m array<struct<role:string,content:string>>")
    show = lambda template, **settings: {r.k: r.t for r in rows.select("k", rendered_by(template, F.col("m"), **settings).alias("t")).collect()}
    assert show(CHATML, add_generation_prompt=True) == {1: "<|system|>\n S \n<|user|>\n q \n<|assistant|>\na\n<|user|>\nr\n<|assistant|>\n", 2: "<|user|>\nq\n<|assistant|>\n a \n<|assistant|>\n", 3: None, 4: "<|assistant|>\n"}
    assert show(CHATML)[4] == ""
    assert show(MARKED, add_generation_prompt=True, enable_thinking=True)[2] == "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n a <|im_end|>\n<|im_start|>assistant\n"
    told = show(INSTRUCTED, bos_token="<s>", eos_token="</s>")
    assert told[1] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n q [/INST] a </s><s>[INST] r [/INST]" and told[2] == "<s>[INST] q [/INST] a </s>"
    assert show("{# note #}{{- 'x' }}  {%- if messages[0]['role'] in ['system'] or false -%}  y {% endif %}{{ messages | length }}".replace(" in ['system']", " == 'system'"))[2] == "x2"
    assert show("{% for m in messages %}{% if not loop.last %}{{ loop.index ~ m.role | upper }},{% else %}{{ 'end' if m.content else 'none' }}{% endif %}{% endfor %}")[1] == "1SYSTEM,2USER,3ASSISTANT,end"
    with pytest.raises(Exception, match="no user"):
        show("{% if messages[0]['role'] != 'user' %}{{ raise_exception('no user') }}{% endif %}")
    for broken in ("{% for m in messages %}", "{% endif %}", "{% macro x() %}", "{{ f(1) }}", "{{ messages | sort }}"):
        with pytest.raises(TemplateError):
            rendered_by(broken, F.col("m"))


def test_template_needs_no_python_worker(spark):
    from pairlens.functions.templates import rendered_by

    rows = spark.createDataFrame([], "m array<struct<role:string,content:string>>").select(rendered_by(CHATML, F.col("m"), add_generation_prompt=True).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_tokenizer_parity(spark):
    from pairlens.operators import tokenizer_parity

    def file(**changes):
        made = {"added_tokens": [{"id": 3, "content": "<s>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}], "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordLevel", "vocab": {"Token": 0, "1": 1, "+": 2, "<s>": 3, "[UNK]": 4}, "unk_token": "[UNK]"}}
        return json.dumps(made | changes)

    settings = {"bos_token": "<s>", "eos_token": {"content": "<s>"}, "chat_template": "a", "additional_special_tokens": ["x", "y"]}
    same = {"model": {"type": "WordLevel", "vocab": {"[UNK]": 4, "<s>": 3, "+": 2, "1": 1, "Token": 0}, "unk_token": "[UNK]"}}
    other = {"model": {"type": "WordLevel", "vocab": {"Token": 0, "1": 2, "+": 1, "<s>": 3, "[UNK]": 4}, "unk_token": "[UNK]"}}
    rows = [("a", file(), json.dumps(settings)), ("b", file(**same), json.dumps(settings)), ("c", file(**other), json.dumps(settings | {"chat_template": "b"})), ("d", file(added_tokens=[]), json.dumps({})), ("u", json.dumps({"model": {"type": "Unigram", "vocab": [["<unk>", 0.0], ["x", -1.5]], "unk_id": 0}}), None)]
    models = spark.createDataFrame(rows, "model string, tokenizer string, settings string")
    parts = tokenizer_parity.tokenizer_parts(models)
    tokenizer_parity.check_parity(parts, "a", "b")
    found = lambda x, y: {(r.part, r.key): (r.left_value, r.right_value) for r in tokenizer_parity.parity_violations(parts, x, y).collect()}
    got = found("a", "c")
    assert got["vocabulary", "1"] == ("1", "2") and got["template", "chat_template"] == ("a", "b") and any(part == "probe" for part, _ in got)
    assert {part for part, _ in found("a", "d")} == {"added token", "special token", "special id", "template"}
    with pytest.raises(ValueError, match="a and c differ in probe.*template.*vocabulary: \\['\\+', '1'\\]"):
        tokenizer_parity.check_parity(parts, "a", "c")
    made = {r.model: r for r in tokenizer_parity.tokenizer_manifest(models, parts).collect()}
    assert made["a"].vocabulary_sha256 == made["b"].vocabulary_sha256 == digest({"Token": 0, "1": 1, "+": 2, "<s>": 3, "[UNK]": 4}) and made["a"].tokenizer_sha256 != made["b"].tokenizer_sha256
    assert made["u"].vocab_size == 2
