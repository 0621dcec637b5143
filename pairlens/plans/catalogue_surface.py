"""Queries of surface validation, identities and plans over the driver's tables, each with its DuckDB twin.

Nations serve as branch points; customers and suppliers as the two arms' evaluations, with planted differences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import surface as S
from .registry import query, rounded, table

HASH = "sha256('x')"


def evaluations(spark, sf_dir):
    """(comparisons, specifications, summaries): nation k has models c<k> and s<k>; some lack a summary, a specification or agreement."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    arms = nations.select("k", F.explode(F.array(F.lit("c"), F.lit("s"))).alias("arm")).withColumn("model_id", F.concat("arm", F.col("k").cast("string")))
    rl, k = F.col("arm") == "s", F.col("k")
    locked = F.concat(F.lit('{"temperature":0.70,"n":4,"enable_thinking":false,"verifier":{"label":"v","function":"f"}}'))
    plan = arms.where(~(rl & (k == 20))).select("model_id", F.lit("main").alias("panel"), F.concat(F.when(k % 2 == 0, "/runs/").otherwise(""), F.lit("eval/"), "model_id").alias("output_dir"), F.when(k % 3 == 0, "data").alias("dataset"), F.when(k % 4 == 0, F.sha2(F.lit("x"), 256)).alias("evaluation_protocol_sha256"), F.when(k % 5 != 4, locked).alias("evaluation_protocol"))
    plan = plan.union(plan.where("model_id = 'c7'").withColumn("panel", F.lit("other")))
    found = arms.where(~(~rl & (k == 10))).select(
        F.concat(F.lit("file:///runs/eval/"), "model_id", F.lit("/")).alias("folder"), F.when(rl & (k == 1), "q").otherwise(F.col("model_id")).alias("model_id"), F.when(~rl & (k == 2), "other").otherwise("main").alias("panel"),
        F.when(rl & (k == 3), "else").otherwise("data").alias("dataset"), F.when(rl & (k == 8), "bad").otherwise(F.sha2(F.lit("x"), 256)).alias("evaluation_protocol_sha256"), F.sha2(F.lit("x"), 256).alias("model_identity_sha256"),
        F.when(rl & (k == 5), 0.6).otherwise(0.7).alias("temperature"), F.lit(4).alias("n"), F.when(k != 11, False).alias("enable_thinking"), F.lit('{"function":"f","label":"v"}').alias("verifier"), F.when(~(rl & (k == 6)), 42).alias("seed"),
        (F.when(rl, 0.5).otherwise(0.3) + (k - 12) * F.when(rl, 0.02).otherwise(0.0)).alias("avg_at_n"), F.when(rl | (k % 2 == 0), 0.25).alias("format_rate"),
    )
    points = nations.select(k.alias("branch_point"), F.concat(F.lit("c"), k.cast("string")).alias("opd_model_id"), F.concat(F.lit("s"), k.cast("string")).alias("rl_model_id"))
    return points, plan, found


def attached(spark, sf_dir):
    points, plan, found = evaluations(spark, sf_dir)
    return points, S.attach_summaries(S.evaluation_index(plan, "main"), found, "/runs/")


#: The same arms, specifications and summaries in SQL.
ARMS = """WITH a AS (SELECT n_nationkey AS k, arm, arm || n_nationkey AS own FROM nation, (VALUES ('c'), ('s')) v(arm)), p AS (SELECT k, own AS model_id, 'main' AS panel, CASE WHEN k % 3 = 0 THEN 'data' END AS dataset, CASE WHEN k % 4 = 0 THEN sha256('x') END AS sha, k % 5 <> 4 AS locked FROM a WHERE NOT (arm = 's' AND k = 20)),
 f AS (SELECT own, CASE WHEN own = 's1' THEN 'q' ELSE own END AS its_id, CASE WHEN own = 'c2' THEN 'other' ELSE 'main' END AS its_panel, CASE WHEN own = 's3' THEN 'else' ELSE 'data' END AS its_dataset, CASE WHEN own = 's8' THEN 'bad' ELSE sha256('x') END AS its_sha, CASE WHEN own = 's5' THEN 0.6 ELSE 0.7 END AS temperature, CASE WHEN k <> 11 THEN false END AS thinking, CASE WHEN own <> 's6' THEN 42 END AS seed FROM a WHERE own <> 'c10') """


@query(ARMS + ", d AS (SELECT panel, model_id FROM p UNION ALL SELECT 'other', model_id FROM p WHERE model_id = 'c7'), e AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE model_id = 'c7') SELECT panel, model_id, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_evaluations(spark, sf_dir):
    _, plan, _ = evaluations(spark, sf_dir)
    return S.duplicate_evaluations(plan.union(plan.where("model_id = 'c7'")))


@query(ARMS + """, j AS (SELECT * FROM p LEFT JOIN f ON f.own = p.model_id) SELECT panel, model_id, field FROM (SELECT panel, model_id, unnest(CASE WHEN own IS NULL THEN ['summary'] ELSE [CASE WHEN its_panel <> panel THEN 'panel' END, CASE WHEN its_id <> model_id THEN 'model_id' END, CASE WHEN its_dataset <> dataset THEN 'dataset' END, CASE WHEN its_sha <> sha THEN 'evaluation_protocol_sha256' END,
 CASE WHEN NOT regexp_full_match(its_sha, '[0-9a-fA-F]{64}') THEN 'evaluation_protocol_sha256 malformed' END, CASE WHEN locked AND temperature <> 0.7 THEN 'temperature' END, CASE WHEN locked AND thinking IS DISTINCT FROM false THEN 'enable_thinking' END] END) AS field FROM j) WHERE field IS NOT NULL""")
def summary_violations(spark, sf_dir):
    return S.summary_violations(attached(spark, sf_dir)[1])


@query(ARMS + """, j AS (SELECT p.model_id AS id, f.* FROM p LEFT JOIN f ON f.own = p.model_id), b AS (SELECT n_nationkey AS branch_point, o.id AS oi, g.id AS gi, o.own AS oo, g.own AS go, o.its_sha AS o1, g.its_sha AS g1, o.temperature AS o2, g.temperature AS g2, o.thinking AS o3, g.thinking AS g3, o.seed AS o4, g.seed AS g4 FROM nation LEFT JOIN j o ON o.id = 'c' || n_nationkey LEFT JOIN j g ON g.id = 's' || n_nationkey)
 SELECT branch_point, field FROM (SELECT branch_point, unnest([CASE WHEN oi IS NULL THEN 'opd specification' END, CASE WHEN gi IS NULL THEN 'rl specification' END] || CASE WHEN oo IS NOT NULL AND go IS NOT NULL THEN [CASE WHEN o1 IS DISTINCT FROM g1 THEN 'evaluation_protocol_sha256' END, CASE WHEN o2 IS DISTINCT FROM g2 THEN 'temperature' END, CASE WHEN o3 IS DISTINCT FROM g3 THEN 'enable_thinking' END, CASE WHEN o4 IS DISTINCT FROM g4 THEN 'seed' END] ELSE [] END) AS field FROM b) WHERE field IS NOT NULL""")
def pair_violations(spark, sf_dir):
    return S.pair_violations(*attached(spark, sf_dir))


@query(f"""WITH n AS (SELECT n_nationkey AS k, 0.3::DOUBLE AS a, 0.5::DOUBLE + (n_nationkey - 12) * 0.02::DOUBLE AS b FROM nation WHERE n_nationkey NOT IN (10, 20))
 SELECT k AS branch_point, 8 AS horizon, k AS target_step, 'main' AS panel, 'avg_at_n' AS metric, 'c' || k AS opd_model_id, 's' || k AS grpo_model_id, round(a, 6) AS opd_endpoint, round(b, 6) AS grpo_endpoint, round(b - a, 6) AS grpo_minus_opd,
 0.05::DOUBLE AS equivalence_band, CASE WHEN abs(b - a) <= 0.05::DOUBLE THEN 'indistinguishable' WHEN b > a THEN 'rl' ELSE 'opd' END AS preferred_arm, {HASH} AS opd_model_identity_sha256, {HASH} AS grpo_model_identity_sha256, {HASH} AS evaluation_protocol_sha256,
 round(a, 6) AS opd_avg_at_n, round(b, 6) AS grpo_avg_at_n, CASE WHEN k % 2 = 0 THEN 0.25::DOUBLE END AS opd_format_rate, CASE WHEN k % 2 = 0 THEN 0.25::DOUBLE END AS grpo_format_rate, CASE WHEN k < 9 THEN CAST(k AS DOUBLE) END AS signal_k FROM n""")
def endpoint_surface(spark, sf_dir):
    points, held = attached(spark, sf_dir)
    signals = table(spark, sf_dir, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").cast("string").alias("branch_point"), F.lit("signal_k").alias("name"), F.col("n_nationkey").cast("double").alias("value"))
    return rounded(S.signal_columns(S.full_surface(points, held, "main", "avg_at_n", 0.05, 8, signals), ["signal_k"]))


FILES = """WITH f AS (SELECT doc_id // 20 AS ck, CASE doc_id % 20 WHEN 0 THEN 'data.pt' WHEN 1 THEN 'actor/optim_' || doc_id || '.pt' WHEN 2 THEN 'actor/extra_state_' || doc_id || '.pt' WHEN 3 THEN 'other.txt' WHEN 4 THEN 'actor/sub/optim_9.pt' WHEN 5 THEN 'actor/optim_x.bin' ELSE 'actor/sub/m' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS path,
 octet_length(encode(text)) AS b, sha256(text) AS s FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN path = 'data.pt' THEN 'd' WHEN path LIKE 'actor/optim_%.pt' THEN 'o' WHEN path LIKE 'actor/extra%' THEN 't' WHEN path LIKE 'actor/sub/m%' THEN 'a' END AS class FROM f),
 g AS (SELECT ck, class, sha256('{' || string_agg('"' || path || '":{"bytes":' || b || ',"sha256":"' || s || '"}', ',' ORDER BY path) || '}') AS h FROM c WHERE class IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT ck, max(h) FILTER (class = 'a') AS actor_hash, max(h) FILTER (class = 'o') AS optimizer_hash, max(h) FILTER (class = 't') AS trainer_state_hash, max(h) FILTER (class = 'd') AS dataloader_hash FROM g GROUP BY 1) """


def checkpoint_files(spark, sf_dir):
    k, n = F.col("doc_id") % 20, F.col("doc_id").cast("string")
    path = F.when(k == 0, "data.pt").when(k == 1, F.concat(F.lit("actor/optim_"), n, F.lit(".pt"))).when(k == 2, F.concat(F.lit("actor/extra_state_"), n, F.lit(".pt"))).when(k == 3, "other.txt").when(k == 4, "actor/sub/optim_9.pt").when(k == 5, "actor/optim_x.bin").otherwise(F.concat(F.lit("actor/sub/m"), F.lpad(n, 9, "0")))
    return table(spark, sf_dir, "documents").where("text is not null").select(F.expr("doc_id div 20").alias("ck"), path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query(FILES + "SELECT * FROM h")
def checkpoint_hashes(spark, sf_dir):
    return I.checkpoint_hashes(checkpoint_files(spark, sf_dir), "ck")


IDENTITY = FILES + """, i AS (SELECT ck, ck // 3 AS grp, actor_hash, CASE WHEN ck % 7 = 0 THEN 'short' ELSE sha256('c') END AS config_hash, dataloader_hash, 0 + ck // 3 AS global_step, optimizer_hash, sha256('p') AS prompt_window_hash, 42 + CAST(ck % 3 = 2 AS BIGINT) AS rollout_seed, sha256('s') AS source_manifest_hash, trainer_state_hash FROM h) """


def identities(spark, sf_dir):
    sha = lambda x: F.sha2(F.lit(x), 256)
    ck = F.col("ck")
    return I.checkpoint_hashes(checkpoint_files(spark, sf_dir), "ck").select("*", F.expr("ck div 3").alias("grp"), F.when(ck % 7 == 0, "short").otherwise(sha("c")).alias("config_hash"), F.expr("ck div 3").alias("global_step"), sha("p").alias("prompt_window_hash"), (42 + (ck % 3 == 2).cast("long")).alias("rollout_seed"), sha("s").alias("source_manifest_hash"))


QUOTED = {f: f"coalesce('\"' || {f} || '\"', 'null')" for f in I.DIGESTS} | {f: f for f in I.NUMBERS}
JSON = " || ',' || ".join(f"'\"{f}\":' || {QUOTED[f]}" for f in sorted(QUOTED))


@query(IDENTITY + f"SELECT ck, sha256('{{' || {JSON} || '}}') AS identity_sha256 FROM i")
def checkpoint_identities(spark, sf_dir):
    return I.with_identity(identities(spark, sf_dir)).select("ck", "identity_sha256")


@query(IDENTITY + "SELECT ck, unnest(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce(regexp_full_match({f}, '[0-9a-fA-F]{{64}}'), false) THEN '{f}' END" for f in I.DIGESTS) + "], lambda x: x IS NOT NULL)) AS field FROM i")
def identity_violations(spark, sf_dir):
    return I.identity_violations(identities(spark, sf_dir), "ck")


DIFFER = ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in (*I.NUMBERS, *I.DIGESTS))


@query(IDENTITY + f"SELECT * FROM (SELECT b.ck, concat_ws(',', {DIFFER}) AS fields FROM i a JOIN i b ON a.ck = b.ck - b.ck % 3 AND a.grp = b.grp) WHERE fields <> ''")
def identity_mismatches(spark, sf_dir):
    every = identities(spark, sf_dir)
    first = every.where("ck % 3 = 0").select("grp", *I.NUMBERS, *I.DIGESTS)
    left = every.select("ck", "grp").join(first, "grp").drop("grp")
    return I.identity_mismatches(left, every, "ck")


@query(IDENTITY + f", heads AS (SELECT *, min(ck) OVER (PARTITION BY grp) AS head FROM i WHERE grp % 4 <> 3) SELECT * FROM (SELECT b.ck, b.grp, concat_ws(',', {DIFFER}) AS fields FROM heads a JOIN heads b ON a.ck = b.head) WHERE fields <> ''")
def lock_violations(spark, sf_dir):
    rows = identities(spark, sf_dir).withColumn("grp", F.when(F.col("grp") % 4 != 3, F.col("grp"))).withColumn("seq", F.col("ck"))
    return I.lock_violations(rows, "grp", "seq", "ck")


@query("SELECT n_nationkey AS id, sha256('') AS optimizer_hash, sha256(n_name) AS actor_hash FROM nation")
def fresh_identities(spark, sf_dir):
    models = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.sha2("n_name", 256).alias("h"))
    return I.fresh_hashes(models, "id", "h").select("id", "optimizer_hash", "actor_hash")


PARTS = {"actor_hash": "actor_hash", "optimizer_hash": "optimizer_hash", "trainer_state_hash": "trainer_state_hash", "dataloader_hash": "dataloader_hash"}
START = ", ".join(f"CASE WHEN n_nationkey % 3 > 0 THEN h.{p} ELSE {'sha256(n_name)' if p == 'actor_hash' else chr(39).join(['sha256(', '', ')'])} END AS {p}" for p in PARTS)


@query(FILES + f""", i AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN 'resumed_checkpoint' ELSE 'fresh_model' END AS kind, CASE WHEN n_nationkey % 3 > 0 THEN 40 ELSE 0 END AS global_step, 42 AS rollout_seed, sha256('c') AS config_hash, sha256('p') AS prompt_window_hash, sha256('s') AS source_manifest_hash, {START} FROM nation LEFT JOIN h ON h.ck = n_nationkey)
 SELECT 'r' || n_nationkey AS execution_id, kind, CAST(global_step AS BIGINT) AS global_step, sha256('{{' || {JSON} || '}}') AS identity_sha256 FROM i""")
def starting_identities(spark, sf_dir):
    sha = lambda x: F.sha2(F.lit(x), 256)
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    runs = nations.select(F.concat(F.lit("r"), k.cast("string")).alias("execution_id"), F.lit(None).cast("string").alias("identity_group"), F.when(k % 3 > 0, k.cast("long")).alias("resume_from"), F.col("n_name").alias("model"), F.lit(40).alias("global_step"), F.lit(42).alias("rollout_seed"), sha("c").alias("config_hash"), sha("p").alias("prompt_window_hash"), sha("s").alias("source_manifest_hash"))
    models = I.fresh_hashes(nations.select(F.col("n_name").alias("model"), F.sha2("n_name", 256).alias("h")), "model", "h")
    held = I.checkpoint_hashes(checkpoint_files(spark, sf_dir), "ck").withColumnRenamed("ck", "checkpoint")
    return I.pre_intervention(runs, held, models).select("execution_id", "kind", "global_step", "identity_sha256")


@query("""WITH f AS (SELECT DISTINCT p_size AS folder, CASE p_partkey % 6 WHEN 0 THEN 'fsdp_config.json' WHEN 1 THEN 'huggingface/config.json' WHEN 2 THEN 'huggingface/tokenizer.json' WHEN 3 THEN 'model_world_size_1_rank_0.pt' WHEN 4 THEN 'extra_state_world_size_1_rank_0.pt' ELSE 'x' END AS path FROM part)
 SELECT folder, string_agg(r, ',' ORDER BY o) AS missing FROM (SELECT DISTINCT folder FROM f) a, (VALUES (1, 'model_world_size_1_rank_0.pt'), (2, 'extra_state_world_size_1_rank_0.pt'), (3, 'fsdp_config.json'), (4, 'huggingface/config.json'), (5, 'huggingface/tokenizer.json')) v(o, r) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.folder = a.folder AND f.path = r) GROUP BY 1""")
def incomplete_checkpoints(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "fsdp_config.json").when(k == 1, "huggingface/config.json").when(k == 2, "huggingface/tokenizer.json").when(k == 3, "model_world_size_1_rank_0.pt").when(k == 4, "extra_state_world_size_1_rank_0.pt").otherwise("x")
    return I.missing_files(table(spark, sf_dir, "part").select(F.col("p_size").alias("folder"), name.alias("path")), "folder", "path")


@query("SELECT path FROM (SELECT p_brand || p_partkey || CASE p_partkey % 7 WHEN 0 THEN '.json' WHEN 1 THEN '.jinja' WHEN 2 THEN '.safetensors' WHEN 3 THEN '.partial.json' WHEN 4 THEN '.bin' WHEN 5 THEN '/a.json' ELSE '.txt' END AS path, p_partkey % 7 AS k FROM part) WHERE k NOT IN (3, 4, 5)")
def model_files(spark, sf_dir):
    k = F.col("p_partkey") % 7
    end = F.when(k == 0, ".json").when(k == 1, ".jinja").when(k == 2, ".safetensors").when(k == 3, ".partial.json").when(k == 4, ".bin").when(k == 5, "/a.json").otherwise(".txt")
    return I.model_files(table(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_partkey").cast("string"), end).alias("path")), "path")


@query("""SELECT p_partkey, sha, e AS expected_sha, CASE WHEN p_size % 3 = 0 THEN 'permitted-local-patch' ELSE 'exact-upstream-text' END AS status, sha IS DISTINCT FROM e AS drifted FROM (SELECT p_partkey, p_size, sha256(p_name) AS sha, CASE WHEN p_size % 3 = 0 THEN sha256(p_brand) WHEN p_size % 2 = 0 THEN sha256(p_name) END AS e FROM part)""")
def file_status(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = lambda df, c: df.select("p_partkey", F.sha2(c, 256).alias("sha"))
    return S.file_status(named(part, "p_name"), named(part.where("p_size % 2 = 0"), "p_name"), named(part.where("p_size % 3 = 0"), "p_brand"), "p_partkey", "sha")


@query("SELECT k, a AS left_id, b AS right_id FROM (SELECT c_custkey AS k, c_nationkey AS a FROM customer) FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS b FROM supplier) USING (k) WHERE a IS DISTINCT FROM b ORDER BY k LIMIT 20")
def first_vocabulary_diffs(spark, sf_dir):
    side = lambda name, p, key: table(spark, sf_dir, name).select(F.col(key).alias("k"), F.col(f"{p}_nationkey").alias("n"))
    return S.first_vocabulary_diffs(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), "k", "n")
