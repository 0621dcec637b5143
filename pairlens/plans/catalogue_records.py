"""Queries of prompts, records, queues and log-probabilities over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit as A
from ..operators import protocol as P
from ..operators import records as M
from .catalogue import QUEUE, D, prompts, queue
from .registry import query, rounded, shown, table


def text_array(rows, column):
    return rows.withColumn(column, F.array_join(column, ","))


@query("SELECT CAST(event_id // 4 AS VARCHAR) AS input, count(DISTINCT event_type) AS parts FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def spanning_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("step"), F.expr("event_id div 4").cast("string").alias("input"), F.lit("x").alias("gts"), F.col("event_type").alias("file"))
    return A.spanning_groups(rows, "file").select("input", "parts")


@query("SELECT concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'gts' END, CASE WHEN event_id % 3 = 0 THEN 'input' END, CASE WHEN event_type = 'click' THEN 'output' END, 'step') AS missing, count(*) AS n FROM events GROUP BY 1")
def missing_fields(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((e % 3 != 0).alias("has_input"), F.lit("i").alias("input"), F.when(e % 5 != 0, "g").alias("gts"), F.col("event_type") != "click", F.when(F.col("event_type") != "click", "o").alias("output"), F.lit(1.0).alias("score"))
    return rows.groupBy(F.array_join(A.missing_fields(rows), ",").alias("missing")).agg(F.count("*").alias("n"))


@query("""SELECT 'all' AS part, round(avg(CAST(value > 100 AS DOUBLE)), 6) AS format_rate, count(*) AS n_rows FROM events UNION ALL SELECT 'some', NULL, count(*) FROM events""")
def format_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") - 100).alias("a"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("b"))
    whole, part = A.format_rate(rows, "a"), A.format_rate(rows, "b")
    return rounded(whole.select(F.lit("all").alias("part"), "*").union(part.select(F.lit("some").alias("part"), "*")))


@query("""WITH h AS (SELECT user_id AS id, count(*) AS have FROM events GROUP BY 1), w AS (SELECT c_custkey AS id, 4 AS want FROM customer)
 SELECT id, coalesce(have, 0) AS have, CAST(coalesce(want, 0) AS BIGINT) AS want FROM h FULL JOIN w USING (id) WHERE coalesce(have, 0) <> coalesce(want, 0)""")
def sample_counts(spark, sf_dir):
    panel = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return A.wrong_sample_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), panel, "id", 4)


@query("""SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN o_orderkey % 7 - 1 < 0 OR o_orderkey % 5 <= 0 THEN 'step' END, CASE WHEN o_orderstatus = 'F' THEN 'checkpoint_identity_hash' END,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'prompt_queue_hash' END, CASE WHEN o_totalprice < 20000 THEN 'generated_tokens' END, CASE WHEN o_custkey % 11 = 0 THEN 'wall_seconds' END]) AS rule FROM orders) WHERE rule IS NOT NULL""")
def branch_result_rules(spark, sf_dir):
    hash_ = F.sha2(F.col("o_orderkey").cast("string"), 256)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 7 - 1).alias("checkpoint"), (F.col("o_orderkey") % 5).alias("horizon"),
        F.when(F.col("o_orderstatus") != "F", hash_).otherwise("short").alias("checkpoint_identity_hash"), F.when(~F.col("o_orderpriority").startswith("1"), hash_).alias("prompt_queue_hash"),
        (F.col("o_totalprice") - 20000).alias("generated_tokens_opd"), F.lit(1).alias("generated_tokens_rl"), F.lit(0.5).alias("wall_seconds_opd"), F.when(F.col("o_custkey") % 11 == 0, -1.0).otherwise(0.0).alias("wall_seconds_rl"),
    )
    return A.branch_result_violations(rows, "o_orderkey")


@query("SELECT s_suppkey, round((s_acctbal - 100) - (CAST(s_nationkey AS DOUBLE) - 100), 6) AS gain FROM supplier")
def gain_difference(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(scalars.gain_difference(F.lit(100.0), F.col("s_nationkey").cast("double"), F.col("s_acctbal")), 6).alias("gain"))


@query(D + """, t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'literal ' || doc_id ELSE txt END AS c FROM d)
 SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR c = '' THEN NULL WHEN doc_id % 4 = 2 THEN sha256('{"prompt":[{"content":"be brief","role":"system"},{"content":' || CAST(to_json(c) AS VARCHAR) || ',"role":"user"}]}')
 ELSE sha256('{"prompt":[{"content":' || CAST(to_json(c) AS VARCHAR) || ',"role":"user"}]}') END AS problem_id FROM t""")
def message_ids(spark, sf_dir):
    k = F.col("doc_id") % 4
    said = lambda role, text: F.struct(F.lit(f" {role} ").alias("role"), text.alias("content"), F.lit(1).alias("extra"))
    one, two = F.array(said("user", F.col("text"))), F.array(said("system", F.lit(" be\t brief")), said("user", F.col("text")))
    literal = F.concat(F.lit("[{'role': 'user', 'content': 'literal  "), F.col("doc_id").cast("string"), F.lit("'}]"))
    kept = F.when(k == 0, F.to_json(one)).when(k == 1, literal).when(k == 2, F.to_json(two)).otherwise(F.to_json(F.struct(F.col("text"))))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", kept.alias("prompt"))
    return rows.select("doc_id", scalars.messages_id(scalars.parse_messages(F.col("prompt"))).alias("problem_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN lang IS NULL OR doc_id % 5 = 1 THEN 'None' ELSE lang END AS answer FROM documents")
def record_answers(spark, sf_dir):
    truth = F.when(F.col("doc_id") % 5 != 1, F.concat(F.lit(" \t"), F.col("lang"), F.lit("　\n"))).alias("ground_truth")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.struct(truth, F.lit("rule").alias("style"))).alias("m"))
    return rows.select("doc_id", scalars.record_answer(F.col("m")).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) ELSE value END AS score FROM events")
def score_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("value").cast("string")).alias("s"))
    return rows.select("event_id", scalars.score_value(F.try_parse_json("s"), "k").alias("score"))


@query(r"SELECT p_partkey, regexp_full_match(replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '-' END), '[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*') AS safe, 'run_' || p_size || '_opd' AS run_id FROM part")
def identifiers(spark, sf_dir):
    name = F.replace(F.col("p_brand"), F.lit("#"), F.when(F.col("p_size") % 2 == 0, "_").otherwise("-"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.safe_identifier(name).alias("safe"), scalars.run_id(F.lit("run"), F.col("p_size").cast("string"), F.lit("opd")).alias("run_id"))


def source_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("answer"), F.col("p_size").alias("level"), F.col("p_type").alias("id"))


@query(r"""SELECT p_partkey AS row, p_name || ' Please reason step by step, and put your final answer within \boxed{}.' AS content, CAST(p_size AS INTEGER) AS level, p_type AS id, p_brand AS truth, 'MATH-' || p_partkey AS index FROM part""")
def native_records(spark, sf_dir):
    made = M.native_records(source_rows(spark, sf_dir), "place")
    return made.select(F.col("_index").alias("row"), F.col("prompt")[0]["content"].alias("content"), "level", "id", F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"))


@query("""SELECT * FROM (SELECT p_partkey AS row, CASE WHEN p_partkey % 101 = 0 THEN 'no row' ELSE concat_ws(',', CASE WHEN p_partkey % 97 = 0 THEN 'prompt' END, CASE WHEN p_partkey % 89 = 0 THEN 'level' END, CASE WHEN p_partkey % 83 = 0 THEN 'reward_model' END) END AS fields FROM part) WHERE fields <> ''
 UNION ALL SELECT -1, 'no row'""")
def mapping_drift(spark, sf_dir):
    source = source_rows(spark, sf_dir)
    p = F.col("_index")
    native = M.native_records(source, "place").where(p % 101 != 0)
    native = native.withColumn("level", F.when(p % 89 == 0, F.lit(-1)).otherwise(F.col("level"))).withColumn("prompt", F.when(p % 97 == 0, F.concat("prompt", "prompt")).otherwise(F.col("prompt")))
    native = native.withColumn("reward_model", F.when(p % 83 == 0, F.struct(F.lit("?").alias("ground_truth"), F.lit("rule").alias("style"))).otherwise(F.col("reward_model")))
    lone = native.where("_index = 1").withColumn("_index", F.lit(-1).cast("long"))
    return M.mapping_drift(M.native_records(source, "place"), M.coerced_records(native.union(lone).withColumnRenamed("_index", "place"), "place"))


@query("""SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR trim(text) = '' THEN 'not one user message' ELSE concat_ws('; ', CASE WHEN (length(txt) - length(replace(txt, 'e', ''))) <> 1 THEN 'required e' END, CASE WHEN contains(txt, 'a') THEN 'forbidden a' END) END AS broken FROM (""" + D + "SELECT * FROM d)) WHERE broken <> '' ORDER BY doc_id LIMIT 20")
def message_contract(spark, sf_dir):
    said = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.array(said, said)).otherwise(F.array(said)).alias("m"))
    return P.message_contract(rows, "doc_id", "m", ["e"], ["a"])


FACTS = """, f AS (SELECT 'rows' AS fact, count(*) AS value FROM p UNION ALL SELECT 'unique_prompts', count(DISTINCT problem_id) FROM p UNION ALL SELECT 'duplicate_prompt_groups', count(*) FROM (SELECT 1 FROM p GROUP BY problem_id HAVING count(*) > 1)
 UNION ALL SELECT 'duplicate_rows', count(*) - count(DISTINCT problem_id) FROM p UNION ALL SELECT 'level ' || lang, count(*) FROM p GROUP BY lang) """


@query(D + FACTS + "SELECT * FROM f")
def data_facts(spark, sf_dir):
    return P.data_facts(prompts(spark, sf_dir), "problem_id", "lang")


@query(D + FACTS + ", e AS (SELECT * FROM (VALUES ('rows', 5), ('level xx', 7)) e(fact, expected)) SELECT fact, value, CAST(expected AS BIGINT) AS expected FROM f FULL JOIN e USING (fact) WHERE (expected IS NOT NULL OR fact LIKE 'level %') AND value IS DISTINCT FROM expected")
def data_drift(spark, sf_dir):
    expected = spark.createDataFrame([("rows", 5), ("level xx", 7)], "fact string, value long")
    return P.drift(P.data_facts(prompts(spark, sf_dir), "problem_id", "lang"), expected)


@query("""WITH t AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%'), o AS (SELECT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '2%'), b AS (SELECT id FROM t INTERSECT SELECT id FROM o)
 SELECT (SELECT count(*) FROM o) AS n_rows, (SELECT count(*) FROM b) AS n_overlap, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM b ORDER BY id LIMIT 20)) AS overlap_ids""")
def overlap_audit(spark, sf_dir):
    side = lambda p: table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("id"))
    return shown(P.overlap_audit(side("1"), side("2"), "id"))


@query("SELECT CAST(400 AS BIGINT) AS prompt_cap, count(*) FILTER (n_chars > 400) AS n_overlong, max(n_chars) AS max_before, max(n_chars) FILTER (n_chars <= 400) AS max_after FROM documents")
def prompt_length_audit(spark, sf_dir):
    return P.length_audit(table(spark, sf_dir, "documents"), "n_chars", 400)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 400")
def prompts_within_cap(spark, sf_dir):
    return P.length_filter(table(spark, sf_dir, "documents"), "n_chars", 400).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 400 ORDER BY doc_id LIMIT 20")
def overlong_prompts(spark, sf_dir):
    return P.overlong(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 400)


SPLIT = """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('11:' || p_partkey), p_partkey) - 1 AS k FROM part), s AS (
 SELECT p_partkey, CASE WHEN k < 50 THEN 'signal' WHEN k < 120 THEN 'eval' ELSE 'train_trunk' END AS split, CASE WHEN k < 50 THEN k WHEN k < 120 THEN k - 50 ELSE k - 120 END AS pos FROM r) """


def split(spark, sf_dir):
    return P.split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", {"signal": 50, "eval": 70}, 11)


@query(SPLIT + """SELECT split, count(*) AS n_ids, sha256('[' || string_agg('"' || p_partkey || '"', ',' ORDER BY pos) || ']') AS digest FROM s GROUP BY 1""")
def split_digests(spark, sf_dir):
    return P.split_digests(split(spark, sf_dir), "p_partkey")


@query(SPLIT + "SELECT p_partkey, split, pos, p_name, p_size FROM s JOIN part USING (p_partkey)")
def split_records(spark, sf_dir):
    return P.split_records(split(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@query("""SELECT * FROM (SELECT 'duplicate id' AS rule, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS n_bad UNION ALL SELECT 'nothing left for the trunk', CAST(count(*) <= 1000000000 AS BIGINT) FROM orders) WHERE n_bad > 0""")
def split_rules(spark, sf_dir):
    return P.split_violations(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", {"signal": 600_000_000, "eval": 400_000_000})


@query(QUEUE + """SELECT count(*) AS n_batches, sha256('[' || string_agg(ids, ',' ORDER BY "update") || ']') AS digest FROM (SELECT "update", '[' || string_agg('"' || s_suppkey || '"', ',' ORDER BY slot) || ']' AS ids FROM w GROUP BY 1)""")
def queue_digest(spark, sf_dir):
    return P.queue_digest(queue(spark, sf_dir), "s_suppkey")


@query(QUEUE + """SELECT "update", slot, s_suppkey, CASE WHEN "update" < 12 THEN 'initial' ELSE 'continuation' END AS stage, CASE WHEN "update" < 12 THEN "update" ELSE "update" - 12 END AS stage_update FROM w""")
def queue_stages(spark, sf_dir):
    return P.stage_of(queue(spark, sf_dir), 12)


@query("SELECT n_nationkey, CAST(u AS BIGINT) AS trainer_updates, CAST(u * 64 * 4 // 32 * 2 AS BIGINT) AS optimizer_steps, CAST(u * 64 AS BIGINT) AS prompts, CAST(u * 256 AS BIGINT) AS trajectories, CAST(u * 256 * 7168 AS BIGINT) AS token_upper_bound FROM (SELECT n_nationkey, n_nationkey + 1 AS u FROM nation)")
def planned_doses(spark, sf_dir):
    plans = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("updates"))
    return P.dose(plans, 64, 4, 32, 2, 7168).drop("updates")


X = "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL), z AS (SELECT vec_id, ln(sum(exp(CAST(x AS DOUBLE)))) AS z FROM e GROUP BY 1) "


@query(X + "SELECT vec_id, CAST(r AS BIGINT) AS rank, CAST(i AS BIGINT) AS id, round(x - z, 6) AS logprob FROM (SELECT vec_id, i, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM e) JOIN z USING (vec_id) WHERE r <= 4")
def top_log_probabilities(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.posexplode(scalars.top_log_probabilities(F.col("embedding"), 4)).alias("r", "t"))
    return rows.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("t.id").cast("long").alias("id"), F.round("t.logprob", 6).alias("logprob"))


@query(X + "SELECT vec_id, CAST(i AS BIGINT) AS id, round(CAST(x AS DOUBLE) - z, 6) AS logprob FROM e JOIN z USING (vec_id) WHERE i IN (0, 7, 63)")
def gathered_log_probabilities(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    ids = F.array(F.lit(0), F.lit(7), F.lit(63))
    found = rows.select("vec_id", F.inline(F.arrays_zip(ids.alias("id"), scalars.gathered_log_probabilities(F.col("embedding"), ids).alias("p"))))
    return found.select("vec_id", F.col("id").cast("long").alias("id"), F.round("p", 6).alias("logprob"))


@query(X + "SELECT vec_id, round(-sum(exp(x - z) * (x - z)), 5) AS entropy FROM (SELECT vec_id, CAST(x AS DOUBLE) AS x FROM e) JOIN z USING (vec_id) GROUP BY 1")
def logit_entropy(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.round(scalars.entropy(F.col("embedding")), 5).alias("entropy"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS verifier_reward, CAST(list_sum(list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER))) AS BIGINT) AS response_length FROM embeddings WHERE embedding IS NOT NULL")
def rollout_totals(spark, sf_dir):
    x = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    totals = scalars.outcome_totals(x, F.transform(x, F.abs), F.transform(x, lambda v: (v > 0).cast("int")))
    return rounded(rows.select("vec_id", totals.alias("t")).select("vec_id", "t.*"))


@query("SELECT vec_id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 6) AS total FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i % 3 = 1 GROUP BY 1")
def selected_values(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("v"), F.transform(e, lambda x, i: i % 3 == 0).alias("m"))
    return rounded(A.unmasked(rows, "v", "m", "vec_id").groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("x").alias("total")))


@query(r"""SELECT event_id, '{"a":[1,{"x":true,"y":null}],"b\"\\":"q' || chr(92) || 'n' || chr(92) || '"",' || '"d":' || CASE WHEN event_id % 4 = 0 THEN CAST(event_id // 4 AS VARCHAR) ELSE (event_id // 4) || CASE event_id % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END || ',"k":' || json_extract_string(props, '$.k') || ',"z":"é/"}' AS canonical FROM events""")
def canonical_texts(spark, sf_dir):
    """Keys out of order, white space, fractions with and without zeros at the end, and escapes that need not be."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    fraction = F.concat((F.expr("event_id div 4")).cast("string"), F.element_at(F.array(F.lit(".0"), F.lit(".250"), F.lit(".50"), F.lit(".75")), (e % 4 + 1).cast("int")))
    text = F.concat(F.lit('{ "z" : "\\u00e9\\/", "k":'), k, F.lit(', "d" : '), fraction, F.lit(', "b\\"\\\\": "q\\n\\"", "a": [1, {"y": null, "x": true}] }'))
    return table(spark, sf_dir, "events").select("event_id", scalars.canonical_json(text).alias("canonical"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 8 END::BIGINT AS rollout_seed FROM events")
def rollout_seeds(spark, sf_dir):
    return A.seeded(table(spark, sf_dir, "events"), {"click": 7, "view": 8}, "event_type").select("event_id", "rollout_seed")
