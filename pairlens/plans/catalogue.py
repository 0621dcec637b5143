"""Queries of the audit engine over the driver's tables, each with its DuckDB twin.

``events`` serve as rollouts (four to a group), ``documents`` as prompts with ``lang``
as the answer, ``customer`` and ``supplier`` balances by nation as paired endpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit as A
from ..operators import identity as I
from ..operators import protocol as P
from ..operators import surface as S
from .registry import ORACLE_SQL, QUERIES, query, rounded, shown, table  # noqa: F401

FLAGSHIP = "audit_by_step_and_total"
N, CAP = 4, 90


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as resolved rollout rows."""
    group = F.expr("event_id div 4")
    rows = table(spark, sf_dir, "events").select(
        (group % 8).cast("int").alias("step"), group.cast("string").alias("input"), F.lit("x").alias("gts"),
        F.when(F.col("event_type") == "purchase", F.lit("\\boxed {1}")).otherwise(F.col("event_type")).alias("output"),
        (F.col("value") - 250).alias("score"), F.array(F.lit(0.0), F.when(F.col("value") > 300, 1.0).otherwise(0.0)).alias("token_rewards"),
        (1 + F.col("event_id") % 97).alias("response_length"),
    )
    return A.resolve(rows)


R = """WITH r AS (SELECT CAST((event_id // 4) % 8 AS INTEGER) AS step, CAST((event_id // 4) % 8 AS INTEGER) AS at_step, (event_id // 4) % 3 AS file, event_id // 4 AS g, value - 250 AS score, CASE WHEN value > 300 THEN 1.0::DOUBLE ELSE 0.0 END AS outcome,
 CAST(1 + event_id % 97 AS DOUBLE) AS len, (value - 250) / (1 + event_id % 97) AS each, event_type = 'purchase' AS boxed FROM events), gr AS (SELECT step, file, g, count(*) AS n, count(*) FILTER (outcome > 0.5) AS k FROM r GROUP BY ALL) """
PEARSON = "CASE WHEN stddev_pop({0}) * stddev_pop(len) <> 0 THEN covar_pop({0}, len) / (stddev_pop({0}) * stddev_pop(len)) END"
SUMMARIES = {"mean_length": "avg(len)", "max_length": "max(len)", "pass_rate": "avg(CAST(outcome > 0.5 AS DOUBLE))", "boxed_rate": "avg(CAST(boxed AS DOUBLE))", "cap_rate": f"avg(CAST(len >= {CAP} AS DOUBLE))"}
SUMMARIES |= {f"p{q}_length": f"quantile_cont(len, 0.{q})" for q in ("50", "95", "99")}
SUMMARIES |= {"mean_score": "avg(score)", "mean_abs_score": "avg(abs(score))", "mean_score_per_token": "avg(each)", "mean_abs_score_per_token": "avg(abs(each))"}
SUMMARIES |= {f"p{q}_{name}": f"quantile_cont({c}, 0.{q})" for name, c in (("score", "score"), ("score_per_token", "each")) for q in ("05", "50", "95")}
SUMMARIES |= {"raw_score_length_pearson": PEARSON.format("score"), "per_token_score_length_pearson": PEARSON.format("each")}
RATES = {"all_fail_rate": "k = 0", "mixed_rate": "k > 0 AND k < n", "all_correct_rate": "k = n", "zero_contrast_rate": "k = 0 OR k = n"}


def audit_sql(by: str) -> str:
    rows = f"SELECT {by}, count(*) AS n_rows, count(*) FILTER (outcome > 0.5) AS n_correct, count(DISTINCT g) AS unique_input_count, array_to_string(list_sort(list(DISTINCT at_step)), ',') AS steps, '2' AS padded_widths, true AS length_exact, {', '.join(f'round({v}, 6) AS {k}' for k, v in SUMMARIES.items())} FROM r GROUP BY GROUPING SETS (({by}), ())"
    rates = f"SELECT {by}, count(*) AS n_groups, {', '.join(f'round(avg(CAST({v} AS DOUBLE)), 6) AS {k}' for k, v in RATES.items())} FROM gr GROUP BY GROUPING SETS (({by}), ())"
    return f"{R}, a AS ({rows}), b AS ({rates}) SELECT a.*, b.* EXCLUDE ({by}) FROM a JOIN b ON a.{by} IS NOT DISTINCT FROM b.{by}"


@query(audit_sql("step"))
def audit_by_step_and_total(spark, sf_dir):
    return rounded(shown(A.audit(rollouts(spark, sf_dir), CAP)))


@query(audit_sql("file"))
def audit_by_file_and_total(spark, sf_dir):
    rows = rollouts(spark, sf_dir).withColumn("file", F.col("input").cast("long") % 3)
    return rounded(shown(A.audit(rows, CAP, "file")))


@query(R + "SELECT step, CAST(g AS VARCHAR) AS input, 'x' AS gts, n, k AS successes FROM gr")
def rollout_groups(spark, sf_dir):
    return A.groups(rollouts(spark, sf_dir))


@query(R + "SELECT s.successes, count(gr.k) AS n_groups FROM range(0, 5) s(successes) LEFT JOIN gr ON gr.k = s.successes GROUP BY s.successes")
def success_histogram(spark, sf_dir):
    return A.success_histogram(rollouts(spark, sf_dir), N)


@query("SELECT CAST(user_id % 8 AS INTEGER) AS step, CAST(user_id AS VARCHAR) AS input, 'x' AS gts, count(*) AS n, count(*) FILTER (value > 300) AS successes FROM events GROUP BY user_id HAVING count(*) <> 4 ORDER BY step, input LIMIT 3")
def group_size_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("step"), F.col("user_id").cast("string").alias("input"), F.lit("x").alias("gts"), (F.col("value") > 300).alias("success"))
    return A.wrong_sizes(rows, N)


@query("""SELECT * FROM (SELECT 'length not positive' AS rule, count(*) FILTER (event_id % 50 <= 0) AS n_bad FROM events UNION ALL SELECT 'outcomes disagree', count(*) FILTER ((event_id % 50 = 3) <> (value > 300)) FROM events
 UNION ALL SELECT 'non-finite score', count(*) FILTER (event_id % 10 = 7) FROM events UNION ALL SELECT 'group size', count(*) FROM (SELECT event_id // 5 FROM events GROUP BY 1 HAVING count(*) <> 4)) WHERE n_bad > 0""")
def rollout_violations(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("step"), F.expr("event_id div 5").cast("string").alias("input"), F.lit("x").alias("gts"), F.lit("o").alias("output"), F.when(e % 10 == 7, float("nan")).otherwise(1.0).alias("score"), F.array((F.col("value") > 300).cast("double")).alias("token_rewards"), (e % 50 == 3).cast("double").alias("scalar_reward"), (e % 50).alias("response_length"))
    return A.violations(A.resolve(rows), N)


@query("""SELECT part, CASE WHEN bool_and(t) AND bool_and(s) THEN 'true_reward_score+verifier_reward_validated' WHEN bool_and(t) THEN 'true_reward_score' WHEN bool_and(s) AND NOT bool_or(t) THEN 'verifier_reward' END AS outcome_source, count(*) AS n_rows
 FROM (SELECT event_type AS part, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true WHEN 'purchase' THEN false ELSE event_id % 2 = 0 END AS t, CASE event_type WHEN 'click' THEN false ELSE true END AS s FROM events) GROUP BY 1""")
def outcome_source(spark, sf_dir):
    """One dataset for each kind of event: token rewards, both, scalar rewards, and token rewards on some rows alone."""
    e, kind = F.col("event_id"), F.col("event_type")
    token = F.when(kind.isin("click", "view"), F.lit(True)).when(kind == "purchase", F.lit(False)).otherwise(e % 2 == 0)
    rows = table(spark, sf_dir, "events").select(kind.alias("part"), F.when(token, F.array(F.lit(1.0))).alias("token_rewards"), F.when(kind != "click", 1.0).alias("scalar_reward"))
    return A.outcome_source(rows, "part")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0 END AS r FROM lineitem), m AS (SELECT l_orderkey, r, avg(r) OVER (PARTITION BY l_orderkey) AS a FROM g),
 p AS (SELECT l_orderkey, sum(abs(r - a)) AS d, var_samp(r) AS v, count(*) FILTER (r > 0.5) AS k, count(*) AS n FROM m GROUP BY 1)
 SELECT round(sum(k) / sum(n), 6) AS pass_rate, round(avg(CAST(k = 0 AS DOUBLE)), 6) AS all_fail_rate, round(avg(CAST(k > 0 AND k < n AS DOUBLE)), 6) AS mixed_rate, round(avg(CAST(k = n AS DOUBLE)), 6) AS all_correct_rate, round(sum(d) / sum(n), 6) AS mean_abs_centred, round(avg(v), 6) AS mean_variance FROM p""")
def reward_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).cast("double").alias("r"))
    return rounded(A.reward_signals(rows, ["l_orderkey"], "r"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 6) AS advantage FROM events")
def centred_rewards(spark, sf_dir):
    return A.centred_rewards(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT count(x) AS n_values, round(avg(CAST(x = 0 AS DOUBLE)), 6) AS zero_rate, round(avg(abs(x)), 6) AS mean_abs, round(quantile_cont(abs(x), 0.5), 6) AS p50_abs, round(quantile_cont(abs(x), 0.95), 6) AS p95_abs, round(quantile_cont(abs(x), 0.99), 6) AS p99_abs, round(avg(CAST(x > 0 AS DOUBLE)), 6) AS positive_rate, round(avg(CAST(x < 0 AS DOUBLE)), 6) AS negative_rate FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, label FROM embeddings) WHERE label % 2 = 0")
def masked_token_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("x"), (F.col("label") % 2 == 0).alias("m"))
    return rounded(A.masked_stats(rows, "x", "m"))


@query("""WITH p AS (SELECT user_id, avg(s) AS a, bool_or(s <> 0) AS o, bool_and(s <> 0) AS e, sum(t) AS t, count(*) FILTER (t >= 90) AS c, count(*) AS n, sum(s) AS s FROM (SELECT user_id, CASE WHEN value > 400 THEN 1.0::DOUBLE WHEN value < 20 THEN -1.0 ELSE 0.0 END AS s, 1 + event_id % 97 AS t FROM events) GROUP BY 1)
 SELECT count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS trajectory_count, round(sum(s) / sum(n), 6) AS avg_at_n, round(avg(CAST(o AS DOUBLE)), 6) AS pass_at_n, round(avg(CAST(NOT o AS DOUBLE)), 6) AS all_fail_rate, round(avg(CAST(e AS DOUBLE)), 6) AS all_correct_rate, round(avg(CAST(o AND NOT e AS DOUBLE)), 6) AS nondegenerate_group_rate, round(sum(t) / sum(n), 6) AS mean_tokens, round(sum(c) / sum(n), 6) AS cap_hit_rate FROM p""")
def endpoint_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 400, 1.0).when(F.col("value") < 20, -1.0).otherwise(0.0).alias("s"), (1 + F.col("event_id") % 97).alias("t"))
    return rounded(A.endpoint_summary(rows, "user_id", "s", "t", CAP))


D = r"""WITH d AS (SELECT doc_id, lang, text, trim(regexp_replace(text, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS txt FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, lang, text, sha256('{"prompt":[{"content":' || CAST(to_json(txt) AS VARCHAR) || ',"role":"user"}]}') AS problem_id FROM d), g AS (SELECT problem_id, min(doc_id) AS first_row, count(*) AS n_rows, count(DISTINCT lang) AS n_answers FROM p GROUP BY 1) """


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", "lang", "text", scalars.problem_id(F.col("text")).alias("problem_id"))


@query(D + "SELECT doc_id, problem_id FROM p")
def problem_ids(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", "problem_id")


@query(D + "SELECT CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_identities, count(*) FILTER (n_answers <= 1) AS n_retained, CAST(coalesce(sum(n_rows - 1) FILTER (n_answers <= 1), 0) AS BIGINT) AS n_duplicates, count(*) FILTER (n_answers > 1) AS n_conflict_groups, CAST(coalesce(sum(n_rows) FILTER (n_answers > 1), 0) AS BIGINT) AS n_conflict_rows FROM g")
def dedup_audit(spark, sf_dir):
    return P.dedup_audit(prompts(spark, sf_dir), "problem_id", "lang", "doc_id")


@query(D + "SELECT problem_id, first_row FROM g WHERE n_answers <= 1")
def retained_prompts(spark, sf_dir):
    return P.retained(prompts(spark, sf_dir), "problem_id", "lang", "doc_id")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('11:' || p_partkey), p_partkey) - 1 AS k FROM part)
 SELECT p_partkey, CASE WHEN k < 50 THEN 'signal' WHEN k < 120 THEN 'eval' ELSE 'train_trunk' END AS split, CASE WHEN k < 50 THEN k WHEN k < 120 THEN k - 50 ELSE k - 120 END AS pos FROM r""")
def hash_split(spark, sf_dir):
    return P.split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", {"signal": 50, "eval": 70}, 11)


@query("SELECT l_suppkey, count(*) AS places FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def split_leakage(spark, sf_dir):
    return P.leakage(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct(), "l_suppkey")


QUEUE = """WITH n AS (SELECT count(*) AS n FROM supplier), q AS (SELECT s_suppkey, e.e * n.n + row_number() OVER (PARTITION BY e.e ORDER BY sha256('2:' || e.e || ':' || s_suppkey), s_suppkey) - 1 AS p, n.n AS n FROM supplier, n, range(0, 100) e(e)),
 b AS (SELECT s_suppkey, p, least(8, n) AS b FROM q), w AS (SELECT p // b AS "update", p % b AS slot, s_suppkey FROM b WHERE p < 30 * b) """


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select("s_suppkey")
    return P.prompt_queue(ids, "s_suppkey", ids.count(), 30, 8, 2)


@query(QUEUE + "SELECT * FROM w")
def prompt_queue(spark, sf_dir):
    return queue(spark, sf_dir)


@query(QUEUE + 'SELECT * FROM w WHERE "update" >= 4 AND "update" < 7')
def branch_window(spark, sf_dir):
    return P.branch_window(queue(spark, sf_dir), 4, 3)


@query(QUEUE + 'SELECT "update" AS schedule_update, slot AS schedule_slot, s_suppkey, s_name, s_acctbal FROM w JOIN supplier USING (s_suppkey)')
def prompt_schedule(spark, sf_dir):
    return P.schedule(queue(spark, sf_dir), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")


@query("""SELECT * FROM (SELECT doc_id, concat_ws('; ', CASE WHEN (length(text) - length(replace(text, '. ', ''))) // 2 <> 1 THEN 'required . ' END, CASE WHEN contains(text, '@') THEN 'forbidden @' END) AS broken FROM documents WHERE text IS NOT NULL) WHERE broken <> '' ORDER BY doc_id LIMIT 20""")
def prompt_contract(spark, sf_dir):
    return P.prompt_contract(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", [". "], ["@"])


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%'")
def train_eval_overlap(spark, sf_dir):
    side = lambda p: table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("id"))
    return P.overlap(side("1"), side("2"), "id")


@query("SELECT lang, source, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1, 2")
def level_histogram(spark, sf_dir):
    return P.level_histogram(table(spark, sf_dir, "documents"), ["lang", "source"], "text")


@query("""SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, sha256('{' || string_agg('"' || path || '":{"bytes":' || octet_length(encode(text)) || ',"sha256":"' || sha256(text) || '"}', ',' ORDER BY path) || '}') AS digest FROM (SELECT source, text, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def file_set_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))
    return I.digest_of_set(rows, ["source"], "path", "bytes", "sha")


ENDS = "WITH c AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS m, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS m, count(*) AS n FROM supplier GROUP BY 1) "


@query(ENDS + """SELECT CAST(n_nationkey AS BIGINT) AS branch_point, 'c' || n_nationkey AS opd_model_id, 's' || n_nationkey AS rl_model_id, c.m AS opd_score, s.m AS rl_score, round(s.m - c.m, 4) AS delta,
 CASE WHEN s.m IS NULL OR c.m IS NULL THEN NULL WHEN abs(s.m - c.m) <= 500::DOUBLE THEN 'indistinguishable' WHEN s.m > c.m THEN 'rl' ELSE 'opd' END AS label FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def paired_surface(spark, sf_dir):
    ends = lambda name, p, letter: table(spark, sf_dir, name).groupBy(F.concat(F.lit(letter), F.col(f"{p}_nationkey").cast("string")).alias("model_id")).agg(F.round(F.avg(f"{p}_acctbal"), 4).alias("m"))
    points = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("branch_point"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("opd_model_id"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("rl_model_id"))
    return S.surface(points, ends("customer", "c", "c").union(ends("supplier", "s", "s")), "m", 500.0).withColumn("delta", F.round("delta", 4))


@query("""SELECT * FROM (SELECT a.o_custkey AS id, concat_ws(',', CASE WHEN a.st IS DISTINCT FROM b.st THEN 'st' END, CASE WHEN a.pr IS DISTINCT FROM b.pr THEN 'pr' END) AS fields FROM
 (SELECT o_custkey, min(o_orderstatus) AS st, nullif(min(o_orderpriority), '1-URGENT') AS pr FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey, min(o_orderstatus) AS st, nullif(min(o_orderpriority), '1-URGENT') AS pr FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (o_custkey)) WHERE fields <> ''""")
def matched_fields(spark, sf_dir):
    side = lambda r: table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("st"), F.nullif(F.min("o_orderpriority"), F.lit("1-URGENT")).alias("pr"))
    return S.mismatches(side(0), side(1), "id", ["st", "pr"])


@query("SELECT event_id, 'signal_k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def flattened_signals(spark, sf_dir):
    return S.flatten_signals(table(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT k, a AS left_id, b AS right_id FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) USING (k) WHERE a IS DISTINCT FROM b")
def vocabulary_diff(spark, sf_dir):
    count = lambda df, k: df.groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n"))
    return S.vocabulary_diff(count(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_nationkey"), count(table(spark, sf_dir, "supplier"), "s_nationkey"), "k", "n")


@query("""SELECT p_partkey, sha, expected_sha FROM (SELECT p_partkey, sha256(p_name) AS sha, CASE WHEN p_size % 3 = 0 THEN sha256(p_brand) WHEN p_size % 2 = 0 THEN sha256(p_name) END AS expected_sha FROM part) WHERE sha IS DISTINCT FROM expected_sha""")
def source_drift(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = lambda df, c: df.select("p_partkey", F.sha2(c, 256).alias("sha"))
    return S.expected_hashes(named(part, "p_name"), named(part.where("p_size % 2 = 0"), "p_name"), named(part.where("p_size % 3 = 0"), "p_brand"), "p_partkey", "sha")


@query("SELECT vec_id, round(CAST(embedding[1 + label % 64] AS DOUBLE) - ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))), 6) AS logprob FROM embeddings WHERE embedding IS NOT NULL")
def selected_log_probability(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select("vec_id", F.round(scalars.log_probability(F.col("embedding"), (1 + F.col("label") % 64).cast("int")), 6).alias("logprob"))


@query("SELECT vec_id, i, round(CAST(embedding[64 - 9 + i + 1] AS DOUBLE), 6) AS x FROM embeddings, range(0, 8) t(i)")
def teacher_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scalars.response_slice(F.col("embedding"), 8)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("SELECT 't' || n_nationkey || '_' || arm AS run_id, CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey + 8 AS BIGINT) AS stop, CAST(8 * 64 * 4 AS BIGINT) AS trajectories, CAST(8 * 64 * 4 // 32 AS BIGINT) AS optimizer_steps FROM nation, (VALUES ('opd'), ('rl')) a(arm)")
def run_plan(spark, sf_dir):
    arms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("start"), F.explode(F.array(F.lit("opd"), F.lit("rl"))).alias("arm"), F.lit(8).alias("updates"))
    costs = P.dose(arms, 64, 4, 32, 1, 1024)
    return costs.select(scalars.run_id(F.concat(F.lit("t"), F.col("start").cast("string")), F.col("arm")).alias("run_id"), "start", (F.col("start") + F.col("updates")).alias("stop"), "trajectories", "optimizer_steps")


@query("SELECT p_brand || '__' || lower(p_type) AS eval_id, count(*) AS n, max(p_size) AS max_size FROM part GROUP BY 1")
def evaluation_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(scalars.evaluation_id(F.col("p_brand"), F.col("p_type")).alias("eval_id")).agg(F.count("*").alias("n"), F.max("p_size").alias("max_size"))


@query("WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_index FROM events) SELECT * FROM a")
def sample_index(spark, sf_dir):
    return A.sample_index(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "user_id", "sample_index")
