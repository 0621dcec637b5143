"""Queries that write the driver's tables through the sinks and read them back through the sources, and tables joined by place, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import places
from ..operators import protocol as P
from ..operators import records as M
from ..sources import files, locks, sinks
from ..sources.shared import shared_root, stored
from .catalogue import QUEUE, audit_sql, queue
from .catalogue_records import SPLIT, split
from .catalogue_surface import DIFFER, IDENTITY, identities
from .registry import query, rounded, shown, table


def folder_of(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}_{uuid.uuid4().hex}"


def step_files(spark, sf_dir) -> str:
    """Events as eight step files of rollouts; every seventh event has no scalar reward, every ninth one is null."""
    e, group = F.col("event_id"), F.expr("event_id div 4")
    rows = table(spark, sf_dir, "events").select(
        (group % 8).cast("int").alias("step"), F.struct(group.alias("q")).alias("input"), F.lit("x").alias("gts"), F.when(F.col("event_type") == "purchase", F.lit("\\boxed {1}")).otherwise(F.col("event_type")).alias("output"),
        (F.col("value") - 250).alias("score"), F.array(F.lit(0.0), F.when(F.col("value") > 300, 1.0).otherwise(0.0)).alias("true_reward_score"), F.when(e % 7 != 0, F.when(F.col("value") > 300, 1.0).otherwise(0.0)).alias("verifier_reward"), (1 + e % 97).alias("response_length"),
    )
    folder = folder_of(spark, "steps")
    sinks.write_steps(rows, folder, "step", ["input", "response_length", "score"])
    return folder


STEP = "(event_id // 4) % 8"


@query(f"""SELECT {STEP} || '.jsonl' AS file, {STEP} AS file_number, row_number() OVER (PARTITION BY {STEP} ORDER BY event_id // 4, event_id % 97, value) AS line, CAST({STEP} AS INTEGER) AS step, '{{"q":' || (event_id // 4) || '}}' AS input, '"x"' AS gts, round(value - 250, 6) AS score,
 CASE WHEN value > 300 THEN '0.0,1.0' ELSE '0.0,0.0' END AS token_rewards, event_id % 7 <> 0 AS has_scalar_reward, CASE WHEN event_id % 7 <> 0 THEN CAST(value > 300 AS DOUBLE) END AS scalar_reward, 1 + event_id % 97 AS response_length, false AS has_response_token_count FROM events""")
def rollout_lines(spark, sf_dir):
    rows = files.read_rollouts(spark, step_files(spark, sf_dir))
    return rounded(shown(rows.select("file", "file_number", "line", "step", "input", "gts", "score", "token_rewards", "has_scalar_reward", "scalar_reward", "response_length", "has_response_token_count")))


@query(audit_sql("step"))
def rollout_files_audit(spark, sf_dir):
    rows = A.resolve(stored(files.read_rollouts(spark, step_files(spark, sf_dir)), "rollouts"))  # the audit reads them many times
    return rounded(shown(A.audit(rows, 90)))


@query("""SELECT * FROM (SELECT CASE WHEN bool_or(t) AND NOT bool_and(t) THEN 'mixed dialects' END AS rule, CAST(1 AS BIGINT) AS n_bad, 'half' AS part FROM (SELECT event_id % 2 = 0 AS t FROM events)
 UNION ALL SELECT CASE WHEN count(*) = 0 THEN 'no rows' END, 1, 'none' FROM events WHERE event_id < 0 UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'group size' END, count(*), part FROM (SELECT 'half' AS part, event_id // 4 FROM events GROUP BY 1, 2 HAVING count(*) <> 4) GROUP BY 3) WHERE rule IS NOT NULL""")
def dialect_violations(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("step"), F.expr("event_id div 4").cast("string").alias("input"), F.lit("x").alias("gts"), F.lit("o").alias("output"), F.lit(1.0).alias("score"), F.when(e % 2 == 0, F.array(F.lit(1.0))).alias("token_rewards"), F.when(e % 2 == 1, 1.0).alias("scalar_reward"), F.lit(3).alias("response_length"), "event_id")
    half = A.violations(A.resolve(rows), 4).withColumn("part", F.lit("half"))
    return half.unionByName(A.violations(A.resolve(rows.where("event_id < 0")), 4).withColumn("part", F.lit("none")))


@query("""SELECT s_suppkey AS place, s_suppkey % 5 = 0 AS flag, s_name AS name, s_nationkey AS nation FROM supplier""")
def json_object_files(spark, sf_dir):
    folder = folder_of(spark, "objects")
    k = F.col("s_suppkey")
    text = sinks.document([F.col("s_name").alias("name"), F.struct(k.alias("place"), F.col("s_nationkey").alias("nation")).alias("inner"), (k % 5 == 0).alias("flag")])
    sinks.write_documents(table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k.cast("string"), F.lit("/summary.json")).alias("path"), text.alias("text")), folder, "path", "text")
    rows = files.read_json_objects(spark, f"{folder}/*/summary.json", "name string, flag boolean, inner struct<place: long, nation: long>")
    return rows.select(F.regexp_extract("folder", "/d([0-9]+)$", 1).cast("long").alias("place"), "flag", "name", F.col("inner.nation").alias("nation"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS index, s_suppkey, s_name FROM supplier")
def json_list(spark, sf_dir):
    folder = folder_of(spark, "list")
    rows = table(spark, sf_dir, "supplier").agg(F.to_json(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))).alias("text"))
    sinks.write_documents(rows.select(F.lit("list.json").alias("path"), "text"), folder, "path", "text")
    return files.read_json_list(spark, f"{folder}/list.json", "s_suppkey long, s_name string")


@query("""SELECT 'f' || (s_suppkey % 3) || '/' || s_suppkey || '.txt' AS path, CAST(octet_length(encode(s_name)) * (1 + s_suppkey % 4) AS BIGINT) AS bytes, sha256(repeat(s_name, CAST(1 + s_suppkey % 4 AS INTEGER))) AS sha256 FROM supplier WHERE s_suppkey % 9 <> 0""")
def tree_hashes(spark, sf_dir):
    k = F.col("s_suppkey")
    folder = folder_of(spark, "tree")
    name = F.when(k % 9 == 0, F.concat(F.lit("f0/x"), k.cast("string"), F.lit("/identity.json"))).otherwise(F.concat(F.lit("f"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".txt")))  # sidecars are left out
    sinks.write_documents(table(spark, sf_dir, "supplier").select(name.alias("path"), F.expr("repeat(s_name, cast(1 + s_suppkey % 4 as int))").alias("text")), folder, "path", "text")
    return files.tree(spark, folder)


@query("""SELECT * FROM (SELECT 'file ' || s_suppkey || '.parquet' AS fact, CASE WHEN s_suppkey % 10 <> 4 THEN sha256(s_name) END AS value, CASE s_suppkey % 10 WHEN 3 THEN sha256('other') WHEN 5 THEN NULL ELSE sha256(s_name) END AS expected FROM supplier) WHERE expected IS NOT NULL AND value IS DISTINCT FROM expected""")
def file_drift(spark, sf_dir):
    """Data files against pinned hashes: some have another, some are gone, some are not pinned."""
    k, suppliers, folder = F.col("s_suppkey"), table(spark, sf_dir, "supplier"), folder_of(spark, "data")
    name = F.concat(k.cast("string"), F.lit(".parquet"))
    sinks.write_documents(suppliers.where(k % 10 != 4).select(name.alias("path"), F.col("s_name").alias("text")), folder, "path", "text")
    pinned = suppliers.where(k % 10 != 5).select(name.alias("path"), F.when(k % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return P.drift(P.file_facts(files.tree(spark, folder)), P.file_facts(pinned))


@query("SELECT n_nationkey, sha256(n_name || chr(10) || n_name || chr(10) || chr(10) || 'end') AS sha256 FROM nation")
def normalized_text_hashes(spark, sf_dir):
    folder = folder_of(spark, "texts")
    text = F.concat("n_name", F.lit("\r\n"), "n_name", F.lit("\r\n\r"), F.lit("end"))
    sinks.write_documents(table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text")), folder, "path", "text")
    return files.normalized_text_hash(spark, folder).select(F.regexp_extract("path", "/([0-9]+)[.]py$", 1).cast("long").alias("n_nationkey"), "sha256")


@query(SPLIT + "SELECT p_partkey, split, pos, p_name, p_size FROM s JOIN part USING (p_partkey)")
def split_files(spark, sf_dir):
    path = folder_of(spark, "splits")
    sinks.write_splits(P.split_records(split(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey"), path)
    return files.read_parquet(spark, path, ["p_partkey", "split", "pos"]).select("p_partkey", "split", "pos", "p_name", "p_size")


@query(QUEUE + 'SELECT "update" AS schedule_update, slot AS schedule_slot, s_suppkey, s_name FROM w JOIN supplier USING (s_suppkey)')
def schedule_file(spark, sf_dir):
    path = folder_of(spark, "schedule")
    sinks.write_schedule(P.schedule(queue(spark, sf_dir), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey"), path)
    return files.read_parquet(spark, path, ["schedule_update", "schedule_slot", "s_suppkey"])


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def trajectory_lines(spark, sf_dir):
    path = folder_of(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value")), path)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS phone FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier")
def surface_csv(spark, sf_dir):
    path = folder_of(spark, "csv")
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("phone"))
    sinks.write_csv([left, right], path)
    return spark.read.option("header", True).csv(path)


@query("""SELECT p_brand AS path, sha256('{"brand":"' || p_brand || '","mean_size":' || mean || ',"n":' || n || ',"none":null}') AS sha256 FROM (SELECT p_brand, CAST(max(p_size) AS BIGINT) AS mean, count(*) AS n FROM part GROUP BY 1)""")
def written_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("mean"))
    text = sinks.document([F.col("n"), F.col("mean").alias("mean_size"), F.lit(None).cast("string").alias("none"), F.col("p_brand").alias("brand")])
    written = sinks.write_documents(rows.select("p_brand", text.alias("text")), folder_of(spark, "documents"), "p_brand", "text")
    return written.select("path", "sha256")


@query("SELECT count(*) AS n_rows, round(avg(value), 6) AS mean_value, max(event_type) AS last_type FROM events")
def audit_report(spark, sf_dir):
    row = table(spark, sf_dir, "events").agg(F.count("*").alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("event_type").alias("last_type"))
    folder = folder_of(spark, "report")
    sinks.write_documents(row.select(F.lit("report.json").alias("path"), sinks.document([F.col(c) for c in row.columns]).alias("text")), folder, "path", "text")
    return files.read_json_objects(spark, f"{folder}/report.json", "n_rows long, mean_value double, last_type string").select("n_rows", "mean_value", "last_type")


@query("""SELECT 'columns' AS rule, 'level,prompt,id,data_source,ability,reward_model,extra_info' AS found, 'prompt,level,id,data_source,ability,reward_model,extra_info' AS wanted FROM part GROUP BY 1 UNION ALL SELECT 'rows', CAST(count(*) FILTER (p_partkey % 101 <> 0) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM part""")
def native_contract(spark, sf_dir):
    source = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("answer"), F.col("p_size").alias("level"), F.col("p_type").alias("id"))
    native = M.native_records(source, "place").where("_index % 101 <> 0").drop("_index")
    return M.native_violations(source, native.select("level", "prompt", *native.columns[2:]))


MOVED = "o_orderkey + CASE WHEN o_orderkey % 97 = 7 THEN 60 ELSE 0 END"


@query(f"""WITH l AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), r AS (SELECT o_orderkey AS output_id, o_custkey % 3 + 1 AS n, row_number() OVER (ORDER BY {MOVED}, o_orderkey) - 1 AS place FROM orders)
 SELECT id, place, CAST(n AS BIGINT) AS n_samples, CAST(i AS BIGINT) AS sample_index, output_id || ':' || i AS sample FROM l JOIN r USING (place), range(0, 3) t(i) WHERE i < n""")
def outputs_by_place(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    samples = F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 3).cast("int")), lambda i: F.concat(k.cast("string"), F.lit(":"), i.cast("string")))
    outputs = orders.select((k + F.when(k % 97 == 7, 60).otherwise(0)).alias("moved"), k.alias("output_id"), samples.alias("samples"))
    return places.sampled(orders.select(k.alias("id")), outputs, ["id"], ["moved", "output_id"], "samples")


@query("""SELECT event_id, 1 + event_id % 97 AS supplied_length FROM events""")
def supplied_lengths(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lengths = events.select(F.col("event_id").alias("at"), (1 + F.col("event_id") % 97).alias("n"))
    return places.with_supplied_lengths(events.select("event_id"), lengths, ["event_id"], ["at"], "n")


@query(IDENTITY + f", heads AS (SELECT *, min(ck) OVER (PARTITION BY grp) AS head FROM i WHERE grp % 4 <> 3) SELECT * FROM (SELECT b.ck, b.grp, concat_ws(',', {DIFFER}) AS fields FROM heads a JOIN heads b ON a.ck = b.head) WHERE fields <> ''")
def locked_identities(spark, sf_dir):
    rows = identities(spark, sf_dir).withColumn("grp", F.when(F.col("grp") % 4 != 3, F.col("grp"))).withColumn("seq", F.col("ck"))
    return locks.lock_groups(rows, folder_of(spark, "locks"), "grp", "seq", "ck")
