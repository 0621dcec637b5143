"""Queries of tokenizers and chat templates over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.templates import rendered_by
from ..operators import tokenizer_parity as T
from ..operators import protocol as P
from ..operators import records as M
from ..sources import sinks
from ..sources.shared import shared_root
from .registry import query, table

# Two shapes of templates: every turn between marks, and answers after instructions with the system turn inside the first.
MARKED = "{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}{{ '<|im_start|>system\nBe brief.<|im_end|>\n' }}{% endif %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% if enable_thinking is defined and not enable_thinking %}{{ '<think>\n\n</think>\n\n' }}{% endif %}{% endif %}"
INSTRUCTED = "{%- if messages[0].role == 'system' -%}{% set turns = messages[1:] %}{% set system = messages[0].content | trim %}{%- else -%}{% set turns = messages %}{% set system = false %}{%- endif -%}{% for message in turns %}{% set content = '<<SYS>>\n' ~ system ~ '\n<</SYS>>\n\n' ~ message.content if loop.index0 == 0 and system else message.content %}{% if message.role == 'user' %}{{ bos_token ~ '[INST] ' ~ content | trim ~ ' [/INST]' }}{% elif message.role == 'assistant' %}{{ ' ' ~ content | trim ~ ' ' ~ eos_token }}{% endif %}{% endfor %}"


def prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


C = "WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations), h AS (SELECT conv_id, role AS first_role, text AS first_text FROM t WHERE i = 1) "


@query(C + "SELECT t.conv_id, sha256(CASE WHEN any_value(first_role) <> 'system' THEN '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) ELSE '' END || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS sha FROM t JOIN h USING (conv_id) GROUP BY 1")
def rendered_prompts(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", F.sha2(rendered_by(MARKED, F.col("messages"), add_generation_prompt=True, enable_thinking=False), 256).alias("sha"))


SAID = r"regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+$', '')"


@query(C + f", u AS (SELECT conv_id, role, i, CASE WHEN first_role = 'system' AND i = 2 AND {SAID.replace('x,', 'first_text,')} <> '' THEN '<<SYS>>' || chr(10) || {SAID.replace('x,', 'first_text,')} || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text ELSE text END AS x, first_role = 'system' AND i = 1 AS head FROM t JOIN h USING (conv_id)) SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN role = 'user' THEN '<s>[INST] ' || {SAID} || ' [/INST]' WHEN role = 'assistant' THEN ' ' || {SAID} || ' </s>' ELSE '' END, '' ORDER BY i) FILTER (NOT head), '')) AS sha FROM u GROUP BY 1")
def instructed_prompts(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", F.sha2(rendered_by(INSTRUCTED, F.col("messages"), bos_token="<s>", eos_token="</s>"), 256).alias("sha"))


def tokenizers(spark, sf_dir):
    """Two tokenizers whose words are the names of parts: some ids, some words, an added token, a named token and the template differ."""
    words = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    entries = lambda keep, number: F.map_from_entries(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("p_name").alias("k"), number.alias("v"))))))
    k = F.col("id")
    both = words.agg(entries(k >= 0, k).alias("left"), entries(k % 11 != 3, F.when(k % 7 == 0, k + 100_000).otherwise(k)).alias("right"))
    added = lambda special: F.array(F.struct(F.lit(900_000).alias("id"), F.lit("<s>").alias("content"), F.lit(False).alias("single_word"), F.lit(special).alias("special")))
    file = lambda vocab, special: F.to_json(F.struct(F.lit("1.0").alias("version"), added(special).alias("added_tokens"), F.struct(F.lit("WordLevel").alias("type"), F.col(vocab).alias("vocab")).alias("model")))
    settings = lambda bos, end: F.to_json(F.struct(F.lit(bos).alias("bos_token"), F.struct(F.lit("<s>").alias("content")).alias("eos_token"), F.lit("{{ messages }}" + end).alias("chat_template")))
    return both.select(F.inline(F.array(F.struct(F.lit("student").alias("model"), file("left", True).alias("tokenizer"), settings("<s>", "").alias("settings")), F.struct(F.lit("teacher").alias("model"), file("right", False).alias("tokenizer"), settings("<none>", ".").alias("settings")))))


W = "WITH w AS (SELECT p_name AS key, min(p_partkey) AS id FROM part GROUP BY 1), "


@query(W + """r AS (SELECT key, CASE WHEN id % 7 = 0 THEN id + 100000 ELSE id END AS id FROM w WHERE id % 11 <> 3), v AS (SELECT 'vocabulary' AS part, key, CAST(w.id AS VARCHAR) AS left_value, CAST(r.id AS VARCHAR) AS right_value FROM w FULL JOIN r USING (key) WHERE w.id IS DISTINCT FROM r.id ORDER BY key LIMIT 20)
 SELECT * FROM v UNION ALL SELECT * FROM (VALUES ('added token', '900000', '{"content":"<s>","id":900000,"single_word":false,"special":true}', '{"content":"<s>","id":900000,"single_word":false,"special":false}'), ('special token', 'bos_token', '<s>', '<none>'), ('special id', 'bos_token', '900000', NULL), ('template', 'chat_template', '{{ messages }}', '{{ messages }}.')) x(part, key, left_value, right_value)""")
def tokenizer_differences(spark, sf_dir):
    return T.parity_violations(T.tokenizer_parts(tokenizers(spark, sf_dir), probe=False), "student", "teacher")


@query(W + """a AS (SELECT 'student' AS model, key, id FROM w UNION ALL SELECT 'teacher', key, CASE WHEN id % 7 = 0 THEN id + 100000 ELSE id END FROM w WHERE id % 11 <> 3), b AS (SELECT * FROM a UNION ALL SELECT DISTINCT model, '<s>', 900000 FROM a)
 SELECT model, count(*) AS vocab_size, sha256('{' || string_agg('"' || key || '":' || id, ',' ORDER BY key) || '}') AS vocabulary_sha256 FROM b GROUP BY 1""")
def tokenizer_manifests(spark, sf_dir):
    models = tokenizers(spark, sf_dir)
    return T.tokenizer_manifest(models, T.tokenizer_parts(models, probe=False)).select("model", "vocab_size", "vocabulary_sha256")


WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+'))"


def measured(spark, sf_dir):
    """Documents with their lengths by a tokenizer of words and marks, whose vocabulary is the languages' names."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    entry = F.struct(F.col("lang").alias("k"), F.xxhash64("lang").alias("v"))
    vocabulary = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(entry)).alias("v"))
    numbered = F.map_from_entries(F.concat(F.array(F.struct(F.lit("[UNK]").alias("k"), F.lit(0).alias("v"))), F.transform("v", lambda x, i: F.struct(x["k"].alias("k"), (i + 1).alias("v")))))
    file = F.to_json(F.struct(F.lit("1.0").alias("version"), F.struct(F.lit("Whitespace").alias("type")).alias("pre_tokenizer"), F.struct(F.lit("WordLevel").alias("type"), numbered.alias("vocab"), F.lit("[UNK]").alias("unk_token")).alias("model")))
    folder = f"{shared_root(spark)}/tokenizer_{uuid.uuid4().hex}"
    sinks.write_documents(vocabulary.select(F.lit("tokenizer.json").alias("path"), file.alias("text")), folder, "path", "text")
    return M.token_lengths(docs.select("doc_id", "text"), "text", f"{folder}/tokenizer.json")


@query(f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_lengths(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", "n_tokens")


@query(f"SELECT CAST(300 AS BIGINT) AS prompt_cap, count(*) FILTER (n > 300) AS n_overlong, CAST(max(n) AS BIGINT) AS max_before, CAST(max(n) FILTER (n <= 300) AS BIGINT) AS max_after FROM (SELECT {WORDS} AS n FROM documents WHERE text IS NOT NULL)")
def token_length_audit(spark, sf_dir):
    return P.length_audit(measured(spark, sf_dir), "n_tokens", 300)
