"""Two tokenizers compared part by part: their files are opened into one long table, and parts are joined."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .digests import ordered_digest

# The text that both must encode alike, and the named tokens of a tokenizer's settings; those of which the ids are compared come first.
PROBE = "Token compatibility probe: 1 + 1 = 2; \\boxed{2}."
NAMED = ("bos_token", "eos_token", "pad_token", "unk_token", "sep_token", "cls_token", "mask_token")
WITH_ID = NAMED[:3]

_ADDED = "array<struct<id:long,content:string,single_word:boolean,lstrip:boolean,rstrip:boolean,normalized:boolean,special:boolean>>"
_ONE = f"model struct<vocab:map<string,long>>, added_tokens {_ADDED}"
_LISTED = "model struct<vocab:array<array<string>>>"


@F.pandas_udf(ArrayType(LongType()))
def _encoded(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ids of the probe, without special ids, by each tokenizer file."""
    from tokenizers import Tokenizer

    for texts in files:
        yield pd.Series([None if t is None else Tokenizer.from_str(t).encode(PROBE, add_special_tokens=False).ids for t in texts])


def _token_text(setting: Column) -> Column:
    """A named token: a text, or an object with its content."""
    return F.coalesce(F.get_json_object(setting, "$.content"), setting)


def tokenizer_parts(models: DataFrame, probe: bool = True) -> DataFrame:
    """(model, part, key, value) of tokenizers; ``models`` has model, tokenizer (its JSON file) and settings (that of its configuration).

    Parts: vocabulary (token to id, added tokens included), added token (id to its canonical JSON),
    special token and special id (by name), template, probe (place to id). What a file does not have
    has no row. Vocabularies may be objects, or lists whose places are the ids.
    """
    opened = models.select("model", F.from_json("tokenizer", _ONE).alias("t"), F.from_json("tokenizer", _LISTED)["model"]["vocab"].alias("listed"), "settings")
    entry = "array<struct<key:string,value:long>>"
    mapped = F.coalesce(F.map_entries("t.model.vocab").cast(entry), F.transform("listed", lambda x, i: F.struct(x[0].alias("key"), i.cast("long").alias("value"))).cast(entry), F.array().cast(entry))
    more = F.coalesce(F.transform("t.added_tokens", lambda a: F.struct(a["content"].alias("key"), a["id"].alias("value"))).cast(entry), F.array().cast(entry))
    row = lambda part, key, value: [F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value")]
    vocabulary = opened.select("model", F.explode(F.concat(mapped, more)).alias("e")).select("model", F.col("e.key").alias("token"), F.col("e.value").alias("id")).distinct()
    added = opened.select("model", F.explode("t.added_tokens").alias("a")).select("model", *row("added token", F.col("a.id"), F.to_json(F.try_parse_json(F.to_json("a")))))
    settings = [F.struct(F.lit(n).alias("name"), _token_text(F.get_json_object("settings", f"$.{n}")).alias("token")) for n in NAMED]
    named = opened.select("model", F.explode(F.array(*settings)).alias("s")).select("model", "s.*").where("token is not null")
    special = named.select("model", *row("special token", F.col("name"), F.col("token")))
    listed = opened.select("model", *row("special token", F.lit("additional_special_tokens"), F.to_json(F.try_parse_json(F.get_json_object("settings", "$.additional_special_tokens")))))
    ids = named.where(F.col("name").isin(*WITH_ID)).join(vocabulary, ["model", "token"]).select("model", *row("special id", F.col("name"), F.col("id")))
    template = opened.select("model", *row("template", F.lit("chat_template"), F.get_json_object("settings", "$.chat_template")))
    parts = vocabulary.select("model", *row("vocabulary", F.col("token"), F.col("id")))
    for other in (added, special, listed, ids, template):
        parts = parts.unionByName(other)
    if probe:
        found = models.select("model", F.posexplode(_encoded("tokenizer")).alias("place", "id"))
        parts = parts.unionByName(found.select("model", *row("probe", F.col("place"), F.col("id"))))
    return parts.where("value is not null")


def parity_violations(parts: DataFrame, left: str, right: str, preview: int | None = 20) -> DataFrame:
    """(part, key, left_value, right_value) where two models differ or one has nothing; the first ``preview`` of each part in the order of keys, or all."""
    side = lambda name, value: parts.where(F.col("model") == name).select("part", "key", F.col("value").alias(value))
    differ = side(left, "left_value").join(side(right, "right_value"), ["part", "key"], "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    if preview is None:
        return differ
    return differ.withColumn("_place", F.row_number().over(Window.partitionBy("part").orderBy("key"))).where(F.col("_place") <= preview).drop("_place")


def check_parity(parts: DataFrame, left: str, right: str) -> None:
    """Raise on the parts in which two models differ, with the first keys of each."""
    found = parity_violations(parts, left, right).orderBy("part", "key").collect()  # twenty a part
    if found:
        by_part: dict[str, list[str]] = {}
        for r in found:
            by_part.setdefault(r.part, []).append(r.key)
        raise ValueError("; ".join(f"{left} and {right} differ in {part}: {keys}" for part, keys in by_part.items()))


def tokenizer_manifest(models: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each model: the hash of its tokenizer file, the size and digest of its vocabulary (canonical JSON, tokens in order), the digest of the probe's ids."""
    quoted = F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1)
    vocabulary = ordered_digest(parts.where("part = 'vocabulary'"), ["model"], ["key"], F.concat(quoted, F.lit(":"), "value"), opening="{", closing="}").select("model", F.col("n_entries").alias("vocab_size"), F.col("digest").alias("vocabulary_sha256"))
    probe = parts.where("part = 'probe'").select("model", F.col("key").try_cast("long").alias("place"), "value")
    ids = ordered_digest(probe, ["model"], ["place"], F.col("value"), opening="[", closing="]").select("model", F.col("digest").alias("probe_sha256"))
    return models.select("model", F.sha2("tokenizer", 256).alias("tokenizer_sha256")).join(vocabulary, "model", "left").join(ids, "model", "left")
