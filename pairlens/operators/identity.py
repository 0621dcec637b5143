"""Identities of file sets and checkpoints: digests over files, comparison, locks by group, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EMPTY_SHA256, is_sha256
from .digests import ordered_digest

# The digests and numbers that make up the identity of a checkpoint.
DIGESTS = ("actor_hash", "config_hash", "dataloader_hash", "optimizer_hash", "prompt_window_hash", "source_manifest_hash", "trainer_state_hash")
NUMBERS = ("global_step", "rollout_seed")
# Files without which an actor's checkpoint is not whole, and those a model must have.
ACTOR_FILES = ("model_world_size_1_rank_0.pt", "extra_state_world_size_1_rank_0.pt", "fsdp_config.json", "huggingface/config.json", "huggingface/tokenizer.json")
MODEL_FILES = ("config.json", "tokenizer.json")


def digest_of_set(entries: DataFrame, keys: list[str], path: str, size: str, sha: str) -> DataFrame:
    """Per set of files: number, bytes and SHA-256 of the canonical JSON object of path to bytes and sha256, paths in order.

    The digest runs over each set's sorted entries from batch to batch; a set may be of any size.
    """
    body = F.concat(F.lit('{"bytes":'), F.col(size).cast("string"), F.lit(',"sha256":"'), F.col(sha), F.lit('"}'))
    name = F.regexp_extract(F.to_json(F.array(F.col(path))), r"(?s)^\[(.*)\]$", 1)
    found = ordered_digest(entries, keys, [path], F.concat(name, F.lit(":"), body), opening="{", closing="}", total=F.col(size))
    return found.select(*keys, F.col("n_entries").alias("n_files"), F.col("total").alias("n_bytes"), "digest")


def checkpoint_class(path: Column) -> Column:
    """The part of a checkpoint that a file (path from the checkpoint's folder) belongs to; null for others."""
    name = F.substring_index(path, "/", -1)
    top = path.rlike(r"^actor/[^/]+$")
    return (
        F.when(path == "data.pt", "dataloader_hash")
        .when(top & name.rlike(r"^optim_.*\.pt$"), "optimizer_hash")
        .when(top & name.rlike(r"^extra_state_.*\.pt$"), "trainer_state_hash")
        .when(path.startswith("actor/") & ~name.startswith("optim_") & ~name.startswith("extra_state_"), "actor_hash")
    )


def checkpoint_hashes(files: DataFrame, checkpoint: str) -> DataFrame:
    """One row for each checkpoint: a digest for each class of its ``files`` (checkpoint, path, bytes, sha256); null where a class has none."""
    classed = files.withColumn("class", checkpoint_class(F.col("path"))).where("class is not null")
    digests = digest_of_set(classed, [checkpoint, "class"], "path", "bytes", "sha256")
    at = lambda c: F.max(F.when(F.col("class") == c, F.col("digest"))).alias(c)
    return digests.groupBy(checkpoint).agg(*[at(c) for c in ("actor_hash", "optimizer_hash", "trainer_state_hash", "dataloader_hash")])


def fresh_hashes(models: DataFrame, model: str, actor_hash: str) -> DataFrame:
    """Identity parts of models without a checkpoint: the model's digest, and that of nothing for what it does not have."""
    empty = F.lit(EMPTY_SHA256)
    return models.select(model, F.col(actor_hash).alias("actor_hash"), empty.alias("optimizer_hash"), empty.alias("trainer_state_hash"), empty.alias("dataloader_hash"))


def pre_intervention(runs: DataFrame, checkpoints: DataFrame, models: DataFrame) -> DataFrame:
    """What each run starts from: its parts, identity_sha256 and kind (resumed_checkpoint or fresh_model).

    ``runs`` have execution_id, identity_group, resume_from (a checkpoint, or null) and model, and the
    parts that no file tells; ``checkpoints`` are ``checkpoint_hashes`` by checkpoint, ``models``
    ``fresh_hashes`` by model. A fresh model starts at step 0; parts that are not found are null.
    """
    hashes = ("actor_hash", "optimizer_hash", "trainer_state_hash", "dataloader_hash")
    named = lambda df, key, prefix: df.select(F.col(key), *[F.col(h).alias(f"{prefix}_{h}") for h in hashes])
    rows = runs.join(named(checkpoints, "checkpoint", "_c").withColumnRenamed("checkpoint", "resume_from"), "resume_from", "left").join(named(models, "model", "_m"), "model", "left")
    resumed = F.col("resume_from").isNotNull()
    whole = rows.select("execution_id", "identity_group", F.when(resumed, "resumed_checkpoint").otherwise("fresh_model").alias("kind"), F.when(resumed, F.col("global_step")).otherwise(0).cast("long").alias("global_step"), "rollout_seed", "config_hash", "prompt_window_hash", "source_manifest_hash", *[F.when(resumed, F.col(f"_c_{h}")).otherwise(F.col(f"_m_{h}")).alias(h) for h in hashes])
    return with_identity(whole)


def identity_violations(identities: DataFrame, key: str) -> DataFrame:
    """(key, field) of parts that are missing or malformed."""
    tests = [F.when(F.coalesce(F.col("global_step") < 0, F.lit(True)), "global_step")] + [F.when(~is_sha256(F.col(f)), f) for f in DIGESTS]
    return identities.select(key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("field"))


def with_identity(identities: DataFrame) -> DataFrame:
    """Adds identity_sha256: SHA-256 of the canonical JSON of all parts."""
    parts = [F.col(f).cast("long").alias(f) if f in NUMBERS else F.col(f) for f in sorted((*DIGESTS, *NUMBERS))]
    return identities.withColumn("identity_sha256", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def differing(left: str, right: str) -> Column:
    """Names of the parts in which two aliased identities differ."""
    names = [F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), f) for f in (*NUMBERS, *DIGESTS)]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def identity_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, fields) of pairs whose identities differ."""
    both = left.alias("l").join(right.alias("r"), key)
    return both.select(key, F.array_join(differing("l", "r"), ",").alias("fields")).where("fields <> ''")


def lock_violations(identities: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(key, group, fields) of members that differ from their group's first by ``order``; rows without a group are free."""
    some = identities.where(F.col(group).isNotNull())
    parts = F.struct(*NUMBERS, *DIGESTS)
    first = F.first(parts).over(Window.partitionBy(group).orderBy(order, key))  # a group is one branch point's runs
    held = some.select(key, group, parts.alias("own"), first.alias("locked"))
    return held.select(key, group, F.array_join(differing("locked", "own"), ",").alias("fields")).where("fields <> ''")


def missing_files(files: DataFrame, folder: str, path: str, required: tuple[str, ...] = ACTOR_FILES) -> DataFrame:
    """(folder, missing) for folders that lack required files."""
    have = files.groupBy(folder).agg(F.collect_set(F.when(F.col(path).isin(*required), F.col(path))).alias("have"))
    return have.select(folder, F.array_join(F.array_except(F.array(*[F.lit(r) for r in required]), "have"), ",").alias("missing")).where("missing <> ''")


def model_files(files: DataFrame, path: str) -> DataFrame:
    """The files of a model's folder that its manifest lists: settings, templates, texts and weights, none of them partial, none in a subfolder."""
    name = F.col(path)
    return files.where(~name.contains("/") & (name.rlike(r"\.(json|jinja|txt)$") | name.endswith(".safetensors")) & ~name.contains(".partial"))
