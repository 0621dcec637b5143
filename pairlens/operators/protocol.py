"""Deterministic data preparation: dedup and conflict audit, hash-rank splits, prompt queues, schedules, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, normalize_messages, occurrences
from .digests import ordered_digest


def identity_groups(records: DataFrame, pid: str, answer: str, order: str) -> DataFrame:
    """One row for each identity: its first row, its number of rows and of different answers."""
    return records.groupBy(pid).agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows"), F.count_distinct(answer).alias("n_answers"))


def retained(records: DataFrame, pid: str, answer: str, order: str) -> DataFrame:
    """First row of every identity that has a single answer, in their order."""
    return identity_groups(records, pid, answer, order).where("n_answers <= 1").select(pid, F.col("first_row")).orderBy("first_row")


def dedup_audit(records: DataFrame, pid: str, answer: str, order: str) -> DataFrame:
    """One row: rows, identities, retained, duplicates dropped, conflict groups and rows."""
    clash = F.col("n_answers") > 1
    return identity_groups(records, pid, answer, order).agg(
        F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_identities"), F.count_if(~clash).alias("n_retained"),
        F.coalesce(F.sum(F.when(~clash, F.col("n_rows") - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(clash).alias("n_conflict_groups"), F.coalesce(F.sum(F.when(clash, F.col("n_rows"))), F.lit(0)).alias("n_conflict_rows"),
    )


def hash_rank(ids: DataFrame, pid: str, seed: int, within: str | None = None) -> DataFrame:
    """Adds rank (from 0) by SHA-256 of "seed:id", or of "seed:within:id" for each value of the column ``within``.

    A global rank without one big window: counts of 4096 prefix buckets give each bucket
    its start (4096 rows at most for each value), and ranks inside a bucket are windows of their own.
    """
    part = [F.col(within).cast("string"), F.lit(":")] if within else []
    own = [within] if within else []
    keyed = ids.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), *part, F.col(pid).cast("string")), 256)).withColumn("bucket", F.substring("digest", 1, 3))
    starts = keyed.groupBy(*own, "bucket").agg(F.count("*").alias("c"))
    starts = starts.select(*own, "bucket", (F.sum("c").over(Window.partitionBy(*own).orderBy("bucket")) - F.col("c")).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*own, "bucket").orderBy("digest", pid)) - 1
    return keyed.withColumn("r", inside).join(starts if within else F.broadcast(starts), [*own, "bucket"]).withColumn("rank", (F.col("base") + F.col("r")).cast("long")).drop("bucket", "base", "r", "digest")


def split_violations(ids: DataFrame, pid: str, sizes: dict[str, int]) -> DataFrame:
    """(rule, n_bad): ids that occur again, and held-out sizes that leave nothing for the trunk."""
    again = ids.groupBy(pid).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit("duplicate id").alias("rule"), F.count("*").alias("n_bad"))
    short = ids.agg(F.lit("nothing left for the trunk").alias("rule"), F.when(F.count("*") <= sum(sizes.values()), 1).otherwise(0).cast("long").alias("n_bad"))
    return again.union(short).where("n_bad > 0")


def split(ids: DataFrame, pid: str, sizes: dict[str, int], seed: int, rest: str = "train_trunk") -> DataFrame:
    """(id, split, pos): ranked ids cut into the named ranges in order; what is left is the trunk."""
    if any(n <= 0 for n in sizes.values()):
        raise ValueError("split sizes must be positive")
    low, name, base = 0, F.lit(rest), F.lit(sum(sizes.values()))
    cuts = []
    for key, n in sizes.items():
        cuts.append((low, low + n, key))
        low += n
    for a, b, key in reversed(cuts):
        here = (F.col("rank") >= a) & (F.col("rank") < b)
        name, base = F.when(here, key).otherwise(name), F.when(here, a).otherwise(base)
    return hash_rank(ids, pid, seed).select(pid, name.alias("split"), (F.col("rank") - base).cast("long").alias("pos"))


def leakage(splits: DataFrame, pid: str) -> DataFrame:
    """Ids in more than one place."""
    return splits.groupBy(pid).agg(F.count("*").alias("places")).where("places > 1")


def prompt_queue(ids: DataFrame, pid: str, n_ids: int, updates: int, batch: int, seed: int) -> DataFrame:
    """(update, slot, id): epochs of all ids, each in its own hash order, cut into batches; with fewer ids than a batch, one epoch is a batch."""
    if min(n_ids, updates, batch) <= 0:
        raise ValueError("ids, updates and the batch must be positive")
    size = min(batch, n_ids)
    total = updates * size
    epochs = -(-total // n_ids)
    every = ids.select(pid, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    place = F.col("epoch") * F.lit(n_ids).cast("long") + F.col("rank")
    return hash_rank(every, pid, seed, "epoch").withColumn("p", place).where(F.col("p") < total).select(F.expr(f"p div {size}").alias("update"), (F.col("p") % size).alias("slot"), pid)


def branch_window(queue: DataFrame, start: int, horizon: int, updates: int | None = None) -> DataFrame:
    """Batches start to start + horizon - 1 of a queue of ``updates`` batches."""
    if start < 0 or horizon <= 0 or updates is not None and start + horizon > updates:
        raise ValueError("the branch window falls outside the queue")
    return queue.where((F.col("update") >= start) & (F.col("update") < start + horizon))


def stage_of(queue: DataFrame, stop: int) -> DataFrame:
    """The queue with stage: initial before update ``stop``, else continuation, and the update within it."""
    first = F.col("update") < stop
    return queue.withColumn("stage", F.when(first, "initial").otherwise("continuation")).withColumn("stage_update", F.when(first, F.col("update")).otherwise(F.col("update") - stop))


def schedule(queue: DataFrame, records: DataFrame, pid: str) -> DataFrame:
    """Queue rows with their records' columns."""
    return queue.join(records, pid).withColumnsRenamed({"update": "schedule_update", "slot": "schedule_slot"})


def split_records(splits: DataFrame, records: DataFrame, pid: str) -> DataFrame:
    """Records of each split in the order of their places: id first, then split, pos and the record's columns."""
    return splits.join(records, pid).select(pid, "split", "pos", *[c for c in records.columns if c != pid])


def split_digests(splits: DataFrame, pid: str) -> DataFrame:
    """For each split its number of ids and the SHA-256 of the canonical JSON list of them in order; a split may be of any size."""
    found = ordered_digest(splits, ["split"], ["pos"], _json_text(F.col(pid)), opening="[", closing="]")
    return found.select("split", F.col("n_entries").alias("n_ids"), "digest")


def _json_text(value: Column) -> Column:
    """A value's text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value.cast("string"))), r"(?s)^\[(.*)\]$", 1)


def message_contract(records: DataFrame, pid: str, messages: str, required: list[str], forbidden: list[str], preview: int = 20) -> DataFrame:
    """The first rows whose prompt is not one user message, or whose content breaks ``prompt_contract``; messages are normalized first."""
    text = let(normalize_messages(F.col(messages)), lambda clean: F.when((F.size(clean) == 1) & (clean[0]["role"] == "user"), clean[0]["content"]))
    return _contract(records, pid, text, required, forbidden, preview)


def prompt_contract(records: DataFrame, pid: str, text: str, required: list[str], forbidden: list[str], preview: int = 20) -> DataFrame:
    """The first rows that do not hold each required text once, or hold a forbidden one."""
    return _contract(records, pid, F.col(text), required, forbidden, preview)


def _contract(records: DataFrame, pid: str, text: Column, required: list[str], forbidden: list[str], preview: int) -> DataFrame:
    def broken(said: Column) -> Column:
        tests = [F.when(said.isNull(), "not one user message")] + [F.when(occurrences(said, r) != 1, f"required {r}") for r in required] + [F.when(occurrences(said, f) > 0, f"forbidden {f}") for f in forbidden]
        return F.array_join(F.filter(F.array(*tests), lambda x: x.isNotNull()), "; ")

    return records.select(pid, let(text, broken).alias("broken")).where("broken <> ''").orderBy(pid).limit(preview)


def level_histogram(records: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows and different texts by level; texts are counted in two steps, so no group is held as a whole."""
    once = records.groupBy(*keys, text).agg(F.count("*").alias("c"))
    return once.groupBy(*keys).agg(F.sum("c").cast("long").alias("n_rows"), F.count(text).alias("n_texts"))


def data_facts(records: DataFrame, pid: str, level: str) -> DataFrame:
    """(fact, value): rows, identities, identities of several rows, rows beyond the first, and rows of each level."""
    per = records.groupBy(pid).agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.count("*").alias("unique_prompts"), F.count_if(F.col("c") > 1).alias("duplicate_prompt_groups"))
    counts = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), v.cast("long").alias("value")) for n, v in (("rows", F.col("rows")), ("unique_prompts", F.col("unique_prompts")), ("duplicate_prompt_groups", F.col("duplicate_prompt_groups")), ("duplicate_rows", F.col("rows") - F.col("unique_prompts")))])).alias("f")).select("f.*")
    levels = records.groupBy(F.concat(F.lit("level "), F.col(level).cast("string")).alias("fact")).agg(F.count("*").alias("value"))
    return counts.union(levels)


def file_facts(files: DataFrame) -> DataFrame:
    """(fact, value): the SHA-256 of each file of ``files`` (path, sha256), to be held against pinned ones with ``drift``."""
    return files.select(F.concat(F.lit("file "), F.col("path")).alias("fact"), F.col("sha256").alias("value"))


def drift(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Pinned facts that differ from what was found, and levels that were found but not pinned, if any level was pinned."""
    pinned = expected.select("fact", F.col("value").alias("expected"))
    both = facts.join(pinned, "fact", "full_outer")
    some = expected.where(F.col("fact").startswith("level ")).agg((F.count("*") > 0).alias("_levels")).withColumn("_one", F.lit(1))
    both = both.withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one")  # one row
    asked = F.col("expected").isNotNull() | (F.col("fact").startswith("level ") & F.col("_levels"))
    return both.where(asked & ~F.col("value").eqNullSafe(F.col("expected"))).select("fact", "value", "expected")


def overlap(train: DataFrame, other: DataFrame, pid: str) -> DataFrame:
    """Identities that both sides hold."""
    return train.select(pid).distinct().join(other.select(pid).distinct(), pid, "left_semi")


def overlap_audit(train: DataFrame, other: DataFrame, pid: str, preview: int = 20) -> DataFrame:
    """One row: rows of the other side, identities that both hold, and the first of these in order."""
    both = overlap(train, other, pid)
    first = both.orderBy(pid).limit(preview).agg(F.array_sort(F.collect_list(pid)).alias("overlap_ids")).withColumn("_one", F.lit(1))
    counted = both.agg(F.count("*").alias("n_overlap")).withColumn("_one", F.lit(1))
    rows = other.agg(F.count("*").alias("n_rows")).withColumn("_one", F.lit(1))
    return rows.join(F.broadcast(counted), "_one").join(F.broadcast(first), "_one").drop("_one")  # one row each


def check_overlap(train: DataFrame, other: DataFrame, pid: str) -> None:
    """Raise if an identity is on both sides."""
    found = overlap_audit(train, other, pid, 1).first()
    if found.n_overlap:
        raise ValueError(f"{found.n_overlap} prompts are on both sides, {found.overlap_ids[0]} for one")


def length_filter(rows: DataFrame, length: str, cap: int) -> DataFrame:
    """Rows whose length is within the cap."""
    return rows.where(F.col(length) <= cap)


def length_audit(rows: DataFrame, length: str, cap: int) -> DataFrame:
    """One row: the cap, rows beyond it, the largest length before and after they go."""
    within = F.col(length) <= cap
    return rows.agg(F.lit(cap).cast("long").alias("prompt_cap"), F.count_if(~within).alias("n_overlong"), F.max(length).cast("long").alias("max_before"), F.max(F.when(within, F.col(length))).cast("long").alias("max_after"))


def overlong(rows: DataFrame, pid: str, length: str, cap: int, preview: int = 20) -> DataFrame:
    """The first rows beyond the cap: an evaluation must have none."""
    return rows.where(F.col(length) > cap).select(pid, F.col(length)).orderBy(pid).limit(preview)


def dose(plans: DataFrame, batch: int, n: int, mini_batch: int, epochs: int, token_cap: int) -> DataFrame:
    """What each plan of ``updates`` costs: trainer updates, optimizer steps, prompts, trajectories, the bound on tokens."""
    if batch * n % mini_batch:
        raise ValueError("trajectories are not divisible by the mini-batch")
    u = F.col("updates").cast("long")
    return plans.select("*", u.alias("trainer_updates"), (u * (batch * n // mini_batch * epochs)).alias("optimizer_steps"), (u * batch).alias("prompts"), (u * (batch * n)).alias("trajectories"), (u * (batch * n * token_cap)).alias("token_upper_bound"))


def queue_digest(queue: DataFrame, pid: str) -> DataFrame:
    """Number of batches, and the SHA-256 of the canonical JSON of a queue: a list of lists of ids. A batch is one value, a queue of any length is not."""
    batches = queue.groupBy("update").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col(pid).cast("string").alias("id")))), lambda x: x["id"])).alias("ids"))
    return ordered_digest(batches, [], ["update"], F.col("ids"), opening="[", closing="]").select(F.col("n_entries").alias("n_batches"), "digest")
