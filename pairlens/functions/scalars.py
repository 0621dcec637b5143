"""Column expressions: prompt identity, outcomes, labels, log-probabilities."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Every character that counts as white space in prompts.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
# Fixed value: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# Fixed value: the mark of a boxed answer.
BOXED = r"\\boxed\s*\{"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: an expression is copied wherever it is used, the variable of a lambda is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no white space between; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def collapse(text: Column) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip(text: Column) -> Column:
    """No white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITESPACE}", ""), f"{WHITESPACE}$", "")


MESSAGES = "array<struct<role:string,content:string>>"


@F.pandas_udf(StringType())
def _literal_json(text: pd.Series) -> pd.Series:
    """Python literals as JSON; null where a text is none."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            return json.dumps(ast.literal_eval(value))
        except (ValueError, SyntaxError, MemoryError, TypeError, RecursionError):
            return None

    return text.map(one)


def parse_messages(text: Column) -> Column:
    """Messages of a prompt kept as text: JSON, else a Python literal (by a UDF that sees only what is no JSON); null if neither is a list of objects."""
    as_json = F.to_json(F.try_parse_json(text))
    shown = F.coalesce(as_json, _literal_json(F.when(as_json.isNull(), text)))
    listed = lambda objects: (F.size(objects) > 0) & F.forall(objects, lambda m: F.schema_of_variant(m).startswith("OBJECT<"))
    return let(shown, lambda s: F.when(let(F.try_parse_json(s).try_cast("array<variant>"), listed), F.from_json(s, MESSAGES)))


def normalize_messages(messages: Column) -> Column:
    """Roles without white space at the ends, contents with runs of it as one blank; null if there is no message or a part is empty."""
    clean = F.transform(messages, lambda m: F.struct(collapse(m["content"]).alias("content"), strip(m["role"]).alias("role")))
    said = lambda m: F.coalesce(F.length(m["content"]) > 0, F.lit(False)) & F.coalesce(F.length(m["role"]) > 0, F.lit(False))
    return let(clean, lambda c: F.when((F.size(c) > 0) & F.forall(c, said), c))


def messages_id(messages: Column) -> Column:
    """SHA-256 of the canonical JSON of normalized messages; null for a prompt that breaks the rules."""
    return let(normalize_messages(messages), lambda clean: F.when(clean.isNotNull(), F.sha2(F.to_json(F.struct(clean.alias("prompt")), {"ignoreNullFields": "false"}), 256)))


def problem_id(content: Column, role: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of a one-message prompt; answers have no part in it."""
    message = F.struct(collapse(content).alias("content"), F.coalesce(role, F.lit("user")).alias("role") if role is not None else F.lit("user").alias("role"))
    return F.sha2(F.to_json(F.struct(F.array(message).alias("prompt")), {"ignoreNullFields": "false"}), 256)


def record_answer(reward_model: Column, field: str = "ground_truth") -> Column:
    """The stripped truth of a reward model: empty without a model, the text None for a null truth."""
    return F.when(reward_model.isNull(), "").otherwise(strip(F.coalesce(reward_model[field].cast("string"), F.lit("None"))))


def score_value(score: Column, field: str = "score") -> Column:
    """A score kept as a variant: the field of an object, else the number itself."""
    return F.coalesce(F.try_variant_get(score, f"$.{field}", "double"), F.try_variant_get(score, "$", "double"))


def gain_difference(start: Column, opd: Column, rl: Column) -> Column:
    """By how much one arm gains more than the other, in the order of operations that doubles need."""
    return (rl - start) - (opd - start)


def safe_identifier(name: Column) -> Column:
    """Letters, digits and underscores only, and one of the first two at least."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*$"), F.lit(False))


def run_id(protocol: Column, *parts: Column) -> Column:
    return F.concat_ws("_", protocol, *parts)


def evaluation_id(model: Column, panel: Column) -> Column:
    return F.concat(model, F.lit("__"), F.lower(panel))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def token_outcome(rewards: Column) -> Column:
    """Largest token reward; null when there is none or one is not finite."""
    return F.when((F.size(rewards) > 0) & F.forall(rewards, finite), F.array_max(rewards))


def boxed(output: Column) -> Column:
    return F.coalesce(output.cast("string").rlike(BOXED), F.lit(False))


def branch_label(rl: Column, opd: Column, band: Column | float) -> Column:
    """indistinguishable within the band (doubles, edge included), else the better arm."""
    delta = rl.cast("double") - opd.cast("double")
    return F.when(F.abs(delta) <= F.lit(band).cast("double"), "indistinguishable").when(delta > 0, "rl").otherwise("opd")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` is in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def log_total(logits: Column) -> Column:
    """(total, mean) of an array of doubles: log of the sum of exponentials, and the mean under the softmax; in one pass over the array.

    The largest value so far shifts the sums; a larger one scales what is summed. Minus
    infinity has no weight, NaN makes both NaN, a null both null; no values have a total of minus infinity.
    """
    state = lambda top, sum_, moment: F.struct(top.alias("top"), sum_.alias("sum"), moment.alias("moment"))

    def step(s: Column, x: Column) -> Column:
        below = let(F.exp(x - s["top"]), lambda e: state(s["top"], s["sum"] + e, s["moment"] + e * x))
        above = let(F.exp(s["top"] - x), lambda e: state(x, s["sum"] * e + 1, s["moment"] * e + x))
        nothing = x == float("-inf")
        return F.when(nothing, s).when(x.isNull(), state(*[F.lit(None).cast("double")] * 3)).when(x > s["top"], above).otherwise(below)

    start = state(F.lit(float("-inf")), F.lit(0.0), F.lit(0.0))
    return F.aggregate(logits, start, step, lambda s: F.struct(F.when(s["sum"] == 0, float("-inf")).otherwise(s["top"] + F.ln(s["sum"])).alias("total"), F.try_divide(s["moment"], s["sum"]).alias("mean")))


def log_probability(logits: Column, index: Column) -> Column:
    """Chosen logit (from 1) minus the log of the sum of exponentials, shifted by the largest."""
    return let(logits.cast("array<double>"), lambda wide: F.element_at(wide, index) - log_total(wide)["total"])


def top_log_probabilities(logits: Column, k: int) -> Column:
    """(id from 0, logprob) of the ``k`` largest logits, largest first, ties to the smaller id."""

    def shown(wide: Column) -> Column:
        ranked = F.array_sort(F.transform(wide, lambda x, i: F.struct((-x).alias("minus"), i.alias("id"))))
        return let(log_total(wide)["total"], lambda total: F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["id"].alias("id"), (-r["minus"] - total).alias("logprob"))))

    return let(logits.cast("array<double>"), shown)


def gathered_log_probabilities(logits: Column, ids: Column) -> Column:
    """Log-probabilities of the listed ids (from 0)."""
    return let(logits.cast("array<double>"), lambda wide: let(log_total(wide)["total"], lambda total: F.transform(ids, lambda i: F.element_at(wide, i.cast("int") + 1) - total)))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of logits, in nats: log of the total minus the mean logit."""
    return let(log_total(logits.cast("array<double>")), lambda t: t["total"] - t["mean"])


def response_slice(values: Column, response_length: Column | int) -> Column:
    """The values that score the response's tokens: value i scores token i + 1, so the last but one and those before it."""
    n = F.lit(response_length).cast("int") if isinstance(response_length, int) else response_length.cast("int")
    return F.slice(values, F.size(values) - n, n)


def token_sum(values: Column) -> Column:
    """Sum of all token values; of nested arrays too."""
    return F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def outcome_totals(scores: Column, verifier: Column, mask: Column) -> Column:
    """What a dump of rollouts tells of a row: score and verifier reward as sums over tokens, length as the sum of the mask."""
    return F.struct(token_sum(scores).alias("score"), token_sum(verifier).alias("verifier_reward"), token_sum(mask).cast("long").alias("response_length"))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
