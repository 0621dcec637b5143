"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows at turn boundaries. Prefix sums of the turns'
token counts choose the boundaries: turns whose sums begin in the same stride make a
window. What the budget leaves beside the system turn and the repeated history is the room;
a turn longer than half of it stands alone, and the stride is the room less the longest of the
other turns. So a window stays within the budget unless one turn alone exceeds it, and is as
full as turns allow. Every window begins with the system turn and the last turns of the window
before it; those are context and are masked, so each assistant text is a target once.

A turn is ``<role>text</turn>``. In roles and texts the escapes ``\\b``, ``\\l`` and
``\\g`` stand for backslash, less-than and greater-than; no marker can appear there.
Tokens are counted of turns as they are written, marks and escapes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "</turn>"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
_TURN = "<([^<>]*)>([^<>]*)</turn>"


def escape(text: Column) -> Column:
    """``text`` without backslash, less-than and greater-than, reversibly."""
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def default_tokens(text: Column) -> Column:
    """Estimate of the tokens of a turn as it is written: a quarter of its bytes."""
    return F.ceil(F.octet_length(text) / 4)


def chat_windows(turns: DataFrame, budget: int = 2048, history_tokens: int = 256, history_turns: int = 2, tokens=default_tokens) -> DataFrame:
    """Windows of all conversations in ``turns`` (conv_id, turn, role, text).

    Returns conv_id, window (from 1), n_context (turns repeated at its head), text,
    loss_spans (start from 0 and length, in characters of ``text``, of each target) and
    tokens. Null text and role count as empty; a null turn comes first and a null
    conv_id is a conversation of its own; rows alike in turn are ordered by role and
    text, and repeated rows are turns of their own. A conversation whose first turn
    has the role system keeps it in every window. Equal turns are turns of their own, long
    ones are kept whole. ``tokens`` counts a turn as it is written. Extra columns are ignored; an empty
    table gives no windows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    rows = rows.withColumn("open", F.concat(F.lit("<"), escape(F.col("role")), F.lit(">"))).withColumn("said", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("open", "said", F.lit(CLOSE)))
    rows = rows.withColumn("tokens", tokens(F.col("piece")).cast("long")).withColumn("pos", F.row_number().over(ordered))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    body = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    head = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(conv)
    rows = rows.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history_tokens) - head)).withColumn("alone", ~F.col("system") & (2 * F.col("tokens") > F.col("room")))
    longest = F.max(F.when(~F.col("system") & ~F.col("alone"), F.col("tokens")).otherwise(0)).over(conv)
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.col("room") - longest))
    rows = rows.withColumn("cell", F.floor((F.sum(body).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - body) / F.col("stride")))
    # A window opens at the first turn that is not the system's, and where the stride changes or a long turn begins or ends.
    opens = (F.col("pos") == 1) | F.coalesce(F.lag("system").over(ordered), F.lit(False))
    opens = opens | (F.lag("cell").over(ordered) != F.col("cell")) | F.col("alone") | F.lag("alone").over(ordered)
    rows = rows.withColumn("opens", (opens & ~F.col("system")).cast("int"))
    rows = rows.withColumn("window", F.greatest(F.lit(1), F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    last = F.max("window").over(conv)
    back = Window.partitionBy("conv_id", "window").orderBy(F.desc("pos"))
    again = (F.row_number().over(back) <= history_turns) & (F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)) <= history_tokens)
    rows = rows.withColumn("last", last).withColumn("again", again & ~F.col("system") & (F.col("window") < F.col("last")))
    # Places of a turn: its own window (2), the next one as history (1), all later ones for a system turn (0).
    place = lambda window, kind: F.struct(window.cast("int").alias("window"), F.lit(kind).alias("kind"))
    later = F.when(F.col("system") & (F.col("last") > 1), F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("last"))), lambda w: place(w, 0)))
    places = F.concat(F.array(place(F.col("window"), 2)), F.when(F.col("again"), F.array(place(F.col("window") + 1, 1))).otherwise(F.array().cast("array<struct<window:int,kind:int>>")), F.coalesce(later, F.array().cast("array<struct<window:int,kind:int>>")))
    rows = rows.select("conv_id", "pos", "tokens", "open", "said", "piece", (F.col("role") == "assistant").alias("answer"), F.explode(places).alias("place"))
    rows = rows.select("conv_id", F.col("place.window").alias("window"), F.col("place.kind").alias("kind"), "pos", "tokens", "answer", F.length("open").alias("lead"), F.length("said").alias("size"), "piece")
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(F.length("piece")).over(inside) - F.length("piece") + F.col("lead"))
    windows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("kind", "pos", "piece", "answer", "start", "size"))).alias("turns"), F.sum("tokens").alias("tokens"))
    targets = F.filter("turns", lambda t: (t["kind"] == 2) & t["answer"])
    return windows.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_context"),
        F.array_join(F.col("turns.piece"), "").alias("text"),
        F.transform(targets, lambda t: F.struct(t["start"].cast("long").alias("start"), t["size"].cast("long").alias("length"))).alias("loss_spans"),
        "tokens",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What windows say, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digest of turns is over role, line end, text, line end of every turn that is
    not context; that of the loss is over all text under the mask, unescaped. The
    whole of one conversation is one digest, so it is one value of one row here.
    """
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(_TURN), F.lit(2)).alias("said"))
    own = F.slice("found", F.col("n_context") + 1, F.greatest(F.size("found") - F.col("n_context"), F.lit(0)))
    read = windows.withColumn("found", found).select(
        "conv_id",
        "window",
        F.length("text").alias("chars"),
        F.size(own).alias("turns"),
        F.array_join(F.transform(own, lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["said"]), F.lit("\n"))), "").alias("plain"),
        unescape(F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))), "")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "plain", "loss"))).alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join(F.col("parts.plain"), "").alias("plain"), F.array_join(F.col("parts.loss"), "").alias("loss"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("plain", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
