"""Repair of conversations by the cheapest edits: A* on the lattice of rows and states.

A conversation should read system?, then user and assistant in turns, ending with an
assistant; or be empty. Rows are kept (cost 0), given the other role (3) or deleted (4),
and empty turns are inserted (3). Blank rows and repeated ones must go; a truncated row that
stays adds 3. A node of the lattice is a number of rows and what was last (nothing, system, user,
assistant). From a node the remaining cost is at least the sum of its mandatory deletions and
of 3 for each truncated row, which is less than deleting it: suffix sums give both. The queue is
keyed by (cost plus this bound, audit), the audit being the initials of the edits so far; no edit
lowers the bound by more than it costs and audits only grow, so the first way to reach a node is
its cheapest, and of these the least in ASCII.

Rows are flagged by joins and aggregates that no conversation holds together. The search
then reads a conversation's rows in order, some at a time: the best ways to the four
states after one block are where the search of the next block starts.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, tune

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATION = 3
#: What was last: nothing, a system turn, a user's, an assistant's. A conversation may end with nothing or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, GONE, CUT = range(3)
#: White space of the contract: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def turn_after(state: int) -> int:
    """The state of the only turn that may come next, but for a first system turn."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after keeping a row whose role has this initial; None where the row can't stand here."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    after = turn_after(state)
    return after if initial == ROLE[after][0] else None


def search(starts: dict[int, tuple[int, str]], rows: list[tuple[str, int]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) to each state after ``rows`` (initial of the role, fault), from ``starts``; only to the best end if these are the ``last``."""
    n = len(rows)
    bound = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        bound[k] = bound[k + 1] + (COST[DELETE] if rows[k][1] == GONE else TRUNCATION if rows[k][1] == CUT else 0)
    queue = [(cost + bound[0], audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(queue)
    closed: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue:
        total, audit, k, state = heapq.heappop(queue)
        if (k, state) in closed:
            continue
        closed.add((k, state))
        cost = total - bound[k]
        if k == n:
            ends[state] = (cost, audit)
            if last and state in (NOTHING, ASSISTANT):
                return {state: (cost, audit)}
        after = turn_after(state)
        ways = [(COST[INSERT], INSERT, k, after)]
        if k < n:
            initial, fault = rows[k]
            ways.append((COST[DELETE], DELETE, k + 1, state))
            if fault != GONE:
                more = TRUNCATION if fault == CUT else 0
                ways.append((COST[REROLE] + more, REROLE, k + 1, after))
                here = kept(state, initial)
                if here is not None:
                    ways.append((COST[KEEP] + more, KEEP, k + 1, here))
        for price, letter, to, then in ways:
            if (to, then) not in closed:
                heapq.heappush(queue, (cost + price + bound[to], audit + letter, to, then))
    return ends


def edited(audit: Iterator[str], state: int, initial: str | None) -> Iterator[tuple[str, str | None, int]]:
    """(letter, new role or None, state) of the edits up to the one of the next row, or all that are left if ``initial`` is None."""
    for letter in audit:
        after = turn_after(state)
        if letter == INSERT:
            state = after
            yield letter, ROLE[after], state
            continue
        if letter == REROLE:
            state = after
        elif letter == KEEP:
            state = kept(state, initial)
        yield letter, ROLE[after] if letter == REROLE else None, state
        return


def counted(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, n, said): one row for all that are alike, ``n`` of them, counted before they are shuffled; ``said`` is the text's digest."""
    count = F.col(copies) if copies else F.lit(1)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), count.cast("long").alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", F.sha2("text", 256))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows of ``counted`` with fault (of the first of those alike), again (an equal turn came before them) and blank.

    A turn said often in one conversation is found by the first turn that says it, so no group is held together.
    """
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    first = rows.where("n > 0").groupBy("conv_id", "role", "said").agg(F.min(place).alias("first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("said").alias("_s"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("said") == F.col("_s")), "left")
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    blank, cut = body == "", ~F.substring(body, -1, 1).isin(".", "!", "?")
    again = ~blank & ~place.eqNullSafe(F.col("first"))
    fault = F.when(blank | again, GONE).when(cut, CUT).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), again.alias("again"), blank.alias("blank"))


_REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


class _Conversation:
    """What is known of a conversation of which some rows have been read."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns, self.low, self.high, self.now = 0, None, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.rows: list[tuple[str, int]] = []
        self.best: dict[int, tuple[int, str]] = {NOTHING: (0, "")}
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, n: int, fault: int, again: bool, blank: bool, block: int) -> None:
        if turn is not None and turn != self.now:
            self.turns, self.now = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.counts["blank"] += n if blank else 0
        self.counts["duplicate"] += n if again else 0 if blank else n - 1
        self.counts["truncated"] += fault == CUT
        initial = role[:1]
        for k in range(n):
            if self.before is not None and (self.before, initial) not in LEGAL:
                self.counts["illegal"] += 1
            self.before = initial
            self.rows.append((initial, fault if not k else GONE))
            if len(self.rows) >= block:
                self.go_on()

    def go_on(self) -> None:
        """Search the rows held; what all ways begin with is settled."""
        self.best = search(self.best, self.rows, last=False)
        self.rows = []
        settled = os.path.commonprefix([audit for _, audit in self.best.values()])
        self.audit.append(settled)
        self.best = {state: (cost, audit[len(settled) :]) for state, (cost, audit) in self.best.items()}

    def end(self) -> tuple:
        ((cost, audit),) = search(self.best, self.rows, last=True).values()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), cost, "".join(self.audit) + audit)


def repairs(rows: DataFrame, block: int = 512) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``rows`` (see ``flagged``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, n, fault, again, blank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.end())
                    now = _Conversation(conv_id)
                if n:
                    now.add(turn, role, n, fault, again, blank, block)
            if done:
                yield _repair_batch(done)
        if now is not None:
            yield _repair_batch([now.end()])

    named = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "n", "fault", "again", "blank")
    return named.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _REPAIR))


def _repair_batch(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "audit" else pa.int64()) for name, c in zip(_REPAIR, zip(*done, strict=True), strict=True)], list(_REPAIR))


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of all turns that ``found`` (see ``repairs``) leaves or makes of ``rows`` (see ``flagged``), places from 0.

    A conversation's audit comes first, then its rows; they are edited one by one as they are read,
    so the turns of a conversation stand together and in order in one partition.
    """
    names = ["conv_id", "place", "role", "text", "edit"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, state, place = None, iter(""), NOTHING, 0

        def rest() -> list[tuple]:
            """Turns put in after a conversation's last row."""
            return [(now, place + k, role, "", letter) for k, (letter, role, _) in enumerate(edited(audit, state, None))]

        for batch in batches:
            out: list[tuple] = []
            for conv_id, kind, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    out += rest()
                    now, audit, state, place = conv_id, iter(text), NOTHING, 0
                    continue
                for _ in range(n):
                    for letter, new, after in edited(audit, state, role[:1]):
                        state = after
                        if letter != DELETE:
                            out.append((now, place, new or role, "" if letter == INSERT else text, letter))
                            place += 1
            if out:
                yield batch_of(out)
        out = rest()
        if out:
            yield batch_of(out)

    turns = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n")
    heads = found.where("audit <> ''").select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "kind", "role", "text", "n")
    return both.mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def repair(turns: DataFrame, copies: str | None = None, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(repairs, repaired turns) of all conversations of ``turns`` (conv_id, turn, role, text); see ``repairs`` and ``repaired_turns``.

    Rows are taken by turn (null first), rows of one turn by role and text. ``copies`` names a
    column with how often a row stands there one after the other; with 0 it only tells that its
    conversation exists. Null roles and texts are one blank; a null conv_id is a conversation of
    its own; repeated rows are duplicates; a role without a first character can't be kept.
    Extra columns are ignored; an empty table gives none. Rows are searched ``block`` at a time, which changes no result.
    """
    tune(turns.sparkSession)
    base = stored(counted(turns, copies), "turns")
    rows = stored(flagged(base), "flagged")
    drop_stored(base)
    found = stored(repairs(rows, block), "repairs")
    return found, repaired_turns(rows, found)


def damaged(turns: DataFrame, share: int = 20) -> DataFrame:
    """Rows of ``turns`` with faults put in by crc32 of "conv_id:turn" modulo ``share`` (nulls are one blank), and copies (0 for a dropped row, 2 for a repeated one).

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % share
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), text)
