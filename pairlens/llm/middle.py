"""Fill-in-the-middle over ropes: a text is cut at two token ranks and its parts change places, reversibly.

A token is a run of ASCII letters or one other character. A text becomes a rope: leaves
hold some thousand characters, always whole tokens, and cache how many tokens and
characters they have; inner nodes cache the sums. Cutting at a rank walks down to one leaf, so
that only this leaf is scanned; putting parts together makes a node and copies no text. The way
back is made of the same cuts, at the characters where the marks stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, tune

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
_LETTERS = re.compile("[A-Za-z]*")
#: Characters of a leaf, but for the letters that end its last token.
LEAF = 2048


class Leaf:
    """Some whole tokens of a text."""

    __slots__ = ("text", "tokens", "chars")

    def __init__(self, text: str):
        self.text, self.tokens, self.chars = text, len(_TOKEN.findall(text)), len(text)

    def leaves(self) -> Iterator[Leaf]:
        yield self

    def cut(self, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
        """The part before a rank, counted in tokens or chars, and the rest; None for an empty part."""
        at = rank
        if by == "tokens":
            found = next(islice(_TOKEN.finditer(self.text), rank, None), None)
            at = found.start() if found else self.chars
        return Leaf(self.text[:at]) if at > 0 else None, Leaf(self.text[at:]) if at < self.chars else None


class Node:
    """Two ropes, one after the other."""

    __slots__ = ("left", "right", "tokens", "chars")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right, self.tokens, self.chars = left, right, left.tokens + right.tokens, left.chars + right.chars

    def leaves(self) -> Iterator[Leaf]:
        open_: list[Rope] = [self]
        while open_:
            top = open_.pop()
            if isinstance(top, Leaf):
                yield top
            else:
                open_ += [top.right, top.left]

    def cut(self, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
        here = getattr(self.left, by)
        if rank <= here:
            a, b = self.left.cut(rank, by)
            return a, joined(b, self.right)
        a, b = self.right.cut(rank - here, by)
        return joined(self.left, a), b


Rope = Leaf | Node


def joined(*parts: Rope | None) -> Rope | None:
    """Parts one after the other; None if all are empty."""
    out = None
    for part in parts:
        out = part if out is None else out if part is None else Node(out, part)
    return out


def rope(text: str) -> Rope | None:
    """A balanced rope; None for an empty text."""
    level: list[Rope] = []
    at = 0
    while at < len(text):
        end = min(at + LEAF, len(text))
        if _LETTERS.match(text, end - 1).end() > end - 1:
            end = _LETTERS.match(text, end).end()  # a run of letters is not cut
        level.append(Leaf(text[at:end]))
        at = end
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def plain_text(part: Rope | None) -> str:
    return "".join(leaf.text for leaf in part.leaves()) if part is not None else ""


def _chars(part: Rope | None) -> int:
    return part.chars if part is not None else 0


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of prefix and middle, output) of a text; ``h1`` to ``h4`` stand for chance."""
    whole = rope(text)
    n = whole.tokens if whole is not None else 0
    if whole is None or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = whole.cut(high, "tokens")
    prefix, middle = head.cut(low, "tokens") if head is not None else (None, None)
    form = "spm" if h4 % 100 < spm else "psm"
    first = (Leaf(PREFIX), prefix, Leaf(SUFFIX), suffix) if form == "psm" else (Leaf(SUFFIX), suffix, Leaf(PREFIX), prefix)
    return n, form, _chars(prefix), _chars(middle), plain_text(joined(*first, Leaf(MIDDLE), middle))


def put_back(output: str, form: str) -> str:
    """The text that ``rearranged`` was given."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    rest, parts = rope(output), []
    for mark in reversed(marks):
        rest, part = rest.cut(output.index(mark), "chars")
        parts.append(part.cut(len(mark), "chars")[1])
    middle, second, first = parts
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return plain_text(joined(prefix, middle, suffix))


def chances(id_col: str, seed: int) -> list[Column]:
    """Four unsigned integers of 32 bits for each id: the head of the SHA-256 of "seed:id"; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every row.

    ``rate`` in a hundred texts are rearranged, ``spm`` in a hundred of these with the suffix
    first. The prefix ends at the smaller of two ranks drawn from 0 to n by the id, the middle
    at the larger. Form plain leaves a text as it is: an empty or null one (which counts as
    empty), and one that holds a mark; its lengths are null. A null id draws as an empty one;
    repeated rows are rows of their own; other columns are ignored; an empty table gives
    no rows. A long text is one rope, and each task holds some megabytes of texts at a time.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, 4 << 20):
                part = batch.slice(a, b - a)
                chance = zip(*(part.column(f"_h{k}").to_pylist() for k in range(1, 5)), strict=True)
                rows = [rearranged(text or "", *h, rate, spm) for text, h in zip(part.column("text").to_pylist(), chance, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *chances(id_col, seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` (see ``fill_in_middle``) with restored: each text again, from its output and form alone."""

    @F.pandas_udf("string")
    def back(outputs, forms):
        return outputs.combine(forms, put_back)

    return rows.withColumn("restored", back("output", "form"))
