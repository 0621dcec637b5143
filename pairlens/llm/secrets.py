"""Secrets in texts, with DataFrame functions only: patterns, and credentials whose parts stand close together.

Six kinds of spans. The first three are reported wherever they stand: a word like password
with a value (assign), an access key (access), a long hexadecimal number (hex). The others
are weak: a capital identifier (identifier), a long mixed word (key), an address (endpoint). A
credential has several parts: an identifier (access or identifier), a secret (assign, hex or key)
and perhaps an endpoint. A weak span is reported only with its complement in its scope, the
text within ``reach`` characters of it: an identifier with a secret, a key with an identifier, an
endpoint with both.

Places come from the lengths of what is between matches and of the matches, summed up in a window
over one text and kind. A text is known by its SHA-256 there, so copies of a text are
looked at once. Scopes are joined to parts by cells of ``reach`` characters; as spans of a kind do
not overlap and weak ones have 16 characters at least, a cell joins a bounded number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The patterns of the contract (the letters of the first word in either case), in the order of their kinds.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: Value of an assignment: this many characters at least.
VALUE = 6
WEAK = {"identifier": "[A-Z]{4}[A-Z0-9]{12,}", "key": "[A-Za-z0-9+/_=-]{32,}", "endpoint": r"[a-z][a-z0-9+]{1,20}://[^\x20\x09-\x0D\"'<>]{4,}"}
KINDS = (*BASE, *WEAK)
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}


def _good(kind: str, match: Column) -> Column:
    """Whether a match counts; those that do not still take their place."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= VALUE
    if kind == "identifier":
        return match.rlike("[0-9]")
    if kind == "key":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _pieces(kind: str, found: Column, between: Column) -> Column:
    """(kind number, place in the order of matches, characters before it since the last, characters, whether it counts) of a kind's matches."""
    return F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.element_at(between, i + 1)).alias("gap"), F.length(m).alias("size"), _good(kind, m).alias("good")))


def matches(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, digest and pieces of every row: what the patterns find in its whole text; both null where they find nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = BASE | WEAK
    rows = docs.select(*keep, text.alias("_text"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()])
    # Only a text with matches is split: what stands between them gives their places.
    rows = rows.select("*", *[F.when(F.size(f"_{k}") > 0, F.split("_text", p, -1)).alias(f"_{k}_gaps") for k, p in patterns.items()])
    pieces = [F.when(F.size(f"_{k}") > 0, _pieces(k, F.col(f"_{k}"), F.col(f"_{k}_gaps"))).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,good:boolean>>")) for k in patterns]
    some = reduce(lambda a, b: a | b, [F.size(f"_{k}") > 0 for k in patterns])
    return rows.select(*keep, F.when(some, F.sha2("_text", 256)).alias("digest"), F.when(some, F.concat(*pieces)).alias("pieces"))


def spans(found: DataFrame) -> DataFrame:
    """(digest, kind, start, end) of all matches that count, in code points, ends exclusive; once for each text."""
    rows = found.where("digest is not null").select("digest", F.inline("pieces")).distinct()
    upto = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return rows.select("digest", "kind", "good", (end - F.col("size")).alias("start"), end.alias("end")).where("good").drop("good")


def _is(kinds: list[str]) -> Column:
    return F.col("kind").isin(*[KINDS.index(k) for k in kinds])


def linked(table: DataFrame, reach: int) -> DataFrame:
    """The weak spans of ``table`` (see ``spans``) that have their complement in scope and lie in no base span.

    Texts without an identifier and a secret have none to link and are left out first. The
    join is on the cells that a part covers and those that a scope covers.
    """
    part = lambda name: F.max(_is([k for k in KINDS if PART[k] == name]))
    both = table.groupBy("digest").agg(part("identifier").alias("a"), part("secret").alias("b"), F.max(_is(list(WEAK))).alias("w")).where("a and b and w").select("digest")
    rows = table.join(both, "digest", "left_semi")
    cell = lambda c: F.expr(f"{c} div {reach}")
    other = rows.select("digest", F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(cell("start"), cell("end"))).alias("cell"))
    weak = rows.where(_is(list(WEAK)))
    scope = weak.select("digest", "kind", "start", "end", F.explode(F.sequence(cell(f"greatest(start - {reach}, 0)"), cell(f"end + {reach}"))).alias("cell"))
    near = scope.join(other, ["digest", "cell"]).where((F.col("s2") <= F.col("end") + reach) & (F.col("e2") + reach >= F.col("start")))
    apart = (F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start"))
    is_part = lambda name: F.col("k2").isin(*[KINDS.index(k) for k in KINDS if PART[k] == name])
    seen = near.groupBy("digest", "kind", "start", "end").agg(
        F.max(is_part("identifier") & apart).alias("identifier"), F.max(is_part("secret") & apart).alias("secret"), F.max((F.col("k2") < len(BASE)) & ~apart).alias("inside")
    )
    asked = F.when(_is(["identifier"]), F.col("secret")).when(_is(["key"]), F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    return seen.where(asked & ~F.col("inside")).select("digest", "kind", "start", "end")


def find_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every row: an array of (kind, start, end) by start, then kind; places in code points of the whole text, ends exclusive.

    Base kinds are matched from the left without overlaps within a kind; a match that breaks its
    rule is dropped but takes its place. Weak kinds are reported with their complements (see
    above), unless they lie over a base span. Null and empty texts have no spans; a
    null id is kept; repeated rows are rows of their own; other columns are ignored; an empty
    table gives no rows; long texts are read whole.
    """
    found = stored(matches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]), "matches")
    table = stored(spans(found), "spans")
    every = table.where(_is(list(BASE))).unionByName(linked(table, reach))
    listed = every.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    named = F.transform("spans", lambda x: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    listed = listed.select("digest", named.alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    with_some = found.where("digest is not null").select("doc_id", "digest").join(listed, "digest", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return with_some.unionByName(found.where("digest is null").select("doc_id", none.alias("spans")))


def shown(spans_: Column) -> Column:
    """Spans as text: kind:start:end, with commas between."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans_: Column) -> Column:
    return F.filter(spans_, lambda s: s["kind"].isin(*BASE))


def count_of(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
