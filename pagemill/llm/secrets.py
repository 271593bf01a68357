r"""Secret scans with multipart credential linking (DataFrame functions only).

Base spans come from three patterns. Beyond them, credentials that are scattered over a text are
linked: an access identifier, a secret and an endpoint count as parts of one credential when they
lie within ``SCOPE`` code points of each other. Weak candidates - runs of mixed letters and digits
that may or may not be secrets, and endpoints - are reported only where complementary parts
co-occur: a weak secret next to an access identifier, or next to both an endpoint and an assigned
value; an endpoint next to an access identifier with a secret.

The interval join runs inside the row, on the arrays of spans of one text, so it needs no shuffle.
Positions follow from the pieces between matches: ``split`` gives what lies before each match and
``regexp_extract_all`` the matches themselves. Texts without any candidate take a plain path.

A null or empty text has no span, an empty table gives an empty result. Repeated rows are scanned each. Whole
texts are scanned, however long. Further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import quoted

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
WEAK = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"(?i:https?)://[A-Za-z0-9.-]+|[a-z0-9.-]+\.amazonaws\.com"
MIN_ASSIGNED, MIN_ACCESS = 8, 16
SCOPE = 200
KINDS = ("assign", "access", "hex", "secret", "endpoint")


def _spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches as array<struct<start,rank,end,kind,value>>, code points from 0, end exclusive.

    Places are running sums. A fold that appends copies what it has so far, so the matches are cut into about
    sqrt(n) blocks, each folded alone from where the blocks before it end.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["before"] + x["hit"]
        span = F.struct(
            (acc["at"] + x["before"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    parts = F.arrays_zip(F.slice(lengths(pieces), F.lit(1), F.size(hits)).alias("before"), lengths(hits).alias("hit"), values.alias("value"))

    def place(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["before"] + x["hit"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        fold = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        # One start more than blocks: the last one has no block and gives nothing.
        return F.flatten(F.filter(F.zip_with(blocks, starts, fold), lambda b: b.isNotNull()))

    def cut(xs: Column) -> Column:
        wide = lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / w).cast("int") - 1), lambda i: F.slice(xs, i * w + 1, w))
        return _let(F.ceil(F.sqrt(F.size(xs))).cast("int"), wide)

    return F.when(text.rlike(pattern), _let(parts, lambda xs: _let(cut(xs), place))).otherwise(empty)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _near(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"] + SCOPE) & (b["start"] <= a["end"] + SCOPE)


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col and ``spans``, an ordered array<struct<start,rank,end,kind,value>>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    assign = F.filter(_spans(text, ASSIGN, "assign", 1), lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    access = F.filter(_spans(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= MIN_ACCESS)
    rows = rows.select("id", "text", assign.alias("assign"), access.alias("access"), _spans(text, HEX, "hex").alias("hex"))
    # Weak parts matter only where a strong part may complete them.
    strong = (F.size("assign") > 0) | (F.size("access") > 0)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    rows = rows.select(
        "id", "assign", "access", "hex",
        F.when(strong, F.filter(_spans(text, WEAK, "secret"), lambda s: _mixed(s["value"]))).otherwise(none).alias("weak"),
        F.when(strong, _spans(text, ENDPOINT, "endpoint")).otherwise(none).alias("ends"),
    )
    some = lambda parts, s: F.exists(parts, lambda p: _near(p, s))
    base = F.concat("assign", "access", "hex")
    fresh = F.filter("weak", lambda s: F.forall(F.col("base"), lambda b: _apart(b, s)) & F.forall(F.col("ends"), lambda b: _apart(b, s)))
    rows = rows.withColumn("base", base).withColumn("weak", fresh)
    secret = F.filter("weak", lambda s: some(F.col("access"), s) | (some(F.col("ends"), s) & some(F.col("assign"), s)))
    rows = rows.withColumn("secret", secret)
    ends = F.filter("ends", lambda s: some(F.col("access"), s) & (some(F.col("secret"), s) | some(F.col("assign"), s) | some(F.col("hex"), s)))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", "secret", ends)).alias("spans"))
