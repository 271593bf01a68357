"""Headings and the section that is in force at a position (an as-of join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import furniture_key, heading_kind, strip

LEVELS = ("part", "item", "section", "note")
#: Kinds of headings that set a level, and those that clear it.
SETS = {"part": ("part",), "item": ("item",), "section": ("note", "subsection"), "note": ("note",)}
CLEARS = {"part": (), "item": ("part",), "section": ("part", "item"), "note": ("part", "item")}


def headings(spans: DataFrame, furniture: DataFrame | None = None, min_size: float = 8.0, max_words: int = 25) -> DataFrame:
    """(document_id, pdf_page, top, text, kind, size): lines wholly in bold, large and short enough, no furniture."""
    keys = ["document_id", "pdf_page", "block_no", "line_no"]
    parts = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    lines = spans.groupBy(*keys).agg(
        strip(F.array_join(F.transform(parts, lambda s: s["text"]), "")).alias("text"),
        F.bool_and(F.lower("font").contains("bold")).alias("bold"),
        F.max("size").alias("size"),
        F.min("ly0").alias("top"),
    )
    words = F.size(F.split(F.regexp_replace("text", r"(?U)\s+", " "), " "))
    lines = lines.where((F.col("text") != "") & F.col("bold") & (F.col("size") >= min_size) & (words <= max_words))
    if furniture is not None:
        lines = lines.withColumn("norm", furniture_key(F.col("text"))).join(furniture.select("document_id", "norm"), ["document_id", "norm"], "left_anti")
    return lines.select("document_id", "pdf_page", "top", "text", heading_kind(F.col("text")).alias("kind"), "size")


def section_states(marks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``kind`` and ``text`` (null kind: no heading) get part, item, section and note as in force there."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    states = {}
    for level in LEVELS:
        sets, clears = SETS[level], CLEARS[level]
        change = F.when(F.col("kind").isin(*sets, *clears), F.struct(F.when(F.col("kind").isin(*sets), F.col("text")).alias("v")))
        states[level] = F.last(change, ignorenulls=True).over(so_far)["v"]
    return marks.withColumns(states)


def sections_at(lookups: DataFrame, heads: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Every lookup (keys, pdf_page, top, ...) with the state of the last heading at or above it.

    A null ``top`` means the end of the page. Headings and lookups are sorted together once, so the
    join costs one exchange by document and no pairs.
    """
    cols = [c for c in lookups.columns if c not in (*keys, "pdf_page", "top")]
    at = F.coalesce(F.col("top"), F.lit(float("inf")))
    asked = lookups.select(*keys, "pdf_page", "top", at.alias("__at"), F.lit(1).alias("__side"), F.struct(*cols, F.lit(0).alias("__")).alias("__row"))
    known = heads.select(*keys, "pdf_page", F.col("top").alias("__at"), F.lit(0).alias("__side"), "kind", "text")
    both = known.unionByName(asked, allowMissingColumns=True)
    out = section_states(both, list(keys), ["pdf_page", "__at", "__side", "text"]).where("__side = 1")
    return out.select(*keys, "pdf_page", "top", *[F.col(f"__row.{c}").alias(c) for c in cols], *LEVELS)
