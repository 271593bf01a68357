"""Narrative text blocks: spans that lie outside tables, without furniture lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import furniture_key, strip
from pagemill.operators.layout import outside_regions

PAGE = ["document_id", "pdf_page"]


def text_blocks(spans: DataFrame, regions: DataFrame, furniture: DataFrame) -> DataFrame:
    """(document_id, pdf_page, block_no, text, x0, y0, x1, y1); furniture lines go wherever they stand on the page."""
    parts = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    box = [F.first(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    lines = spans.groupBy(*PAGE, "block_no", "line_no").agg(strip(F.array_join(F.transform(parts, lambda s: s["text"]), "")).alias("text"), *box)
    lines = outside_regions(lines.where("text <> ''"), regions, PAGE)
    lines = lines.withColumn("norm", furniture_key(F.col("text"))).join(furniture.select("document_id", "norm"), ["document_id", "norm"], "left_anti")
    listed = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    joined = F.array_join(F.transform(listed, lambda s: s["text"]), " ")
    return lines.groupBy(*PAGE, "block_no").agg(joined.alias("text"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
