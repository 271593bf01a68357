"""Page furniture: lines that repeat at the edges of a document's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Config
from pagemill.functions.text import furniture_key, strip

PAGE = ("document_id", "pdf_page")


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, pdf_page, line_no, text): the non-empty lines of pages with a ``text``."""
    lines = F.transform(F.split("text", "\n"), strip)
    kept = F.filter(lines, lambda x: x != "")
    return pages.select(*PAGE, F.posexplode(kept).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def with_edges(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Lines with the number of lines on their page, their furniture key and whether they stand at an edge."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAGE))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))
    edge = (F.col("place") <= cfg.scan_lines) | (F.col("place") > F.col("n") - cfg.scan_lines)
    return lines.withColumns({"n": n, "place": place, "norm": furniture_key(F.col("text"))}).withColumn("edge", edge)


def furniture_profile(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(document_id, norm, occ, is_footer): edge lines that occur often enough in their document.

    Occurrences count, not pages: a line twice at the edges of one page counts twice.
    """
    pages = lines.groupBy("document_id").agg(F.countDistinct("pdf_page").alias("pages"))
    edges = with_edges(lines, cfg).where("edge").where(F.col("norm").rlike("[a-z]") & (F.length("norm") >= 4))
    counts = edges.groupBy("document_id", "norm").agg(F.count(F.lit(1)).alias("occ"))
    least = F.greatest(F.lit(cfg.min_repeats), F.floor(F.col("pages") * cfg.repeat_share))
    return (
        counts.join(pages, "document_id")
        .where(F.col("occ") >= least)
        .select("document_id", "norm", "occ", F.col("norm").rlike(r"#\s*$").alias("is_footer"))
    )


def strip_furniture(lines: DataFrame, profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The lines less the unbroken runs of furniture at both ends of a page, a few lines long at most."""
    named = profile.select("document_id", "norm", F.lit(1).alias("hit"))
    rows = with_edges(lines, cfg).join(named, ["document_id", "norm"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    page = Window.partitionBy(*PAGE)
    most = F.least(F.lit(cfg.scan_lines), F.floor(F.col("n") / 2))
    most = F.when(most == 0, F.col("n")).otherwise(most)
    back = F.col("n") - F.col("place") + 1
    head = (F.min("hit").over(page.orderBy("place")) == 1) & (F.col("place") <= most)
    tail = (F.min("hit").over(page.orderBy(F.desc("place"))) == 1) & (back <= most)
    return rows.withColumn("gone", head | tail).where("not gone").select(*PAGE, "line_no", "text")


def printed_pages(lines: DataFrame, profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(document_id, pdf_page, printed_page): the last number of the last footer line at a page's edges."""
    footers = profile.where("is_footer").select("document_id", "norm")
    found = with_edges(lines, cfg).where("edge").join(footers, ["document_id", "norm"], "left_semi")
    number = F.regexp_extract("text", r"(\d+)\s*$", 1).cast("int")
    printed = found.groupBy(*PAGE).agg(F.max_by(number, "place").alias("printed_page"))
    return lines.select(*PAGE).distinct().join(printed, list(PAGE), "left")


def page_offsets(printed: DataFrame) -> DataFrame:
    """(document_id, page_offset): PDF page less printed page where a document has one such difference, else null."""
    gap = F.col("pdf_page") - F.col("printed_page")
    return printed.groupBy("document_id").agg(
        F.when(F.countDistinct(gap) == 1, F.max(gap)).cast("int").alias("page_offset")
    )
