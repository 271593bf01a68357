"""Whole documents: from spans, table cells and images to tables, blocks, figures and chunks with provenance.

Everything is keyed by document and page, so all documents of a collection go through one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Config
from pagemill.functions.text import breadcrumb, strip
from pagemill.operators import blocks, chunking, figures, furniture, layout, sections, tables

PAGE = ["document_id", "pdf_page"]
TABLE = [*PAGE, "table_no"]
LEVELS = sections.LEVELS
BOX = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Loaded:
    """What is known of the pages before their content is taken apart."""

    spans: DataFrame
    #: (document_id, pdf_page, block_no, line_no, text, x0, y0, x1, y1), line_no counted through the page
    lines: DataFrame
    profile: DataFrame
    headings: DataFrame
    printed: DataFrame


def span_lines(spans: DataFrame) -> DataFrame:
    """Lines of spans joined in order, numbered through their page in reading order; blank ones go."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")
    box = [F.first(f"l{c}").alias(c) for c in BOX]
    lines = spans.groupBy(*PAGE, "block_no", F.col("line_no").alias("in_block")).agg(strip(joined).alias("text"), *box).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no", "in_block"))
    return lines.withColumn("line_no", number).drop("in_block")


def load(spans: DataFrame, cfg: Config = DEFAULT) -> Loaded:
    lines = span_lines(spans)
    profile = furniture.furniture_profile(lines, cfg)
    return Loaded(spans, lines, profile, sections.headings(spans, profile), furniture.printed_pages(lines, profile, cfg))


def page_records(loaded: Loaded, cfg: Config = DEFAULT) -> DataFrame:
    """(document_id, pdf_page, printed_page, lines, raw_line_count): pages with their lines less the furniture."""
    kept = furniture.strip_furniture(loaded.lines, loaded.profile, cfg)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    raw = loaded.lines.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("raw_line_count"))
    out = raw.join(kept.groupBy(*PAGE).agg(listed.alias("lines")), PAGE, "left").join(loaded.printed, PAGE, "left")
    return out.select(*PAGE, "printed_page", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), "raw_line_count")


def placed_tables(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, boxes) with ``table_no`` from top to bottom of the page; a box spans its cells and knows its floor."""
    extent = cells.groupBy(*TABLE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    numbered = layout.table_numbers(extent.withColumnRenamed("table_no", "found"), PAGE)
    names = numbered.select(*PAGE, F.col("found").alias("table_no"), F.col("table_no").alias("number"))
    cells = cells.join(names, TABLE).withColumn("table_no", F.col("number")).drop("number")
    return cells, layout.table_floors(numbered.drop("found"), PAGE)


def recover_headers(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table, label, x0, x1, group): headers read from the lines above each table; none for a table without any."""
    band = layout.header_band(lines, boxes, TABLE)
    return layout.header_columns(layout.fragment_rows(band, TABLE), TABLE)


def extract_tables(lines: DataFrame, cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Normalised tables with box, caption and units, all tables of all documents at once.

    Cells (document_id, pdf_page, table_no, row, col, text, x0, y0, x1, y1); a cell may have no box.
    """
    cells, boxes = placed_tables(cells)
    heads = recover_headers(lines, boxes)
    named = heads.select(*TABLE, layout.full_label(F.col("label"), F.col("group")).alias("label"), "x0", "x1")
    labels = layout.assign_headers(layout.column_spans(cells, TABLE), named, TABLE)
    # Labels go by place: columns without any cell are not counted.
    grids = tables.normalise_tables(cells, labels.select(*TABLE, F.col("place").alias("col"), "label"), TABLE)
    context = tables.context_of(tables.band_lines(lines, boxes, TABLE, cfg.context_band), TABLE)
    return boxes.join(grids, TABLE).join(context, TABLE, "left")


def _attributed(rows: DataFrame, top: str, loaded: Loaded) -> DataFrame:
    """Rows with the section levels in force at ``top`` of their page, its printed number and the breadcrumb."""
    placed = sections.sections_at(rows.withColumn("top", F.col(top)), loaded.headings).drop("top")
    crumbs = breadcrumb(*[F.col(c) for c in ("part", "item", "note", "section")])
    return placed.withColumn("breadcrumb", crumbs).join(loaded.printed, PAGE, "left")


def text_parts(loaded: Loaded, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Text chunks of the blocks outside tables; a chunk is placed where its first block starts."""
    found = blocks.text_blocks(loaded.spans, boxes.select(*PAGE, *BOX), loaded.profile)
    placed = _attributed(found.select(*PAGE, "block_no", "text", "y0"), "y0", loaded)
    key = F.coalesce("section", "item", F.lit(""))
    packed = chunking.pack_blocks(placed.select(*PAGE, F.col("block_no").alias("ord"), key.alias("key"), "text"), cfg)
    anchors = placed.select(*PAGE, F.col("block_no").cast("bigint").alias("anchor"), *LEVELS, "printed_page")
    return chunking.text_chunks(packed.join(anchors, [*PAGE, "anchor"], "left"), keep=[*LEVELS, "printed_page"])


@dataclass(frozen=True)
class Extracted:
    chunks: DataFrame
    tables: DataFrame
    figures: DataFrame


def extract(spans: DataFrame, cells: DataFrame, images: DataFrame, cfg: Config = DEFAULT) -> Extracted:
    """All chunks of the documents, in three content types, with the tables and figures they come from."""
    loaded = load(spans, cfg)
    found = _attributed(extract_tables(loaded.lines, cells, cfg), "y0", loaded)
    figs = _attributed(figures.figures(images.drop("content"), loaded.lines, cfg), "y0", loaded)
    figs = figures.figure_texts(figs).withColumn("image_id", figures.image_id())
    pages = [part.select(*PAGE) for part in (spans, cells, images)]
    counts = pages[0].union(pages[1]).union(pages[2]).groupBy("document_id").agg(F.max("pdf_page").alias("page_count"))
    inventory = figures.figure_inventory(counts, figs.drop("printed_page"), loaded.printed).join(loaded.printed, PAGE, "left")
    where = [*LEVELS, "printed_page"]
    chunks = chunking.all_chunks(
        text_parts(loaded, found, cfg),
        chunking.table_chunks(found, keep=[*where, "units", "validation", "headers", "records", "markdown"]),
        chunking.figure_chunks(figs, keep=[*where, "is_decorative", "image_id"]),
        chunking.inventory_chunks(inventory.withColumn("section", F.lit("Document summary")), keep=["section", "printed_page"]),
    )
    return Extracted(chunks, found, figs)
