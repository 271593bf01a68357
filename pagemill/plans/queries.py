"""Named queries over the driver's tables: one or more for each operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import engine
from pagemill.config import DEFAULT
from pagemill.functions import text as T
from pagemill.operators import answers, blocks, chunking, context, evaluation, extraction, figures, furniture, fusion, layout, lexical, sections, tables, vectors
from pagemill.plans import inputs
from pagemill.sources.index import merge_by_key
from pagemill.streaming.upsert import arrivals

DOC = ["document_id", "pdf_page"]
TABLE = ["table_id"]


def long(c: str):
    return F.col(c).cast("long").alias(c)


# Lines, furniture, printed pages


def line_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inputs.lines(spark, sf_dir)
    return out.select("document_id", long("pdf_page"), long("line_no"), T.furniture_key(F.col("text")).alias("norm"))


def furniture_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.furniture_profile(inputs.lines(spark, sf_dir))


def furniture_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir, footer=True)
    out = furniture.strip_furniture(rows, furniture.furniture_profile(rows))
    return out.select("document_id", long("pdf_page"), long("line_no"), "text")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir, footer=True)
    return furniture.printed_pages(rows, furniture.furniture_profile(rows))


def printed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir).select("document_id", long("pdf_page"), long("printed_page"))


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.page_offsets(_printed(spark, sf_dir)).select("document_id", long("page_offset"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a footer: printed number, lines before and after the furniture went."""
    rows = inputs.lines(spark, sf_dir, footer=True)
    profile = furniture.furniture_profile(rows)
    loaded = extraction.Loaded(rows, rows, profile, rows, furniture.printed_pages(rows, profile))
    out = extraction.page_records(loaded)
    text = F.md5(F.array_join("lines", "\n")).alias("text_md5")
    return out.select("document_id", long("pdf_page"), long("printed_page"), "raw_line_count", F.size("lines").cast("long").alias("n_lines"), text)


# Headings and sections


def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.headings(spark, sf_dir).select(long("ord"), "text", T.heading_kind(F.col("text")).alias("kind"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.headings(spark, sf_dir).withColumn("kind", T.heading_kind(F.col("text")))


def _gone(spans: DataFrame) -> DataFrame:
    return spans.select("document_id", F.explode(F.array(F.lit("lot # nf of #"), F.lit("item #. ro of #"))).alias("norm")).distinct()


def heading_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings among the lines of all spans: bold throughout, large enough, no furniture."""
    spans = inputs.spans(spark, sf_dir)
    return sections.headings(spans, _gone(spans)).select("document_id", long("pdf_page"), "top", "text", "kind", "size")


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined to lines, which are numbered through their page."""
    out = extraction.span_lines(inputs.spans(spark, sf_dir))
    return out.select("document_id", long("pdf_page"), long("block_no"), long("line_no"), "text", "x0", "y0", "x1", "y1")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks outside regions (the first line of each page), without furniture lines."""
    spans = inputs.spans(spark, sf_dir)
    regions = extraction.span_lines(spans).where("line_no = 1").select("document_id", "pdf_page", "x0", "y0", "x1", "y1")
    return blocks.text_blocks(spans, regions, _gone(spans)).select("document_id", long("pdf_page"), long("block_no"), "text", "x0", "y0", "x1", "y1")


def section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.section_states(_heads(spark, sf_dir), ["document_id"], ["pdf_page", "top"])
    return out.select("document_id", long("pdf_page"), "top", *sections.LEVELS)


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_nationkey") % 5).cast("string").alias("document_id"), (F.col("c_custkey") % 3 + 1).cast("int").alias("pdf_page"),
        F.when(F.col("c_custkey") % 9 != 0, (F.col("c_custkey") % 10 * 60).cast("double") + F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(5.0)).alias("top"), "c_custkey",
    )


def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.sections_at(_lookups(spark, sf_dir), _heads(spark, sf_dir))
    return out.select("c_custkey", *sections.LEVELS)


def provenance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation, location and breadcrumb of every looked-up position."""
    out = sections.sections_at(_lookups(spark, sf_dir), _heads(spark, sf_dir))
    printed = F.when(F.col("c_custkey") % 2 == 0, F.col("pdf_page") + 7)
    c = {n: F.col(n) for n in sections.LEVELS}
    return out.select(
        "c_custkey", T.citation(printed, F.col("pdf_page")).alias("citation"),
        T.location(c["note"], c["section"], c["item"], c["part"]).alias("location"),
        T.breadcrumb(c["part"], c["item"], c["note"], c["section"]).alias("breadcrumb"),
    )


# Geometry


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = inputs.boxes(spark, sf_dir)
    return b.where("box_no > 2"), b.where("box_no <= 2")


def region_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, regions = _sides(spark, sf_dir)
    return layout.outside_regions(blocks, regions, DOC).select("document_id", long("box_no"), "x0", "y0", "x1", "y1")


def table_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.table_floors(inputs.boxes(spark, sf_dir).withColumnRenamed("box_no", "table_no"), DOC)
    return out.select("document_id", long("table_no"), "floor")


def _columns_and_headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = inputs.boxes(spark, sf_dir)
    columns = b.select("document_id", (F.col("box_no") - 1).cast("int").alias("place"), "x0", "x1")
    headers = b.where("box_no % 2 = 0").select(
        "document_id", F.concat(F.lit("H"), F.col("box_no").cast("string")).alias("label"), (F.col("y0") * 2 + F.col("box_no")).alias("x0"), (F.col("y0") * 2 + 80 + F.col("box_no")).alias("x1")
    )
    return columns, headers


def header_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.assign_headers(*_columns_and_headers(spark, sf_dir), ["document_id"])
    return out.select("document_id", long("place"), "label")


def header_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, headers = _columns_and_headers(spark, sf_dir)
    leaves = columns.select("document_id", F.concat(F.lit("C"), F.col("place").cast("string")).alias("label"), "x0", "x1")
    groups = headers.select("document_id", F.col("label").alias("text"), "x0", "x1")
    out = layout.assign_groups(leaves, groups, ["document_id"])
    return out.select("document_id", "label", F.col("group").alias("grp"), layout.full_label(F.col("label"), F.col("group")).alias("full_label"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return b.select(
        "document_id", F.concat(F.lit("f"), F.col("box_no").cast("string")).alias("text"), "x0", (F.col("x0") + 40).alias("x1"), (F.col("y0") / 20).alias("y")
    )


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.fragment_rows(_fragments(spark, sf_dir), ["document_id"])
    return out.select("document_id", F.posexplode("rows").alias("row", "fragments")).select(
        "document_id", long("row"), F.array_join(F.transform("fragments", lambda f: f["text"]), " ").alias("row_text")
    )


def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.header_columns(layout.fragment_rows(_fragments(spark, sf_dir), ["document_id"]), ["document_id"])
    return out.select("document_id", "label", "x0", "x1", F.col("group").alias("grp"))


KEYS = ["document_id", "pdf_page", "table_no"]


def header_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header fragments above every table."""
    return layout.header_band(*inputs.band(spark, sf_dir), KEYS).select("document_id", "text", "x0", "x1", "y")


def header_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf headers with their groups, from the lines above every table."""
    out = extraction.recover_headers(*inputs.band(spark, sf_dir))
    return out.select("document_id", "label", "x0", "x1", F.col("group").alias("grp"))


def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption and units from the band above every table that has lines there."""
    lines, at = inputs.band(spark, sf_dir)
    return tables.context_of(tables.band_lines(lines, at, KEYS), KEYS).select("document_id", "caption", "units")


def figure_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each order, with the lines near it."""
    o = F.col("o_orderkey")
    images = inputs.table(spark, sf_dir, "orders").select(
        o.alias("document_id"), F.lit(1).alias("pdf_page"), F.lit(0).alias("img_no"), (o % 50 * 5).cast("int").alias("width"), (F.col("o_custkey") % 30 * 5).cast("int").alias("height"),
        F.lit(0.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(120.0).alias("y1"),
    )
    return figures.figures(images, inputs.band(spark, sf_dir)[0]).select("document_id", "caption", "surrounding_text", "is_decorative")


# Tables


def column_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_kinds(inputs.cells(spark, sf_dir), TABLE).select("table_id", long("col"), "kind")


def table_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.collapse(inputs.cells(spark, sf_dir), inputs.labels(spark, sf_dir), TABLE)
    return out.select("table_id", long("row"), long("grp"), "label", "value")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.normalise_tables(inputs.cells(spark, sf_dir), inputs.labels(spark, sf_dir), TABLE)


def table_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).select("table_id", "validation", long("raw_column_count"), F.size("headers").cast("long").alias("n_columns"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).select("table_id", "markdown")


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each table as sorted key=value text, one row for each record."""
    out = _normalised(spark, sf_dir).select("table_id", F.posexplode("records").alias("pos", "record"))
    pairs = F.transform(F.array_sort(F.map_entries("record")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("table_id", long("pos"), F.array_join(pairs, ";").alias("record"))


def units_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    intro = F.concat(F.lit("The following table shows "), F.left("text", F.lit(30)), F.lit(": "), F.lit("(In Millions, except"), F.col("lang"), F.lit(") "), "text", F.lit(" (in units)"))
    band = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(intro)
    band = T.squeeze(band)
    return docs.select("doc_id", T.last_match(band, T.CAPTION).alias("caption"), T.last_match(band, T.UNITS).alias("units"))


# Chunks and figures


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    blocks = rows.select(*DOC, F.col("line_no").alias("ord"), (F.col("line_no") / 7).cast("int").cast("string").alias("key"), "text")
    return chunking.pack_blocks(blocks)


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    caption = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Figure "), "p_name"))
    out = p.select(
        (F.col("p_partkey") % 40).cast("string").alias("document_id"), (F.col("p_partkey") % 6 + 1).cast("int").alias("pdf_page"), F.col("p_partkey").alias("img_no"),
        (F.col("p_size") * 4).cast("int").alias("width"), (F.col("p_size") * 3).cast("int").alias("height"), caption.alias("caption"), F.col("p_type").alias("surrounding_text"),
        F.when(F.col("p_partkey") % 6 > 1, (F.col("p_partkey") % 6 - 1).cast("int")).alias("printed_page"), F.col("p_brand").alias("breadcrumb"),
    )
    out = out.where(~((F.col("width") < DEFAULT.min_figure) & (F.col("height") < DEFAULT.min_figure)))
    return out.withColumn("is_decorative", figures.decorative())


def figure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.figure_texts(_figures(spark, sf_dir)).select("document_id", "img_no", "is_decorative", "embed_text", "display_text")


def figure_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = _figures(spark, sf_dir)
    docs = spark.range(60).select(F.col("id").cast("string").alias("document_id"), F.lit(6).alias("page_count"))
    printed = figs.select("document_id", "pdf_page", "printed_page").distinct()
    out = figures.figure_inventory(docs, figs.drop("printed_page"), printed)
    return out.select("chunk_id", long("pdf_page"), "total", "decorative", "text")


def _table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), "o_orderpriority")
    t = _normalised(spark, sf_dir).join(orders, "table_id")
    units = F.when(F.col("table_id") % 2 == 0, "(in units)")
    return t.select(
        F.lit("orders").alias("document_id"), (F.col("table_id") % 90 + 1).cast("int").alias("pdf_page"), F.col("table_id").alias("table_no"),
        F.lit(None).cast("int").alias("printed_page"), F.col("o_orderpriority").alias("breadcrumb"),
        F.when(F.col("table_id") % 4 == 0, F.lit("The following table shows sales (in units):")).alias("caption"), units.alias("units"),
        "headers", "rows", "markdown", "validation", "raw_column_count",
    )


def table_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.table_chunks(_table_parts(spark, sf_dir)).select("chunk_id", "embed_text", "display_text")


def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of three types, counted by document and type."""
    parts = _all_chunks(spark, sf_dir)
    return parts.groupBy("document_id", "content_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("embed_text")).cast("long").alias("chars"))


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every chunk of three types in its document."""
    return chunking.in_order(_all_chunks(spark, sf_dir)).select("chunk_id", long("ordinal"))


def table_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as tables, numbered on their page."""
    out = layout.table_numbers(inputs.boxes(spark, sf_dir), DOC)
    return out.select("document_id", long("pdf_page"), long("table_no"), "x0", "y0", "x1", "y1")


def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the columns of tables whose columns are the line numbers of an order."""
    cells = inputs.boxes(spark, sf_dir).withColumnsRenamed({"document_id": "table_id", "box_no": "col"})
    cells = cells.withColumn("x0", F.when(F.col("col") != 3, F.col("x0")))
    return layout.column_spans(cells, TABLE).select("table_id", long("col"), long("place"), "x0", "x1")


def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence flagged by replies that name every other chunk, some of them twice, and one that isn't there."""
    used = _used(spark, sf_dir)
    odd = F.sort_array(F.collect_list(F.when(F.col("place") % 2 == 1, F.col("chunk_id").cast("string"))))
    answered = used.groupBy("question_id").agg(F.concat(odd, F.slice(odd, 1, 1), F.array(F.lit("absent"))).alias("cited"))
    return answers.flag_cited(used, answered).select("question_id", "chunk_id", "cited")


def _all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select(
        F.col("source").alias("document_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("pdf_page"), F.col("doc_id").alias("chunk_no"), F.col("text").alias("body"),
        F.lit(None).cast("string").alias("part"), F.col("lang").alias("item"), F.lit("").alias("note"), F.lit(None).cast("string").alias("section"),
    )
    figs = figures.figure_texts(_figures(spark, sf_dir))
    return chunking.all_chunks(chunking.text_chunks(docs), chunking.table_chunks(_table_parts(spark, sf_dir)), chunking.figure_chunks(figs))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table_parts(spark, sf_dir)
    out = evaluation.ingest_report(_all_chunks(spark, sf_dir), t, _figures(spark, sf_dir))
    return out.select("document_id", *[long(c) for c in out.columns if c not in ("document_id", "flagged")], "flagged")


# Lexical retrieval


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    counts = T.token_rows(docs, ["doc_id"], "text").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count("term").alias("n_terms"), F.max("term").alias("last_term"))


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embed_text"))
    posts = lexical.postings(chunks)
    stats = lexical.corpus_stats(chunks, posts)
    return posts, lexical.term_stats(posts, stats), stats


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf_dir: str, allowed: DataFrame | None = None) -> DataFrame:
    posts, terms, stats = _lexical(spark, sf_dir)
    return lexical.bm25_topk(inputs.questions(spark, sf_dir), posts, terms, stats, DEFAULT.lexical_k, allowed=allowed)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("question_id", "chunk_id", "score", long("rank"))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks of type table; statistics of the whole corpus."""
    allowed = inputs.chunks(spark, sf_dir).where("content_type = 'table'").select("chunk_id")
    return _bm25(spark, sf_dir, allowed).select("question_id", "chunk_id", "score", long("rank"))


# Dense retrieval


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_topk(inputs.question_vectors(spark, sf_dir), inputs.vectors(spark, sf_dir), DEFAULT.dense_k)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("question_id", "chunk_id", "score", long("rank"))


def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks of type table, filtered before the limit."""
    v = inputs.vectors(spark, sf_dir).where("chunk_id % 3 = 1")
    return vectors.cosine_topk(inputs.question_vectors(spark, sf_dir), v, DEFAULT.dense_k).select("question_id", "chunk_id", "score", long("rank"))


class VowelCounts:
    """An embedder that SQL can restate: how often each vowel stands in a text."""

    name, dimension = "vowels", 5

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(v)) for v in "aeiou"] for t in texts]


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through an embedder, batch by batch."""
    docs = vectors.embed_texts(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), VowelCounts(), "text")
    return docs.select("doc_id", *[F.get("embedding", F.lit(i)).cast("long").alias(f"n_{v}") for i, v in enumerate("aeiou")])


# Routing and fusion


def route_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = inputs.turns(spark, sf_dir).where("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("question_id"), F.col("text").alias("question"))
    names = inputs.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("question_id"),
        F.concat(
            F.element_at(F.array(*[F.lit(s) for s in ("How  much did ", "Explain ", "Show the chart of ", "Show charts of ", "Why did total ", "Was 1,234,567 ")]), (F.col("p_partkey") % 6).cast("int") + 1),
            F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, " cost?").otherwise("?"),
        ).alias("question"),
    )
    asked = inputs.questions(spark, sf_dir).select(F.concat(F.lit("b"), "question_id").alias("question_id"), "question")
    out = fusion.routed(asked.union(user).union(names))
    return out.select("question_id", *[F.col(f"bias.{t}").alias(f"bias_{t}") for t in inputs.TYPES], "routed_to")


def _fused(spark: SparkSession, sf_dir: str, boosted: bool) -> DataFrame:
    asked = inputs.questions(spark, sf_dir)
    extra = {}
    if boosted:
        # Benchmark passages have few cues, so a lead that rotates gives them some.
        lead = F.element_at(F.array(F.lit("Explain "), F.lit("How much "), F.lit("Which chart ")), (F.col("question_id") % 3).cast("int") + 1)
        extra = {"bias": fusion.routed(asked.withColumn("question", F.concat(lead, "question"))), "types": inputs.chunks(spark, sf_dir)}
    return fusion.fuse(_dense(spark, sf_dir), _bm25(spark, sf_dir), DEFAULT.top_k, **extra)


def _fused_columns(df: DataFrame) -> DataFrame:
    return df.select("question_id", "chunk_id", "score", "boost", long("dense_rank"), long("lexical_rank"), "found_by", long("rank"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_columns(_fused(spark, sf_dir, False))


def rrf_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_columns(_fused(spark, sf_dir, True))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, True).join(inputs.chunks(spark, sf_dir), "chunk_id")


def content_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.content_mix(_hits(spark, sf_dir))
    pairs = F.transform(F.map_entries("content_mix"), lambda e: F.format_string("%s=%d", e["key"], e["value"]))
    return out.select("question_id", F.array_join(pairs, ", ").alias("mix"))


# Evidence, answers, evaluation


def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.distinct_hits(_hits(spark, sf_dir)).select("question_id", "chunk_id", long("rank"))


def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = inputs.chunks(spark, sf_dir)
    return chunks.select("chunk_id", context.evidence_block(chunks).alias("block"))


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = context.distinct_hits(_hits(spark, sf_dir))
    return context.within_budget(hits.withColumn("block", context.evidence_block(hits)))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _used(spark, sf_dir).select("question_id", "chunk_id", long("place"), long("n_dropped"))


def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.build_context(_used(spark, sf_dir))
    return out.select("question_id", F.md5("evidence").alias("evidence_md5"), "n_used", long("n_dropped"), long("characters"))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked for each question; those of even number get no evidence."""
    made = context.build_context(_used(spark, sf_dir)).where("question_id % 2 = 1").select("question_id", "evidence")
    rows = inputs.questions(spark, sf_dir).join(made, "question_id", "left").fillna("", ["evidence"])
    return rows.select("question_id", F.md5(T.prompt(F.col("question"), F.col("evidence"))).alias("prompt_md5"))


def answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a stand-in that cites all it is shown, or refuses; questions of a number divisible by 5 have no hits."""
    hits = _hits(spark, sf_dir).where("question_id % 5 <> 0")
    out = engine.answer(inputs.questions(spark, sf_dir), hits, answers.EchoCompleter())
    n = F.coalesce(F.size(F.filter("evidence", lambda e: e["cited"])), F.lit(0)).cast("long")
    first = F.try_element_at("evidence", F.lit(1))["citation"]
    return out.select("question_id", "answer", "refused", "model", long("n_hits"), n.alias("n_cited"), first.alias("first_citation"), F.md5("rendered").alias("rendered_md5"))


def vision_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.vision_pages(_used(spark, sf_dir)).select("question_id", "document_id", long("pdf_page"), long("place"))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _used(spark, sf_dir).withColumn("cited", (F.col("question_id") % 2 == 0) & (F.col("place") % 2 == 1))
    return answers.source_lists(inputs.questions(spark, sf_dir), used)


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.turns(spark, sf_dir).where("role = 'assistant'")
    safe = F.regexp_replace(F.left("text", F.lit(60)), r'[^A-Za-z0-9 .]', "")
    n = F.col("conv_id") % 6
    raw = (
        F.when(n == 0, F.concat(F.lit('{"answer": "'), safe, F.lit('", "refused": false, "cited_chunk_ids": ["a", "b"]}')))
        .when(n == 1, F.concat(F.lit('{"answer": "'), safe, F.lit('", "refused": true}')))
        .when(n == 2, F.lit('{"answer": "  ", "refused": false, "cited_chunk_ids": ["c"]}'))
        .when(n == 3, F.concat(F.lit('["'), safe, F.lit('"]')))
        .when(n == 4, safe)
        .otherwise(F.concat(F.lit('{"answer": "'), safe, F.lit('", "refused": "false", "cited_chunk_ids": null}')))
    )
    out = t.select("conv_id", "turn", answers.parsed_reply(raw).alias("r"))
    return out.select("conv_id", "turn", "r.answer", "r.refused", F.array_join("r.cited", ",").alias("cited"))


def contains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer holds the first and the fourth word of the turn before it."""
    t = inputs.turns(spark, sf_dir)
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = F.split("asked", " ")
    wanted = F.array(F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(3)), F.lit("")))
    out = t.withColumn("asked", asked).where("role = 'assistant' and asked is not null")
    return out.select("conv_id", "turn", T.contains_all(F.col("text"), wanted).alias("has_all"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage: found by an equality join on five-word shingles, then checked in full."""
    words = lambda c: F.split(F.regexp_replace(F.lower(c), r"[^a-z]+", " "), " ")
    q = inputs.questions(spark, sf_dir).select("question_id", F.trim("question").alias("t"))
    # The third shingle of a passage lies inside it, whatever stands around it in a document.
    q = q.withColumn("gram", F.array_join(F.slice(words(F.col("t")), 3, 5), " "))
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    grams = F.transform(F.col("w"), lambda x, i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(5)), " "))
    # Shingles travel without the texts, which only the documents that have one of a passage need.
    hits = d.select("doc_id", F.explode(grams).alias("gram")).join(q, "gram").select("question_id", "t", "doc_id").distinct()
    found = hits.join(docs, "doc_id").where(F.contains("text", F.col("t")))
    return found.groupBy("question_id").agg(F.sort_array(F.collect_set("doc_id")).alias("expected"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _fused(spark, sf_dir, False)
    lists = hits.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("retrieved"))
    none = F.array().cast("array<bigint>")
    rows = inputs.questions(spark, sf_dir).join(lists, "question_id", "left").join(_truth(spark, sf_dir), "question_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("retrieved", "expected")})
    return evaluation.retrieval_scores(rows)


def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, sf_dir).select("question_id", "hit", six("recall"), six("precision"), six("reciprocal_rank"), long("first_rank"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from conversations, scored: pages, refusals and expectations follow from the numbers of a turn."""
    t = inputs.turns(spark, sf_dir).where("role = 'assistant'")
    c, n = F.col("conv_id"), F.col("turn")
    page = lambda x: F.array(((x % 9) + 1).cast("int"), ((x % 4) + 1).cast("int"))
    none = F.array().cast("array<int>")
    should = c % 5 == 0
    rows = t.select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.element_at(F.array(*[F.lit(x) for x in evaluation.CATEGORIES]), F.when(should, 4).otherwise((c % 3).cast("int") + 1)).alias("category"),
        F.col("text").alias("answer"), ((c + n) % 7 == 0).alias("refused"), F.when(c % 8 == 1, none).otherwise(page(c + n)).alias("cited_pages"),
        F.when(should, none).otherwise(page(c)).alias("expected_pages"), F.when(c % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 2, 3))).alias("expected"),
        should.alias("should_refuse"), (F.length("text") / 100.0).alias("seconds"),
    )
    rows = evaluation.answer_scores(rows)
    scored = evaluation.retrieval_scores(rows.withColumn("wanted", F.col("expected")).withColumn("expected", F.col("expected_pages")).withColumn("retrieved", F.col("cited_pages")))
    return scored.withColumn("expected", F.col("wanted")).drop("wanted")


def answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("conv_id", "turn", "correct", "refusal_correct", "hallucinated", "citation_correct", "cited_any", "graded")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_answered(spark, sf_dir)))


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_answered(spark, sf_dir), ("category",)))


def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(_answered(spark, sf_dir)).select("id", "category", "reason")


# Index and streams


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents merged with a second version of those of even id and with new ones."""
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("embed_text"))
    newer = docs.where("cast(chunk_id as bigint) % 2 = 0").select("chunk_id", F.concat(F.lit("v2 "), "embed_text").alias("embed_text"))
    added = docs.where("cast(chunk_id as bigint) % 10 = 3").select(F.concat("chunk_id", F.lit("-new")).alias("chunk_id"), "embed_text")
    out = merge_by_key(docs, newer.unionByName(added), "chunk_id")
    return out.select("chunk_id", F.length("embed_text").cast("long").alias("n"), F.md5("embed_text").alias("text_md5"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(inputs.table(spark, sf_dir, "events"))


QUERIES = (
    line_normalise, furniture_profile, furniture_strip, printed_page, page_offset, page_records, heading_scan, span_lines, text_blocks, header_band, header_recover,
    table_context, figure_context, prompt_text, answer_flow, embed_batches, heading_classify, section_state, section_asof,
    provenance_labels, region_antijoin, table_floor, header_assign, header_groups, header_rows, header_columns, column_classify,
    table_collapse, table_validate, table_markdown, table_records, units_caption, chunk_pack, figure_flags, figure_inventory,
    table_chunk_text, chunk_union, chunk_order, table_number, header_spans, cited_evidence, ingest_report, tokenize_stats, term_stats, bm25_topk, bm25_filtered, cosine_topk, cosine_filtered,
    route_bias, rrf_fuse, rrf_boosted, content_mix, context_dedup, evidence_block, context_budget, context_text, vision_pick,
    source_list, reply_parse, contains_all, retrieval_score, answer_score, eval_summary, eval_by_category, eval_failures,
    index_upsert, event_windows,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
