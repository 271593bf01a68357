"""The engine's tables, derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators.furniture import page_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, footer: bool = False) -> DataFrame:
    """A source is a document and its documents are pages; optionally with a footer that carries a page number."""
    docs = table(spark, sf_dir, "documents")
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("int")
    out = docs.select(F.col("source").alias("document_id"), number.alias("pdf_page"), "doc_id", "text")
    if footer:
        line = F.concat(F.lit("\nReport "), F.col("document_id"), F.lit(" | "), (F.col("pdf_page") + 2).cast("string"))
        out = out.withColumn("text", F.concat("text", line))
    return out


def lines(spark: SparkSession, sf_dir: str, footer: bool = False) -> DataFrame:
    return page_lines(pages(spark, sf_dir, footer))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are documents, nations are headings of rotating kinds, ten to a page."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = (
        F.when(key % 7 == 0, F.concat(F.lit("PART I — "), "n_name"))
        .when(key % 7 == 2, F.concat(F.lit("Item 2. "), "n_name"))
        .when(key % 7 == 4, F.concat(F.lit("Note 3 – "), "n_name"))
        .otherwise(F.col("n_name"))
    )
    page, top = (key / 10).cast("int") + 1, (key % 10 * 60).cast("double")
    return n.select(F.col("n_regionkey").cast("string").alias("document_id"), page.alias("pdf_page"), top.alias("top"), text.alias("text"), key.alias("ord"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with ``line``, their number within the order (``l_linenumber`` repeats)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each lineitem; orders are documents and ship modes of three pages."""
    x0, y0 = F.col("l_quantity") * 4, F.round(F.col("l_discount") * 2000)
    return order_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 3).cast("int").alias("pdf_page"), F.col("line").alias("box_no"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 30 + F.round(F.col("l_tax") * 1000)).alias("x1"), (y0 + 20 + F.col("line") * 8).alias("y1"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are pages of fifty documents; a lineitem is a line of two spans, two lines a block."""
    line = F.col("line")
    lead = F.when(line % 5 == 0, "Item 2. ").when(line % 5 == 1, "Note 3 – ").otherwise(" Lot 4 ")
    rest = F.concat("l_returnflag", "l_linestatus", F.lit(" of "), (F.col("l_partkey") % 7).cast("string"))
    bold = lambda c, v: F.when(c == v, "Times-BOLD").otherwise("Times")
    x0, y0 = F.col("l_quantity") * 4, F.round(F.col("l_discount") * 2000)
    rows = order_lines(spark, sf_dir).select(
        (F.col("l_orderkey") % 50).cast("string").alias("document_id"), F.col("l_orderkey").cast("int").alias("pdf_page"), F.floor((line - 1) / 2).cast("int").alias("block_no"), ((line - 1) % 2).alias("line_no"),
        x0.alias("lx0"), y0.alias("ly0"), (x0 + 30 + F.round(F.col("l_tax") * 1000)).alias("lx1"), (y0 + 20).alias("ly1"), (line % 3 + 7).cast("double").alias("size"),
        F.posexplode(F.array(F.struct(lead.alias("text"), bold(F.col("l_returnflag") != "N", True).alias("font")), F.struct(rest.alias("text"), bold(F.col("l_linestatus"), "F").alias("font")))).alias("span_no", "s"),
    )
    block = Window.partitionBy("document_id", "pdf_page", "block_no")
    edges = {"bx0": F.min("lx0").over(block), "by0": F.min("ly0").over(block), "bx1": F.max("lx1").over(block), "by1": F.max("ly1").over(block)}
    return rows.withColumns({"text": F.col("s.text"), "font": F.col("s.font"), **edges}).drop("s")


def band(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, tables): a table on the one page of each order, and the lines around it."""
    line, y0 = F.col("line"), F.round(F.col("l_discount") * 2000)
    text = F.when(line % 4 == 1, F.concat(F.lit("h"), line)).when(line % 4 == 2, F.concat(F.lit("The following table shows lot "), line, F.lit(":"))).when(line % 4 == 3, "(in units)").otherwise(F.concat(F.lit("Figure "), line, F.lit(" of sales")))
    x0 = F.col("l_quantity") * 8
    at = [F.col("l_orderkey").alias("document_id"), F.lit(1).alias("pdf_page")]
    lines_ = order_lines(spark, sf_dir).select(
        *at, line.alias("line_no"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(line % 4 == 2, 200.0).otherwise(40.0)).alias("x1"), (y0 + 10).alias("y1")
    )
    key = F.col("o_orderkey")
    tables = table(spark, sf_dir, "orders").select(
        key.alias("document_id"), F.lit(1).alias("pdf_page"), F.lit(0).alias("table_no"), F.lit(0.0).alias("x0"), F.lit(150.0).alias("y0"), F.lit(360.0).alias("x1"), F.lit(180.0).alias("y1"),
        F.when(key % 3 == 0, 100.0).alias("floor"),
    )
    return lines_, tables


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a table and a lineitem a row of seven raw columns, with stray symbols and negatives."""
    li = order_lines(spark, sf_dir)
    price = F.format_number(F.col("l_extendedprice").cast("long"), 0)
    price = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), price, F.lit(")"))).otherwise(price)
    odd = F.col("line") % 2 == 1
    merged = F.when(F.col("l_orderkey") % 11 == 0, F.concat(price, F.lit(" "), price)).otherwise(price)
    texts = [
        F.concat(F.lit("Line "), F.col("line").cast("string")), F.when(odd, F.lit("$")).otherwise(merged), F.when(odd, merged).otherwise(F.lit("")),
        F.lit(" "), F.lit("$"), F.col("l_quantity").cast("long").cast("string"), F.lit("%"),
    ]
    rows = li.select(F.col("l_orderkey").alias("table_id"), F.col("line").alias("row"), F.posexplode(F.array(*texts)).alias("col", "text"))
    return rows


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the raw columns; some orders repeat one, some have none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"))
    none, twice = F.col("table_id") % 13 == 0, F.col("table_id") % 7 == 0
    pick = lambda s: F.when(none, "").otherwise(s)
    names = F.array(F.lit(""), pick(F.lit("Sales | 1995")), pick(F.lit("Sales | 1995")), F.lit(""), F.lit(""), pick(F.when(twice, "Sales | 1995").otherwise("Units")), F.lit(""))
    return o.select("table_id", F.posexplode(names).alias("col", "label"))


TYPES = ("text", "table", "figure")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of rotating types, with provenance and trust flags."""
    docs, flags = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 3).cast("int") + 1)
    return docs.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), kind.alias("content_type"), F.col("text").alias("display_text"), F.col("text").alias("embed_text"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("pdf_page"), F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 50 - 1).cast("int")).alias("printed_page"),
        F.lit(None).cast("string").alias("part"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Item "), F.col("lang"))).alias("item"),
        F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("section"), F.lit("").alias("note"),
        F.when(F.col("doc_id") % 6 == 1, "(in millions)").alias("units"), F.when(F.coalesce("quality", F.lit(1)) == 1, "ok").otherwise("width_mismatch").alias("validation"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_decorative"), F.col("source").alias("document_id"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of the same number stands for a question's."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return v.join(questions(spark, sf_dir).select("question_id"), "question_id", "left_semi")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
