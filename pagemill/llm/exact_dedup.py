"""Exact dedup by content sort (DataFrame functions only).

Texts are normalised by deleting ASCII white space. Sampled splitters range-partition the
normalised text, each partition is sorted externally, so that equal texts stand side by side, and
the window operator compares neighbours in full to find the runs. Splitters are short (the first
``PREFIX`` characters and a fingerprint), so the sample that the driver sees stays small however
long the texts are; texts that agree in both are still compared in full. Texts that hold more than one
row in ``HOT_SHARE`` are found first by fingerprint; their runs are split by a salt, and the few
salted runs (at most ``HOT_SHARE`` texts times ``SALTS``) are joined by digest afterwards.

Nulls count as empty texts; all empty texts are equal. A null ``doc_id`` sorts last and stays
only when its whole group has none. Of repeated rows (same id, same text) one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, quoted

BLANKS = " \t\n\x0b\x0c\r"
#: A text is hot when it holds more than one in HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot texts.
HOT_SHARE = 512
SALTS = 512
PREFIX = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    The row that stays has the most code points in the original text, then the smallest id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))

    prints = base.select(F.xxhash64(norm).alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    prints = materialise(prints.where("n > 1"), "prints")
    least = max(1, base.count() // HOT_SHARE)
    hot = prints.where(F.col("n") > least).select("print", F.lit(True).alias("hot"))  # fewer than HOT_SHARE rows
    rows = base.select("doc_id", norm.alias("norm"), F.length(text).alias("len"), F.xxhash64(norm).alias("print"))
    rows = rows.join(F.broadcast(hot), "print", "left").withColumn("prefix", F.substring("norm", 1, PREFIX))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "len"), F.lit(SALTS))).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt.cast("int"))

    run = Window.partitionBy("prefix", "print", "salt", "norm")
    order = run.orderBy(F.desc("len"), F.asc_nulls_last("doc_id"))
    runs = rows.repartitionByRange("prefix", "print", "salt").select(
        "doc_id",
        "len",
        F.coalesce("hot", F.lit(False)).alias("hot"),
        F.row_number().over(order).alias("place"),
        F.first("doc_id").over(order).alias("keep_id"),
        F.first("len").over(order).alias("keep_len"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    runs = materialise(runs, "runs")
    best = (
        runs.where("hot and place = 1")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("keep_len")).alias("l"), F.col("keep_id").isNull().alias("void"), F.col("keep_id").alias("id"))).alias("best"),
            F.sum("group_size").alias("size"),
        )
    )
    out = runs.join(F.broadcast(best), "text_sha256", "left")
    first = F.when(F.col("hot"), F.col("best.id")).otherwise(F.col("keep_id"))
    # Repeated rows share id and length, so they share a salt: the first of its run is the one that stays.
    kept = (F.col("place") == 1) & F.col("keep_id").eqNullSafe(first) & (~F.col("hot") | (F.col("len") == -F.col("best.l")))
    return out.select(
        F.col("doc_id").alias(id_col),
        first.alias("keep_id"),
        F.when(F.col("hot"), F.col("size")).otherwise(F.col("group_size")).alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
    )
