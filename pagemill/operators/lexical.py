"""BM25 over chunks: postings and statistics are tables, scoring is an equality join on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Config
from pagemill.functions.text import token_rows


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "embed_text") -> DataFrame:
    """(id_col, term, tf, dl), dl being the number of tokens of the chunk.

    All tokens of a chunk stand in one partition, so the map side already counts them and a row for
    each chunk and term is shuffled; ``dl`` is the sum of a chunk's counts.
    """
    counted = token_rows(chunks, [id_col], text_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("dl", F.sum("tf").over(Window.partitionBy(id_col)))


def corpus_stats(chunks: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: n and avgdl of all chunks, those without a token included; ``posts`` are their postings."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    words = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    return n.join(F.broadcast(words)).select("n", F.when(F.col("n") > 0, F.col("words") / F.col("n")).alias("avgdl"))  # one row each


def term_stats(posts: DataFrame, stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(term, df, idf): a negative idf is replaced by a share of the mean over all terms."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.join(F.broadcast(stats.select("n"))).withColumn("raw", raw)  # stats is one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    out = idf.join(F.broadcast(mean))
    return out.select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * cfg.bm25_epsilon).otherwise(F.col("raw")).alias("idf"))


def query_terms(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id_col, term, qtf): a term that a question repeats counts as often."""
    return token_rows(questions, [id_col], text_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("qtf"))


def ranked(scores: DataFrame, by: str, score: Column, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The k best rows for each ``by``, numbered from 1; a limit on the window keeps tasks small before the shuffle."""
    order = Window.partitionBy(by).orderBy(score.desc(), F.col(tie))
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def bm25_topk(
    questions: DataFrame,
    posts: DataFrame,
    terms: DataFrame,
    stats: DataFrame,
    k: int,
    cfg: Config = DEFAULT,
    allowed: DataFrame | None = None,
    chunk_col: str = "chunk_id",
    digits: int = 6,
) -> DataFrame:
    """(question_id, chunk_col, score, rank): the k best chunks with a positive score.

    ``allowed`` (chunk_col) restricts the chunks; statistics stay those of the whole corpus. The terms of the
    questions reduce stored postings before they are shuffled; postings made on the fly have been by then.
    """
    asked = query_terms(questions).join(terms, "term")
    hits = posts.join(asked, "term").join(F.broadcast(stats))
    if allowed is not None:
        hits = hits.join(allowed.select(chunk_col).distinct(), chunk_col, "left_semi")
    tf, k1, b = F.col("tf"), cfg.bm25_k1, cfg.bm25_b
    weight = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("question_id", chunk_col).agg(F.round(F.sum(weight), digits).alias("score")).where("score > 0")
    return ranked(scores, "question_id", F.col("score"), chunk_col, k)
