"""Incremental ingestion: new chunks arrive as a stream and are merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.sources.index import Index


def stream_into(chunks: DataFrame, index: Index, model: str, dimension: int, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, version_col: str | None = None) -> StreamingQuery:
    """Merge a stream of chunks into an index; the version of a chunk with the greatest ``version_col`` in a batch wins.

    Without ``version_col`` a batch must hold one version of a chunk at most; of several, any is taken.
    The column is not stored.

    Merging by key is idempotent, so a batch that is replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.write(prepare(latest(batch, version_col)), model, dimension)

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(chunks: DataFrame, version_col: str | None) -> DataFrame:
    """One row for each chunk_id: that with the greatest version, which goes."""
    if version_col is None:
        return chunks.dropDuplicates(["chunk_id"])
    row = F.struct(*[c for c in chunks.columns if c != version_col])
    return chunks.groupBy("chunk_id").agg(F.max_by(row, version_col).alias("row")).select("row.*")


def arrivals(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of events (ts, event_type) per window; works on a stream and on a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
