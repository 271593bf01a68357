"""The index as Parquet tables in one folder: chunks with their vectors, postings, statistics and a marker.

``chunks`` is partitioned by content type, so a filter on it prunes files. Every
build writes new version folders and moves the pointer last; readers never see half a build.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.errors import IndexMissing, InvalidRequest, ModelMismatch
from pagemill.operators.lexical import corpus_stats, postings, term_stats


def merge_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of the rows of ``existing`` with the same key; others stay.

    Of new rows with the same key one stays: that with the least values, in the order of the columns.
    """
    sortable = [c for c, t in new.dtypes if c != key and "map<" not in t]
    first = Window.partitionBy(key).orderBy(*sortable) if sortable else Window.partitionBy(key).orderBy(key)
    new = new.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def chunk_uuid(chunk_id: str) -> str:
    """The stable point id of a chunk."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, chunk_id))


class Index:
    """An index under ``path`` (any file system that Spark reads and writes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointer(self) -> dict | None:
        try:
            row = self.spark.read.schema("version string, model string, dimension int, at timestamp").json(f"{self.path}/meta").orderBy(F.desc("at")).first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def _read(self, name: str) -> DataFrame:
        meta = self._pointer()
        if meta is None:
            raise IndexMissing(self.path)
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/{name}")

    def write(self, chunks: DataFrame, model: str, dimension: int, rebuild: bool = False) -> int:
        """Merge chunks (with an ``embedding``) into the index, or replace it; returns how many it holds.

        As in an upsert, chunks that are no longer produced stay until a rebuild.
        """
        meta = None if rebuild else self._pointer()
        if meta is not None:
            self.verify(model)
            chunks = merge_by_key(self.chunks(), chunks, "chunk_id")
        version = f"v-{uuid.uuid4().hex}"
        # Written first and checked then, so that no text is embedded twice; the pointer moves only to a sound build.
        chunks.write.partitionBy("content_type").parquet(f"{self.path}/{version}/chunks")
        stored = self.spark.read.parquet(f"{self.path}/{version}/chunks")
        if stored.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).limit(1).count():
            raise InvalidRequest(f"an embedding is not of length {dimension}")
        postings(stored).write.parquet(f"{self.path}/{version}/postings")
        posts = self.spark.read.parquet(f"{self.path}/{version}/postings")
        corpus_stats(stored, posts).write.parquet(f"{self.path}/{version}/stats")
        stats = self.spark.read.parquet(f"{self.path}/{version}/stats")
        term_stats(posts, stats).write.parquet(f"{self.path}/{version}/terms")
        pointer = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), F.current_timestamp().alias("at"))
        pointer.write.mode("append").json(f"{self.path}/meta")
        return stored.count()

    def verify(self, model: str) -> None:
        """Raise unless the index exists and was built with this embedding model."""
        meta = self._pointer()
        if meta is None:
            raise IndexMissing(self.path)
        if meta["model"] != model:
            raise ModelMismatch(f"{meta['model']} is stored, {model} is asked for")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def lexical(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._read("postings"), self._read("terms"), self._read("stats")

    def write_report(self, report: DataFrame) -> None:
        """Append the report of an ingestion, a row for each document."""
        report.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{self.path}/reports")

    def reports(self) -> DataFrame:
        return self.spark.read.json(f"{self.path}/reports")

    def write_images(self, images: DataFrame) -> None:
        """Append images (document_id, pdf_page, img_no, image_id, content)."""
        images.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/images")

    def images(self) -> DataFrame:
        """(image_id, document_id, pdf_page, content), the bytes as last stored, also in base64 for a prompt."""
        last = self.spark.read.parquet(f"{self.path}/images").groupBy("image_id", "document_id", "pdf_page").agg(F.max_by("content", "at").alias("content"))
        return last.withColumn("base64", F.base64("content"))

    def wait_until_ready(self, seconds: float = 30.0, every: float = 0.5) -> bool:
        """Whether the index has a build, after waiting for one for so long at most."""
        until = time.monotonic() + seconds
        while self._pointer() is None:
            if time.monotonic() >= until:
                return False
            time.sleep(every)
        return True

    def count(self) -> int:
        return self.chunks().count()

    def health(self) -> dict:
        meta = self._pointer()
        return {"ready": meta is not None, "chunks": self.count() if meta else 0, "model": meta and meta["model"]}
