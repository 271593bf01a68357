"""Documents as files: a decoder that plugs in, rejects, and the question set.

Decoding pages is the one step that needs a foreign library, so it is an interface. A decoder gets
the bytes of one file and yields rows of spans and, if it can, of table cells and images; everything
after that is DataFrame work. ``JsonDecoder`` reads the output of a decoder that ran elsewhere.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.errors import DocumentEncrypted, DocumentError, DocumentInvalid, DocumentMissing
from pagemill.schemas import CELLS, IMAGES, QUESTIONS, SPANS

MAGIC = b"%PDF-"
PARTS = {"spans": SPANS, "cells": CELLS, "images": IMAGES}


class Decoder(Protocol):
    """Yields one dict for each span; raises DocumentEncrypted or DocumentInvalid.

    ``cells`` and ``images`` with the same arguments are optional; tables are numbered in any order.
    """

    def spans(self, document_id: str, content: bytes) -> Iterator[dict]: ...


class JsonDecoder:
    """Decoded documents as JSON: an object with lists ``spans``, ``cells`` and ``images`` of rows as in ``schemas``,
    without their document; the bytes of an image in base64."""

    def _rows(self, part: str, document_id: str, content: bytes) -> Iterator[dict]:
        try:
            found = json.loads(content)
            rows = [dict(row) for row in found.get(part) or []]
        except (ValueError, TypeError, AttributeError) as e:
            raise DocumentInvalid(document_id) from e
        for row in rows:
            if row.get("content") is not None:
                row["content"] = base64.b64decode(row["content"])
            yield {**row, "document_id": document_id}

    def spans(self, document_id: str, content: bytes) -> Iterator[dict]:
        return self._rows("spans", document_id, content)

    def cells(self, document_id: str, content: bytes) -> Iterator[dict]:
        return self._rows("cells", document_id, content)

    def images(self, document_id: str, content: bytes) -> Iterator[dict]:
        return self._rows("images", document_id, content)


class PlainTextDecoder:
    """Pages parted by form feeds, a line for a span; for tests and for text exports."""

    def spans(self, document_id: str, content: bytes) -> Iterator[dict]:
        try:
            text = content.decode()
        except UnicodeDecodeError as e:
            raise DocumentInvalid(document_id) from e
        if not text.strip():
            raise DocumentInvalid(document_id)
        for page, body in enumerate(text.split("\f"), 1):
            for n, line in enumerate(body.split("\n")):
                if line.strip():
                    box = dict(zip(("x0", "y0", "x1", "y1"), (0.0, n * 12.0, 7.0 * len(line), n * 12.0 + 10.0), strict=True))
                    font = "Bold" if line.isupper() else "Regular"
                    yield {
                        "document_id": document_id, "pdf_page": page, "block_no": n, "line_no": n, "span_no": 0, "text": line, "font": font, "size": 9.0,
                        **{f"l{k}": v for k, v in box.items()}, **{f"b{k}": v for k, v in box.items()},
                    }


def _decoded(spark: SparkSession, path: str, decoder: Decoder, part: str, magic: bytes | None) -> DataFrame:
    """Rows of one part of the files under ``path`` with ``error``, which is set in the one row of a file that failed."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except Exception as e:
        raise DocumentMissing(str(e)) from e
    files = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("document_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("document_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if magic and not content.startswith(magic):
                        raise DocumentInvalid("not of the expected kind")
                    rows = list(getattr(decoder, part)(name, content))
                    if not rows and part == "spans":
                        raise DocumentInvalid("no pages")
                except DocumentError as e:
                    kind = {DocumentEncrypted: "encrypted", DocumentInvalid: "invalid"}.get(type(e), "unreadable")
                    rows = [{"document_id": name, "error": kind}]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    schema = StructType.fromDDL(PARTS[part] + ", error string")
    arrow = to_arrow_schema(schema)
    return files.mapInArrow(run, schema)


def read_spans(spark: SparkSession, path: str, decoder: Decoder, magic: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, rejects) of the files under ``path``; rejects are (document_id, error).

    Files are decoded by the executors. A file that can't be decoded gives one reject and no span.
    """
    decoded = _decoded(spark, path, decoder, "spans", magic)
    return decoded.where("error is null").drop("error"), decoded.where("error is not null").select("document_id", "error")


def read_part(spark: SparkSession, path: str, decoder: Decoder, part: str, magic: bytes | None = None) -> DataFrame:
    """The table cells or images of the files under ``path``; none if the decoder doesn't yield them.

    Files that can't be decoded give no row: they are among the rejects of ``read_spans``.
    """
    if not hasattr(decoder, part):
        return spark.createDataFrame([], PARTS[part])
    return _decoded(spark, path, decoder, part, magic).where("error is null").drop("error")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of a JSON question set."""
    return spark.read.schema(QUESTIONS).json(path, multiLine=True).select("document", F.explode("questions").alias("q")).select("document", "q.*")
