"""WARC archives: writing captures and assembling transactions.

Writing: each page becomes a request, a response or revisit, and a metadata record; request and
metadata name the response's record in ``WARC-Concurrent-To``. Files are gzip-compressed WARC 1.1,
written with Spark's text writer into a folder that all executors share.

Reading: files are split into records by ``Content-Length``; then request, response (or revisit)
and metadata records are joined through the concurrent-to identifiers into one nested row per
capture. A capture without request or metadata has a null there; records that name an unknown
response give no capture.

Blanks and control characters of a URL are percent-encoded in the archive. Texts and payloads are whole,
however long; an empty table gives archives without a record. Further columns may have any name.

Payloads of at least ``REVISIT_BYTES`` bytes that equal that of a row with a smaller page id are
revisits; of repeated rows one is the response and the others revisit it. A null payload is empty.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import PIECE, arrow_pass, discard, dropping_shuffles, hot_keys, join_unique, materialise, quoted, scratch_root

REVISIT_BYTES = 100
#: Captures (of three records) in one file, which a reader holds at once: so many, or as many as have FILE_BYTES of payload
#: on average if that is less.
CAPTURES_PER_FILE, FILE_BYTES = 2000, 32 << 20
CRLF = "\r\n"


def _record(kind: str, uid: Column, headers: list[Column], block: Column) -> Column:
    """One record without its closing pair of line ends."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uid, F.lit(">")), *headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, *lines, length), F.lit(CRLF * 2), block)


def _uuid(*parts: Column) -> Column:
    """A version-3 style UUID string from the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _safe(url: Column) -> Column:
    """A URL without line ends, blanks and other control characters, which would break the header it stands in."""
    for code in range(33):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one capture per row of ``pages`` under ``path``, which must be in a shared folder.

    Record names follow from digest and page id, so pages are neither staged nor named twice; only groups of equal
    payloads in which a page id repeats are written first, with a random name for each row.
    """
    html = F.coalesce(F.col(quoted(html_col)), F.lit(""))
    base = pages.select(
        F.col(quoted(id_col)).alias("page_id"), F.coalesce(F.col(quoted(url_col)), F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"),
    )
    void = F.col("page_id").isNull().alias("void")
    counts = base.groupBy("digest", "page_id", "bytes").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("digest").agg(
        F.min(F.struct(void, "page_id")).alias("first"), F.max("n").alias("most"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("bytes")).alias("bytes")
    )
    groups = materialise(groups, "payloads")
    firsts = groups.where("rows > 1").select("digest", "first", "most")
    hot = groups.where("rows > 1").orderBy(F.desc("rows"), "digest").limit(hot_keys(pages.sparkSession)).select("digest")
    known = join_unique(base, firsts, ["digest"], hot)

    again = (F.col("bytes") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    name = lambda id_: _uuid(F.lit("capture"), F.col("digest"), F.coalesce(id_.cast("string"), F.lit("")))
    once = known.where("coalesce(most, 1) = 1")
    rows = once.withColumns({"row": name(F.col("page_id")), "refers": F.when(again, name(F.col("first.page_id")))}).drop("first", "most")
    several = None
    if groups.where("most > 1").limit(1).count():
        several = materialise(known.where("most > 1").drop("first", "most").withColumn("row", F.expr("uuid()")), "pages")  # from here on the names stand
        chosen = several.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(F.struct(void, "page_id", "row")).alias("first"))
        named = join_unique(several, chosen, ["digest"]).withColumn("refers", F.when(F.col("row") != F.col("first.row"), F.col("first.row")))
        rows = rows.unionByName(named.drop("first"))

    date_line = F.lit(f"WARC-Date: {date}")
    url = F.when(F.col("url").rlike(r"[\x00-\x20]"), _safe(F.col("url"))).otherwise(F.col("url"))
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    rid, qid, mid = F.col("row"), _uuid(F.lit("request"), F.col("row")), _uuid(F.lit("metadata"), F.col("row"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), rid, F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    asked = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF * 2}"))
    seen = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    common = [date_line, target]
    http_type = lambda t: F.lit(f"Content-Type: application/http; msgtype={t}")
    response = _record("response", rid, [*common, digest, http_type("response")], F.concat(http, F.col("html")))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), F.col("refers"), F.lit(">"))
    revisit = _record("revisit", rid, [*common, digest, profile, refers, http_type("response")], http)
    records = F.array(
        _record("request", qid, [*common, concurrent, http_type("request")], asked),
        F.when(F.col("refers").isNull(), response).otherwise(revisit),
        _record("metadata", mid, [*common, concurrent, F.lit("Content-Type: application/warc-fields")], seen),
    )
    lines = rows.select(F.array_join(records, CRLF * 2).alias("value"))
    mean = groups.agg(F.sum("bytes") / F.sum("rows")).first()[0] or 1
    per_file = max(1, min(CAPTURES_PER_FILE, int(FILE_BYTES / max(mean, 1))))
    with dropping_shuffles(pages.sparkSession):
        lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    discard(groups, *([several] if several is not None else []))


RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, digest string, http string, "
    "payload binary, payload_bytes long, payload_sha256 string, fields string"
)


def parse_records(raw: bytes) -> Iterator[dict]:
    """Records of one WARC file (gzip or plain), in order; lengths decide where a block ends."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    stream = io.BytesIO(data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record starts with its version, not with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        http, payload, fields = None, None, None
        if "application/http" in headers.get("content-type", ""):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        else:
            fields = block.decode("utf-8", "replace")
        bare = lambda k: headers.get(k, "").removeprefix("<urn:uuid:").removesuffix(">") or None  # noqa: B023, E731
        yield {
            "record_id": bare("warc-record-id"), "type": headers.get("warc-type"), "concurrent_to": bare("warc-concurrent-to"),
            "refers_to": bare("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "digest": headers.get("warc-payload-digest"), "http": http, "payload": payload, "fields": fields,
            "payload_bytes": None if payload is None else len(payload), "payload_sha256": None if payload is None else hashlib.sha256(payload).hexdigest(),
        }


_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the WARC files under ``path``; without ``payloads`` only their lengths and digests come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, held = [], 0
                for record in parse_records(raw.as_py()):
                    if not payloads:
                        record["payload"] = None
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if len(rows) == 500 or held >= PIECE:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return arrow_pass(files, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, date, request, response, metadata.

    ``response.payload_bytes`` and ``response.digest`` are those of the full payload, for revisits
    as their HTTP headers and digest say; ``response.refers_to`` is the record a revisit repeats.
    """
    said = F.regexp_extract("http", r"(?i)Content-Length:\x20*(\d+)", 1)
    is_revisit = F.col("type") == "revisit"
    own = F.concat(F.lit("sha256:"), F.col("payload_sha256"))
    responses = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri", "date",
        F.struct(
            "type", "http", F.when(~is_revisit, F.col("payload")).alias("payload"),
            F.when(is_revisit, F.nullif(said, F.lit("")).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(is_revisit, F.col("digest")).otherwise(own).alias("digest"), "refers_to",
        ).alias("response"),
    )
    side = lambda kind, what: records.where(F.col("type") == kind).where("concurrent_to is not null").select(
        F.col("concurrent_to").alias("capture_id"), what.alias(kind)
    )
    requests = side("request", F.struct("record_id", "http"))
    metadata = side("metadata", F.struct("record_id", "fields"))
    return responses.join(requests, "capture_id", "left").join(metadata, "capture_id", "left").select(
        "capture_id", "target_uri", "date", "request", "response", "metadata"
    )


def scratch_archive(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared scratch folder."""
    return f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
