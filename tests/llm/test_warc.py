import gzip
import hashlib
from collections import Counter

from pagemill.llm import warc
from pagemill.llm.queries import op10_warc

LONG = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
PAGES = [
    (1, "http://a/x", LONG), (5, "http://b/ y\r\nz", LONG), (3, None, LONG), (4, "http://c", "small"), (6, "http://d", "small"), (7, "http://e", None),
    (8, "http://f", "x" * 100), (9, "http://g", "x" * 100), (9, "http://g", "x" * 100), (10, "http://h", "z" * 300_000), (None, "http://i", "q" * 200),
]


def brute(pages):
    out, seen = [], {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        first = seen.setdefault(digest, page) if digest in seen or len(raw) < 100 else None
        if len(raw) >= 100 and digest in seen:
            out.append((page, len(raw), digest, "revisit", seen[digest]))
        else:
            seen[digest] = page
            out.append((page, len(raw), digest, "response", None))
        del first
    return out


def test_query_matches_brute_force(spark, tmp_path):
    pages = PAGES + [(100 + i, f"http://hot/{i}", "hot " * 40) for i in range(600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in op10_warc(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(pages)))


def test_archives_are_valid_and_assemble(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_warc(df.withColumn("row", df["url"]).withColumn("digest", df["url"]), str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("part-*.gz") for r in warc.parse_records(f.read_bytes())]
    assert Counter(r["type"] for r in records) == {"request": 11, "metadata": 11, "response": 7, "revisit": 4}
    ids = {r["record_id"] for r in records}
    assert len(ids) == 33 and all(r["refers_to"] in ids for r in records if r["type"] == "revisit")
    assert {r["target_uri"] for r in records} >= {"http://b/%20y%0D%0Az", "http://a/x"}
    thin = warc.assemble(warc.read_records(spark, str(tmp_path / "w"), payloads=False)).select("response.payload", "response.payload_bytes", "response.digest").collect()
    assert all(r["payload"] is None for r in thin)
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert sorted((c["response"]["payload_bytes"], c["response"]["digest"]) for c in captures) == sorted((r["payload_bytes"], r["digest"]) for r in thin)
    assert len(captures) == 11 and all(c["request"] and c["metadata"] for c in captures)
    payloads = Counter(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["type"] == "response")
    assert payloads == Counter([LONG, "small", "small", "", "x" * 100, "z" * 300_000, "q" * 200])


def test_no_pages_and_lone_records(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "none"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "none"))).collect() == []
    lone = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    stray = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:9>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "lone").mkdir()
    (tmp_path / "lone" / "a.warc.gz").write_bytes(gzip.compress(lone) + gzip.compress(stray))
    (c,) = warc.assemble(warc.read_records(spark, str(tmp_path / "lone"))).collect()
    assert c["request"] is None and c["metadata"] is None and bytes(c["response"]["payload"]) == b"body"
