"""Whole flows over a small decoded document: a page of prose and a table under a two-level header, and a page with images."""

import base64
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagemill import cli, engine
from pagemill.config import Config
from pagemill.errors import CompletionError, EmbeddingError, from_worker
from pagemill.operators import answers, extraction, vectors
from pagemill.schemas import CELLS, IMAGES, SPANS
from pagemill.sources.documents import JsonDecoder, read_part, read_spans
from pagemill.sources.index import Index, merge_by_key


def span(page, block, text, x0, y0, x1=None, font="Regular", line=0):
    x1 = x0 + 5.0 * len(text) if x1 is None else x1
    box = {"x0": x0, "y0": y0, "x1": x1, "y1": y0 + 10.0}
    row = {"pdf_page": page, "block_no": block, "line_no": line, "span_no": 0, "text": text, "font": font, "size": 9.0}
    return row | {f"l{k}": v for k, v in box.items()} | {f"b{k}": v for k, v in box.items()}


def cell(page, table, row, col, text, x0, y0, width=40.0):
    box = dict.fromkeys(("x0", "y0", "x1", "y1")) if x0 is None else {"x0": x0, "y0": y0, "x1": x0 + width, "y1": y0 + 10.0}
    return {"pdf_page": page, "table_no": table, "row": row, "col": col, "text": text, **box}


PROSE = "The company sells apples and pears in many shops, and it expects to sell more of them next year."


def document():
    spans = [
        span(1, 0, "Item 2. Results", 0.0, 10.0, font="Bold"), span(1, 1, PROSE, 0.0, 30.0, 290.0),
        span(1, 2, "The following table shows sales (in millions):", 0.0, 120.0, 250.0),
        # The upper row of the header has fewer parts than the lower one, whose dates are split over two lines.
        span(1, 3, "Three Months", 110.0, 140.0, 170.0), span(1, 4, "Nine Months", 210.0, 140.0, 270.0),
        span(1, 5, "June 25,", 100.0, 155.0, 130.0), span(1, 6, "June 26,", 150.0, 155.0, 180.0), span(1, 7, "June 25,", 200.0, 155.0, 230.0),
        span(1, 8, "2022", 100.0, 170.0, 130.0), span(1, 9, "2021", 150.0, 170.0, 180.0), span(1, 10, "2022", 200.0, 170.0, 230.0),
        span(1, 11, "Apples 1 2 3", 0.0, 200.0, 240.0),
        span(2, 0, "Figure 1: growth of sales", 0.0, 420.0), span(2, 1, "Far below it stands a line that says nothing about the picture above.", 0.0, 700.0),
    ]
    cells = [cell(1, 7, r, c, t, x, 200.0 + 12 * r) for r, row in enumerate([("Apples", "10", "20", "(30)"), ("Pears", "1", "2", "3")]) for c, (t, x) in enumerate(zip(row, (0.0, 95.0, 145.0, 198.0), strict=True))]
    # A second table, listed first, under the first one: its band is empty, so its columns stay unnamed.
    cells += [cell(1, 3, 0, c, t, 50.0 * c, 260.0) for c, t in enumerate(("Plums", "4 5"))]
    cells += [cell(1, 3, 0, 2, None, None, None)]
    images = [
        {"pdf_page": 2, "img_no": 0, "width": 400, "height": 300, "x0": 0.0, "y0": 100.0, "x1": 400.0, "y1": 400.0, "content": base64.b64encode(b"png").decode()},
        {"pdf_page": 1, "img_no": 1, "width": 20, "height": 20, "x0": 0.0, "y0": 0.0, "x1": 20.0, "y1": 20.0, "content": None},
        {"pdf_page": 2, "img_no": 2, "width": 60, "height": 60, "x0": 0.0, "y0": 800.0, "x1": 60.0, "y1": 860.0, "content": base64.b64encode(b"logo").decode()},
    ]
    return {"spans": spans, "cells": cells, "images": images}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("decoded")
    (path / "filing.json").write_text(json.dumps(document()))
    (path / "broken.json").write_text("{")
    return str(path)


@pytest.fixture(scope="module")
def found(spark, folder):
    spans, rejects = read_spans(spark, folder, JsonDecoder())
    assert [tuple(r) for r in rejects.collect()] == [("broken", "invalid")]
    parts = [read_part(spark, folder, JsonDecoder(), part) for part in ("cells", "images")]
    return extraction.extract(spans, *parts)


def test_tables_get_headers_groups_context_and_numbers(found):
    got = {r["table_no"]: r for r in found.tables.collect()}
    assert got[0]["headers"] == ["", "Three Months | June 25, 2022", "Three Months | June 26, 2021", "Nine Months | June 25, 2022"]
    assert got[0]["rows"] == [["Apples", "10", "20", "-30"], ["Pears", "1", "2", "3"]] and got[0]["validation"] == "ok"
    assert got[0]["records"][1] == {"label": "Pears", "Three Months | June 25, 2022": "1", "Three Months | June 26, 2021": "2", "Nine Months | June 25, 2022": "3"}
    assert (got[0]["caption"], got[0]["units"]) == ("The following table shows sales (in millions):", "(in millions)")
    assert got[0]["item"] == "Item 2. Results" and got[0]["floor"] is None
    assert got[1]["floor"] == 222.0 and got[1]["headers"] == ["", ""] and got[1]["validation"] == "headers_unresolved"
    assert got[1]["caption"] is None and got[1]["raw_column_count"] == 3


def test_chunks_of_all_types_carry_provenance(found):
    got = {r["chunk_id"]: r for r in found.chunks.collect()}
    assert set(got) == {"filing::p001::text::0", "filing::p002::text::0", "filing::p001::table::0", "filing::p001::table::1", "filing::p002::figure::0", "filing::p002::figure::1", "filing::document::figure-inventory"}
    text = got["filing::p001::text::0"]
    assert PROSE in text["display_text"] and "Apples 1 2 3" not in text["display_text"] and text["item"] == "Item 2. Results"
    figure, logo = got["filing::p002::figure::0"], got["filing::p002::figure::1"]
    assert not figure["is_decorative"] and logo["is_decorative"] and "growth of sales" in figure["display_text"] and "Far below" not in figure["display_text"]
    assert got["filing::document::figure-inventory"]["section"] == "Document summary" and "images: 2" in got["filing::document::figure-inventory"]["display_text"]
    assert "[Structure unreliable: headers_unresolved." in got["filing::p001::table::1"]["display_text"]


def test_pages_without_furniture(spark, folder):
    loaded = extraction.load(read_spans(spark, folder, JsonDecoder())[0])
    got = {r["pdf_page"]: r for r in extraction.page_records(loaded).collect()}
    assert got[2]["lines"][0] == "Figure 1: growth of sales" and got[2]["raw_line_count"] == 2 and got[2]["printed_page"] is None and got[1]["raw_line_count"] == 12


def test_nothing_to_extract(spark):
    empty = [spark.createDataFrame([], s) for s in (SPANS, CELLS, IMAGES)]
    found = extraction.extract(*empty)
    assert found.chunks.count() == found.tables.count() == found.figures.count() == 0


def picky():
    class Picky:
        """Cites the best table twice and an id that isn't there; refuses what asks for kiwis, though it says something."""

        def complete(self, system, prompts):
            out = []
            for p in prompts:
                refuse = "kiwis" in p.split("\n")[0]
                out.append(json.dumps({"answer": "Sales of apples were 10.", "refused": refuse, "cited_chunk_ids": [] if refuse else ["filing::p001::table::0"] * 2 + ["absent"]}))
            return out

    return Picky()


def test_from_files_to_scores(spark, folder, tmp_path):
    index, e, cfg = Index(spark, str(tmp_path / "index")), vectors.HashingEmbedder(64), Config()
    assert engine.ingest(spark, folder, index, e, cfg, JsonDecoder()) == 7
    assert engine.ingest(spark, folder, index, e, cfg, JsonDecoder()) == 7  # merged, not doubled
    report = index.reports().first()
    assert (report["tables"], report["tables_ok"], report["figures"], report["decorative"], report["captions"]) == (2, 1, 2, 1, 1)
    assert {r["image_id"]: base64.b64decode(r["base64"]) for r in index.images().collect()} == {"filing_p002_0": b"png", "filing_p002_2": b"logo"}

    q = spark.createDataFrame([(1, "How much were sales of apples"), (2, "How many kiwis")], "question_id int, question string")
    hits = engine.retrieve(q, index, e, cfg, 3)
    out = {r["question_id"]: r for r in engine.answer(q, hits, picky(), cfg).collect()}
    assert not out[1]["refused"] and out[1]["answer"] == "Sales of apples were 10." and out[1]["n_hits"] == 3
    cited = [x for x in out[1]["evidence"] if x["cited"]]
    assert [x["chunk_id"] for x in cited] == ["filing::p001::table::0"] and cited[0]["trusted"] and cited[0]["records"][0]["label"] == "Apples"
    assert [x["place"] for x in out[1]["evidence"]] == sorted(x["place"] for x in out[1]["evidence"])
    assert "Sources:\n  - PDF p. 1 — table — Item 2. Results\n" in out[1]["rendered"] and "3 chunks (" in out[1]["rendered"] and "[" + out[1]["model"] in out[1]["rendered"]
    assert out[2]["refused"] and out[2]["rendered"].startswith("No supported answer found.\n")
    only = engine.retrieve(q, index, e, cfg, 3, ["figure"])
    assert {r["content_type"] for r in only.select("content_type").collect()} == {"figure"}
    # Without evidence a question is refused whatever the reply says, and still has its row.
    none = {r["question_id"]: r for r in engine.answer(q, hits.where("question_id = 2"), picky(), cfg).collect()}
    assert none[1]["refused"] and none[1]["evidence"] is None and answers.NO_SOURCES in none[1]["rendered"] and "0 chunks (none)" in none[1]["rendered"]

    questions = [
        {"id": "a", "category": "table", "question": "How much were sales of apples", "expected_pages": [1], "answer_contains": ["10"], "should_refuse": False},
        {"id": "b", "category": "unsupported", "question": "How many kiwis", "expected_pages": [], "answer_contains": [], "should_refuse": True},
        {"id": "c", "category": "table", "question": "How much were sales of pears", "expected_pages": [2], "answer_contains": ["1,000"], "should_refuse": False},
    ]
    (tmp_path / "q.json").write_text(json.dumps({"document": "filing", "questions": questions}))
    run = json.loads(engine.evaluate_file(spark, str(tmp_path / "q.json"), index, e, picky(), cfg))
    assert run["n"] == 3 and run["accuracy"] == pytest.approx(2 / 3) and run["refusal_accuracy"] == 1 and run["citation_accuracy"] == 0.5 and run["hallucination_rate"] == 0
    assert [f["question_id"] for f in run["failures"]] == ["c"] and {c["category"]: c["n"] for c in run["categories"]} == {"table": 2, "unsupported": 1}


def test_command_line_plugins():
    assert isinstance(cli.plugin("pagemill.operators.answers:EchoCompleter"), answers.EchoCompleter)
    with pytest.raises(cli.InvalidRequest):
        cli.plugin("pagemill.nothing:Here")


def test_errors_of_workers_keep_their_kind(spark):
    class Down:
        name, dimension = "down", 2

        def embed(self, texts):
            raise EmbeddingError("quota")

        def complete(self, system, prompts):
            return []

    rows = spark.createDataFrame([("q", "e", False)], "question string, evidence string, needs_vision boolean")
    for made, kind in ((vectors.embed_texts(rows, Down(), "question"), EmbeddingError), (answers.complete(rows, Down()), CompletionError)):
        with pytest.raises(PySparkException) as e:
            made.collect()
        assert type(from_worker(str(e.value))) is kind
    assert from_worker("ValueError: no") is None


def test_new_rows_with_the_same_key(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("a", "1"), ("c", "3")], "k string, v string")
    assert sorted(map(tuple, merge_by_key(old, new, "k").collect())) == [("a", "1"), ("b", "y"), ("c", "3")]
    assert merge_by_key(old, new.withColumn("m", F.create_map(F.lit(1), F.lit(2))), "k").count() == 3
