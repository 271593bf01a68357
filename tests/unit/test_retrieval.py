import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.errors import ConfigError, EmptyQuestion, IndexMissing, InvalidRequest, ModelMismatch
from pagemill.operators import answers, context, evaluation, fusion, lexical, vectors
from pagemill.sources.documents import PlainTextDecoder, read_questions, read_spans
from pagemill.sources.index import Index, merge_by_key
from pagemill.streaming.upsert import latest, stream_into


def bm25(corpus, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(t for d in corpus for t in set(d))
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf[t] * (f := d.count(t)) * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avg)) for t in query if t in idf) for d in corpus]


def test_bm25_matches_a_scalar_form(spark):
    rng = random.Random(8)
    corpus = [["common"] * rng.randrange(0, 3) + [f"t{rng.randrange(30)}x" for _ in range(rng.randrange(3, 25))] for _ in range(50)]
    chunks = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(corpus)], "chunk_id long, embed_text string")
    asked = [["common", "t1x", "t1x"], ["t2x", "nothing"], ["t5x", "t6x", "t7x"]]
    posts = lexical.postings(chunks)
    stats = lexical.corpus_stats(chunks, posts)
    q = spark.createDataFrame([(i, " ".join(a)) for i, a in enumerate(asked)], "question_id long, question string")
    allowed = chunks.where("chunk_id % 2 = 0")
    for limit, keep in ((None, lambda i: True), (allowed, lambda i: i % 2 == 0)):
        got = lexical.bm25_topk(q, posts, lexical.term_stats(posts, stats), stats, 10, allowed=limit)
        for n, a in enumerate(asked):
            scores = [(-round(s, 6), i) for i, s in enumerate(bm25(corpus, a)) if round(s, 6) > 0 and keep(i)]
            mine = [(-r["score"], r["chunk_id"]) for r in got.where(F.col("question_id") == n).orderBy("rank").collect()]
            assert mine == sorted(scores)[:10]


def test_cosine_block_and_join_agree(spark):
    rng = np.random.default_rng(1)
    v = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 16)))] + [(300, [0.0] * 16)]
    vecs = spark.createDataFrame(v, "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x) for i, x in v[:7]], "question_id long, embedding array<float>")
    rows = lambda df: sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    block = rows(vectors.cosine_topk(q, vecs, 5))
    assert block == rows(vectors.cosine_topk_joined(q, vecs.where("chunk_id < 300"), 5))
    assert block == rows(vectors.cosine_topk_joined(q, vecs, 5, block=3, part=2)) == rows(vectors.cosine_topk(q, vecs, 5, Config(max_broadcast_questions=3)))
    assert vectors.cosine_topk_joined(q.where("false"), vecs, 5).collect() == vectors.cosine_topk_joined(q, vecs.where("false"), 5).collect() == []
    assert all(r[2] == r[0] for r in block if r[1] == 1)
    assert vectors.cosine_topk(q.where("false"), vecs, 5).collect() == []


def ranked(spark, rows):
    return spark.createDataFrame([(1, c, r) for c, r in rows], "question_id int, chunk_id string, rank int")


def test_fusion(spark):
    dense, lex = ranked(spark, [("a", 1), ("b", 2), ("c", 3)]), ranked(spark, [("c", 1), ("d", 2)])
    got = {r["chunk_id"]: r for r in fusion.fuse(dense, lex, 10).collect()}
    assert got["c"]["rank"] == 1 and got["c"]["found_by"] == "both" and math.isclose(got["c"]["score"], 1 / 63 + 1 / 61, abs_tol=1e-9)
    assert [got[x]["rank"] for x in "abd"] == [2, 3, 4]  # a tie goes to the dense side
    assert got["a"]["found_by"] == "dense" and got["d"]["found_by"] == "lexical"


def test_boost_is_bounded(spark):
    n = 20
    dense = ranked(spark, [(f"c{i}", i) for i in range(1, n + 1)])
    bias = spark.createDataFrame([(1, "how much")], "question_id int, question string")
    types = lambda r: spark.createDataFrame([(f"c{i}", "table" if i == r else "text") for i in range(1, n + 1)], "chunk_id string, content_type string")
    for r in (2, 3, 4, 5, 12):
        got = {x["chunk_id"]: x["rank"] for x in fusion.fuse(dense, ranked(spark, [("c1", 99)]).where("false"), n, bias=fusion.routed(bias), types=types(r)).collect()}
        assert (got[f"c{r}"] == 1) == (r < 1 + 61 * 0.05)
    plain = fusion.fuse(dense, dense.where("false"), n, Config(boost=0.0), bias=fusion.routed(bias), types=types(12))
    assert {x["chunk_id"]: x["rank"] for x in plain.collect()}["c12"] == 12


HIT = "question_id int, chunk_id string, content_type string, rank int, display_text string, units string, validation string, is_decorative boolean, pdf_page int, printed_page int, part string, item string, section string, note string, document_id string"


def hits(spark, rows):
    return spark.createDataFrame([(1, c, t, r, x, u, v, d, 3, None, None, None, None, None, "doc") for c, t, r, x, u, v, d in rows], HIT)


def built(df, cfg=None):
    uniq = context.distinct_hits(df)
    used = context.within_budget(uniq.withColumn("block", context.evidence_block(uniq)), cfg or Config())
    return used, context.build_context(used)


def test_context(spark):
    df = hits(spark, [("a", "text", 1, "Same text ", None, None, False), ("b", "text", 2, " Same text", None, None, False), ("c", "table", 3, "grid", "(in units)", "width_mismatch", False), ("d", "figure", 4, "logo", None, None, True)])
    used, text = built(df)
    assert [r["chunk_id"] for r in used.orderBy("place").collect()] == ["c", "a", "d"]
    body = text.first()["evidence"]
    assert body.startswith("<<<EVIDENCE\n[c] type=table | PDF p. 3 | Unattributed\nUnits: (in units)\nWARNING") and body.endswith("EVIDENCE>>>")
    assert "NOTE: this image is decorative" in body and text.first()["characters"] == len(body)
    assert built(df.where("false"))[1].collect() == []


def test_budget(spark):
    df = hits(spark, [(f"c{i}", "text", i, f"{i} " + "x" * 500, None, None, False) for i in range(20)])
    used, text = built(df, Config(budget_chars=1200))
    assert used.count() == 2 and text.first()["n_dropped"] == 18
    one, _ = built(df, Config(budget_chars=10))
    assert one.count() == 1


def test_retrieval_scores(spark):
    rows = [(1, [9, 4, 18], [4, 18]), (2, [1, 2], [7]), (3, [5], []), (4, [], [1]), (5, [4, 4], [4, 9])]
    df = spark.createDataFrame(rows, "id int, retrieved array<int>, expected array<int>")
    got = {r["id"]: (r["hit"], r["recall"], round(r["precision"], 4), r["reciprocal_rank"], r["first_rank"]) for r in evaluation.retrieval_scores(df).collect()}
    assert got == {1: (True, 1.0, 0.6667, 0.5, 2), 2: (False, 0.0, 0.0, 0.0, None), 3: (True, 1.0, 1.0, 1.0, None), 4: (False, 0.0, 0.0, 0.0, None), 5: (True, 0.5, 1.0, 1.0, 1)}


def test_answer_scores(spark):
    rows = [
        ("63,355 m", False, [4], [4], ["63355"], False), ("x", True, [], [4], ["63355"], False), ("made up", False, [], [], [], True), ("no", True, [], [], [], True), ("63355", False, [], [4], ["63355"], False), ("63355", False, [5], [], [], False),
    ]
    df = spark.createDataFrame(rows, "answer string, refused boolean, cited_pages array<int>, expected_pages array<int>, expected array<string>, should_refuse boolean")
    got = [tuple(r[c] for c in ("correct", "refusal_correct", "hallucinated", "citation_correct", "graded")) for r in evaluation.answer_scores(df).collect()]
    assert got == [(True, True, False, True, True), (False, False, False, False, True), (False, False, True, True, True), (True, True, False, True, True), (True, True, False, False, True), (True, True, False, True, False)]


def test_replies(spark):
    rows = [
        ('{"answer": " yes ", "refused": false, "cited_chunk_ids": ["a"]}', ("yes", False, ["a"])), ("not json", (answers.UNREADABLE, True, [])), ('["yes"]', (answers.UNREADABLE, True, [])),
        ('{"answer": "", "refused": false}', (answers.NO_ANSWER, True, [])), ('{"answer": "a", "refused": "false", "cited_chunk_ids": null}', ("a", False, [])), ('{"answer": "a", "refused": true}', ("a", True, [])), (None, (answers.UNREADABLE, True, [])), ('{"answer"', (answers.UNREADABLE, True, [])),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string").select("i", answers.parsed_reply(F.col("raw")).alias("r"))
    assert [tuple(r["r"]) for r in df.orderBy("i").collect()] == [w for _, w in rows]


def test_answering_end_to_end(spark):
    df = hits(spark, [("a", "text", 1, "t", None, None, False), ("c", "table", 2, "grid", None, "width_mismatch", False)])
    used, text = built(df)
    q = spark.createDataFrame([(1, "why"), (2, "nothing")], "question_id int, question string")
    rows = q.join(text, "question_id", "left").fillna("", ["evidence"]).join(answers.vision_pages(used).select("question_id", F.lit(True).alias("needs_vision")).distinct(), "question_id", "left")
    out = {r["question_id"]: r for r in answers.answers(answers.complete(rows, answers.EchoCompleter())).collect()}
    assert out[1]["answer"] == "2 sources" and out[1]["cited"] == ["c", "a"] and not out[1]["refused"]
    assert out[2]["refused"]
    lists = {r["question_id"]: r["sources"] for r in answers.source_lists(q, used.withColumn("cited", F.col("chunk_id") == "c")).collect()}
    assert lists == {1: "Sources:\n  - PDF p. 3 — table — Unattributed  [structure unverified]", 2: answers.NO_SOURCES}


def test_requests_and_config():
    with pytest.raises(EmptyQuestion):
        answers.check_question("  ")
    with pytest.raises(InvalidRequest):
        answers.check_question("x" * 2001)
    with pytest.raises(InvalidRequest):
        answers.check_question("x", 51)
    with pytest.raises(ConfigError):
        Config(chunk_overlap=900)
    with pytest.raises(ConfigError):
        Config(top_k=21)


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert vectors.with_retry(call, 4, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        vectors.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), 2, waits.append)


def test_index_versions_merge_and_model(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.health() == {"ready": False, "chunks": 0, "model": None}
    with pytest.raises(IndexMissing):
        index.chunks()
    chunks = spark.createDataFrame([(f"c{i}", "text" if i % 2 else "table", f"words number{i} shared", "d") for i in range(10)], "chunk_id string, content_type string, embed_text string, document_id string")
    e = vectors.HashingEmbedder(8)
    assert index.write(vectors.embed_texts(chunks, e, "embed_text"), e.name, 8) == 10
    newer = spark.createDataFrame([("c1", "text", "changed", "d"), ("c99", "text", "added", "d")], chunks.schema)
    assert index.write(vectors.embed_texts(newer, e, "embed_text"), e.name, 8) == 11
    assert index.chunks().where("chunk_id = 'c1'").first()["embed_text"] == "changed"
    with pytest.raises(ModelMismatch):
        index.write(vectors.embed_texts(newer, e, "embed_text"), "other", 8)
    with pytest.raises(InvalidRequest):
        index.write(vectors.embed_texts(newer, e, "embed_text"), e.name, 9)
    posts, terms, stats = index.lexical()
    q = spark.createDataFrame([(1, "number4")], "question_id int, question string")
    assert lexical.bm25_topk(q, posts, terms, stats, 3).first()["chunk_id"] == "c4"
    assert index.write(vectors.embed_texts(newer, e, "embed_text"), e.name, 8, rebuild=True) == 2
    assert merge_by_key(chunks, newer, "chunk_id").count() == 11


def test_stream_merges_batches(spark, tmp_path):
    e = vectors.HashingEmbedder(4)
    schema = "chunk_id string, content_type string, embed_text string"
    index = Index(spark, str(tmp_path / "index"))
    for version in ("one", "two"):
        spark.createDataFrame([("a", "text", version), (version, "text", "x")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = stream_into(stream, index, e.name, 4, str(tmp_path / "ck"), lambda df: vectors.embed_texts(df, e, "embed_text"))
        q.awaitTermination(120)
    assert {(r["chunk_id"], r["embed_text"]) for r in index.chunks().collect()} == {("a", "two"), ("one", "x"), ("two", "x")}


def test_documents_and_rejects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "good.txt").write_text("TITLE\nbody\fpage two")
    (tmp_path / "d" / "blank.txt").write_text(" ")
    (tmp_path / "d" / "bytes.bin").write_bytes(b"\xff\xfe\x00")
    spans, rejects = read_spans(spark, str(tmp_path / "d"), PlainTextDecoder())
    assert {(r["document_id"], r["pdf_page"], r["text"]) for r in spans.collect()} == {("good", 1, "TITLE"), ("good", 1, "body"), ("good", 2, "page two")}
    assert {(r["document_id"], r["error"]) for r in rejects.collect()} == {("blank", "invalid"), ("bytes", "invalid")}
    _, rejects = read_spans(spark, str(tmp_path / "d"), PlainTextDecoder(), magic=b"%PDF-")
    assert rejects.count() == 3


def test_question_set(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"document": "d", "notes": ["n"], "questions": [{"id": "q1", "category": "table", "question": "x", "expected_pages": [1, 2], "answer_contains": ["y"], "should_refuse": False}]}))
    row = read_questions(spark, str(path)).first()
    assert (row["id"], row["expected_pages"], row["should_refuse"], row["note"]) == ("q1", [1, 2], False, None)


def test_summary_uses_own_rows(spark):
    rows = [("table", "a", False, [1], [1], ["a"], False, 1.0), ("table", "b", True, [], [2], ["z"], False, 3.0), ("unsupported", "c", False, [], [], [], True, 8.0), ("text", "d", False, [3], [3], [], False, 2.0)]
    df = spark.createDataFrame(rows, "category string, answer string, refused boolean, cited_pages array<int>, expected_pages array<int>, expected array<string>, should_refuse boolean, seconds double")
    scores = evaluation.answer_scores(df)
    scores = evaluation.retrieval_scores(scores.withColumn("retrieved", F.col("cited_pages")).withColumn("x", F.col("expected")).withColumn("expected", F.col("expected_pages")))
    r = evaluation.summary(scores).first()
    assert (r["n"], r["n_graded"], round(r["hit_rate"], 4), round(r["accuracy"], 4), r["hallucination_rate"], round(r["false_refusal_rate"], 4), r["median_seconds"]) == (4, 3, 0.6667, 0.3333, 1.0, 0.3333, 2.5)
    assert {x["reason"] for x in evaluation.failures(scores).collect()} == {"refused a supported question", "hallucinated"}
    assert evaluation.summary(scores.where("false")).first()["hit_rate"] == 0.0


def test_ingest_query_and_evaluate(spark, tmp_path):
    from pagemill import engine

    (tmp_path / "d").mkdir()
    pages = [f"REPORT HEAD\n{' '.join([w] * 3)} is the subject of page {i} and it says quite a lot about {w}.\nReport | {i + 1}" for i, w in enumerate(["apples", "pears", "plums", "cherries"])]
    (tmp_path / "d" / "doc.txt").write_text("\f".join(pages))
    index, e, cfg = Index(spark, str(tmp_path / "index")), vectors.HashingEmbedder(32), Config(dense_k=8)
    assert engine.ingest(spark, str(tmp_path / "d"), index, e, cfg) == 5  # four pages and the inventory of figures
    q = spark.createDataFrame([(1, "what about plums")], "question_id int, question string")
    used, text = engine.evidence(engine.retrieve(q, index, e, cfg, 2), cfg)
    best = used.orderBy("rank").first()
    assert best["pdf_page"] == 3 and best["printed_page"] == 3 and "REPORT" not in best["display_text"] and text.count() == 1
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"document": "doc", "questions": [{"id": "a", "category": "text", "question": "pears", "expected_pages": [2], "answer_contains": [], "should_refuse": False}]}))
    report = json.loads(engine.evaluate_file(spark, str(path), index, e, answers.EchoCompleter(), cfg))
    assert report["hit_rate"] == 1 and report["results"][0]["hit"] and report["config"]["dense_k"] == 8 and report["categories"][0]["category"] == "text"


def test_zero_and_null_vectors_in_both_branches(spark):
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "question_id long, embedding array<double>")
    got = [
        sorted((r["question_id"], r["chunk_id"], r["score"], r["rank"]) for r in out.collect())
        for out in (vectors.cosine_topk(asked, vectors_, 5), vectors.cosine_topk_joined(asked, vectors_, 5))
    ]
    assert got[0] == got[1] == [(1, 1, 1.0, 1), (1, 2, 0.0, 3), (1, 4, 0.707107, 2), (2, 1, 0.0, 1), (2, 2, 0.0, 2), (2, 4, 0.0, 3)]


def test_postings_with_and_without_tokens(spark):
    chunks = spark.createDataFrame([("a", "Cats, cats and 1,234 boxes."), ("b", "..."), ("c", "")], "chunk_id string, embed_text string")
    posts = lexical.postings(chunks)
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["dl"]) for r in posts.collect()}
    assert got == {("a", t): (n, 9) for t, n in {"cats": 2, "cat": 2, "and": 1, "1,234": 1, "1234": 1, "boxes": 1, "box": 1}.items()}
    assert lexical.corpus_stats(chunks, posts).first().asDict() == {"n": 3, "avgdl": 3.0}


def test_latest_version_of_a_chunk(spark):
    rows = [("a", "old", 1), ("a", "new", 3), ("a", "mid", 2), ("b", "only", 1)]
    out = latest(spark.createDataFrame(rows, "chunk_id string, embed_text string, v int"), "v")
    assert out.columns == ["chunk_id", "embed_text"] and {tuple(r) for r in out.collect()} == {("a", "new"), ("b", "only")}


def test_flags_of_cited_evidence(spark):
    used = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "question_id long, chunk_id string, place int")
    answered = spark.createDataFrame([(1, ["b", "b", "x"]), (2, None)], "question_id long, cited array<string>")
    assert {(r["question_id"], r["chunk_id"]): r["cited"] for r in answers.flag_cited(used, answered).collect()} == {(1, "a"): False, (1, "b"): True, (2, "a"): False}


def test_waiting_for_an_index(spark, tmp_path):
    assert Index(spark, str(tmp_path / "none")).wait_until_ready(0.2, 0.05) is False
