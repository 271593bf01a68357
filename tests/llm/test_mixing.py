import re
from collections import Counter, defaultdict

import pytest

from pagemill.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, full = {}, {}
    while True:
        free = [s for s in names if s not in full]
        left = 1.5 * sum(sizes.values()) - sum(full.values())
        out = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if out[s] > 2 * sizes[s]}
        if not above:
            return out | full
        full |= above


def test_mix(docs, wide, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    runs = []
    for df in (docs, wide.repartition(3)):
        got = mixing.mix_sources(df.withColumn("from", df["source"])).collect()
        assert sorted(repr((r["doc_id"], r["size"])) for r in got) == sorted(repr((r[0], size(r[1]))) for r in rows)
        runs.append(sorted(repr((r["doc_id"], r["taken"])) for r in got))
        by_size = defaultdict(list)
        for r in got:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            by_size[r["source_size"], round(r["target"], 6)].append(r)
        assert {(s, round(want[k], 6)) for k, s in sizes.items()} == set(by_size)
        for (_, target), own in by_size.items():
            assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert runs[0] == runs[1]
    assert mixing.mix_sources(empty).collect() == [] and mixing.keep_mix(empty).collect() == []


def test_keep_mix_repeats_rows_as_taken(docs, wide):
    for df in (docs, wide):
        kept = mixing.keep_mix(df)
        assert kept.columns == df.columns
        want = Counter()
        for r in mixing.mix_sources(df).collect():
            want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
        assert Counter(r["doc_id"] for r in kept.collect()) == +want


def test_heavier_quality_is_taken_first(spark):
    clean, noisy = "word " * 20, "1$3% " * 20
    rows = [(i, clean + f"c{i}" if i % 2 else noisy + f"n{i}", "a") for i in range(1000)] + [(5000, "word " * 1000, "b")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = Counter()
    for r in got.where("doc_id < 5000").collect():
        taken[r["doc_id"] % 2] += r["taken"] > r["size"]
    assert taken[1] > taken[0] + 50


def test_slices_are_even_and_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, ("1$3% " if i % 10 else "word ") * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    whole = sorted(map(repr, mixing.mix_sources(df).collect()))
    tables = {}
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    keep = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda frame, name: tables.update({name: keep(frame, name)}) or tables[name])
    assert sorted(map(repr, mixing.mix_sources(df).collect())) == whole
    counts = [r["count"] for r in tables["slices"].groupBy("slice").count().collect()]
    assert len(counts) > 30 and max(counts) < 400


@pytest.mark.parametrize("text", ["", None, "a b", "x" * 50])
def test_unit_hash_is_open(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(1, text)], "i long, t string").select(mixing.unit_hash(F.col("i"), F.col("t")).alias("u")).first()
    assert 0 < row["u"] < 1
