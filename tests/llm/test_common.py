import random

from pyspark.sql import functions as F

from pagemill.llm import common
from pagemill.llm.common import bucket_members, components, join_unique, linked, materialise, mixed_members, open_pairs, star_pairs


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def union_find(edges):
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(2000, 2001 + i) for i in range(80)]  # a star
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == union_find(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_join_unique_with_hot_null_and_missing_keys(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(400)] + [(None, 1), ("none", 2), ("none", 3)]
    table = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 400, 2)]
    got = join_unique(spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame(table, "k string, w int"), ["k"])
    want = [(k, v, dict(table).get(k)) for k, v in rows]
    assert sorted(map(repr, [(r["k"], r["v"], r["w"]) for r in got.collect()])) == sorted(map(repr, want))


def test_linked_finds_links_that_leaders_miss(spark):
    # Bucket 1 holds two cliques; no member of the second links to the first leader.
    sets = {i: 0 for i in range(40)} | {i: 1 for i in range(40, 70)} | {70: 2}
    members = [(1, i) for i in sets] + [(2, 70), (3, 5)]
    grouped = bucket_members(spark.createDataFrame(members, "bucket long, node long"), 16).cache()
    assert star_pairs(grouped).count() <= len(sets) + 16
    about = spark.createDataFrame(list(sets.items()), "node long, own int")
    may = lambda x, y: F.col(f"{x}.own") == F.col(f"{y}.own")
    plain = lambda x, y: F.lit(True)

    def verify(pairs):
        links = [(r["a"], r["b"]) for r in pairs.collect() if sets[r["a"]] == sets[r["b"]]]
        return materialise(spark.createDataFrame(links, "a long, b long"), "links")

    for test in (may, plain):
        got = {r["node"]: r["label"] for r in linked(grouped, verify, about, lambda at, turn, test=test: open_pairs(at, test, turn)).collect()}
        assert {i: got.get(i, i) for i in sets} == {i: (0, 40, 70)[sets[i]] for i in sets}
    labels = spark.createDataFrame([(i, 0) for i in range(70)], "node long, label long")
    at = mixed_members(grouped, labels).join(about, "node")
    assert open_pairs(at, plain).count() == 70  # only those with node 70
    assert open_pairs(at, may).count() == 0
    assert open_pairs(at, plain, 1).count() < 20  # with a few of the others


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """The same components with all rounds, with some, and in one task, which needs no round."""
    rng = random.Random(31)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)]
    edges += [(9000, 9000 - k) for k in range(1, 200)] + [(5000, 5000), (-7, 1 << 62)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    written, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append(name) or write(df, name))
    for gathered in (1 << 19, 100, 0):
        written.clear()
        monkeypatch.setattr(common, "GATHERED", gathered)
        df = spark.createDataFrame(edges, "a long, b long").repartition(5)
        assert {r["node"]: r["label"] for r in common.components(df).collect()} == least
        assert (written.count("moved") == 1) == (gathered > 1000)
