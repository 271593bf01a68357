import random
import re
from collections import defaultdict

import numpy as np

from pagemill.llm import minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


def check(df, rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_components_match_brute_force(docs, wide, rows, empty):
    check(docs, rows)
    check(wide, rows)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_one_of_each(empty).collect() == []


def test_chains_and_hot_groups(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(80)]
    rows = []
    for i in range(120):  # a hot group of near copies
        copy = list(base)
        copy[rng.randrange(80)] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(200)]
    for i in range(12):  # neighbours are alike, the ends are not
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[8:] + [word() for _ in range(8)]
    passage = [word() for _ in range(40)]
    rows += [(2000 + i, " ".join([word() for _ in range(35)] + passage)) for i in range(40)]  # a shared passage is no copy
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_a_crowd_that_its_leaders_leave_open(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(9000)}"
    base, rows = [word() for _ in range(150)], []
    for i in range(160):  # 0 to 10 changed words: near the base or not, alike or not among themselves
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(11)):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
        if i % 4 == 0:  # copies of a copy share its rare shingles
            rows.append((500 + i, " ".join([*copy[:-1], word()])))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_print_passes_every_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: len(x) - rng.integers(0, len(x) // 3 + 1)], rng.integers(0, 2**63, rng.integers(0, len(x) // 4 + 1), dtype=np.uint64)]))
        side = lambda s: (len(s), minhash.parities(s).tolist())
        rows.append((i, bool(len(y)) and minhash.similar(x, y), side(x), side(y)))
    df = spark.createDataFrame(rows, "i long, link boolean, x struct<n:long,bits:array<long>>, y struct<n:long,bits:array<long>>")
    got = df.select("link", minhash.may_be_similar("x", "y").alias("may")).collect()
    assert all(r["may"] for r in got if r["link"]) and sum(r["link"] for r in got) > 50
    assert sum(not r["may"] for r in got) > 50


def test_keep_one_of_each_keeps_one_row_as_it_was(spark, wide, rows):
    out = minhash.keep_one_of_each(wide)
    kept = out.collect()
    assert out.columns == wide.columns
    own = {repr(r[:5]) for r in rows}
    assert all(repr(tuple(r)[:5]) in own for r in kept)
    flags = minhash.near_duplicates(wide).where("first").select("doc_id", "text_hash").distinct().collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(r["doc_id"]) for r in flags)
    # Of repeated rows, of near copies under one id and of copies without any id, one stays.
    text = " ".join(f"w{i}" for i in range(60))
    odd = [(1, text), (1, text), (1, text + " x"), (2, text), (None, text.replace("w", "v")), (None, text.replace("w", "v") + " y"), (3, None), (4, "")]
    got = minhash.keep_one_of_each(spark.createDataFrame(odd, "`a.b` long, `my text` string"), "a.b", "my text").collect()
    assert sorted(repr(r["a.b"]) for r in got) == ["1", "3", "4", "None"]


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert np.count_nonzero(minhash.sketch(x)) == minhash.BINS
        assert (minhash.sketch(x) == minhash.sketch(x[::-1])).all()
    hits = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 500, dtype=np.uint64)
        y = np.concatenate([x[:400], rng.integers(0, 2**63, 100, dtype=np.uint64)])
        hits.append((minhash.sketch(x) == minhash.sketch(y)).mean())
    assert abs(np.mean(hits) - 400 / 600) < 0.02
