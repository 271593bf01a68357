"""Line links against all pairs of lines by edit similarity, with no use of the module's candidates."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_lines import edit

from pagemill.llm import lines

SAMPLE = Path("/root/testdata/sf0.01/documents.parquet")


def planted(seed=11):
    """Lines of 8 to 60 words and copies with some words replaced, all at edit similarity 0.75 and more."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    one, many = [], []
    for n in (8, 12, 20, 40, 60):
        while len([p for p in one if p[2] == n]) < 12 or len([p for p in many if p[2] == n]) < 12:
            a = [word() for _ in range(n)]
            for out, m in ((one, 1), (many, n // 5)):
                b = list(a)
                for i in rng.sample(range(n), m):
                    b[i] = word()
                x, y = " ".join(a), " ".join(b)
                if len([p for p in out if p[2] == n]) < 12 and 100 * edit(x, y) <= 25 * max(len(x), len(y)):
                    out.append((x, y, n))
    return one, many


@pytest.mark.parametrize("part, least", [(0, 0.95), (1, 0.5)])
def test_bands_meet_planted_pairs(part, least):
    pairs = planted()[part]
    hashes = lines.WordHashes()
    x, y = (lines.line_bands([p[i].encode().split() for p in pairs], hashes) for i in (0, 1))
    assert (x == y).any(axis=1).mean() >= least


def test_removed_lines_against_all_pairs(spark):
    one, _ = planted()
    texts = [t for x, y, _ in one for t in (x, y)]
    want = {
        j for j in range(len(texts)) for i in range(j)
        if abs(len(texts[i]) - len(texts[j])) <= 25 * max(len(texts[i]), len(texts[j])) // 100
        and edit(texts[i], texts[j]) <= 25 * max(len(texts[i]), len(texts[j])) // 100
    }
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("__removed > 0")
    got = {r["doc_id"] for r in got.collect()}
    assert got <= want and len(want) >= len(one) and len(got) >= 0.95 * len(want)


@pytest.mark.skipif(not SAMPLE.exists(), reason="the driver's tables are not here")
def test_bands_meet_real_pairs():
    """Every 20th distinct line of the driver's documents against all of them."""
    texts = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SAMPLE}' WHERE text IS NOT NULL").fetchall():
        texts |= {b" ".join(w).decode() for w in map(bytes.split, lines.fold(t.encode()).split(b"\n")) if len(w) >= lines.MIN_WORDS}
    texts = sorted(texts, key=lambda t: (len(t), t))
    counts = np.stack([lines.bigrams(t) for t in texts]).astype(np.int32)
    sizes = np.array([len(t) for t in texts])
    pairs = []
    for i in range(0, len(texts), 20):
        longer = np.maximum(sizes, sizes[i])
        near = np.flatnonzero((np.minimum(sizes, sizes[i]) * 100 >= 75 * longer))
        near = near[np.abs(counts[near] - counts[i]).sum(axis=1) <= 4 * (25 * longer[near] // 100)]
        pairs += [(i, j) for j in near if i != j and lines.alike(texts[i], texts[j])]
    bands = lines.line_bands([t.encode().split() for t in texts], lines.WordHashes())
    met = [(bands[i] == bands[j]).any() for i, j in pairs]
    assert len(pairs) >= 20 and np.mean(met) >= 0.9


def test_filter_before_verification_loses_nothing():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 60)))
        b = "".join(rng.choice("xyz") if rng.random() < 0.12 else c for c in a if rng.random() > 0.1)
        assert not lines.alike(a, b) or lines.may_be_alike(a, b)
