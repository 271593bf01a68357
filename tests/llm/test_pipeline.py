"""run() against a plain restatement of its five stages."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import pytest
import test_lines
import test_minhash
import test_mixing
import xxhash

from pagemill.llm import lines, quality, spm
from pagemill.llm.queries import model_path


def good(rows):
    failed = [m[0] < 20 or 100 * m[4] > 30 * m[0] for m in (quality.measure(r[1]) for r in rows)]
    n, bad = Counter(), Counter()
    for r, f in zip(rows, failed, strict=True):
        n[r[3]] += 1
        bad[r[3]] += f
    hosts = [h for h in n if h is not None]
    rates = [bad[h] / n[h] for h in hosts]
    mean = sum(rates) / len(rates)
    a, b = quality.beta_prior(mean, sum((x - mean) ** 2 for x in rates) / len(rates), sum(1 / n[h] for h in hosts) / len(hosts))
    fine = {h for h in hosts if (bad[h] + a) / (n[h] + a + b) <= quality.host_limit(a, b)} | {None}
    return [r for r, f in zip(rows, failed, strict=True) if not f and r[3] in fine]


def clean(rows):
    at, of = test_lines.brute(rows)
    groups = {}
    for key, text in at.items():
        groups.setdefault(of[text], []).append(key)
    lost = {}
    for own in groups.values():
        for _, d, t, k in sorted(own, key=lambda x: (x[0], x[1] or 0))[1:]:
            lost.setdefault((d, t), set()).add(k)
    out = []
    for r in rows:
        drop = lost.get((r[0], r[1]), set())
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in drop)
        if not drop or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((r[0], text, *r[2:]))
    return out


def first_copies(rows):
    """One row of each component: the least id (null last), then the least hash; sets of nothing stand alone."""
    out, seen = [], set()
    groups = {}
    for r, (i, n, c) in zip(rows, test_minhash.brute(rows), strict=True):
        # Components without any id are told apart by their sets.
        groups.setdefault((c, n and c is None and frozenset(test_minhash.shingles(r[1]))) if n else ("bare", i, r[1]), []).append(r)
    for own in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in own)
        first = min((r for r in own if (r[0] is None, r[0] or 0) == least), key=lambda r: spark_hash(r[1]))
        assert id(first) not in seen
        seen.add(id(first))
        out.append(first)
    return out


def spark_hash(text):
    """Spark's xxhash64 of a string, signed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += test_mixing.size(r[1])
    out = []
    for source, target in test_mixing.targets(sizes).items():
        own = []
        for r in (r for r in rows if r[3] == source):
            u = (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            odd = len(re.findall(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", r[1]))
            own.append((-math.log(u) / max(0.1, 1 - odd / max(len(r[1]), 1)), r))
        own.sort(key=lambda x: x[0])
        epochs, upto = math.floor(target / sizes[source]) if sizes[source] else 0, 0
        for _, r in own:
            n = test_mixing.size(r[1])
            upto += n
            out += [r] * (min(2, epochs + (2 * upto - n <= 2 * (target - epochs * sizes[source]))) if n else 0)
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_and_run(spark, sf_dir):
    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = (good, clean, first_copies, mixed)
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain, strict=False):
        out = stage(spark, docs, path)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = brute(rows)
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, rows)), name
        docs = spark.createDataFrame(rows, docs.schema)
    model = spm.load(model_path())
    want = sorted(repr((r[0], model.encode(r[1]))) for r in rows)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in corpus_pipeline.run(spark, path).collect()) == want
    assert lines.MIN_WORDS == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
