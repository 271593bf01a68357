import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import xxhash

from pagemill.llm import exact_dedup, sharding


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, r in enumerate(own):
            out.append((r[0], own[0][0], len(own), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_dedup(docs, wide, rows, empty):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for df in (docs, wide):
        assert sorted(repr(tuple(r[n] for n in names)) for r in exact_dedup.exact_dedup(df).collect()) == brute_exact(rows)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_of_hot_texts(spark):
    rows = [(i, "hot text" if i % 3 else f"t {i}") for i in range(3000)] + [(9000, "hot  text"), (9001, "hot  text")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == brute_exact(rows)


def test_sharding_keeps_groups_and_fills_slots(docs, wide, rows, empty):
    for df in (docs, wide):
        got = sharding.shard_documents(df, 7).collect()
        assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(
            repr((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows
        )
        shards = defaultdict(list)
        of_text = defaultdict(set)
        for r in got:
            shards[r["shard"]].append(r["slot"])
            of_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        assert all(len(s) == 1 for s in of_text.values())
        assert set(shards) <= set(range(7))
    assert sharding.shard_documents(empty, 7).collect() == []


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_shards(rows, n):
    """shard_documents restated in plain Python: (doc_id, size, shard, slot) in sorted form."""
    keys = [hashlib.sha256((r[1] or "").encode()).digest()[:16] for r in rows]
    sizes = [len((r[1] or "").encode()) + 16 for r in rows]
    group = defaultdict(int)
    for k, size in zip(keys, sizes, strict=True):
        group[k] += size
    step = {k: math.floor(math.log2(b) * 16) for k, b in group.items()}
    per = defaultdict(list)
    for k, b in group.items():
        per[step[k]].append(b)
    total = rest = sum(sizes)
    parts = {}
    for s in sorted(per, reverse=True):
        parts[s] = max(1, min(len(per[s]), math.ceil(sum(per[s]) * n * 32 / rest)))
        rest -= sum(per[s])
    unit = {}
    for k, b in group.items():
        alone = b > max(total // (n * 32), 1)
        unit[k] = "g" + k.hex().upper() if alone else f"b.{step[k]}.{signed(xxhash.xxh64_intdigest(k, seed=42)) % parts[step[k]]}"
    loads = defaultdict(int)
    for k, b in group.items():
        loads[unit[k]] += b
    shards, shard = [0] * n, {}
    for u in sorted(loads, key=lambda u: (-loads[u], u)):  # longest first, to the least loaded
        least = min(range(n), key=lambda s: (shards[s], s))
        shard[u] = least
        shards[least] += loads[u]
    return sorted(repr((r[0], size, shard[unit[k]])) for r, k, size in zip(rows, keys, sizes, strict=True))


def test_sharding_matches_brute_force(spark, docs, rows):
    rng = random.Random(6)
    more = [(i, rng.choice("abcdef") * rng.randrange(1, 2000) + str(i % 300)) for i in range(1500)]
    for df, own, n in ((docs, rows, 7), (spark.createDataFrame(more, "doc_id long, text string"), more, 40)):
        got = sharding.shard_documents(df, n).collect()
        assert sorted(repr((r["doc_id"], r["size"], r["shard"])) for r in got) == brute_shards(own, n)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.choice([5, 50, 500, rng.randrange(3000)]) + str(i % 900)) for i in range(4000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    loads = [r["b"] for r in got.groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(loads) == 10
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 10


def test_lpt_is_longest_first():
    assert sharding.lpt([(3, "a"), (3, "b"), (2, "c"), (2, "d"), (2, "e")], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
