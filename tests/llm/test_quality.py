import re
from collections import defaultdict

from pagemill.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    if text is None:
        return 0, 0, 0, 0, 0
    w = re.findall(WORD, text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    hit = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(WORD, line)) and line in lines[:i]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measures_match_brute_force(rows):
    texts = [r[1] for r in rows] + ["a b c d e f g h " * 4, "x\n\ny\nx\n x\nx", "a " * 30, "#$ é\u00a0ü 😀 | <b>", "\x0b\x0c\r a", " ".join("abcdefgh") + " z " + " ".join("abcdefgh")]
    for t in texts:
        assert quality.measure(t) == brute(t)


def test_rules_and_hosts(spark, docs, wide, rows, empty):
    for df in (docs, wide):
        got = quality.quality_rules(df).collect()
        assert sorted(repr((r["doc_id"], *(r[n] for n in quality.NAMES))) for r in got) == sorted(repr((r[0], *brute(r[1]))) for r in rows)
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)
        kept = quality.keep_good(df)
        assert kept.columns == df.columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in got if r["kept"])
    assert quality.quality_rules(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, f"h{i % 10}") for i in range(400)] + [(1000 + i, "short" if i < 95 else good, "bad") for i in range(100)]
    rows += [(2000, "short", "tiny"), (2001, good, "tiny"), (2002, good, None)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1099]["kept"] and got[1099]["host_rate"] > 0.5  # a clean page of a bad host
    assert got[0]["kept"] and got[2001]["kept"] and got[2002]["kept"]
    assert got[2001]["host_rate"] < 0.5  # shrunk from one in two
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_limit_follows_the_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    # Twenty hosts that fail now and then, and one that fails in two of five: below MAX_HOST_RATE, far from the others.
    rows = [(1000 * h + i, "short" if i % 20 == 0 else good, f"h{h}") for h in range(20) for i in range(100)]
    rows += [(50_000 + i, "short" if i % 5 < 2 else good, "worse") for i in range(100)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    lost = {r["host"] for r in got if not r["kept"] and not r["base_failed"]}
    assert lost == {"worse"} and all(r["host_rate"] < quality.MAX_HOST_RATE for r in got)


def test_beta_prior_stays_in_bounds():
    for args in ((0.0, 0.0, 1.0), (0.5, 0.25, 0.1), (0.1, 0.0, 0.01), (1.0, 0.0, 1.0)):
        a, b = quality.beta_prior(*args)
        assert a >= 0 and b >= 0 and 1 <= round(a + b, 6) <= quality.MAX_PRIOR
