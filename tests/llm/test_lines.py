import random

from pagemill.llm import lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(line):
    return b" ".join(lines.normal(line.encode())).decode()


def brute(rows):
    """The lines to remove, with links between all pairs of lines that are alike."""
    at = {}
    for r in set(rows):
        for k, line in enumerate((r[1] or "").split("\n")):
            if len(normal(line).split()) >= lines.MIN_WORDS:
                at[r[0] is None, r[0], r[1], k] = normal(line)
    texts = sorted(set(at.values()))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and lines.alike(texts[i], texts[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    of = {t: label[i] for i, t in enumerate(texts)}
    return at, of


def test_removed_lines(docs, wide, rows, empty):
    at, of = brute(rows)
    for df in (docs, wide):
        got = lines.dedup_lines(df).collect()
        groups = {}
        for key, text in at.items():
            groups.setdefault(of[text], []).append(key)
        gone = {(d, t, k) for own in groups.values() for v, d, t, k in sorted(own, key=lambda x: (x[0], x[1] or 0))[1:]}
        lost = {}
        for d, t, k in gone:
            lost.setdefault((d, t), set()).add(k)
        want = []
        for r in rows:
            drop = lost.get((r[0], r[1]), ())
            want.append((r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in drop), len(drop)))
        assert sorted(repr((r["doc_id"], r["text"], r["__removed"])) for r in got) == sorted(map(repr, want))
    assert lines.dedup_lines(empty).collect() == [] and lines.keep_clean_lines(empty).collect() == []


def test_fuzzy_lines_and_short_lines(spark):
    rng = random.Random(2)
    long = [f"word{rng.randrange(900)}" for _ in range(400)]
    other = list(long)
    other[200] = "changed"
    digits = "On 12 March 2021 we sold 1,234 units of it to them"
    rows = [
        (1, " ".join(long) + "\nThe end.\n" + digits),
        (2, "Own line of this very document here\n" + " ".join(other) + "\nThe end."),
        (3, digits.replace("12", "7").replace("2021", "1999").upper() + "!\n\nThe end."),
        (4, digits),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got[1] == rows[0][1]
    assert got[3] == "\nThe end." and got[4] == ""
    assert got[2].startswith("Own line") and got[2].endswith("The end.")
    assert {r["doc_id"] for r in lines.keep_clean_lines(df).collect()} == {1, 2, 3}


def test_distance():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        d = edit(a, b)
        for most in (0, d - 1, d, d + 1, 20):
            if most >= 0:
                assert lines.distance_at_most(a, b, most) == (d <= most), (a, b, d, most)
    a = "".join(rng.choice("abcdef ") for _ in range(900))
    b = "".join(c for c in a if rng.random() > 0.03)
    d = edit(a, b)
    assert lines.distance_at_most(a, b, d) and not lines.distance_at_most(a, b, d - 1)


def test_repeated_rows_and_clashing_names(spark):
    line = "one two three four five six seven"
    rows = [(1, line, "x")] * 3 + [(2, f"{line} eight\nown words that stand here only once", "y"), (None, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "`a.b` long, `the text` string, __removed string")
    once = lines.dedup_lines(df, "a.b", "the text")
    assert once.columns == ["a.b", "the text", "__removed"]
    got = sorted(map(tuple, lines.dedup_lines(once, "a.b", "the text").collect()), key=repr)
    assert got == sorted([(1, line, 0)] * 3 + [(2, "own words that stand here only once", 0), (None, None, 0), (3, "", 0)], key=repr)
    assert lines.keep_clean_lines(df, "a.b", "the text").columns == df.columns


def test_search_of_open_buckets_joins_what_all_pairs_join(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(14)], []
    for _ in range(700):  # two or three words of a common line changed: some are alike, many aren't
        copy = list(base)
        for k in rng.sample(range(14), rng.randrange(1, 7)):
            copy[k] = word()
        texts.append(" ".join(copy))
    bits = [lines.parities(t).tolist() for t in texts]
    bands = lines.line_bands([t.encode().split() for t in texts], lines.WordHashes()).view("int64")
    rows = [(int(b), i, i, 0, len(texts), len(t), bits[i], t) for b in set(bands.ravel().tolist()) for i, t in enumerate(texts) if b in bands[i]]
    at = spark.createDataFrame(rows, "bucket long, node long, label long, big long, members long, size int, bits array<long>, text string")
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and (bands[i] == bands[j]).any() and lines.alike(texts[i], texts[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    want = [root(i) for i in range(len(texts))]
    found = lines.open_links(at).collect()
    assert all(lines.alike(texts[r["a"]], texts[r["b"]]) for r in found)
    label = list(range(len(texts)))
    for r in found:
        a, b = root(r["a"]), root(r["b"])
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts)


def test_normal():
    assert normal("  The  CAT, (no. 12,345) sat -- É! ") == "the cat no 0 sat É"
    assert normal("a7\tb  800 c-d") == "a0 b 0 cd"


def test_many_distances_and_prints():
    rng = random.Random(3)
    pairs = [("", ""), ("", "ab"), ("abcd", ""), ("same " * 30, "same " * 30), ("x" * 5000, "x" * 2500 + "y" * 1200 + "x" * 1300)]
    for _ in range(1500):
        chars = rng.choice(["ab", "abcdé ", "abcdefghij漢字 😀"])
        a = "".join(rng.choice(chars) for _ in range(rng.choice([1, 5, 30, 63, 64, 65, 127, 128, 129, 200, 400])))
        share = rng.choice([0.05, 0.2, 0.28, 0.33])
        pairs.append((a, "".join(rng.choice(chars) if rng.random() < share / 2 else c for c in a if rng.random() > share / 2)))
    want = [lines.alike(a, b) for a, b in pairs]
    assert lines.alike_many(pairs).tolist() == want and 200 < sum(want) < 1450
    assert all(lines.alike(a, b) == (100 * edit(a, b) <= 25 * max(len(a), len(b))) for a, b in pairs[5:60])
    texts = [t for p in pairs for t in p]
    assert lines.parities_of(texts).tolist() == [lines.parities(t).tolist() for t in texts]


def test_band_members_are_those_of_shared_keys(spark, monkeypatch):
    """Hot keys within and across the blocks of keys that are sorted at once, and keys of one node."""
    rng = random.Random(12)
    keys = [-(1 << 63), -1, 0, 7, (1 << 63) - 1]
    bands = {n: [rng.choice(keys) if rng.random() < 0.2 else rng.randrange(1 << 40) for _ in range(lines.BANDS)] for n in range(600)}
    bands = {n: list(dict.fromkeys(b)) for n, b in bands.items()}
    bands = {n: b + [(n << 44) + i + 1 for i in range(lines.BANDS - len(b))] for n, b in bands.items()}
    rows = [(n, b) for n, b in bands.items()]
    held = {}
    for n, b in rows:
        for k in b:
            held.setdefault(k, set()).add(n)
    want = {(k, n) for k, own in held.items() if len(own) > 1 for n in own}
    for slices in (1, 7):
        df = spark.createDataFrame(rows, "node long, bands array<long>").repartition(slices)
        got = lines.band_members(df, len(rows)).collect()
        assert sorted((r["bucket"], r["node"]) for r in got) == sorted(want) and len(want) > 500
        for r in got:  # every member leads to the top of its bucket over its leader
            own = held[r["bucket"]]
            assert r["leader"] in own and (r["node"] != r["leader"] or r["top"] == min(own))
        assert all(any(x["bucket"] == r["bucket"] and x["node"] == r["leader"] == x["leader"] for x in got) for r in got if r["node"] != r["leader"])


def test_distances_left_early_or_outside_the_band_change_no_answer(monkeypatch):
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    pairs = []
    for _ in range(240):
        a = text(rng.choice([60, 64, 66, 130, 200, 330]))
        share = rng.choice([0.1, 0.22, 0.25, 0.28, 0.6])
        b = "".join(rng.choice("abcde ") if rng.random() < share / 2 else c for c in a if rng.random() > share / 2)
        k = len(b) // 7
        pairs.append((a, rng.choice([b, b + text(k), text(k) + b[k:], b[k:] + text(k), b[k:]])))
    want = [100 * edit(a, b) <= 25 * max(len(a), len(b)) for a, b in pairs]
    for cells, check in ((lines.CELLS, lines.CHECK), (40, 1), (lines.CELLS, 1), (300, 7)):
        monkeypatch.setattr(lines, "CELLS", cells)
        monkeypatch.setattr(lines, "CHECK", check)
        assert lines.alike_many(pairs).tolist() == want and 50 < sum(want) < 190
    monkeypatch.setattr(lines, "LETTERS", 3)
    assert lines.alike_many(pairs).tolist() == want
    for a, b in pairs:
        most = 25 * max(len(a), len(b)) // 100
        assert not lines.clearly_alike(a, b, most) or lines.alike(a, b)


def test_few_words_of_the_table_are_computed(monkeypatch):
    """Half the table at most for alike pairs with scattered edits, a third for random ones, which are left early."""
    rng = random.Random(22)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    far, close = [], []
    for _ in range(100):
        a = text(900)
        far.append((a, text(900)))
        close.append((a, "".join(rng.choice("xyz") if rng.random() < 0.2 else c for c in a)))
    shift, done = lines.np.left_shift, []
    monkeypatch.setattr(lines.np, "left_shift", lambda x, *args, **named: done.append(x.size) or shift(x, *args, **named))
    for pairs, want, most in ((far, False, 0.33), (close, True, 0.5)):
        done.clear()
        assert (lines.alike_many(pairs) == want).all()
        assert 0 < sum(done) / 2 <= most * 100 * 900 * -(-900 // 64)


def test_white_space_of_lines():
    for line in (b"a\tb  c \r", b" \x0b a - b\x0cc d", b"", b"  ", b"x" * 70000 + b"  y"):
        assert lines.squeezed(lines.fold(line)) == b" ".join(lines.normal(line))
    words = [b"w", b"ww", b"x" * 70000, b"y" * 70000, b"x" * 69999, "é漢".encode()]
    apart, together = lines.WordHashes(), lines.WordHashes()
    assert [int(apart([w])[0]) for w in words] == together([b" ".join(words)]).tolist() and len(set(together(words).tolist())) == len(words)
