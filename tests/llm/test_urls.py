import re

from pagemill.llm import urls

LISTED = ["http://www.bad.example.net/x/", "https://bad.example.net/y.html?z=1", "nonsense", None]
PAGES = [
    "https://bad.example.net/x", "http://m.bad.example.net/x/?q", "https://BAD.example.net/y#top", "https://good.example.net/x", None, "", "no scheme/x",
    "https://a.example.org/es/1", "https://example.org/en/12", "https://example.org/de/12", "https://notexample.org/es/", "https://x.com/fr/a", "https://x.com/de/a?b",
    "https://com", "https://x.com", "a://b://c/d", "https://x.org", "https://x.org\n/p", "https://bad.example.net/x", "//bad.example.net/x",
]


def brute(url, names):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    listed = host != "" and name(host, path) in names
    return host, path, best and best[0] + best[1], listed, best[2] if best else "block" if listed else "allow"


def name(host, path):
    return re.sub(r"^(www\.|m\.)", "", host) + re.sub(r"/+$", "", re.sub(r"\.html$", "", path))


def frame(spark, values, key="page_id"):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(values)], f"{key} long, url string, host string, id string")


def test_rules_and_list(spark):
    pages = PAGES + ["https://bad.example.net/x"] * 500
    names = {"bad.example.net/x", "bad.example.net/y"}
    got = urls.filter_urls(frame(spark, pages), frame(spark, LISTED)).collect()
    want = [(i, *brute(u, names)) for i, u in enumerate(pages)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = frame(spark, PAGES).where("false")
    assert urls.filter_urls(none, frame(spark, LISTED)).collect() == []
    assert not any(r["listed"] for r in urls.filter_urls(frame(spark, PAGES), none).collect())


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('l', id) AS url")
    blocks = 150
    bloom = urls.bloom(listed, blocks)
    assert bloom.count() <= blocks
    passed = " and ".join(f"(w{i} & m{i}) = m{i}" for i in range(urls.WORDS))
    probe = lambda df: df.select("url", *urls._hashes_of("url", blocks)).join(bloom, "block").where(passed).count()
    assert probe(listed) == 3000
    assert probe(spark.range(20000).selectExpr("concat('other', id) AS url")) < 2000
