"""URL filters: path rules, and a list of URLs behind a blocked Bloom filter.

Listed URLs are brought to a canonical form. A blocked Bloom filter of them (one row of eight
32-bit words for each block, built with ``bit_or`` aggregates) passes the possible hits; an exact
hash join with the listed canonical URLs removes the false positives. The filter has at most
``MAX_BLOCKS`` blocks, about 30 MB when broadcast, however long the list is: beyond that it passes
more, and the exact join still decides.

Null URLs, and those without ``://``, have empty host and path; they fit no rule and are never
listed. Repeated rows are judged alike. An empty list lists nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import join_unique, materialise, quoted

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 20
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as struct(rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """One name for the forms of a URL: no scheme, query, fragment, ``www.`` or ``m.``, ``.html`` or closing slash."""
    bare = F.regexp_replace(host, r"^(www\.|m\.)", "")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""))


def _hashes_of(name: str, blocks: int) -> list[Column]:
    """The block of a URL and its bit in each of the block's words, five bits of hash for each."""
    bits = f"xxhash64('bits', {name})"
    masks = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({bits}, {5 * i}) & 31 as int))").alias(f"m{i}") for i in range(WORDS)]
    return [F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block"), *masks]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocks of the filter of listed ``url``: block, w0 .. w7. At most ``blocks`` rows."""
    rows = listed.select(*_hashes_of("url", blocks))
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct ``url`` values of ``urls`` that ``listed`` (column url) holds."""
    listed = materialise(listed.select("url").where("url is not null").distinct(), "listed")
    blocks = max(1, min(MAX_BLOCKS, math.ceil(listed.count() / KEYS_PER_BLOCK)))
    filter_ = materialise(bloom(listed, blocks), "bloom")
    probe = urls.select("url").where("url is not null").distinct()
    probe = probe.select("url", *_hashes_of("url", blocks))
    passed = " and ".join(f"(w{i} & m{i}) = m{i}" for i in range(WORDS))
    possible = probe.join(F.broadcast(filter_), "block").where(passed).select("url")
    return possible.join(listed.hint("shuffle_hash"), "url", "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id_col, host, path, rule, listed, verdict.

    A rule decides where one fits; else listed URLs are blocked and all others allowed.
    ``listed`` has a column ``url`` of raw URLs.
    """
    at = lambda df, c: df.select(host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path"))
    name = canonical(F.col("host"), F.col("path"))
    wanted = at(listed, "url").where("host <> ''").select(name.alias("url"))
    rows = pages.select(F.col(quoted(id_col)).alias("id"), host_of(F.col(quoted(url_col))).alias("host"), path_of(F.col(quoted(url_col))).alias("path"))
    rows = rows.withColumn("url", F.when(F.col("host") != "", name)).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    rows = materialise(rows, "urls")
    hits = materialise(listed_hits(rows, wanted).withColumn("listed", F.lit(True)), "hits")
    found = join_unique(rows.where("url is not null"), hits, ["url"]).unionByName(rows.where("url is null"), allowMissingColumns=True)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("listed", F.lit(False)).alias("listed"), verdict.alias("verdict"),
    )
