"""The training-data operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, lines, minhash, mixing, quality, secrets, sharding, spm, urls, warc
from pagemill.llm.common import discard, join_unique, materialise

SHARDS = 40
#: Labels of the hosts whose pages make up the block list of op5, under any domain.
LISTED_FAMILIES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = rf"(^|\.)({'|'.join(LISTED_FAMILIES)})\."


def model_path() -> str:
    """The public vocabulary that op1 uses unless another path is given."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents")
    path = model_path()
    return spm.round_trip(docs, path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("host").alias("source"), F.round("host_rate", 6).alias("host_rate"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The block list of op5: the URLs on hosts with a label of LISTED_FAMILIES, in the form in which a list gives
    them: with another scheme, ``www.``, capitals, a closing slash and a query."""
    host = urls.host_of(F.col("url"))
    name = urls.canonical(host, urls.path_of(F.col("url")))
    bare, path = F.regexp_extract(name, "(?s)^[^/]*", 0), F.regexp_extract(name, "(?s)^[^/]*(.*)", 1)
    shown = F.concat(F.lit("HTTP://WWW."), F.translate(bare, urls.LOWER, urls.UPPER), path, F.lit("/?from=list"))
    return pages.where(host.rlike(LISTED)).select(shown.alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = materialise(listed_urls(pages), "block-list")  # a table of its own, as a list is
    return urls.filter_urls(pages, listed)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), "text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] <= 2)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch_archive(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # The archives are parsed once; what the digest columns need is written without the payloads.
    records = materialise(warc.read_records(spark, path, payloads=False), "records")
    captures = warc.assemble(records)
    page = F.nullif(F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    rows = captures.select(
        "capture_id", page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.regexp_replace("response.digest", "^sha256:", "").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"),
    )
    rows = materialise(rows, "captures")
    discard(records)
    named = rows.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    out = join_unique(rows.where("to is not null"), named, ["to"]).unionByName(rows.where("to is null"), allowMissingColumns=True)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_sentencepiece, op2_sharding, op3_quality, op4_exact_dedup, op5_url_filter, op6_line_dedup,
        op7_secrets, op8_near_dedup, op9_mixing, op10_warc, pipeline,
    ]
    return {f.__name__: f for f in own}


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST)
"""

_URL = r"""
  SELECT {id} url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
"""
OP5_SQL = rf"""
WITH p AS ({_URL.format(id="page_id,")}),
named AS (
  SELECT *, regexp_replace(host, '^(www\.|m\.)', '')
            || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS name
  FROM p),
listed AS (
  SELECT DISTINCT name FROM named
  WHERE regexp_matches(host, '{LISTED}')),
rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, urls.RULES))}),
fits AS (
  SELECT DISTINCT n.host, n.path,
         first_value(rule_host || rule_path) OVER w AS rule, first_value(r.verdict) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM named) n
  JOIN rules r ON (n.host = rule_host OR ends_with(n.host, '.' || rule_host)) AND starts_with(n.path, rule_path)
  WINDOW w AS (PARTITION BY n.host, n.path ORDER BY length(rule_host) + length(rule_path) DESC))
SELECT page_id, n.host, n.path, rule, (l.name IS NOT NULL AND n.host <> '') AS listed,
       coalesce(f.verdict, CASE WHEN l.name IS NOT NULL AND n.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM named n
LEFT JOIN fits f ON n.host = f.host AND n.path = f.path
LEFT JOIN listed l ON n.name = l.name
"""

OP10_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
r AS (
  SELECT page_id, bytes, sha256(html) AS digest,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first
  FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= {warc.REVISIT_BYTES} AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= {warc.REVISIT_BYTES} AND n > 1 THEN first END AS refers_to
FROM r
"""


OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT *, row_number() OVER () AS row FROM w),
grams AS (
  SELECT row, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM r WHERE len(ws) >= 8),
twice AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY row),
m AS (
  SELECT r.doc_id, r.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM r LEFT JOIN covered c ON c.row = r.row),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT coalesce(avg(failed / n::DOUBLE), 0) AS mean, coalesce(var_pop(failed / n::DOUBLE), 0) AS spread, coalesce(avg(1e0 / n), 1) AS inverse FROM h),
b AS (SELECT mean, (spread - mean * (1 - mean) * inverse) / greatest(1 - inverse, 1e-9) AS between_hosts FROM s),
p AS (
  SELECT mean, least(greatest(CASE WHEN between_hosts <= 0 THEN {quality.MAX_PRIOR!r} ELSE mean * (1 - mean) / between_hosts - 1 END, 1e0), {quality.MAX_PRIOR!r}) AS weight FROM b),
rates AS (
  SELECT source, (failed + mean * weight) / (n + weight) AS host_rate,
         least({quality.MAX_HOST_RATE!r}, greatest({quality.SURE_HOST_RATE!r}, mean + {quality.LIMIT_DEVIATIONS!r} * sqrt(mean * (1 - mean) / (weight + 1)))) AS most
  FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate <= most, true) AS kept, f.source, round(host_rate, 6) AS host_rate
FROM f LEFT JOIN rates ON rates.source = f.source
"""


def _spans_sql(pattern: str, kind: str, test: str, group: int = 0) -> str:
    """A list of spans of one pattern: what lies between the matches gives their places."""
    quoted = pattern.replace("'", "''")
    rank = secrets.KINDS.index(kind)
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda i: {{
      's': ({length(f"string_split_regex(t, '{quoted}')[1:i]")} + {length(f"regexp_extract_all(t, '{quoted}')[1:i - 1]")})::BIGINT, 'r': {rank},
      'e': ({length(f"string_split_regex(t, '{quoted}')[1:i]")} + {length(f"regexp_extract_all(t, '{quoted}')[1:i]")})::BIGINT,
      'k': '{kind}', 'v': regexp_extract_all(t, '{quoted}', {group})[i]}}), lambda x: {test})"""


_NEAR = f"x.s <= y.e + {secrets.SCOPE} AND y.s <= x.e + {secrets.SCOPE}"
_ANY = f"len(list_filter({{}}, lambda y: {_NEAR})) > 0"
_APART = "len(list_filter({}, lambda y: x.s < y.e AND y.s < x.e)) = 0"
_NAMES = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
_MIXED = "regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]')"
OP7_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
strong AS (
  SELECT doc_id, t, {_spans_sql(secrets.ASSIGN, "assign", f"length(x.v) >= {secrets.MIN_ASSIGNED}", 1)} AS assign,
         {_spans_sql(secrets.ACCESS, "access", f"length(x.v) >= {secrets.MIN_ACCESS}")} AS access, {_spans_sql(secrets.HEX, "hex", "true")} AS hex FROM t),
parts AS (
  SELECT *, list_concat(list_concat(assign, access), hex) AS base,
         CASE WHEN len(assign) + len(access) > 0 THEN {_spans_sql(secrets.WEAK, "secret", _MIXED)} ELSE [] END AS weak,
         CASE WHEN len(assign) + len(access) > 0 THEN {_spans_sql(secrets.ENDPOINT, "endpoint", "true")} ELSE [] END AS ends FROM strong),
fresh AS (SELECT *, list_filter(weak, lambda x: {_APART.format("base")} AND {_APART.format("ends")}) AS own FROM parts),
linked AS (SELECT *, list_filter(own, lambda x: {_ANY.format("access")} OR ({_ANY.format("ends")} AND {_ANY.format("assign")})) AS secret FROM fresh),
done AS (
  SELECT *, list_filter(ends, lambda x: {_ANY.format("access")} AND ({_ANY.format("secret")} OR {_ANY.format("assign")} OR {_ANY.format("hex")})) AS endpoint FROM linked)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex,
       sha256({_NAMES.format("list_sort(base)")}) AS base_sha256, {_NAMES.format("list_sort(list_concat(list_concat(base, secret), endpoint))")} AS spans
FROM done
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
keys AS (
  SELECT doc_id, source, size,
         -ln((('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || t)[1:13])::BIGINT + 0.5e0) / {1 << 52})
           / greatest(0.1e0, 1e0 - len(regexp_extract_all(t, '[\x21-\x40\x5B-\x60\x7B-\x7E]')) / greatest(length(t), 1)::DOUBLE) AS key FROM d),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keys GROUP BY 1),
weighted AS (SELECT *, {list(map(float, mixing.WEIGHTS))}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w, source_size * {float(mixing.MOST)!r} AS cap FROM sizes),
level AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) * {mixing.SHARE!r} - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER rest AS high
  FROM weighted WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       rest AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
chosen AS (SELECT min(high) AS high FROM (SELECT high FROM level WHERE high * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1)),
targets AS (SELECT source, source_size, least(cap, coalesce(w * high, cap))::DOUBLE AS target FROM weighted, chosen),
split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.*, s.source_size, s.target, s.epochs, target - epochs * source_size AS budget,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keys k JOIN split s ON s.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * least(epochs + CASE WHEN 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END, {mixing.MOST}))::BIGINT AS taken
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op7_secrets": OP7_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL,
    }
