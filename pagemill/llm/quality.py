"""Host-level quality rules.

Every document is measured in one Arrow pass. Documents that fail a rule count against their host
(the ``source`` column). The rate of failures of a host is shrunk with a beta prior fitted to all
hosts by moments, and the verdict on a host is joined back to its documents. A host is rejected when its
shrunk rate is ``LIMIT_DEVIATIONS`` standard deviations of the prior above its mean, but never at rates below
``SURE_HOST_RATE`` (nearly all its documents are clean) and always above ``MAX_HOST_RATE``.

Null text: no words, so the document fails. Null host: no evidence, so the host passes. Texts are measured
whole, however long. Repeated rows count each; an empty table gives an empty result. Further columns may
have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_pass, join_unique, materialise, packed, quoted, unpacked

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The limit on a host's shrunk rate of failing documents: prior mean plus so many deviations, within these bounds.
LIMIT_DEVIATIONS, SURE_HOST_RATE, MAX_HOST_RATE = 3.0, 0.2, 0.5
#: Weight of the prior, in documents, when all hosts fail alike and moments give no finite one.
MAX_PRIOR = 10_000.0


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more, the first one included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # Windows of equal word numbers: name pairs, then pairs of pairs, ... exactly, by doubling.
    names, width = x, 1
    while width < n:
        names = np.unique(names[:-width] * np.int64(len(x) + 1) + names[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    counts = np.bincount(names)
    starts = np.flatnonzero(counts[names] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if text is None:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(NAMES))
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(columns | {n: pa.array(found[:, i]) for i, n in enumerate(NAMES)})


def measured(docs: DataFrame, key_cols: dict[str, str], text_col: str = "text") -> DataFrame:
    """The measures of every row beside the columns in ``key_cols`` (name in docs to name in the result)."""
    base = docs.select(*[F.col(quoted(c)).alias(n) for c, n in key_cols.items()], F.col(quoted(text_col)).alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in base.dtypes if n != "text"] + [f"{n} long" for n in NAMES])
    return arrow_pass(base, _measure_batches, schema)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_kept) from rows with host and base_failed."""
    hosts = (
        rows.where("host is not null")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    hosts = materialise(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"),
        F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("inverse"),
    ).first()  # one row
    alpha, beta = beta_prior(m["mean"] or 0.0, m["spread"] or 0.0, m["inverse"] or 1.0)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= F.lit(host_limit(alpha, beta)))


def host_limit(alpha: float, beta: float) -> float:
    """The greatest shrunk rate at which a host is kept."""
    weight = alpha + beta
    deviation = math.sqrt(alpha * beta / (weight + 1)) / weight
    return min(MAX_HOST_RATE, max(SURE_HOST_RATE, alpha / weight + LIMIT_DEVIATIONS * deviation))


def beta_prior(mean: float, spread: float, inverse: float) -> tuple[float, float]:
    """Beta(alpha, beta) by moments: ``spread`` of observed rates less what sampling alone gives them.

    ``inverse`` is the mean of 1 / documents of a host. The weight alpha + beta stays within 1 and MAX_PRIOR.
    """
    noise = mean * (1 - mean) * inverse
    between = (spread - noise) / max(1 - inverse, 1e-9)
    weight = MAX_PRIOR if between <= 0 else mean * (1 - mean) / between - 1
    weight = min(max(weight, 1.0), MAX_PRIOR)
    return mean * weight, (1 - mean) * weight


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id_col, the measures, base_failed, host, host_rate, host_kept, kept (and ``carry``)."""
    rows = measured(docs, {id_col: "doc_id", host_col: "host"} | {c: c for c in carry}, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", failed), "measures")
    verdicts = materialise(host_verdicts(rows).select("host", "host_rate", "host_kept"), "verdicts")
    known = join_unique(rows.where("host is not null"), verdicts, ["host"])
    out = known.unionByName(rows.where("host is null"), allowMissingColumns=True)
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return out.withColumn("kept", kept).withColumnRenamed("doc_id", id_col)


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t) for t in batch.column("text").to_pylist()]
        failed = pa.array([n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, _, _, _, r in found], pa.bool_())
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "host": batch.column("host"), "base_failed": failed})


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    base = docs.select(packed(docs).alias("row"), F.col(quoted(host_col)).alias("host"), F.col(quoted(text_col)).alias("text"))
    types = dict(base.dtypes)
    judged = arrow_pass(base, _judge_batches, f"row {types['row']}, host {types['host']}, base_failed boolean")
    # What failed counts for its host; its text isn't needed again.
    judged = judged.withColumn("row", F.when(~F.col("base_failed"), F.col("row")))
    judged = materialise(judged, "judged")
    bad = materialise(host_verdicts(judged).where("not host_kept").select("host", F.lit(True).alias("bad")), "bad-hosts")
    good = judged.where("not base_failed").select("row", "host")
    if not bad.isEmpty():
        named = join_unique(good.where("host is not null"), bad, ["host"]).where("bad is null").drop("bad")
        good = named.unionByName(good.where("host is null"))
    return good.select(*unpacked(docs))
