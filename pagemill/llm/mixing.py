"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order, null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``SHARE`` times all
words; no source may exceed ``MOST`` times its own words, and what it can't take is shared again by
weight until none is above. A source takes all its documents for every complete epoch in its
target; of the rest, documents in the order of exponential keys -ln(u) / quality are taken whole
until the words reach the remaining budget (the document at the border is taken if that comes
nearer). ``u`` is a hash of id and text, so reruns agree.

Prefix sums are taken within slices, with the sums of the slices before added. The slices come from a range
partitioning of (source, key) by sampled splitters, so they hold about ``SLICE_ROWS`` rows each whatever
the weights, and a source with a third of all rows needs no task that holds it. Null or wordless
texts have size 0 and are never taken. Texts are counted whole. Repeated rows share their key and are taken
one by one. An empty table gives an empty result; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, materialise, packed, quoted, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SLICE_ROWS = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters and white space among the characters, at least 0.1: markup and digits lower it."""
    text = F.coalesce(text, F.lit(""))
    other = F.regexp_count(text, F.lit(r"[\x21-\x40\x5B-\x60\x7B-\x7E]"))
    return F.greatest(F.lit(0.1), F.lit(1.0) - other / F.greatest(F.length(text), F.lit(1)))


def unit_hash(id_: Column, text: Column) -> Column:
    """A number in (0, 1) from id and text: 52 bits of MD5."""
    name = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target, epochs, budget).

    The rank of a source is numbered in range partitions, so no task holds all sources.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "sources")
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    starts, at = [], 0
    for part in sorted(counts):
        starts.append((part, at))
        at += counts[part]
    starts = sizes.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    turn = F.pmod(F.col("start") + F.row_number().over(within) - 1, F.lit(len(WEIGHTS))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), turn + 1)
    ranged = materialise(ranged.join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("weight")), "sources")

    total = float(ranged.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, cap = 0.0, F.col("source_size") * float(MOST)
    full = F.lit(False)
    while True:
        # The level only rises: a source that is full at one level is full at every later one.
        held = ranged.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if held["weight"] == 0:
            break
        level = (total - held["held"]) / held["weight"]
        full = F.col("weight") * F.lit(level) > cap
        if ranged.where(full).count() == held["n"]:
            break
    target = F.when(full, cap).otherwise(F.col("weight") * F.lit(level))
    target = F.least(target, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = ranged.select("source", "source_size", target.alias("target")).withColumn("epochs", epochs)
    return out.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id_col, text_hash, size, source_size, target, taken."""
    text, id_ = F.col(quoted(text_col)), F.col(quoted(id_col))
    key = -F.log(unit_hash(id_, text)) / quality_weight(text)
    rows = docs.select(
        id_.alias("id"), F.xxhash64(text).alias("text_hash"), F.col(quoted(source_col)).alias("source"), words_in(text).alias("size"), key.alias("key")
    )
    rows = materialise(rows, "keys")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes), "targets")

    # The null source stands under a name of its own, so that it joins and hashes like any other.
    named = lambda df: df.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    slices = max(16, rows.count() // SLICE_ROWS)
    rows = named(rows).repartitionByRange(slices, "named", "key").withColumn("slice", F.spark_partition_id())
    rows = materialise(rows, "slices")
    sums = rows.groupBy("named", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("named").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("named", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = materialise(starts.join(named(targets).drop("source"), "named"), "starts")
    within = Window.partitionBy("named", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(starts, ["named", "slice"])
    upto = F.col("start") + F.col("upto")
    # Nearer with the document at the border than without it.
    more = (upto + (upto - F.col("size")) <= 2 * F.col("budget")).cast("long")
    taken = F.col("size") * F.least(F.col("epochs") + more, F.lit(MOST))
    return placed.select(F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def keep_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they were."""
    name = lambda id_, print_: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), print_.cast("string"))
    picks = mix_sources(docs, id_col, text_col, source_col).where("taken > 0")
    picks = picks.select(name(F.col(quoted(id_col)), F.col("text_hash")).alias("name"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    # Repeated rows share a name; as many of them stay as were taken, shared out evenly.
    picks = picks.groupBy("name").agg(F.sum("times").alias("times"))
    rows = docs.select(packed(docs).alias("row"), name(F.col(quoted(id_col)), F.xxhash64(F.col(quoted(text_col)))).alias("name"))
    rows = rows.join(picks, "name")
    alike = Window.partitionBy("name")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(alike)).withColumn("k", F.row_number().over(alike.orderBy("times")))
    times = F.floor(F.col("times") / F.col("n")) + (F.col("k") <= F.col("times") % F.col("n")).cast("long")
    return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*unpacked(docs))
