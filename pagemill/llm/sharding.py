"""Sharding by longest-processing-time scheduling.

Groups (equal texts) stay together. Groups that weigh a good part of a shard are scheduled one by
one; lighter groups of like size are bundled by hash first, with bundles that shrink as the
remaining bytes shrink, so the number of scheduled units is bounded by the number of shards and
the logarithm of the total, whatever the number of groups. The units, sorted by size, go to the
least-loaded shard through a heap on the driver.

Null texts count as empty. Every row gets a shard, repeated rows and null ids too; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import bytes_of, join_unique, materialise, quoted

OVERHEAD = 16
#: Units per shard into which the remaining bytes are cut; more make shards more even and the heap longer.
UNITS_PER_SHARD = 32
#: Steps in which group sizes are classed, for each doubling.
STEPS = 16


def lpt(sizes: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Longest processing time first: (size, unit) pairs to shards; ties go by unit and lowest shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, shard, slot (gapless from 0 within a shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).select(
        "doc_id",
        (bytes_of("text") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"),
    )
    rows = materialise(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    step = F.floor(F.log2(F.col("bytes")) * STEPS).cast("int")
    groups = materialise(groups.withColumn("step", step), "groups")

    # At most STEPS * 64 rows: one for each class of sizes.
    classes = groups.groupBy("step").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(c["bytes"] for c in classes)
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    parts, rest = {}, total
    units = n_shards * UNITS_PER_SHARD
    for c in sorted(classes, key=lambda c: -c["step"]):
        parts[c["step"]] = max(1, min(c["n"], math.ceil(c["bytes"] * units / rest)))
        rest -= c["bytes"]
    alone = max(total // units, 1)  # fewer than `units` groups are larger: each is a unit of its own
    n_parts = spark.createDataFrame(list(parts.items()) or [(0, 1)], "step int, parts int")
    units_of = groups.join(F.broadcast(n_parts), "step").select(
        "key",
        "bytes",
        "n",
        F.when(F.col("bytes") > alone, F.concat(F.lit("g"), F.hex("key")))
        .otherwise(F.concat_ws(".", F.lit("b"), "step", F.pmod(F.xxhash64("key"), F.col("parts"))))
        .alias("unit"),
    )
    loads = units_of.groupBy("unit").agg(F.sum("bytes").alias("bytes")).collect()
    plan = lpt([(u["bytes"], u["unit"]) for u in loads], n_shards)
    placed = spark.createDataFrame(list(plan.items()) or [("", 0)], "unit string, shard int")
    of_group = materialise(units_of.join(F.broadcast(placed), "unit").select("key", "shard"), "placed")

    # Slots: a shard is cut by hash into parts that one task can number; a part starts where those before it end.
    n_parts = max(16, min(4096, n_rows // 20_000))
    out = join_unique(rows, of_group, ["key"]).drop("key")
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_parts)).cast("int"))
    out = materialise(out, "sharded")
    counts = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        out.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "part"])  # at most n_shards * 4096 rows
        .select(
            F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")
        )
    )
