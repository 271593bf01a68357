"""Shared plumbing of the training-data operators.

* ``materialise`` cuts lineage with a Parquet table in the shared folder that the
  cluster names in ``spark.checkpoint.dir``; a lost executor never loses it.
* ``join_unique`` joins rows to a table with one row per key without letting a hot
  key gather in one task.
* ``bucket_members`` / ``star_pairs`` / ``open_pairs`` / ``components`` turn candidate
  buckets into connected groups without emitting all pairs of a bucket.
* ``packed`` puts whole rows of any columns into one struct with names of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that a skew-safe join sends by broadcast at least; every other key holds at most 1/257 of the rows.
HOT_KEYS = 256
#: Members of a bucket that one task holds at most when the open part of a bucket is searched.
PART = 2048
#: Random members of a bucket that open members meet in one round, and how many meetings for each member of a
#: bucket make a round worth its while.
HUBS, MEETINGS = 4, 4
#: Edges between numbered nodes that one task takes to the end; 16 bytes each and some arrays as long.
GATHERED = 1 << 19


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the checkpoint folder of the session (``spark.checkpoint.dir``); only where that
    is unset, as in local tests, a temporary folder is set.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pagemill-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


#: Makes Spark drop a statement's shuffle files when it ends; a written table doesn't need them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """For statements that write a table: their shuffle files go when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(spark: SparkSession) -> int:
    """How many keys a skew-safe join broadcasts: HOT_KEYS, or one for each shuffle partition if there are more."""
    return max(HOT_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes that a Python pass handles at once; a row is never split.
PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about PIECE bytes each."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_pass(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` for rows that hold whole texts.

    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), ``pieces`` by
    PIECE; no setting of the session is changed. Python workers find this package where it isn't installed.
    """
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df.mapInArrow(lambda batches: run(pieces(batches)), schema)


def quoted(name: str) -> str:
    """A column name, dots and blanks included, as ``F.col`` takes it."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct with fields c0, c1, ...: no name can clash."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def unpacked(docs: DataFrame, row: str = "row", **instead: str) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``; ``instead`` names another column for some of them."""
    return [F.col(instead.get(c, f"{row}.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def bytes_of(text: str) -> Column:
    """UTF-8 length of a text column, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` to ``table`` (at most one row per key) that stands hot keys.

    The ``hot_keys`` most frequent keys of ``rows`` (or those in ``hot``, as many at most) meet a
    broadcast table of at most that many rows; all other rows take an ordinary shuffle join. Rows
    with a null key find no partner.
    """
    if hot is None:
        hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        for k in keys:
            hot = hot.where(F.col(k).isNotNull())
        hot = materialise(hot.orderBy(F.desc("__n"), *keys).limit(hot_keys(rows.sparkSession)).select(*keys), "hot-keys")
    of_hot = hot.join(table.join(F.broadcast(hot), keys, "left_semi"), keys, "left")
    near = rows.join(F.broadcast(of_hot), keys, "inner")
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left")
    return near.unionByName(cold)


def salts_for(n_rows: int) -> int:
    """Parts of a bucket so that neither a part nor the list of parts outgrows about sqrt(n_rows)."""
    return max(16, min(65536, int(n_rows**0.5)))


def bucket_members(members: DataFrame, salts: int) -> DataFrame:
    """Members (bucket, node) of buckets with two or more nodes, with two levels of leaders.

    Buckets of one node go first, as most are. Returns (bucket, node, leader, top): ``leader`` is the least node of the member's salted part
    of the bucket, ``top`` the least node of the bucket. No key of any exchange holds more rows
    than a salted part has, so a bucket with a third of all nodes is spread over many tasks.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("top")).where("n > 1")
    multi = materialise(counts, "multi")
    hot = multi.orderBy(F.desc("n"), "bucket").limit(hot_keys(members.sparkSession)).select("bucket")
    kept = join_unique(members, multi.select("bucket", "top"), ["bucket"], hot).where("top is not null")
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    leaders = salted.groupBy("bucket", "salt").agg(F.min("node").alias("leader"))
    return salted.join(leaders, ["bucket", "salt"]).select("bucket", "node", "leader", "top")


def star_pairs(grouped: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b: each member with its leader, each leader with the top."""
    hub = F.when(F.col("node") == F.col("leader"), F.col("top")).otherwise(F.col("leader"))
    return grouped.select(hub.alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def mixed_members(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label, big, members) of buckets that hold several components.

    ``big`` is the label of the bucket's largest component, ``members`` the size of the bucket.
    """
    at = grouped.select("bucket", "node").join(labels, "node", "left")
    at = at.withColumn("label", F.coalesce("label", "node"))
    counts = at.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("big"), F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("members")
    )
    return at.join(mixed.where("n_labels > 1").drop("n_labels"), "bucket").select("bucket", "node", "label", "big", "members")


def open_pairs(at: DataFrame, may_link: Callable[[str, str], Column], turn: int | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, of a bucket whose ends are not yet in one component, distinct.

    ``at`` has the rows of ``mixed_members`` with what ``may_link`` needs of a node; ``may_link("x", "y")`` is a
    condition on the structs x and y of two such rows that every link meets. It is part of the join, so what it
    rules out is never a row. Members outside a bucket's largest component meet all others, ``PART`` of them in a
    task, so a hot bucket is spread and one whose members are linked yields nothing. With a ``turn`` they
    meet some ``HUBS`` random members of each bucket only.
    """
    facts = F.struct(*[F.col(c) for c in at.columns if c not in ("bucket", "members")])
    small = at.where("label <> big").select("bucket", "members", facts.alias("x"))
    if turn is None:
        parts = F.ceil(F.col("members") / PART).cast("int")
        small = small.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "x")
        other = at.select("bucket", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), facts.alias("y"))
        met = small.join(other, ["bucket", "part"])
    else:
        hub = F.pmod(F.xxhash64(F.lit(turn), "bucket", "node"), F.col("members")) < HUBS
        met = small.join(at.where(hub).select("bucket", facts.alias("y")), "bucket")
    apart = F.expr("x.label <> y.label and (y.label = y.big or x.node < y.node)" if turn is None else "x.label <> y.label")
    return met.where(apart & may_link("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def bits_apart(x: str, y: str, words: int) -> Column:
    """How many bits differ in the arrays ``bits`` of two structs."""
    return sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(words)), F.lit(0))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the least node of the component of each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if held:
        found = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from pieces(iter([pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["v", "to"])]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) as (node, label), label the least node.

    Randomised contraction: in every round a vertex moves to the neighbour of least hash, edges
    are rewritten to the vertices that stay, and loops and repeats vanish. Each round is a table
    in the shared folder, deleted when the next stands. Once GATHERED edges of numbered nodes or fewer are left,
    one task finds the rest. Nodes without an edge do not appear.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = materialise(ends.select("node", F.col("node").alias("label")), "labels")
    turn = 0
    numbered = dict(edges.dtypes)["a"] == "bigint"
    while n_edges := edges.count():
        if numbered and n_edges <= GATHERED:
            moved = materialise(arrow_pass(edges.repartition(1), _joined_batches, "v long, to long"), "moved")
            renamed = join_unique(labels, moved.withColumnRenamed("v", "label"), ["label"])
            renamed = materialise(renamed.select("node", F.coalesce("to", "label").alias("label")), "labels")
            discard(labels, moved)
            labels = renamed
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn // 2)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        moved = materialise(
            moved.select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "moved"
        )
        to_a, to_b = moved.select(F.col("v").alias("a"), F.col("to").alias("ta")), moved.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        left = materialise(
            edges.join(to_a, "a")
            .join(to_b, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct(),
            "edges",
        )
        renamed = join_unique(labels, moved.select(F.col("v").alias("label"), "to"), ["label"])
        renamed = materialise(renamed.select("node", F.coalesce("to", "label").alias("label")), "labels")
        discard(edges, labels, moved)
        edges, labels = left, renamed
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = materialise(join_unique(labels, least, ["label"]).select("node", F.col("least").alias("label")), "components")
    discard(edges, labels)
    return out


def linked(
    grouped: DataFrame, verify: Callable[[DataFrame], DataFrame], about: DataFrame, meet: Callable[[DataFrame, int | None], DataFrame]
) -> DataFrame:
    """Components of all verified candidate pairs of ``grouped`` (see ``bucket_members``) as (node, label).

    First every member is held against its leaders. While the buckets that stay mixed would take more than
    ``MEETINGS`` meetings for each member, those outside the largest component of a bucket are held against a
    few random members, as long as that still links one in a hundred of them; then all pairs of different
    components in a bucket are, so no pair is left out. ``verify`` takes (a, b) pairs and returns a written
    table of the links among them. ``meet(at, turn)`` gives the pairs, as ``open_pairs`` does, from the rows of
    ``mixed_members`` with the columns that ``about`` has for their nodes.
    """
    n_members = grouped.count()
    found = verify(star_pairs(grouped))
    labels = components(found)
    turn, gain = 0, 1.0
    while True:
        discard(found)
        at = materialise(mixed_members(grouped, labels).join(about, "node"), "mixed")
        work = at.where("label <> big").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("met"), F.count_distinct("node").alias("n")).first()
        last = gain < 0.01 or work["met"] <= MEETINGS * n_members
        pairs = materialise(meet(at, None if last else turn), "pairs")
        found = verify(pairs)
        n_found = found.count()
        gain = n_found / max(work["n"], 1)
        if n_found:
            tree = labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
            more = components(tree.unionByName(found))
            discard(labels)
            labels = more
        discard(at, pairs)
        if last:
            discard(found)
            return labels
        turn += 1
