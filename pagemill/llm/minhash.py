"""MinHash near-duplicates by fast similarity sketching.

A sketch has ``BINS`` coordinates. In each of the first ``BINS`` rounds every shingle is hashed to
a bin and a value, and a bin keeps its least (round, value); bins still empty after that are filled
directly, one round for one bin, so every coordinate fills. Sets of BINS * ln(BINS) shingles and
more need a round or two. Bands of ``ROWS`` coordinates give candidate buckets; candidates are held
against each other on their full shingle sets. See ``common`` for how buckets become components
without all pairs.

Buckets that the leaders leave open are searched exactly. Each set has a print of ``BITS`` parities (bit i:
whether an odd number of its shingles hash to i), and a differing bit needs a shingle that only one
of two sets holds. A link has at most a seventh of both sizes of those, so pairs whose prints differ in
more bits are no links; they never become rows. What is left is held against each other in full.

Documents with equal shingle sets are one node from the start. A null or wordless text has an empty
set and is linked with nothing. A repeated row (same id, same text) gets the same result as the
first; a null id never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_pass, bits_apart, bucket_members, discard, join_unique, linked, materialise, open_pairs, packed, quoted, salts_for, unpacked

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: Parities in the print of a set, a power of two.
BITS = 512
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], _U)


class WordHashes(dict):
    """Hashes of words, kept while there are fewer than ``limit``."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence when it is shorter."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, _U)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    x = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = len(x) - SHINGLE + 1
    total = np.zeros(n, _U)
    for i in range(SHINGLE):
        total += mix(x[i : i + n] + _POWERS[i]) * _POWERS[i]
    return np.unique(mix(total))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes. Small sets take several rounds at once."""
    out = np.zeros(bins, _U)
    empty = np.ones(bins, bool)
    step = max(1, 4 * bins // len(items))
    for turn in range(0, bins, step):
        turns = mix(np.arange(turn + 1, min(turn + step, bins) + 1, dtype=_U))
        # The high bits of the hash name the bin, so in a sorted round the least value of each bin comes first.
        x = np.sort(mix(items[None, :] ^ turns[:, None]), axis=1).ravel()[::-1]
        at = ((x >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        held, filled = np.zeros(bins, _U), np.zeros(bins, bool)
        held[at] = x  # of repeated bins the last one stands: the earliest round, its least value
        filled[at] = True
        filled &= empty
        out[filled] = held[filled]
        empty &= ~filled
        if not empty.any():
            return out
    for i in np.flatnonzero(empty):
        out[i] = mix(items ^ mix(np.full(1, bins + i + 1, _U))[0]).min()
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is hashed in."""
    rows = mix(values.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))
    weights = np.arange(1, 2 * ROWS, 2, dtype=_U) * _U(0xD6E8FEB86659FD93) | _U(1)
    return mix((rows * weights[None, :]).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(0xA0761D6478BD642F))


def parities(items: np.ndarray) -> np.ndarray:
    """Print of a set of hashes: BITS parities as 64-bit words."""
    odd = np.bincount((items >> _U(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(x: str, y: str) -> Column:
    """Holds for every link: sizes within PERCENT, and at most (1 - t) / (1 + t) of both sizes in bits that differ."""
    n, k = F.col(f"{x}.n"), F.col(f"{y}.n")
    near = 100 * F.least(n, k) >= PERCENT * F.greatest(n, k)
    return near & ((100 + PERCENT) * bits_apart(x, y, BITS // 64) <= (100 - PERCENT) * (n + k))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        counts, prints, bands, bits = [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingle_set(text, hashes)
            counts.append(len(items))
            prints.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
            bands.append(band_keys(sketch(items)).view(np.int64) if len(items) else None)
            bits.append(parities(items) if len(items) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_shingles", "print", "bands", "bits"],
        )


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs come sorted by ``a``, so its set is made once for each run."""
    hashes, last, left = WordHashes(), None, np.empty(0, _U)
    for batch in batches:
        ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
        keep = []
        for i, a in enumerate(ids_a):
            if a != last:
                last, left = a, shingle_set(texts_a[i].as_py(), hashes)
            right = shingle_set(texts_b[i].as_py(), hashes)
            keep.append(similar(left, right))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, k in zip(ids_a, keep, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(ids_b, keep, strict=True) if k], pa.int64())],
            names=["a", "b"],
        )


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on the full sets."""
    if not len(left) or not len(right) or 100 * min(len(left), len(right)) < PERCENT * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= PERCENT * (len(left) + len(right) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, text_hash, n_shingles, component_id, kept, and ``first``, whether
    the row's id and text are those of the first of its component (by id, null last, then hash of the text).

    ``component_id`` is the smallest id reachable over links, the document's own included.
    """
    at, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    base = docs.select(at.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = dict(base.dtypes)["doc_id"]
    features = arrow_pass(
        base, _feature_batches, f"doc_id {id_type}, text_hash long, n_shingles long, print binary, bands array<bigint>, bits array<bigint>"
    )
    features = materialise(features, "features")

    # One node for each distinct set, under a number that is unique once it is written.
    first = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")
    nodes = (
        features.where("print is not null")
        .groupBy("print")
        .agg(
            F.min(first).alias("rep"), F.count(F.lit(1)).alias("rows"),
            F.min_by(F.struct("bands", "bits", F.col("n_shingles").alias("n")), first).alias("of"),
        )
        .select("print", "rep", "rows", "of.*", F.monotonically_increasing_id().alias("node"))
    )
    nodes = materialise(nodes, "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    grouped = materialise(bucket_members(members, salts_for(nodes.count())), "buckets")

    wanted = grouped.select("node").distinct().join(nodes.select("node", "n", "rep", "rows"), "node")
    wanted = wanted.select("node", "n", "rows", F.col("rep.doc_id").alias("key"), F.col("rep.text_hash").alias("hash"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash")))
    texts = texts.select("node", "n", "text", "rows")
    # Only a set that several rows have may have several rows of one id and text: one of these is enough.
    several = texts.where("rows > 1").groupBy("node", "n").agg(F.first("text").alias("text"))
    texts = materialise(texts.where("rows = 1").drop("rows").unionByName(several), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (texts.withColumnsRenamed({"node": end, "n": f"n_{end}", "text": f"text_{end}"}) for end in ("a", "b"))
        both = pairs.join(right, "b").join(left, "a").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
        both = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        return materialise(arrow_pass(both, _verify_batches, "a long, b long"), "links")

    labels = linked(grouped, verify, nodes.select("node", "n", "bits"), lambda at, turn: open_pairs(at, may_be_similar, turn))
    discard(grouped, texts)
    named = nodes.select("node", "print", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "named")
    discard(nodes, labels)
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    of_print = materialise(join_unique(named, least, ["label"]).select("print", "least"), "of-print")
    discard(named)
    rows = features.select("doc_id", "text_hash", "n_shingles", "print")
    # A document without a set is a component of its own; its id stands in where no print does.
    full = join_unique(rows.where("print is not null"), of_print, ["print"])
    bare = rows.where("print is null").withColumn("least", first)
    return full.unionByName(bare).select(
        F.col("doc_id").alias(id_col), "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("least.doc_id")).alias("kept"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("first"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns as they were: that of the smallest id (null last),
    then of the least hash of the text; of repeated rows one. Rows without a word are each a component of
    their id, so of those with one id and text one stays too.
    """
    place = [F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("hash")]
    found = near_duplicates(docs, id_col, text_col).select(F.col(quoted(id_col)).alias("id"), F.col("text_hash").alias("hash"), "first")
    # What goes, and what several rows have; most rows are neither.
    known = found.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("rows"), F.max("first").alias("first"))
    known = materialise(known.where("rows > 1 or not first"), "gone")
    rows = docs.select(packed(docs).alias("row"), *place)
    same = rows["id"].eqNullSafe(known["id"]) & (rows["hash"] == known["hash"])
    at = rows.join(known, same, "left").where(F.coalesce(known["first"], F.lit(True))).select("row", rows["id"], rows["hash"], "rows")
    once = at.where("rows is null").select("row")
    several = at.where("rows is not null").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(several).select(*unpacked(docs))
