"""Near-duplicate records by signatures over a partitioned feature domain (problem 2).

The features of a text are its distinct runs of `words` words, as 64-bit hashes. Equal sets form one class, and classes are compared:

* The domain is partitioned by frequency into a rare and a hot part, by the counts of a hashed sketch over all texts. Two sets with a
  similarity of `threshold` share a feature among the least frequent |x| - ceil(threshold |x|) + 1 of each (any fixed order will do), and, if
  they share two features at all, two among one more of each.
* A rare feature there is a signature by itself; of the hot ones, every subset of two is. Of sets that share none of the rare ones, all shared
  ones there are hot, so they share a subset. Sets above `band` features would have too many subsets and use single hot features instead; those
  of the neighbouring size band use both, so that sets of similar size always meet. Long sets meet many others by chance; but as similar ones
  share k features among k - 1 more of the least frequent ones, for any k, two sets above the band must meet in n/16 + 1 signatures.
* A 128-bit map of a set's features goes with its signatures. The bits in which two maps differ bound their difference from below, which drops
  nearly all chance meetings before anything is compared.
* What is left is compared exactly.

No step loses a pair. With the plain hashed partition of the PartEnum scheme a threshold of 0.5 over 50 features allows a difference of 33, so
34 parts with 1.5 features each, of which a fifth are empty and hence equal for all: the signatures would select nothing. Hence the partition
by frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.components import connected_components
from foliant.session import saved

#: Sets above the band share one more than this part of their features' number, so many more of the least frequent ones are signatures.
SHARED = 16
_WORD = re.compile(r"[^\W_]+")


def word_runs(texts: list[str | None], words: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` words, one after the other, and their number. A word is an unbroken run of letters
    and digits, lower-cased; known keeps the hashes of words from call to call."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    for w in set().union(*found) - known.keys():
        known[w] = xxhash.xxh64_intdigest(w)
    n = np.array([len(w) for w in found], np.int64)
    flat = np.fromiter((known[w] for ws in found for w in ws), np.uint64, int(n.sum()))
    row = np.repeat(np.arange(len(n)), n)
    last = len(flat) - words + 1
    if last <= 0:
        return np.empty(0, np.int64), np.zeros(len(n), np.int64)
    h = flat[:last].copy()
    for k in range(1, words):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + flat[k : last + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    inside = row[:last] == row[words - 1 :]
    row, h = row[:last][inside], h[inside].view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def with_word_runs(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item_id, runs, h1, h2, n_runs) of the texts that have runs; h1 and h2 identify the set of runs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            values, sizes = word_runs(batch.column("text").to_pylist(), words, known)
            some = np.flatnonzero(sizes)
            sizes = sizes[some]
            ends = np.cumsum(sizes)
            data = values.tobytes()
            marks = np.array([xxhash.xxh128_intdigest(data[8 * (e - n) : 8 * e]).to_bytes(16, "little") for n, e in zip(sizes, ends)], "V16").view(np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(some)), lists, pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array(sizes.astype(np.int32))], ["item_id", "runs", "h1", "h2", "n_runs"])

    given = df.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null and text is not null")
    kind = given.schema["item_id"].dataType.simpleString()
    return given.mapInArrow(runs, f"item_id {kind}, runs array<bigint>, h1 bigint, h2 bigint, n_runs int")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def signatures(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray, hot: float, threshold: float, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each set in values, whose sizes are given."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    seen = counts[values & (len(counts) - 1)]
    order = np.lexsort((values, seen, row))
    values, seen = values[order], seen[order]
    rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    common = seen > hot
    more = np.where(size > band, size // SHARED, 0)
    single = (rank < prefix + more) & (~common | (size > band) | (size < 2 / threshold))
    rows, sigs = [row[single]], [values[single]]
    paired = np.flatnonzero((rank < prefix + 1) & common & (size <= band / threshold))
    if len(paired):
        r, v = row[paired], values[paired]
        first = np.searchsorted(r, r, "left")
        for back in range(1, int((np.arange(len(r)) - first).max()) + 1):  # pairs that are `back` apart, for all rows at once
            j = np.flatnonzero(np.arange(len(r)) - first >= back)
            rows.append(r[j])
            with np.errstate(over="ignore"):
                a, b = v[j], v[j - back]
                low, high = np.minimum(a, b), np.maximum(a, b)
                sigs.append(low * np.int64(-7046029254386353131) ^ (high + np.int64(7809847782465536322)) * np.int64(-4417276706812531889))
    return np.concatenate(rows), np.concatenate(sigs)


def _bits(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Map of `width` bits of each set, as bytes."""
    maps = np.zeros((len(sizes), width), bool)
    maps[np.repeat(np.arange(len(sizes)), sizes), (values >> 20) & (width - 1)] = True
    return np.packbits(maps, axis=1)


def _maps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, sizes = _flat(batch.column("runs"))
        if len(sizes):
            raw = _bits(values, sizes, width).tobytes()
            step = width // 8
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("n_runs"), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())], ["class_id", "n", "m"])


def _within(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (class_a, class_b) whose maps don't differ more than sets of this similarity can."""
    a = maps.select(F.col("class_id").alias("class_a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    b = maps.select(F.col("class_id").alias("class_b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    joined = pairs.join(a, "class_a").join(b, "class_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ma", "mb"))
                differ = np.bitwise_count(x ^ y).sum(axis=1)
                most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * ((1 - threshold) / (1 + threshold)) + 1e-6
                yield batch.select(["class_a", "class_b"]).take(pa.array(np.flatnonzero(differ <= most)))

    kind = maps.schema["class_id"].dataType.simpleString()
    return joined.mapInArrow(near, f"class_a {kind}, class_b {kind}")


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, band: int = 256, max_sketch: int = 1 << 22, max_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the similar pairs of classes.

    Returns members (item_id, class_id, n_runs) and links (class_a, class_b, similarity), class_a < class_b, similarity being the exact
    Jaccard similarity of the runs, at least `threshold`. class_id is the least item_id of its class. A null id or text, and a text with fewer
    than `words` words, has no runs and is left out of both. Repeated rows count once; an id with several texts is in a class for each. Other
    columns are ignored. max_sketch bounds the counters of the frequency sketch (and so the broadcast, 4 bytes each). Ids of met pairs are
    broadcast up to `max_broadcast` pairs; beyond, they are joined by a shuffle.
    """
    spark = df.sparkSession
    by = ["h1", "h2", "n_runs"]
    keyed = with_word_runs(df, id_col, text_col, words)
    classes = saved(keyed.groupBy(*by).agg(F.min(F.struct("item_id", "runs")).alias("x")).select(F.col("x.item_id").alias("class_id"), *by, F.col("x.runs").alias("runs")), "sets")
    members = keyed.select("item_id", *by).distinct().join(classes.select("class_id", *by), by).select("item_id", "class_id", "n_runs")

    total = classes.agg(F.coalesce(F.sum("n_runs"), F.lit(0))).first()[0]
    size = 1 << int(np.clip(np.ceil(np.log2(max(total, 1) / 64)), 10, np.log2(max_sketch)))
    counts = np.zeros(size, np.int32)
    found = classes.select(F.explode("runs").alias("r")).groupBy(F.col("r").bitwiseAND(F.lit(size - 1)).alias("k")).count().toArrow()
    counts[found["k"].to_numpy()] = found["count"].to_numpy()
    shared, hot = spark.sparkContext.broadcast(counts), 1.5 * total / size + 30

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _flat(batch.column("runs"))
            if not len(values):
                continue
            row, sig = signatures(values, sizes, shared.value, hot, threshold, band)
            bits = _bits(values, sizes, 128).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), batch.column("class_id").take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array(bits[row, 0].copy()), pa.array(bits[row, 1].copy())], ["sig", "class_id", "n", "m0", "m1"])

    kind = classes.schema["class_id"].dataType.simpleString()
    signed = classes.select("class_id", "runs").mapInArrow(sign, f"sig bigint, class_id {kind}, n int, m0 bigint, m1 bigint")
    x, y = signed.alias("x"), signed.alias("y")
    differ = F.bit_count(F.col("x.m0").bitwiseXOR(F.col("y.m0"))) + F.bit_count(F.col("x.m1").bitwiseXOR(F.col("y.m1")))
    most = (F.col("x.n") + F.col("y.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    smaller = F.least("x.n", "y.n")
    met = (
        x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.n") >= F.col("y.n") * threshold) & (F.col("y.n") >= F.col("x.n") * threshold) & (differ <= most) & (F.col("x.class_id") < F.col("y.class_id")))
        .groupBy(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b"))
        .agg(F.count("*").alias("shared"), F.max(F.when(smaller > band, F.floor(smaller / SHARED) + 1).otherwise(1)).alias("due"))
        .filter("shared >= due")
        .select("class_a", "class_b")
    )
    # a map of 512 bits, bounding in the same way, leaves hardly any pair that is not similar
    maps = classes.select("class_id", "runs", "n_runs").mapInArrow(lambda batches: _maps(batches, 512), f"class_id {kind}, n int, m binary")
    wide = saved(maps, "maps")
    met = saved(_within(met, wide, threshold), "met")
    # only the sets that still meet are compared; the others never leave their executors while the list of ids is small
    ids = met.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    ids = F.broadcast(ids) if met.count() <= max_broadcast else ids
    own = saved(classes.select("class_id", "runs").join(ids, "class_id", "left_semi"), "met-sets")
    compared = (
        met.join(own.select(F.col("class_id").alias("class_a"), F.col("runs").alias("ra")), "class_a")
        .join(own.select(F.col("class_id").alias("class_b"), F.col("runs").alias("rb")), "class_b")
        .withColumn("both", F.size(F.array_intersect("ra", "rb")))
        .select("class_a", "class_b", (F.col("both") / (F.size("ra") + F.size("rb") - F.col("both"))).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    return members, saved(compared, "links")


def near_duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of different item_ids (key_a < key_b) in the same class or in linked ones, each once. The result is as large as the pairs are many."""
    a = members.select(F.col("item_id").alias("item_a"), F.col("class_id").alias("class_a"))
    b = members.select(F.col("item_id").alias("item_b"), F.col("class_id").alias("class_b"))
    same = a.join(b, (a["class_a"] == b["class_b"]) & (a["item_a"] < b["item_b"])).select("item_a", "item_b")
    linked = links.join(a, "class_a").join(b, "class_b").filter("item_a <> item_b").select("item_a", "item_b")
    both = same.union(linked)
    return both.select(F.least("item_a", "item_b").alias("key_a"), F.greatest("item_a", "item_b").alias("key_b")).distinct()


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each item_id and class: (item_id, class_id, group_id, n_copies, n_links). group_id is the least class of those reached over
    links; n_copies counts the class's members, n_links the classes linked to it."""
    parts = connected_components(links, "class_a", "class_b")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    about = (
        members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
        .join(degree, "class_id", "left")
        .join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("class_id", F.coalesce("component", "class_id").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    )
    return members.join(about, "class_id").select("item_id", "class_id", "group_id", "n_copies", "n_links")
