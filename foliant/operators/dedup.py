"""Exact and near duplicates of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators.components import connected_components
from foliant.session import saved


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, kept_id, is_duplicate): SHA-256 of each text that is not null; the least id of equal texts is kept."""
    hashed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("hash"))
    kept = hashed.groupBy("hash").agg(F.min("id").alias("kept_id"))
    return hashed.join(kept, "hash").select("id", "hash", "kept_id", (F.col("id") != F.col("kept_id")).alias("is_duplicate"))


def shingles(text: Column, words: int) -> Column:
    """Distinct 64-bit hashes of the runs of `words` tokens; of all tokens where there are fewer, none for a text without tokens."""

    def runs(t: Column) -> Column:
        at = F.when(F.size(t) > words, F.sequence(F.lit(1), F.size(t) - words + 1)).when(F.size(t) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(t, i - 1 + k) for k in range(words)]))))

    return F.get(F.transform(F.array(tokens(text)), runs), F.lit(0))


def minhash_classes(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, bands: int = 42, rows: int = 3) -> DataFrame:
    """(id, class_id, group_id, n_links): near-duplicate documents, one row for each id.

    Equal sets of shingles are one class (class_id, its least id); classes whose MinHash signatures agree in a band are compared exactly, and links of
    a similarity of at least `threshold` join classes into groups (group_id, the least class). n_links counts a class's links. With 42 bands of 3 a pair
    at 0.8 is missed with a probability of 1e-13. Documents without a token are their own class and group. A null text counts as one without tokens;
    repeated rows of an id count once, by the least text.
    """
    one = docs.groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    sets = saved(one.select("id", F.array_sort(shingles(F.coalesce("text", F.lit("")), words)).alias("s")), "shingles")
    some = sets.filter(F.size("s") > 0).withColumn("h", F.xxhash64("s"))
    classes = some.groupBy("h", "s").agg(F.min("id").alias("class_id"))
    members = some.select("id", "h", "s").join(classes.withColumnsRenamed({"h": "h2", "s": "s2"}), (F.col("h") == F.col("h2")) & (F.col("s") == F.col("s2"))).select("id", "class_id")

    rng = np.random.default_rng(7)
    mult, add = (rng.integers(1, 1 << 62, bands * rows) * 2 + 1).astype(np.uint64), rng.integers(0, 1 << 62, bands * rows).astype(np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("s")
            n = lists.value_lengths().to_numpy()
            x = lists.flatten().to_numpy().view(np.uint64)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            key = np.zeros((len(n), bands), np.uint64)
            for k in range(bands * rows):
                h = x * mult[k] + add[k]
                low = np.minimum.reduceat(h ^ (h >> np.uint64(31)), start)
                key[:, k // rows] = (key[:, k // rows] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            yield pa.RecordBatch.from_arrays([batch.column("class_id").take(pa.array(np.repeat(np.arange(len(n)), bands))), pa.array(key.ravel().view(np.int64))], ["class_id", "band"])

    banded = classes.select("class_id", "s").mapInArrow(sign, f"class_id {classes.schema['class_id'].dataType.simpleString()}, band bigint")
    # a link between two members of a hot band is not lost, but copies are one class already, so a band holds different texts only
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.class_id") < F.col("y.class_id"))).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    own = classes.select("class_id", "s")
    both = F.size(F.array_intersect("sa", "sb"))
    links = saved(
        met.join(own.withColumnsRenamed({"class_id": "a", "s": "sa"}), "a").join(own.withColumnsRenamed({"class_id": "b", "s": "sb"}), "b")
        .filter(both / (F.size("sa") + F.size("sb") - both) >= threshold).select("a", "b"),
        "links",
    )
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    parts = connected_components(links).withColumnRenamed("node", "class_id")
    placed = members.unionByName(sets.filter(F.size("s") == 0).select("id", F.col("id").alias("class_id")))
    zero = F.lit(0).cast("bigint")
    return placed.join(n, "class_id", "left").join(parts, "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", zero).alias("n_links"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each combination of keys: the first in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
