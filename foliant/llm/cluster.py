"""Grouping vectors into broad clusters by direction (problem 5).

1. A vector becomes a small set: of `anchors` directions, fitted on a bounded sample, up to `near` that are most similar to it and not below
   `stray`. Vectors with one set are
   one record with a weight from here on; how many different sets there are depends on the shape of the data, hardly on the number of rows.
2. MinHash banding finds candidate pairs of sets, exact Jaccard similarity verifies them.
3. Connected components of the verified links form groups. A component whose highest-degree set is linked to less than half of its weight is
   loose; there every set joins the linked set of highest degree, step by step up to a medoid that no neighbour exceeds.
4. The middles of the groups, the heaviest `max_groups` first, are compared on the driver; those closer than `merge` are one group, as denser knots
   inside a group would otherwise be groups of their own.
5. Every row gets the group whose middle its vector is most similar to, or none below `stray`; the middles are set anew from all their rows,
   a few times. A group is one that has `min_rows` rows with a mean similarity to each other of `coherent`, which rows near each other by chance don't
   have. No share of all rows is asked for.
6. The rows left as strays go through all steps again, and the groups found among them are added, until there is none: so groups beyond the first
   `max_groups` have their turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.hnsw import matrix, usable_vectors, vector_sample
from foliant.operators.components import connected_components
from foliant.session import saved


def real_groups(weights: np.ndarray, alike: np.ndarray, min_rows: int, coherent: float) -> np.ndarray:
    """Which groups have min_rows rows and, of two different ones, a mean similarity of `coherent`; alike is the mean similarity to the middle, of which a
    row's own share is taken off."""
    return (weights >= min_rows) & (weights * alike**2 - 1 >= coherent * (weights - 1))


def merge_middles(middles: np.ndarray, weights: np.ndarray, merge: float) -> np.ndarray:
    """Middles of length 1, the heaviest first, after joining the two most similar ones until none are more similar than `merge`."""
    total, w = middles * weights[:, None], weights.astype(float)
    unit = total / np.linalg.norm(total, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    there = np.ones(len(w), bool)
    while there.sum() > 1:
        i, j = np.unravel_index(np.argmax(s), s.shape)
        if s[i, j] < merge:
            break
        total[i] += total[j]
        w[i] += w[j]
        there[j] = False
        unit[i] = total[i] / np.linalg.norm(total[i])
        s[i] = s[:, i] = np.where(there, unit @ unit[i], -2)
        s[i, i] = -2
        s[j] = s[:, j] = -2
    order = np.flatnonzero(there)[np.argsort(-w[there], kind="stable")]
    return unit[order].astype(np.float32)


def spread_points(x: np.ndarray, k: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """k directions that cover the unit vectors x: each is drawn with a chance that grows with its distance from those drawn before, then moved to
    the mean of what is nearest to it."""
    rng = np.random.default_rng(seed)
    c = np.empty((min(k, len(x)), x.shape[1]), np.float32)
    gap = np.ones(len(x))
    for i in range(len(c)):
        p = gap * gap
        c[i] = x[rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x))]
        gap = np.minimum(gap, np.maximum(1 - x @ c[i], 0))
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def set_groups(sets: DataFrame, anchors: int, threshold: float, bands: int = 16, rows: int = 2, seed: int = 7) -> DataFrame:
    """(sid, medoid) for sets (sid bigint, f array<int> of anchor numbers, w bigint); w is the weight, medoid the sid of the group."""
    order = np.argsort(np.random.default_rng(seed).random((bands * rows, anchors)), axis=1).astype(np.int32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = batch.column("f")
            ends, flat = np.cumsum(f.value_lengths().to_numpy()), f.flatten().to_numpy()
            first = np.concatenate([[0], ends[:-1]])
            x = flat[np.minimum(first[:, None] + np.arange((ends - first).max()), ends[:, None] - 1)]  # the last member fills short sets up
            low = np.stack([order[h][x].min(axis=1) for h in range(bands * rows)], axis=1).astype(np.int64)
            key = np.zeros((len(x), bands), np.int64)
            for r in range(rows):
                key = key * anchors + low[:, r::rows]
            key = key * bands + np.arange(bands)
            row = pa.array(np.repeat(np.arange(len(x)), bands))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("sid").take(row), f.take(row)], ["key", "sid", "f"])

    signed = sets.select("sid", "f").mapInArrow(sign, "key bigint, sid bigint, f array<int>")
    x, y = signed.alias("x"), signed.alias("y")
    both = F.size(F.array_intersect("x.f", "y.f"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid"))).filter(both / (F.size("x.f") + F.size("y.f") - both) >= threshold)
    links = saved(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), "links")
    ways = links.union(links.select("b", "a"))
    weight = sets.select("sid", "w")
    degree = saved(weight.join(ways.join(weight.withColumnsRenamed({"sid": "b", "w": "wb"}), "b").groupBy("a").agg(F.sum("wb").alias("more")), F.col("sid") == F.col("a"), "left").select("sid", "w", (F.col("w") + F.coalesce("more", F.lit(0))).alias("degree")), "degree")
    part = saved(degree.join(connected_components(links), F.col("sid") == F.col("node"), "left").select("sid", "w", "degree", F.coalesce("component", "sid").alias("part")), "parts")
    # tight: the highest degree covers half of the component's weight
    tight = part.groupBy("part").agg(F.sum("w").alias("all"), F.max(F.struct("degree", "sid")).alias("top")).select("part", (F.col("top.degree") * 2 >= F.col("all")).alias("tight"), F.col("top.sid").alias("top"))
    known = degree.select(F.col("sid").alias("b"), F.struct("degree", F.col("sid").alias("to")).alias("rank"))
    best = ways.join(known, "b").groupBy("a").agg(F.max("rank").alias("rank"))
    up = saved(
        part.join(tight, "part")
        .join(best, F.col("sid") == F.col("a"), "left")
        .select("sid", F.when(F.col("tight"), F.col("top")).when(F.col("rank") > F.struct("degree", F.col("sid").alias("to")), F.col("rank.to")).otherwise(F.col("sid")).alias("to")),
        "up",
    )
    # steps up never meet a lower degree, so they end; each round doubles their length
    for _ in range(40):
        higher = up.select(F.col("sid").alias("to"), F.col("to").alias("next"))
        nxt = saved(up.join(higher, "to").select("sid", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "up")
        up = nxt.select("sid", "to")
        if not nxt.filter("moved").limit(1).count():
            break
    return up.select("sid", F.col("to").alias("medoid"))


def medoid_groups(units: DataFrame, n: int, dim: int, anchors: int, near: int, threshold: float, stray: float, sample_rows: int) -> tuple[np.ndarray, DataFrame]:
    """The anchors, and (medoid, anchor, w): the weight of every anchor in each medoid group of n rows."""
    points = spread_points(vector_sample(units, n, sample_rows, dim), anchors)
    width = min(near, len(points))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = matrix(batch.column("unit"), dim) @ points.T
                top = np.argpartition(-s, width - 1, axis=1)[:, :width].astype(np.int32)
                top = np.sort(np.where(np.take_along_axis(s, top, 1) >= stray, top, -1), axis=1)
                one, count = np.unique(top, axis=0, return_counts=True)
                one, count = one[one[:, -1] >= 0], count[one[:, -1] >= 0]
                ends = np.concatenate([[0], np.cumsum((one >= 0).sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(one[one >= 0]))
                yield pa.RecordBatch.from_arrays([lists, pa.array(count.astype(np.int64))], ["f", "w"])

    found = units.mapInArrow(features, "f array<int>, w bigint").groupBy("f").agg(F.sum("w").alias("w"))
    sets = saved(found.select(F.xxhash64("f").alias("sid"), "f", "w"), "sets")
    groups = set_groups(sets, len(points), threshold)
    shares = sets.join(groups, "sid").select("medoid", (F.col("w") / F.size("f")).alias("w"), F.explode("f").alias("anchor"))
    total = shares.groupBy("medoid", "anchor").agg(F.sum("w").alias("w"))
    return points, saved(total, "medoid-groups")


def group_middles(points: np.ndarray, total: DataFrame, least: float, skip: int, most: int, merge: float) -> tuple[np.ndarray, int]:
    """Merged middles of the medoid groups that weigh `least`: `most` of them after the `skip` heaviest; and how many these are before merging."""
    dim = points.shape[1]
    top = total.groupBy("medoid").agg(F.sum("w").alias("all")).filter(F.col("all") >= least)
    top = top.orderBy(F.desc("all"), "medoid").offset(skip).limit(most).select("medoid")
    heavy = total.join(F.broadcast(top), "medoid", "left_semi").toPandas()  # `most` groups of at most as many rows as there are anchors
    middles = np.zeros((0, dim))
    weights = []
    for _, g in heavy.groupby("medoid", sort=True):
        middles = np.vstack([middles, (points[g["anchor"]] * g["w"].to_numpy()[:, None]).sum(axis=0)])
        weights.append(g["w"].sum())
    if not len(middles):
        return middles, 0
    return merge_middles(middles / np.linalg.norm(middles, axis=1, keepdims=True), np.array(weights), merge), len(middles)


def moved_middles(units: DataFrame, middles: np.ndarray, dim: int, stray: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The middles set anew from the rows most similar to each, none below `stray`; their rows, and these rows' mean similarity to them."""

    def sums(batches: Iterator[pa.RecordBatch], middles: np.ndarray = middles) -> Iterator[pa.RecordBatch]:
        at_sum, count = np.zeros((len(middles), dim)), np.zeros(len(middles), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("unit"), dim)
                s = x @ middles.T
                at, best = np.argmax(s, axis=1), s.max(axis=1)
                good = best >= stray
                np.add.at(at_sum, at[good], x[good])
                count += np.bincount(at[good], minlength=len(middles))
        lists = pa.ListArray.from_arrays(np.arange(0, dim * (len(middles) + 1), dim, dtype=np.int32), pa.array(at_sum.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(middles), dtype=np.int32)), lists, pa.array(count)], ["g", "total", "n"])

    part = units.mapInArrow(sums, "g int, total array<double>, n bigint")
    rows = part.groupBy("g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(dim)]).alias("total")).filter("n > 0").collect()  # one row a group
    weights = np.array([r["n"] for r in rows])
    total = np.array([r["total"] for r in rows]).reshape(-1, dim)
    norm = np.linalg.norm(total, axis=1)
    return total / norm[:, None], weights, norm / weights


def direction_groups(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, anchors: int = 256, near: int = 4, threshold: float = 0.5, max_groups: int = 1024,
    merge: float = 0.6, stray: float = 0.4, rounds: int = 3, sample_rows: int = 20_000, min_rows: int = 24, coherent: float = 0.3,
) -> DataFrame:
    """(item_id, group_no, similarity): the broad group of every usable vector, null for a stray one, and the similarity to the group's middle.

    Usable is a vector of `dim` finite numbers, not all zero, with an id; repeated rows of an item come out once. A group has `min_rows` rows, whatever
    their share, so fewer usable rows than that are strays. Groups are numbered from 0, the
    largest first. An empty table gives no rows.
    Other columns are ignored. Anchors are fitted on about `sample_rows` vectors, all else covers all rows. `max_groups` bounds what a pass has on the
    driver, not the groups that are found.
    """
    spark = df.sparkSession
    units = saved(usable_vectors(df, id_col, vector_col, dim), "units")
    kind = units.schema["item_id"].dataType.simpleString()
    n = units.count()
    if not n:
        return spark.createDataFrame([], f"item_id {kind}, group_no int, similarity double")
    middles, sizes, rest, left = np.zeros((0, dim), np.float32), np.zeros(0), units, n
    while left >= min_rows:
        points, total = medoid_groups(rest, left, dim, anchors, near, threshold, stray, sample_rows)
        skip, count, real = 0, max_groups, np.zeros(0, bool)
        while count == max_groups and not real.any():  # where none of the heaviest is a group, the next ones are looked at
            more, count = group_middles(points, total, min_rows, skip, max_groups, merge)
            skip += count
            for k in range(rounds if len(more) else 0):
                more, weights, alike = moved_middles(rest, more, dim, stray)
                real = real_groups(weights, alike, min_rows, coherent)
                if k < rounds - 1:
                    more = merge_middles(more[real], weights[real], merge) if real.any() else more[:0]
                if not len(more):
                    break
        if not real.any():
            break
        middles, sizes = np.vstack([middles, more[real]]), np.concatenate([sizes, weights[real]])

        def strays(batches: Iterator[pa.RecordBatch], middles: np.ndarray = middles) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    s = matrix(batch.column("unit"), dim) @ middles.T
                    yield batch.filter(pa.array(s.max(axis=1, initial=-2) < stray))

        rest = saved(rest.mapInArrow(strays, rest.schema), "strays")
        before, left = left, rest.count()
        if left == before:
            break
    middles = middles[np.argsort(-sizes, kind="stable")]
    if not len(middles):
        return units.select("item_id", F.lit(None).cast("int").alias("group_no"), F.lit(None).cast("double").alias("similarity")).distinct()

    def assign(batches: Iterator[pa.RecordBatch], middles: np.ndarray = middles) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = matrix(batch.column("unit"), dim) @ middles.T
                at, best = np.argmax(s, axis=1).astype(np.int32), s.max(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(at, mask=best < stray), pa.array(best.astype(np.float64))], ["item_id", "group_no", "similarity"])

    placed = units.mapInArrow(assign, f"item_id {kind}, group_no int, similarity double")
    return placed.groupBy("item_id").agg(F.max_by("group_no", F.struct("similarity", "group_no")).alias("group_no"), F.max("similarity").alias("similarity"))


def group_report(groups: DataFrame, items: DataFrame, id_col: str, document_col: str, typical: int = 3) -> DataFrame:
    """(group_no, n_rows, n_documents, typical): size of every group, its documents, and the ids of the members nearest to its middle.

    groups: of direction_groups; items: the table it was made from. Strays are one row with a null group_no and no typical members.
    """
    owner = items.select(F.col(id_col).alias("item_id"), F.col(document_col).alias("document")).distinct()
    both = groups.join(owner, "item_id")
    size = both.groupBy("group_no", "document").agg(F.countDistinct("item_id").alias("n")).groupBy("group_no").agg(F.sum("n").alias("n_rows"), F.count("document").alias("n_documents"))
    salt = F.pmod(F.xxhash64("item_id"), F.lit(64))
    # the best of each salted part first, so that a large group is never sorted in one task
    part = W.partitionBy("group_no", "salt").orderBy(F.desc("similarity"), "item_id")
    best = groups.filter("group_no is not null").withColumn("salt", salt).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= typical)
    top = best.groupBy("group_no").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "item_id"))), 1, typical).alias("t"))
    return size.join(top.withColumnRenamed("group_no", "g"), F.col("group_no") == F.col("g"), "left").select("group_no", "n_rows", "n_documents", F.transform("t", lambda x: x["item_id"]).alias("typical"))
