"""Directed graphs as edge tables (src, dst, ...): traversal, paths, cycles, merging, unlinking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.components import connected_components
from foliant.session import saved


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 2) -> DataFrame:
    """(seed, node, depth): every node within max_depth edges of a seed (one column `seed`), with the least depth; the seed itself has depth 0.

    One join a level: only nodes that were new in the level before are extended, and what is already reached is taken out. Without a max_depth the
    walk ends with the first level that reaches nothing new.
    """
    out = edges.select("src", "dst").distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    front = reached
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        step = front.join(out, front["node"] == out["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = saved(step.join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)), "front")
        if max_depth is None and front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def simple_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, weight: str = "confidence") -> DataFrame:
    """(seed, path, depth, strength): all paths without a repeated node of 1 to max_depth edges from each seed; strength is the geometric mean of the
    edges' weights. Parallel edges count as one with the greatest weight. The result grows with the paths there are, so keep max_depth small."""
    out = edges.groupBy("src", "dst").agg(F.max(weight).alias("w"))
    front = seeds.select("seed", F.array("seed").alias("path"), F.lit(0.0).alias("logs")).distinct()
    found = None
    for d in range(1, max_depth + 1):
        step = front.join(out, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = saved(step.select("seed", F.array_append("path", F.col("dst")).alias("path"), (F.col("logs") + F.log("w")).alias("logs")), "paths")
        part = front.select("seed", "path", F.lit(d).alias("depth"), F.exp(F.col("logs") / d).alias("strength"))
        found = part if found is None else found.unionByName(part)
    return found


def in_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst): the edges left when nodes without an incoming or without an outgoing edge are removed again and again: those on cycles, or on ways
    between them. Empty if and only if the graph has no cycle (self-loops count as cycles)."""
    left = saved(edges.select("src", "dst").distinct(), "cycles")
    n = left.count()
    while True:
        less = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = saved(less.select("src", "dst"), "cycles")
        m = left.count()
        if m == n:
            return left
        n = m


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) over distinct edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def merged_ids(same: DataFrame, a: str, b: str) -> DataFrame:
    """(old_id, new_id) for ids that pairs (a, b) say are one; new_id is the least of those connected."""
    return connected_components(same, a, b).select(F.col("node").alias("old_id"), F.col("component").alias("new_id"))


def redirected(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, n_edges, confidence): edges with merged ends, without the self-loops that this makes; parallel edges are one with the best confidence."""
    a, b = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("ns")), ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("nd"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ns", "src").alias("src"), F.coalesce("nd", "dst").alias("dst"), "confidence")
    return moved.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_edges"), F.max("confidence").alias("confidence"))


def unlink_documents(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(src, dst, n_refs, n_left, fate): what removing the documents of `gone` (document_id) does to each edge: kept, updated (some references go) or
    orphaned (all go)."""
    refs = edges.select("src", "dst", "document_id").distinct().join(gone.select("document_id", F.lit(1).alias("gone")).distinct(), "document_id", "left")
    counted = refs.groupBy("src", "dst").agg(F.count("*").alias("n_refs"), (F.count("*") - F.coalesce(F.sum("gone"), F.lit(0))).alias("n_left"))
    return counted.withColumn("fate", F.when(F.col("n_left") == 0, "orphaned").when(F.col("n_left") < F.col("n_refs"), "updated").otherwise("kept"))
