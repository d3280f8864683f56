"""Keywords of groups of texts, and measures of a given clustering of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.functions.vectors import cosine, distance
from foliant.operators.search import best


def tfidf_keywords(docs: DataFrame, group: str, text: str, most: int = 5, least_length: int = 3) -> DataFrame:
    """(group, term, tf, df, score, place): a group's best terms by tf * (ln(N/df) + 1), N being the number of groups and df that of groups with the term."""
    terms = docs.filter(F.col(group).isNotNull()).select(group, F.explode(tokens(F.col(text), least_length)).alias("term"))
    tf = terms.groupBy(group, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.select(group).distinct().agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1)).drop("n")  # a single row
    return best(scored, group, F.round("score", 6), "term", most)


def centroids(points: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """(label, n, centroid): mean vector of every label, over the points of `dim` numbers. The sums are formed column by column, so every task sends one
    row a label."""
    good = points.filter((F.size(vector) == dim) & F.col(label).isNotNull())
    sums = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dim)]
    return good.groupBy(label).agg(F.count("*").alias("n"), *sums).select(label, "n", F.array(*[f"c{i}" for i in range(dim)]).alias("centroid"))


def with_centroid(points: DataFrame, label: str, id_col: str, vector: str, dim: int) -> DataFrame:
    """(id, label, n, centroid, similarity, distance) of every point to its label's centroid."""
    good = points.filter(F.size(vector) == dim).select(F.col(id_col).alias("id"), label, F.col(vector).alias("v"))
    return good.join(centroids(points, label, vector, dim), label).select("id", label, "n", "centroid", cosine(F.col("v"), F.col("centroid")).alias("similarity"), distance(F.col("v"), F.col("centroid")).alias("distance"))


def cluster_report(points: DataFrame, label: str, id_col: str, vector: str, dim: int) -> DataFrame:
    """(label, n, coherence, spread): size, mean cosine and mean distance to the centroid."""
    return with_centroid(points, label, id_col, vector, dim).groupBy(label).agg(F.count("*").alias("n"), F.avg("similarity").alias("coherence"), F.avg("distance").alias("spread"))


def representatives(points: DataFrame, label: str, id_col: str, vector: str, dim: int, most: int = 3) -> DataFrame:
    """(label, id, score, place): the points nearest to the centroid; score is the negative distance."""
    near = with_centroid(points, label, id_col, vector, dim).select(label, "id", (-F.col("distance")).alias("score"))
    return best(near, label, F.round("score", 6), "id", most)


def quality(points: DataFrame, label: str, id_col: str, vector: str, dim: int) -> DataFrame:
    """One row (n, n_clusters, calinski_harabasz, davies_bouldin), both from centroids and sums, so that no two points meet.

    Davies-Bouldin compares every two clusters' centroids; their number must be small against that of the points.
    """
    placed = with_centroid(points, label, id_col, vector, dim)
    per = placed.groupBy(label).agg(F.count("*").alias("n"), F.avg("distance").alias("spread"), F.sum(F.col("distance") * F.col("distance")).alias("within"))
    all_ = points.filter((F.size(vector) == dim) & F.col(label).isNotNull()).withColumn("_one", F.lit(0))
    middle = centroids(all_, "_one", vector, dim).select(F.col("centroid").alias("middle"))
    c = per.drop("n").join(centroids(points, label, vector, dim), label)
    between = c.crossJoin(F.broadcast(middle)).select((F.col("n") * F.pow(distance(F.col("centroid"), F.col("middle")), 2)).alias("b"), "n", "within")  # a single row
    sums = between.agg(F.sum("n").alias("n"), F.count("*").alias("n_clusters"), F.sum("b").alias("b"), F.sum("within").alias("w"))
    a, z = c.select(F.col(label).alias("i"), F.col("spread").alias("si"), F.col("centroid").alias("ci")), c.select(F.col(label).alias("j"), F.col("spread").alias("sj"), F.col("centroid").alias("cj"))
    ratio = a.join(z, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / distance(F.col("ci"), F.col("cj"))).alias("worst"))
    ch = (F.col("b") / (F.col("n_clusters") - 1)) / (F.col("w") / (F.col("n") - F.col("n_clusters")))
    return sums.crossJoin(F.broadcast(ratio.agg(F.avg("worst").alias("davies_bouldin")))).select("n", "n_clusters", ch.alias("calinski_harabasz"), "davies_bouldin")


def silhouettes(points: DataFrame, own: DataFrame, label: str, id_col: str, vector: str, dim: int) -> DataFrame:
    """(label, n, silhouette): the mean of (b - a) / max(a, b) with a a point's distance to its own centroid (own: id, label, distance) and b that to the
    nearest other one. Every point meets every centroid, whose number must be small against that of the points; they are one row, joined as an array."""
    all_ = centroids(points, label, vector, dim).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("centroids"))
    good = points.filter(F.size(vector) == dim).select(F.col(id_col).alias("id"), F.col(label).alias("own_label"), F.col(vector).alias("v"))
    other = good.crossJoin(F.broadcast(all_)).select("id", F.array_min(F.transform(F.filter("centroids", lambda c: c["l"] != F.col("own_label")), lambda c: distance(F.col("v"), c["c"]))).alias("b"))  # a single row
    both = own.join(other, "id").withColumn("s", (F.col("b") - F.col("distance")) / F.greatest("b", "distance"))
    return both.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("silhouette"))
