"""Names that are alike by Jaro-Winkler, without comparing every two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """1 for equal names, 0 for names without a letter in common; the first four letters count more where the rest is alike by more than 0.7."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken) if t))) // 2
    s = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return s + 0.1 * head * (1 - s) if s > 0.7 else s


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _numbered_letters(name: Column) -> Column:
    """A name's letters, sorted, each with its number among equal ones: no two are equal, so sets can be compared."""
    letters = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def similar_names(names: DataFrame, id_col: str, name_col: str, kind_col: str, threshold: float = 0.9) -> DataFrame:
    """(kind, id_a, id_b, similarity) of every two rows of a kind with a Jaro-Winkler similarity of their lower-cased names of at least `threshold`,
    which must be above 0.8; id_a < id_b.

    A similarity of t takes a plain Jaro one of (t - 0.4) / 0.6, and that takes so many letters in common that the names share one of the rarer letters of
    both. Pairs meet on those; letters and lengths bound the similarity of pairs before names are compared, so none is lost. Equal names are one row until the end. A null or
    empty name is like none; a null kind is no kind.
    """
    if not 0.8 < threshold <= 1:
        raise ValueError("the threshold must be above 0.8 and at most 1")
    k = 3 * (threshold - 0.4) / 0.6 - 1  # letters in common, of a and b: at least k * a * b / (a + b)
    rows = names.select(F.col(id_col).alias("id"), F.lower(name_col).alias("name"), F.col(kind_col).alias("kind")).filter("name <> '' and kind is not null and id is not null").distinct()
    one = rows.select("name", "kind").distinct().withColumn("letters", _numbered_letters(F.col("name")))
    each = one.select("kind", "name", F.explode("letters").alias("letter"))
    often = each.groupBy("letter").agg(F.count("*").alias("often"))
    ranked = each.join(often, "letter").groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("often", "letter"))).alias("r"))
    n = F.size("r")
    keyed = ranked.select("kind", "name", n.alias("n"), F.transform("r", lambda x: x["letter"]).alias("letters"), F.explode(F.slice("r", F.lit(1), n - F.ceil((k - 1) * n - 1e-9).cast("int") + 1)).alias("x"))
    keyed = keyed.select("kind", "name", "n", "letters", F.col("x.letter").alias("letter"))
    x, y = keyed.alias("x"), keyed.alias("y")
    sized = (F.col("x.n") >= (k - 1) * F.col("y.n") - 1e-9) & (F.col("y.n") >= (k - 1) * F.col("x.n") - 1e-9)
    shared = F.size(F.array_intersect("x.letters", "y.letters")) >= k * F.col("x.n") * F.col("y.n") / (F.col("x.n") + F.col("y.n")) - 1e-9
    met = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.letter") == F.col("y.letter")) & (F.col("x.name") < F.col("y.name")) & sized & shared)
    met = met.select(F.col("x.kind").alias("kind"), F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    alike = met.withColumn("similarity", similarity("a", "b")).filter(F.col("similarity") >= threshold - 1e-12)
    alike = alike.unionByName(one.select("kind", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity")))
    own = rows.withColumnRenamed("id", "i")
    both = alike.join(own.withColumnsRenamed({"name": "a", "i": "ia"}), ["kind", "a"]).join(own.withColumnsRenamed({"name": "b", "i": "ib"}), ["kind", "b"])
    both = both.filter((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))).filter("ia <> ib")
    return both.groupBy("kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).agg(F.max("similarity").alias("similarity"))
