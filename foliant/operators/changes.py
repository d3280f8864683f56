"""Snapshots, change detection, versions and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(versions: DataFrame, key: str, at: Column, order: list[str], until: Column | None = None) -> DataFrame:
    """The newest row of each key (by the columns in order), optionally only of rows with `at` not after `until`."""
    rows = versions if until is None else versions.filter(at <= until)
    cols = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select("x.*")


def classify_changes(before: DataFrame, now: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, change): new, modified, unchanged or deleted, from two snapshots with one row a key. Null hashes are equal to each other only."""
    a = before.select(F.col(key), F.col(hash_col).alias("was"), F.lit(True).alias("in_before"))
    b = now.select(F.col(key), F.col(hash_col).alias("is"), F.lit(True).alias("in_now"))
    change = F.when(F.col("in_before").isNull(), "new").when(F.col("in_now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def numbered_versions(versions: DataFrame, key: str, hash_col: str, order: list[str]) -> DataFrame:
    """Adds `new_number`, counting from 1, to the versions whose hash differs from the one before; the others, which change nothing, are left out."""
    w = W.partitionBy(key).orderBy(*order)
    kept = versions.withColumn("hash_before", F.lag(hash_col).over(w)).filter(~F.col(hash_col).eqNullSafe(F.col("hash_before")) | F.col("hash_before").isNull())
    return kept.drop("hash_before").withColumn("new_number", F.row_number().over(w))


def retention(versions: DataFrame, key: str, at: str, order: list[str], newest: int = 5, days: int = 30, now: Column | None = None) -> DataFrame:
    """Adds `decision` to every version: keep_newest, keep_recent, keep_first, keep_daily, keep_weekly, keep_tagged or delete, the first that applies.

    The newest `newest` of a key, those not older than `days` before `now` (the newest time of all where it is not given), the first of all, the first
    of a day within a year, the first of a week, and any with tags are kept.
    """
    back = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ahead = [F.col(c) for c in order]
    first_of = lambda part: F.row_number().over(W.partitionBy(key, part).orderBy(*ahead)) == 1
    if now is None:
        last = versions.agg(F.max(at).alias("last_at"))
        versions, now = versions.crossJoin(F.broadcast(last)), F.col("last_at")  # a single row
    age = F.date_diff(now, F.col(at))
    return (
        versions.withColumn("nth", F.row_number().over(back))
        .withColumn("oldest", F.row_number().over(W.partitionBy(key).orderBy(*ahead)) == 1)
        .withColumn("daily", first_of(F.to_date(at)))
        .withColumn("weekly", first_of(F.date_trunc("week", F.col(at))))
        .withColumn("decision", F.when(F.col("nth") <= newest, "keep_newest").when(age <= days, "keep_recent").when(F.col("oldest"), "keep_first").when(F.col("daily") & (age <= 365), "keep_daily").when(F.col("weekly"), "keep_weekly").when(F.size("tags") > 0, "keep_tagged").otherwise("delete"))
        .drop("nth", "oldest", "daily", "weekly", *(["last_at"] if "last_at" in versions.columns else []))
    )


def changed_by(before: DataFrame, now: DataFrame, key: str, at: str, size: str, hash_col: str, strategy: str = "both") -> DataFrame:
    """(key, change) as classify_changes, with what tells a change as a parameter: hash, time (a later one), or both (a later time or another size, and
    another hash). A null hash can't tell, so that time decides."""
    later = F.coalesce(F.col("now.t") > F.col("was.t"), F.col("was.t").isNull() & F.col("now.t").isNotNull())
    other = F.when(F.col("now.h").isNull() | F.col("was.h").isNull(), later).otherwise(F.col("now.h") != F.col("was.h"))
    changed = {"hash": other, "time": later, "both": (later | ~F.col("now.z").eqNullSafe(F.col("was.z"))) & other}[strategy]
    part = lambda df, name: df.select(key, F.struct(F.col(at).alias("t"), F.col(size).alias("z"), F.col(hash_col).alias("h")).alias(name))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    return part(before, "was").join(part(now, "now"), key, "full_outer").select(key, kind.alias("change"))


def first_of_periods(versions: DataFrame, key: str, at: str, id_col: str, number: str, every: int = 10) -> DataFrame:
    """(id, reason) of the versions that patterns keep: the first of each day, week and month of a key, its version 1 and every `every`-th one. A version
    may have several reasons. The least rows are found by grouping, so a key with very many versions is shared out; of equal times the least id counts.
    Rows without a time are the first of nothing."""
    out = versions.filter((F.col(number) == 1) | (F.col(number) % every == 0)).select(id_col, F.lit("number").alias("reason"))
    timed = versions.filter(F.col(at).isNotNull())
    for unit in ("day", "week", "month"):
        first = timed.groupBy(key, F.date_trunc(unit, F.col(at))).agg(F.min(F.struct(at, id_col)).alias("x"))
        out = out.union(first.select(f"x.{id_col}", F.lit(unit)))
    return out.distinct()


def storage_kind(number: Column, before: Column, every: int = 10) -> Column:
    """How to store a version, by its number and how the one before is stored: the first, every `every`-th, and after a delta every (every / 2 + 1)-th
    one in full, else as a delta; all in full where every is 0."""
    if not every:
        return F.lit("full")
    return F.when((number == 1) | (number % every == 0) | ((before == "delta") & (number % (every // 2 + 1) == 0)), "full").otherwise("delta")


def restored(versions: DataFrame, key: str, number: str, hash_col: str, wanted: DataFrame) -> DataFrame:
    """(key, new_number, hash, restored_from): the new version of each key that takes up an older one's content again. wanted: (key, number), one row a
    key; a version that the key doesn't have gives nothing. Null hashes are kept."""
    last = versions.groupBy(key).agg(F.max(number).alias("_last"))
    old = versions.join(wanted.select(key, number).distinct(), [key, number]).groupBy(key, number).agg(F.max(hash_col).alias("hash"))
    return old.join(last, key).select(key, (F.col("_last") + 1).alias("new_number"), "hash", F.col(number).alias("restored_from"))
