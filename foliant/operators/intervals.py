"""Intervals: overlaps, merged busy time, free time, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(events: DataFrame, key: str, id_col: str, start: str, end: str, bucket: str = "day") -> DataFrame:
    """(key, id_a, id_b, minutes) for every two events of a key that overlap by more than an instant, id_a < id_b.

    Every event is put into each day (or other bucket) it touches and pairs are formed within key and bucket only; a pair is reported from the bucket
    in which the later one starts, so it comes out once. Events that end before they start, or lack a time, overlap nothing.
    """
    rows = events.select(key, F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).filter("e > s")
    first = F.date_trunc(bucket, F.col("s"))
    placed = rows.withColumn("b", F.explode(F.sequence(first, F.date_trunc(bucket, F.col("e")), F.expr(f"interval 1 {bucket}"))))
    x, y = placed.alias("x"), placed.alias("y")
    same = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.b") == F.col("y.b"))
    meet = (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e"))
    later = F.greatest("x.s", "y.s")
    pairs = x.join(y, same & meet & (F.col("x.id") < F.col("y.id")) & (F.date_trunc(bucket, later) == F.col("x.b")))
    seconds = F.least("x.e", "y.e").cast("timestamp").cast("double") - later.cast("timestamp").cast("double")
    return pairs.select(F.col(f"x.{key}").alias(key), F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.round(seconds / 60, 3).alias("minutes"))


def islands(events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the events of a key merged where they overlap or touch.

    The events that start on one day are merged first, then what is left of all days, so that a key with very many events is shared out by day.
    """
    rows = events.select(key, F.col(start).alias("s"), F.col(end).alias("e")).filter("e > s").withColumn("day", F.to_date("s"))
    return _merged(_merged(rows, [key, "day"]), [key]).withColumnsRenamed({"s": "start", "e": "end"})


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("n", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("n")


def free_time(events: DataFrame, key: str, start: str, end: str, first_hour: int = 9, last_hour: int = 17, least_minutes: int = 30) -> DataFrame:
    """(key, day, free_from, free_until): gaps of at least `least_minutes` in the working hours of the weekdays from a key's first to its last event."""
    busy = islands(events, key, start, end)
    span = busy.groupBy(key).agg(F.min(F.to_date("start")).alias("a"), F.max(F.to_date("end")).alias("z"))
    days = span.select(key, F.explode(F.sequence("a", "z")).alias("day")).filter(F.weekday("day") < 5)
    open_, close = (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h)) for h in (first_hour, last_hour))
    by_day = busy.select(key, "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day"))
    clipped = by_day.withColumn("s", F.greatest("start", open_)).withColumn("e", F.least("end", close)).filter("e > s").select(key, "day", "s", "e")
    marks = clipped.unionByName(days.select(key, "day", open_.alias("s"), open_.alias("e"))).unionByName(days.select(key, "day", close.alias("s"), close.alias("e")))
    w = W.partitionBy(key, "day").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    gaps = marks.withColumn("free_from", reach).withColumn("free_until", F.col("s"))
    minutes = (F.col("free_until").cast("timestamp").cast("double") - F.col("free_from").cast("timestamp").cast("double")) / 60
    return gaps.filter(minutes >= least_minutes).join(days, [key, "day"], "left_semi").select(key, "day", "free_from", "free_until")


def recurrences(rules: DataFrame, id_col: str, start: str, unit: str, every: str, count: str) -> DataFrame:
    """(id, nth, at): the occurrences of rules whose `unit` column is day, week or month, `every` so many units, `count` times. Months keep the day or
    end at the month's last one. Rules with another unit, or with a count or interval below 1, give nothing."""
    good = rules.filter(F.col(unit).isin("day", "week", "month") & (F.col(every) >= 1) & (F.col(count) >= 1))
    n = good.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    step = (F.col("nth") * F.col(every)).cast("int")
    zero = F.lit(0)
    at = F.col(start) + F.when(F.col(unit) == "day", F.make_dt_interval(days=step)).when(F.col(unit) == "week", F.make_dt_interval(days=7 * step)).otherwise(F.make_dt_interval(days=zero))
    moved = F.when(F.col(unit) == "month", F.col(start) + F.make_ym_interval(months=step)).otherwise(at)
    return n.select(id_col, F.col("nth").cast("int").alias("nth"), moved.alias("at"))


def occurrences(rules: DataFrame, id_col: str, start: str, unit: str, every: str, until: str, exceptions: str, first: str, last: str, most: int = 100) -> DataFrame:
    """(id, nth, at): the occurrences of rules from time `first` to `last` (columns), none after `until` (null: no end) and none at a time in the
    array `exceptions` (null: none). At most `most` are counted from the start, as recurrences() does."""
    known = rules.withColumn("_most", F.lit(most))
    all_ = recurrences(known, id_col, start, unit, every, "_most")
    bounds = rules.select(F.col(id_col).alias("_id"), F.col(until).alias("_until"), F.col(exceptions).alias("_not"), F.col(first).alias("_a"), F.col(last).alias("_z"))
    near = all_.join(bounds, F.col(id_col) == F.col("_id"))
    kept = F.col("at").between(F.col("_a"), F.col("_z")) & (F.col("_until").isNull() | (F.col("at") <= F.col("_until"))) & ~F.coalesce(F.array_contains("_not", F.col("at")), F.lit(False))
    return near.filter(kept).select(id_col, "nth", "at")
