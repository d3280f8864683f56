"""The same work on streams of files: windows, sessions and duplicates with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import shared_dir


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the parquet files of a folder or matching a glob."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """(window_start, *keys, n, total): counts and sums of `value` in fixed windows."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, session_start, session_end, n): activity of a key without a pause longer than `gap`."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(s.alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """Rows whose keys did not occur within the watermark before."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, exactly once, into a parquet table of the shared folder, and read that table.

    In append mode Spark writes a window when the watermark has passed it, so a stream must hold later events for its last windows to come out; complete
    mode rewrites the table with every micro-batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/table").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/table")).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/table")
