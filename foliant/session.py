"""Session factory and the shared folder for tables that cut a long lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foliant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a new temporary one; a cluster's executors have no
    folder in common then, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="foliant-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_written: list[tuple[SparkSession, str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages neither recompute it nor depend on one executor. The table stays until
    remove_saved() or the end of the program, as what is derived from it reads it lazily."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_saved)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_saved() -> None:
    """Remove all tables that saved() wrote. Call it when results are written; what was derived from the tables can't be read any more."""
    while _written:
        spark, path = _written.pop()
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            continue
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return
