"""Files as sources and sinks: directory scans with glob filters, JSON lines export and import."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # microseconds are kept


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ** crosses folders, * and ? don't."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"^{out}$"


def glob_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a relative path is wanted: a match of exclude wins, an empty include matches all."""
    keep = F.lit(not include)
    for g in include or []:
        keep = keep | path.rlike(glob_pattern(g))
    for g in exclude or []:
        keep = keep & ~path.rlike(glob_pattern(g))
    return keep


def scan_folder(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, size, modified) of the files under a folder, path being relative to it. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = folder.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(glob_filter(F.col("path"), include, exclude))


def export_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write rows as JSON lines; null fields are left out."""
    df.write.mode("errorifexists").option("compression", compression).options(**_TIMES).json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read JSON lines with a given schema. A line that is not JSON, or doesn't fit the schema, is kept as `corrupt_line`, null for all others; see
    sound_lines() and rejected_lines()."""
    return spark.read.schema(f"{schema}, corrupt_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_line").options(**_TIMES).json(path)


def sound_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("corrupt_line is null").drop("corrupt_line")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(corrupt_line): what import_jsonl could not read."""
    return lines.filter("corrupt_line is not null").select("corrupt_line")
