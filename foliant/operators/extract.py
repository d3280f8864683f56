"""Mentions in texts: patterns, their places, and which of them stand together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what is found in texts, as patterns that Java, RE2 and Python read alike
PATTERNS = {
    "context": r"@[a-z]+",
    "ticket": r"\b[A-Z]{2}-[0-9]{3,6}\b",
    "money": r"€[0-9]+|\b[0-9]+(?:\.[0-9]{2})? (?:EUR|credits)\b",
    "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "dotted_date": r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b",
    "time": r"\b[0-9]{1,2}:[0-9]{2}\b",
    "checkbox": r"- \[[ x]\]",
}


def mentions(docs: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """(doc, kind, mention) for every match of every pattern, within the JVM; null texts have none."""

    def found(kind: str) -> Column:
        every = F.regexp_extract_all(F.col(text_col), F.lit(f"({PATTERNS[kind]})"), F.lit(1))
        return F.transform(every, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("mention")))

    parts = [found(k) for k in kinds or PATTERNS]
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(F.flatten(F.array(*parts))).alias("x")).select("doc", "x.kind", "x.mention")


def mention_spans(docs: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """(doc, kind, mention, start, stop) with places in characters from 0."""
    compiled = {k: re.compile(PATTERNS[k]) for k in kinds or PATTERNS}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, m[0], m.start(), m.end()) for d, t in zip(b["doc"], b["text"]) for k, p in compiled.items() for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc", "kind", "mention", "start", "stop"])

    given = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return given.mapInPandas(find, f"doc {given.schema['doc'].dataType.simpleString()}, kind string, mention string, start int, stop int")


def together(spans: DataFrame, first: str, second: str, within: int = 200, base: float = 0.8) -> DataFrame:
    """(a, b, n_docs, n_pairs, confidence) for mentions of two kinds that stand within `within` characters of a document.

    confidence is the mean of base * (1 - 0.3 * gap / within). Mentions are joined by document and block of `within` characters, each of the second kind
    with its own block and the two beside it, so a long document's mentions don't all meet.
    """
    block = F.floor(F.col("start") / within)
    a = spans.filter(F.col("kind") == first).select("doc", F.col("mention").alias("a"), F.col("start").alias("sa"), F.col("stop").alias("ea"), block.alias("block"))
    b = spans.filter(F.col("kind") == second).select("doc", F.col("mention").alias("b"), F.col("start").alias("sb"), F.col("stop").alias("eb"), F.explode(F.sequence(F.floor(F.col("start") / within) - 2, F.floor(F.col("start") / within) + 2)).alias("block"))
    gap = F.greatest(F.lit(0), F.col("sb") - F.col("ea"), F.col("sa") - F.col("eb"))
    near = a.join(b, ["doc", "block"]).withColumn("gap", gap).filter(F.col("gap") <= within)
    return near.groupBy("a", "b").agg(F.countDistinct("doc").alias("n_docs"), F.count("*").alias("n_pairs"), F.round(F.sum((base * (1 - 0.3 * F.col("gap") / within)).cast("decimal(18,9)")).cast("double") / F.count("*"), 6).alias("confidence"))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc, n, start, chunk): windows of `size` characters, each starting size - overlap after the one before, within the JVM. The last one ends with the
    text; empty and null texts have none."""
    step = size - overlap
    rows = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.length(text_col).alias("len"))
    last = F.greatest(F.ceil((F.col("len") - overlap) / step) - 1, F.lit(0)).cast("int")
    return rows.select("doc", "text", F.explode(F.sequence(F.lit(0), last)).alias("n")).select("doc", "n", (F.col("n") * step).alias("start"), F.substring("text", F.col("n") * step + 1, F.lit(size)).alias("chunk"))
