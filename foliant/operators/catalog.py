"""Look-ups over catalogues: pages, names, edges of nodes, removal with what hangs on it, periods of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 100) -> DataFrame:
    """The rows from `offset` on, `limit` at most, in the given order, which should be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def named(entities: DataFrame, part: str, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """The entities of which the name or an alias contains `part`, in any case; a null name or alias contains nothing."""
    part = part.lower()
    return entities.filter(F.coalesce(F.contains(F.lower(name), F.lit(part)), F.lit(False)) | F.coalesce(F.exists(aliases, lambda a: F.coalesce(F.contains(F.lower(a), F.lit(part)), F.lit(False))), F.lit(False)))


def deduped(entities: DataFrame, key: list[Column], confidence: str, tie: str) -> DataFrame:
    """The row of each key with the greatest confidence, of equal ones that with the least `tie`; null confidences count as least."""
    cols = [F.col(c) for c in entities.columns]
    best = F.struct(-F.coalesce(confidence, F.lit(-1.0)), F.col(tie))
    return entities.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*cols), best).alias("x")).select("x.*")


def involving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, direction) of the edges (src, dst) at the nodes (one column `node`); parallel edges are one."""
    e = edges.select("src", "dst").distinct()
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    into = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    return out.union(into).join(nodes.select("node").distinct(), "node", "left_semi")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that are left when the nodes of `gone` (one column `node`) are removed with all edges at them."""
    gone = gone.select("node").distinct()
    return edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")


def unknown_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that can't be added as an end is not among the nodes (one column `node`)."""
    known = nodes.select(F.col("node"), F.lit(True).alias("there")).distinct()
    a, b = known.withColumnsRenamed({"node": "src", "there": "has_src"}), known.withColumnsRenamed({"node": "dst", "there": "has_dst"})
    return edges.join(a, "src", "left").join(b, "dst", "left").filter("has_src is null or has_dst is null").select(*edges.columns)


def newest(rows: DataFrame, key: str, *order: Column, most: int) -> DataFrame:
    """The first `most` rows of each key in the given order, with their place from 1; every task sends on `most` rows of a key."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def period_ends(at: Column) -> dict[str, Column]:
    """Last days of the week (its Sunday), month, quarter and year of a time."""
    day = F.to_date(at)
    return {
        "week_end": F.date_add(day, 6 - F.weekday(day)),
        "month_end": F.last_day(day),
        "quarter_end": F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
        "year_end": F.last_day(F.add_months(F.trunc(day, "year"), 11)),
    }


def severity(minutes: Column) -> Column:
    # fixed values: an overlap of more than an hour is high, of more than half an hour medium
    return F.when(minutes > 60, "high").when(minutes > 30, "medium").otherwise("low")


# fixed values: weekdays, in the order of the week
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# fixed values: words before a day that is a deadline
UNTIL = ["by", "due", "before", "until"]


def deadlines(docs: DataFrame, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """(doc, mention, day): weekdays that a text names as deadlines ("by Friday"), with the next such day after the text's own date. Texts or dates
    that are null name none."""
    pattern = rf"(?i)\b(({'|'.join(UNTIL)}) ({'|'.join(WEEKDAYS)}))\b"
    found = docs.select(F.col(id_col).alias("doc"), F.col(at_col).alias("at"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("mention")).filter("at is not null")
    mention = F.lower("mention")
    number = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.substring_index(mention, " ", -1)).cast("int") - 1
    ahead = F.pmod(number - F.weekday(F.to_date("at")) - 1, F.lit(7)) + 1
    return found.select("doc", mention.alias("mention"), F.date_add(F.to_date("at"), ahead).alias("day"))


def relative_days(docs: DataFrame, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """(doc, mention, day): today, tomorrow and yesterday in texts, as days."""
    found = docs.select(F.col(id_col).alias("doc"), F.col(at_col).alias("at"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\b(today|tomorrow|yesterday)\b"), F.lit(1))).alias("mention")).filter("at is not null")
    ahead = F.when(F.col("mention") == "tomorrow", 1).when(F.col("mention") == "yesterday", -1).otherwise(0)
    return found.select("doc", "mention", F.date_add(F.to_date("at"), ahead).alias("day"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, paragraph): the parts of a text between blank lines, numbered from 0, those without ink left out."""
    parts = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.filter(F.split(text_col, r"\n[ \t]*\n"), lambda p: F.length(F.trim(p)) > 0)).alias("n", "paragraph"))
    return parts.select("doc", "n", F.trim("paragraph").alias("paragraph"))


def tidy(text: Column) -> Column:
    """The text with every run of white space as one character: a line break where it holds one, else a blank."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n\s*", "\n"), r"[ \t]+", " ")


def mime_matches(mime: Column, pattern: str) -> Column:
    """Whether a MIME type is that of the pattern: type/*, */* or a whole type. A null type matches nothing."""
    if pattern == "*/*":
        return mime.isNotNull()
    if pattern.endswith("/*"):
        return F.coalesce(F.startswith(mime, F.lit(pattern[:-1])), F.lit(False))
    return F.coalesce(mime == pattern, F.lit(False))
