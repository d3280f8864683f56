"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.cluster import direction_groups, group_report
from foliant.llm.garbled import garbled_texts
from foliant.llm.hnsw import most_similar
from foliant.llm.mixing import mixed, shuffled_copies
from foliant.llm.names import link_names
from foliant.llm.near import near_duplicate_classes, near_duplicate_groups, near_duplicate_pairs
from foliant.llm.packing import packed
from foliant.llm.split import placed_pieces, split_oversized
from foliant.llm.tokens import with_token_counts
from foliant.session import saved
from foliant.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = [split_oversized(table(spark, folder, t), "chunk_id", "text") for t in ("vectors", "vector_results")]
    return cut[0].unionByName(cut[1]).select(F.col("item_id").alias("chunk_id")).filter("chunk_id is not null").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """New pieces of the texts that are too long, indexed (vectors) and as they were found (vector_results), placed by the newest chunk version.

    Different texts of one chunk have different text_hash."""
    long = None
    for name in ("vectors", "vector_results"):
        rows = table(spark, folder, name).filter(F.octet_length("text") > 1000).select(F.lit(name).alias("record_table"), "chunk_id", "text").distinct()
        long = rows if long is None else long.unionByName(rows)
    keep = ["record_table", "text_hash"]
    # the places need the pieces twice more, so they are cut once and written
    pieces = saved(split_oversized(long.withColumn("text_hash", F.md5(F.col("text").cast("binary"))), "chunk_id", "text", keep=keep), "pieces")
    return placed_pieces(pieces, table(spark, folder, "chunk_versions"), F.col("record_table") == "vectors", keep)


_PASSAGES = (("vectors", "chunk_id", "text"), ("fulltext_results", "result_id", "snippet"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, key, text in _PASSAGES:
        pairs = near_duplicate_pairs(*near_duplicate_classes(table(spark, folder, name), key, text, words=3, threshold=0.5))
        rows = pairs.select(F.lit(name).alias("record_table"), "key_a", "key_b")
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every passage, with its copies and links."""
    out = None
    for name, key, text in _PASSAGES:
        groups = near_duplicate_groups(*near_duplicate_classes(table(spark, folder, name), key, text, words=3, threshold=0.5))
        rows = groups.select(F.lit(name).alias("record_table"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near = most_similar(table(spark, folder, "vectors"), "chunk_id", "vector", queries=table(spark, folder, "knn_probes"))
    return near.select(F.least("query_id", "item_id").alias("chunk_a"), F.greatest("query_id", "item_id").alias("chunk_b")).distinct()


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar chunks of every chunk."""
    return most_similar(table(spark, folder, "vectors"), "chunk_id", "vector").withColumn("similarity", F.round("similarity", 6))


_PEOPLE = ("commitment_by", "commitment_to", "follow_up_with")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    actions, entities = table(spark, folder, "detected_actions"), table(spark, folder, "entities")
    fields = actions.select("action_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("typed_name")) for c in _PEOPLE])).alias("x"))
    fields = fields.select("action_id", "x.field_name", "x.typed_name").filter("typed_name is not null").distinct()
    linked = link_names(fields, "typed_name", entities.filter("entity_type in ('person', 'organization')"))
    return fields.join(linked, "typed_name").select("action_id", "field_name", "entity_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = direction_groups(table(spark, folder, "vectors"), "chunk_id", "vector").filter("group_no is not null")
    sample = table(spark, folder, "cluster_sample").distinct()
    a = sample.join(groups, F.col("chunk_id") == F.col("item_id")).select("batch_no", "group_no", F.col("chunk_id").alias("chunk_a"))
    pairs = a.join(a.withColumnRenamed("chunk_a", "chunk_b"), ["batch_no", "group_no"])
    return pairs.filter("chunk_a < chunk_b").select("batch_no", "chunk_a", "chunk_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each broad group with its size, its documents and its most typical chunks."""
    vectors = table(spark, folder, "vectors")
    return group_report(direction_groups(vectors, "chunk_id", "vector"), vectors, "chunk_id", "document_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("item_id", "doc_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    sized = saved(with_token_counts(documents, "doc_id", "text", keep=["source"]), "sized")
    return mixed(sized, table(spark, folder, "mix_targets"), 50 * documents.count())


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].select(F.col("item_id").alias("doc_id"), "source", "n_tokens", "n_uses", "place")


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself: every use of every chosen text as a row, in one global order over all sources."""
    return shuffled_copies(_mix(spark, folder)[0]).withColumnRenamed("item_id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents"), "doc_id", "text", "source", restore=False).select(F.col("item_id").alias("doc_id")).distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with their original text, or without where it cannot be regained."""
    return garbled_texts(table(spark, folder, "documents"), "doc_id", "text", "source").withColumnRenamed("item_id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_containers": p6_containers, "p7_mix": p7_mix, "p7_copies": p7_copies, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}

def _runs_of_three(name: str, key: str, text: str) -> str:
    """SQL (three steps of a with clause) of the pairs of records whose distinct runs of three words are half the same."""
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"
    return f"""
        {name}_words as (select distinct {key} k, {words} w from {name} where {key} is not null and {text} is not null),
        {name}_sets as (select k, row_number() over () no, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) r from {name}_words where len(w) > 2),
        {name}_runs as (select k, no, len(r) n, unnest(r) x from {name}_sets),
        {name}_pairs as (select distinct '{name}' record_table, key_a, key_b from (select a.k key_a, b.k key_b, a.no, b.no, any_value(a.n) na, any_value(b.n) nb, count(*) n
            from {name}_runs a join {name}_runs b on a.x = b.x and a.k < b.k group by a.k, b.k, a.no, b.no) where 2 * n >= na + nb - n)"""


_FAULT = "vector is null or len(vector) <> 64 or len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(vector, lambda x: x <> 0)) = 0"


ORACLES: dict[str, str] = {
    "p1_found": """
        select distinct chunk_id from (select chunk_id, text from vectors union all select chunk_id, text from vector_results)
        where strlen(text) > 1000 and chunk_id is not null""",
    "p2_found": f"with {_runs_of_three('vectors', 'chunk_id', 'text')}, {_runs_of_three('fulltext_results', 'result_id', 'snippet')} select * from vectors_pairs union all select * from fulltext_results_pairs",
    "p3_found": f"""
        with u as (select distinct chunk_id, vector::double[] v from vectors where not ({_FAULT})),
        s as (select q.chunk_id a, u.chunk_id b, list_cosine_similarity(q.v, u.v) c from u q join u on q.chunk_id <> u.chunk_id where q.chunk_id in (select chunk_id from knn_probes)),
        r as (select a, b, row_number() over (partition by a order by c desc, b) place from s)
        select distinct least(a, b) chunk_a, greatest(a, b) chunk_b from r where place <= 10""",
}
