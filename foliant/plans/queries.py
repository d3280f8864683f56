"""The library's queries over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import heading, lang_key, snippet, source_key, tokens
from foliant.functions.vectors import fault
from foliant.operators import access, changes, dedup, extract, graph, intervals, search, topics
from foliant.operators.components import connected_components
from foliant.session import saved, shared_dir
from foliant.sources import files
from foliant.streaming import pipelines
from foliant.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = 64


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- ranked retrieval ------------------------------------------------------------------------------------------------------------------------


def _title_terms(documents: DataFrame) -> DataFrame:
    """The stated query set: headings of the documents whose id is divisible by 100, or their texts where the heading has no word or is missing."""
    title = tokens(heading(F.col("text")))
    asked = F.when(F.coalesce(F.size(title), F.lit(0)) > 0, title).otherwise(tokens(F.col("text")))
    return documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(asked).alias("term")).distinct()


@query
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return search.bm25(search.postings(documents, "doc_id", "text"), _title_terms(documents))


@query
def bm25_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The best hits with a cut-out around the query's longest term."""
    documents = table(spark, folder, "documents")
    terms = _title_terms(documents)
    hits = search.bm25(search.postings(documents, "doc_id", "text"), terms, k=3)
    longest = terms.groupBy("query_id").agg(F.max(F.struct(F.length("term").alias("n"), "term"))["term"].alias("term"))
    texts = search.with_texts(hits.join(longest, "query_id"), documents, "doc_id", "text")
    return texts.select("query_id", "doc", "place", "term", snippet(F.col("text"), F.col("term")).alias("snippet"))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.filter(fault(F.col("vector"), DIM).isNull()).groupBy("chunk_id").agg(F.min(F.struct("document_id", "vector")).alias("x")).select("chunk_id", "x.document_id", "x.vector")


@query
def vector_search_cosine(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "vectors")
    asked = _usable(vectors.filter("document_id % 100 = 0")).select(F.col("chunk_id").alias("query_id"), "vector")
    return search.vector_topk(vectors, "chunk_id", "vector", asked)


@query
def vector_search_l2(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "embeddings")
    asked = points.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_topk(points, "vec_id", "embedding", asked, metric="l2")


def _vector_arm(spark: SparkSession, folder: str) -> DataFrame:
    return search.max_pool(table(spark, folder, "vector_results").distinct(), ["query_id", "document_id"], "score", "text")


def _text_arm(spark: SparkSession, folder: str) -> DataFrame:
    return search.max_pool(table(spark, folder, "fulltext_results").distinct(), ["query_id", "document_id"], "score", "snippet")


@query
def chunk_max_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_arm(spark, folder)


def _arms(spark: SparkSession, folder: str, vector_weight: float = 0.6) -> list[tuple[DataFrame, float]]:
    return [(_vector_arm(spark, folder), vector_weight), (_text_arm(spark, folder), 1 - vector_weight)]


@query
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return search.rrf(_arms(spark, folder), "query_id", "document_id").withColumn("score", F.round("score", 8))


@query
def dbsf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return search.dbsf(_arms(spark, folder), "query_id", "document_id").withColumn("score", F.round("score", 6))


@query
def minmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    return search.min_max(_text_arm(spark, folder).select("query_id", "document_id", "score"), "query_id").withColumn("normalized", F.round("normalized", 6))


@query
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: both arms fused, the ten best documents of every query with their source and heading."""
    fused = search.rrf(_arms(spark, folder), "query_id", "document_id")
    top = search.min_max(search.best(fused, "query_id", F.round("score", 8), "document_id", 10), "query_id")
    # the texts of the hits alone are looked at
    hit = table(spark, folder, "documents").withColumnRenamed("doc_id", "document_id").join(top.select("document_id").distinct(), "document_id", "left_semi")
    documents = hit.select("document_id", source_key(F.col("source")).alias("source"), heading(F.col("text")).alias("heading"))
    return top.join(documents, "document_id").select("query_id", "place", "document_id", "score", F.round("normalized", 4).alias("normalized"), "n_arms", "source", "heading")


@query
def reranked_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Full-text hits ranked anew by the words they share with the query's best hit."""
    hits = search.min_max(_text_arm(spark, folder).filter("score is not null"), "query_id")
    words = F.array_distinct(tokens(F.col("best_text")))
    top = search.best(hits, "query_id", F.col("score"), "document_id", 1).select("query_id", words.alias("wanted"))
    both = hits.join(top, "query_id").withColumn("own", words)
    shared = F.size(F.array_intersect("own", "wanted"))
    alike = shared / F.greatest(F.size("own") + F.size("wanted") - shared, F.lit(1))
    return search.reranked(both, alike, score="normalized", tie="document_id").select("query_id", "document_id", "score", "place")


@query
def highlighted_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Where the best hits of the stated queries have the queries' terms."""
    documents = table(spark, folder, "documents")
    terms = _title_terms(documents)
    hits = search.bm25(search.postings(documents, "doc_id", "text"), terms, k=3)
    asked = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    texts = hits.join(asked, "query_id").join(documents.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return texts.select("query_id", "doc", F.explode(search.highlights(F.col("text"), F.col("terms"))).alias("h")).select("query_id", "doc", "h.start", "h.stop")


@query
def feedback_terms(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.best(_text_arm(spark, folder).filter("score is not null"), "query_id", F.col("score"), "document_id", 10)
    return search.feedback_terms(hits, "query_id", "best_text")


@query
def name_typos(spark: SparkSession, folder: str) -> DataFrame:
    """Words of typed names that are one edit from a word of a person's or an organization's name."""
    known = table(spark, folder, "entities").filter("entity_type in ('person', 'organization')").select(F.explode(tokens(F.col("name"))).alias("term"))
    typed = table(spark, folder, "detected_actions").select(F.explode(F.flatten(F.array_compact(F.array(*[tokens(F.col(c)) for c in ("commitment_by", "commitment_to", "follow_up_with")])))).alias("term"))
    return search.edit_neighbours(known, typed.distinct(), 1)


@query
def filtered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """English or German markdown documents of two sources, changed in a range."""
    d = table(spark, folder, "documents")
    wanted = source_key(F.col("source")).isin("src-pension", "src-cargo") & (F.col("mime_type") == "text/markdown") & lang_key(F.col("lang")).isin("en", "de")
    return d.filter(wanted & F.col("modified_at").between(F.lit("2024-03-01").cast("timestamp_ntz"), F.lit("2025-03-01").cast("timestamp_ntz"))).select("doc_id", source_key(F.col("source")).alias("source"), lang_key(F.col("lang")).alias("lang"), "modified_at")


# -- documents, sources, pieces --------------------------------------------------------------------------------------------------------------


@query
def document_metadata(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", heading(F.col("text")).alias("heading"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.size(tokens(F.col("text"))).alias("words"), lang_key(F.col("lang")).alias("lang"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


@query
def source_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with its documents, whichever way these spell it."""
    d = table(spark, folder, "documents").select(source_key(F.col("source")).alias("source_id"), "author", "n_chars")
    n = d.groupBy("source_id").agg(F.count("*").alias("n_documents"), F.countDistinct("author").alias("n_authors"), F.sum("n_chars").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    return table(spark, folder, "sources").join(n, "source_id", "left").select("source_id", "source_type", "status", *[F.coalesce(c, zero).alias(c) for c in ("n_documents", "n_authors", "n_chars")])


@query
def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    pieces = extract.chunks(table(spark, folder, "documents"), "doc_id", "text")
    return pieces.select("doc", "n", "start", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("md5"))


@query
def vector_faults(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vectors")
    return v.groupBy(F.coalesce(fault(F.col("vector"), DIM), F.lit("usable")).alias("state")).agg(F.count("*").alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks"))


@query
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "documents").select("doc_id", F.explode(tokens(F.col("text"), 3)).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query
def source_keywords(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(source_key(F.col("source")).alias("source"), "text")
    return topics.tfidf_keywords(d, "source", "text")


@query
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text", "modified_at")
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    files.export_jsonl(d, path)
    back = files.sound_lines(files.import_jsonl(spark, path, d.schema.simpleString()[len("struct<") : -1].replace(":", " ")))
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "modified_at")


@query
def scanned_files(spark: SparkSession, folder: str) -> DataFrame:
    return files.scan_folder(spark, folder, include=["*.parquet", "**/*.parquet"], exclude=["**/_*", "_*"]).select("path", "size")


@query
def readable_documents(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each author may read: its own, all of a watched source's, and markdown of its team, in which ten authors are together."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.col("author").alias("owner"), source_key(F.col("source")).alias("source_id"), "mime_type")
    team = F.concat(F.lit("team-"), F.substring("owner", 1, 4))
    members = d.filter("owner is not null").select(F.col("owner").alias("user"), team.alias("role")).distinct()
    inherits = members.select("role", F.substring("role", 1, 8).alias("parent")).distinct()
    watched = d.join(table(spark, folder, "sources").filter("watching").select("source_id"), "source_id", "left_semi").select("doc", F.lit(access.EVERYONE).alias("principal"))
    shared = d.filter("mime_type = 'text/markdown' and owner is not null").select("doc", team.alias("principal"))
    return access.readable_counts(d, watched.union(shared), access.effective_principals(members, inherits))


# -- duplicates ------------------------------------------------------------------------------------------------------------------------------


@query
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, folder, "documents"), "doc_id", "text")


@query
def near_duplicate_documents(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.minhash_classes(table(spark, folder, "documents"), "doc_id", "text")


# -- snapshots and versions ------------------------------------------------------------------------------------------------------------------

ORDER = ["created_at", "version_number", "version_id"]


@query
def changed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every document since a day."""
    v = table(spark, folder, "doc_versions")
    before = changes.as_of(v, "document_id", F.col("created_at"), ORDER, F.lit("2024-06-30 00:00:00").cast("timestamp_ntz"))
    return changes.classify_changes(before, changes.as_of(v, "document_id", F.col("created_at"), ORDER), "document_id", "content_hash")


@query
def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return changed_documents(spark, folder).groupBy("change").agg(F.count("*").alias("n"))


@query
def version_numbers(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "doc_versions")
    return changes.numbered_versions(v, "document_id", "content_hash", ORDER).select("version_id", "document_id", "version_number", F.col("new_number").cast("bigint").alias("new_number"))


@query
def retention_decisions(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "doc_versions")
    return changes.retention(v, "document_id", "created_at", ORDER).select("version_id", "document_id", "decision")


@query
def stale_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the history that left the index, with their last version."""
    last = changes.as_of(table(spark, folder, "chunk_versions"), "chunk_id", F.col("created_at"), ["created_at", "version_id"])
    return last.join(table(spark, folder, "vectors").select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", "document_id", "version_id", "created_at")


@query
def orphaned_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "vector_results").distinct()
    gone = hits.join(table(spark, folder, "vectors").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return gone.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.countDistinct("document_id").alias("n_documents"))


@query
def text_drift(spark: SparkSession, folder: str) -> DataFrame:
    """How far the text of a hit has moved from what its piece says now."""
    now = table(spark, folder, "vectors").groupBy("chunk_id").agg(F.min("text").alias("now"))
    then = table(spark, folder, "vector_results").select("query_id", "chunk_id", "text").distinct()
    a, b = F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.col("now")))
    both = then.join(now, "chunk_id").select("query_id", "chunk_id", (F.col("text") == F.col("now")).alias("same"), a.alias("a"), b.alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("query_id", "chunk_id", "same", (F.size("a") - shared).alias("removed"), (F.size("b") - shared).alias("added"), F.round(shared / F.greatest(F.size("a") + F.size("b") - shared, F.lit(1)), 6).alias("similarity"))


# -- extraction ------------------------------------------------------------------------------------------------------------------------------


@query
def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    m = extract.mentions(table(spark, folder, "documents"), "doc_id", "text")
    return m.groupBy("kind", "mention").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


@query
def mentions_together(spark: SparkSession, folder: str) -> DataFrame:
    spans = saved(extract.mention_spans(table(spark, folder, "documents"), "doc_id", "text", ["context", "ticket", "time"]), "spans")
    return extract.together(spans, "context", "time")


# -- graph of who promised what to whom ------------------------------------------------------------------------------------------------------


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    """Each action once, as it was ingested last."""
    return dedup.first_of_each(table(spark, folder, "detected_actions"), ["action_id"], [F.desc("ingested_at"), F.desc("detected_at")])


def promises(spark: SparkSession, folder: str) -> DataFrame:
    """Edges (src, dst, document_id, confidence) between entities whose names are typed as they are known, but for case and blanks."""
    named = table(spark, folder, "entities").filter("entity_type in ('person', 'organization')").select("entity_id", F.lower(F.trim("name")).alias("name"))
    a = _actions(spark, folder).select("document_id", "confidence", F.lower(F.trim("commitment_by")).alias("by"), F.lower(F.trim("commitment_to")).alias("to"))
    by, to = named.select(F.col("name").alias("by"), F.col("entity_id").alias("src")), named.select(F.col("name").alias("to"), F.col("entity_id").alias("dst"))
    return a.join(by, "by").join(to, "to").filter("src <> dst").select("src", "dst", "document_id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def _mean(name: str) -> Column:
    """Mean of six digits, of numbers taken to six digits: summed as decimals, so that the order of rows doesn't show."""
    return F.round(F.sum(F.col(name).cast("decimal(18,6)")).cast("double") / F.count(name), 6)


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("seed")).distinct()


@query
def entity_statistics(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities")
    return e.groupBy("entity_type").agg(F.count("*").alias("n"), _mean("confidence").alias("confidence"), F.count_if(F.size("aliases") > 0).alias("n_with_alias"), F.max("updated_at").alias("last_update"))


@query
def latest_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _actions(spark, folder).groupBy("action_type", F.date_trunc("month", "detected_at").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"), _mean("confidence").alias("confidence"))


@query
def promise_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(promises(spark, folder))


@query
def promise_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone within three promises of each entity that made one."""
    edges = saved(promises(spark, folder), "promises")
    return graph.reachable(edges, _seeds(edges), 3)


@query
def promise_paths(spark: SparkSession, folder: str) -> DataFrame:
    """All simple paths of up to three promises from each entity that made one."""
    edges = saved(promises(spark, folder), "promises")
    paths = graph.simple_paths(edges, _seeds(edges), 3)
    return paths.select("seed", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth", F.round("strength", 6).alias("strength"))


@query
def promise_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.in_cycles(promises(spark, folder))


@query
def promise_components(spark: SparkSession, folder: str) -> DataFrame:
    return connected_components(saved(promises(spark, folder), "promises"), "src", "dst").groupBy("component").agg(F.count("*").alias("n_nodes"))


@query
def unlinked_promises(spark: SparkSession, folder: str) -> DataFrame:
    """What removing the documents without a MIME type does to the edges."""
    gone = table(spark, folder, "documents").filter("mime_type is null").select(F.col("doc_id").alias("document_id"))
    return graph.unlink_documents(promises(spark, folder), gone)


# -- clusters of given labels ----------------------------------------------------------------------------------------------------------------


@query
def cluster_coherence(spark: SparkSession, folder: str) -> DataFrame:
    r = topics.cluster_report(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", DIM)
    return r.select("label", "n", F.round("coherence", 5).alias("coherence"), F.round("spread", 5).alias("spread"))


@query
def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return topics.representatives(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", DIM).withColumn("score", F.round("score", 5))


@query
def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    q = topics.quality(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", DIM)
    return q.select("n", "n_clusters", F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"))


@query
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=7, maxIter=50).fit(points)
    return model.transform(points).select("vec_id", F.col("prediction").alias("cluster"))


@query
def principal_axes(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="axes").fit(points).transform(points).withColumn("a", vector_to_array("axes"))
    return flat.select("vec_id", F.round(F.get("a", F.lit(0)), 6).alias("x"), F.round(F.get("a", F.lit(1)), 6).alias("y"))


# -- time ------------------------------------------------------------------------------------------------------------------------------------


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 60, 0).cast("decimal(18,6)"))).alias("end"))


@query
def overlapping_events(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.overlaps(_spans(spark, folder), "user_id", "event_id", "start", "end")


@query
def busy_islands(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.islands(_spans(spark, folder), "user_id", "start", "end")


@query
def free_time(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.free_time(_spans(spark, folder), "user_id", "start", "end")


@query
def recurring_events(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of rules made from the events: unit by user, interval by event."""
    unit = F.get(F.array(F.lit("day"), F.lit("week"), F.lit("month")), (F.col("user_id") % 3).cast("int"))
    rules = _spans(spark, folder).select("event_id", "start", unit.alias("unit"), (1 + F.col("event_id") % 3).alias("every"), F.lit(5).alias("times"))
    return intervals.recurrences(rules, "event_id", "start", "unit", "every", "times")


@query
def daily_share(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, with the type's share of the day."""
    from pyspark.sql import Window as W

    d = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    return d.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("day")), 6))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    path = f"{folder}/events.parque[t]"  # a pattern stands for a file as for a folder
    return pipelines.file_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    s = pipelines.tumbling(_event_stream(spark, folder), "ts", "1 hour", "2 hours", "event_type")
    return pipelines.run_available(s, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = pipelines.sessions(_event_stream(spark, folder), "ts", "6 hours", "2 hours", "user_id")
    return pipelines.run_available(s, "complete").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each user and type, whichever event came first."""
    s = pipelines.first_seen(_event_stream(spark, folder), "ts", "60 days", ["user_id", "event_type"])
    return pipelines.run_available(s).select("user_id", "event_type")
