"""Look-ups, calendars, versions and texts over the given tables: queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import source_key
from foliant.operators import catalog, changes, graph, intervals, search, topics
from foliant.plans import oracles as sql
from foliant.plans.queries import DIM, ORDER, _spans, promises
from foliant.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):  # noqa: ANN201
    """Registers a query with its SQL, or without where SQL can't express it or is too slow on whole tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _time(value: str) -> F.Column:
    return F.lit(value).cast("timestamp_ntz")


# -- entities and edges ----------------------------------------------------------------------------------------------------------------------


@query("""select entity_id, entity_type, name, confidence, updated_at from entities where entity_type in ('person', 'organization') and confidence >= 0.6
    order by updated_at desc nulls last, entity_id limit 50 offset 10""")
def entity_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of people and organizations that are fairly sure, the last updated first."""
    e = table(spark, folder, "entities").filter("entity_type in ('person', 'organization') and confidence >= 0.6")
    return catalog.page(e, F.desc_nulls_last("updated_at"), F.col("entity_id"), offset=10, limit=50).select("entity_id", "entity_type", "name", "confidence", "updated_at")


@query("select entity_id, name from entities where contains(lower(name), 'el') or len(list_filter(aliases, lambda a: contains(lower(a), 'el'))) > 0")
def entities_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.named(table(spark, folder, "entities"), "EL").select("entity_id", "name")


@query("""select entity_id, name, score from (select entity_id, name, case when lower(name) = 'robotics' then 1.0 when contains(lower(name), 'robotics') then 0.9 end::double score from entities) where score is not null""")
def entity_name_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well names match a word: 1 for equal ones, 0.9 where it is part of the name."""
    name = F.lower("name")
    return table(spark, folder, "entities").select("entity_id", "name", F.when(name == "robotics", 1.0).when(F.contains(name, F.lit("robotics")), 0.9).alias("score")).filter("score is not null")


@query("""select entity_id, lower(name) name, entity_type, confidence from (select *, row_number() over (partition by lower(name), entity_type order by coalesce(confidence, -1) desc, entity_id) nth from entities where name is not null) where nth = 1""")
def deduped_entities(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities").filter("name is not null")
    return catalog.deduped(e, [F.lower("name"), F.col("entity_type")], "confidence", "entity_id").select("entity_id", F.lower("name").alias("name"), "entity_type", "confidence")


@query(f"""with {sql._PROMISES}, e as (select distinct src, dst from edges) select node, other, direction from (select src node, dst other, 'out' direction from e union all select dst, src, 'in' from e) where node in (select entity_id from entities where confidence >= 0.9)""")
def edges_at_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The promises from and to the entities that are nearly certain."""
    sure = table(spark, folder, "entities").filter("confidence >= 0.9").select(F.col("entity_id").alias("node"))
    return catalog.involving(promises(spark, folder), sure)


@query(f"""with {sql._PROMISES}, gone as (select entity_id from entities where confidence < 0.8) select src, dst, count(*) n_promises from edges where src not in (select * from gone) and dst not in (select * from gone) group by 1, 2""")
def edges_after_removal(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the promises when the unsure entities are removed with all edges at them."""
    gone = table(spark, folder, "entities").filter("confidence < 0.8").select(F.col("entity_id").alias("node"))
    return catalog.without_nodes(promises(spark, folder), gone).groupBy("src", "dst").agg(F.count("*").alias("n_promises"))


@query(f"""with {sql._PROMISES}, known as (select entity_id from entities where entity_type = 'person') select src, dst, document_id from edges where src not in (select * from known) or dst not in (select * from known)""")
def edges_with_unknown_ends(spark: SparkSession, folder: str) -> DataFrame:
    """The promises that a catalogue of people alone could not take."""
    people = table(spark, folder, "entities").filter("entity_type = 'person'").select(F.col("entity_id").alias("node"))
    return catalog.unknown_ends(promises(spark, folder).select("src", "dst", "document_id"), people)


@query(f"""with {sql._PROMISES} select document_id, node, count(*) n_edges from (select document_id, src node from edges union all select document_id, dst from edges) group by 1, 2""")
def entities_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    p = promises(spark, folder)
    return p.select("document_id", F.col("src").alias("node")).union(p.select("document_id", "dst")).groupBy("document_id", "node").agg(F.count("*").alias("n_edges"))


@query(f"""with {sql._PROMISES}, ids as (select entity_id, min(entity_id) over (partition by lower(split_part(name, ' ', 1)), entity_type) new_id from entities where name is not null),
    moved as (select coalesce(a.new_id, src) src, coalesce(b.new_id, dst) dst, confidence from edges left join ids a on a.entity_id = src left join ids b on b.entity_id = dst)
    select src, dst, count(*) n_edges, max(confidence) confidence from moved where src <> dst group by 1, 2""")
def edges_after_merging(spark: SparkSession, folder: str) -> DataFrame:
    """The promises when entities of one type with the same first word are taken for one: its least id stands for all."""
    e = table(spark, folder, "entities").filter("name is not null").select("entity_id", "entity_type", F.lower(F.substring_index("name", " ", 1)).alias("word"))
    least = e.groupBy("entity_type", "word").agg(F.min("entity_id").alias("new_id"))
    ids = graph.merged_ids(e.join(least, ["entity_type", "word"]).select("entity_id", "new_id"), "entity_id", "new_id")
    return graph.redirected(promises(spark, folder), ids)


@query(f"""with {sql._PROMISES}, e as (select distinct src, dst from edges), n as (select src node from e union select dst from e)
    select (select count(*) from n) n_nodes, (select count(*) from e) n_edges, (select count(*) from n where node not in (select dst from e)) n_roots, (select count(*) from n where node not in (select src from e)) n_leaves""")
def promise_graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.degrees(promises(spark, folder))
    return d.agg(F.count("*").alias("n_nodes"), F.sum("n_out").alias("n_edges"), F.count_if(F.col("n_in") == 0).alias("n_roots"), F.count_if(F.col("n_out") == 0).alias("n_leaves"))


# -- calendar --------------------------------------------------------------------------------------------------------------------------------


@query(f"""with {sql._SPANS} select event_id, user_id, s as start, e as "end" from spans where s < timestamp '2024-01-08' and e >= timestamp '2024-01-01' order by s, event_id limit 100 offset 20""")
def events_of_a_week(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the events that touch a week, in their order."""
    inside = _spans(spark, folder).filter((F.col("start") < _time("2024-01-08")) & (F.col("end") >= _time("2024-01-01")))
    return catalog.page(inside, F.col("start"), F.col("event_id"), offset=20).select("event_id", "user_id", "start", "end")


_OVERLAPS = f"""{sql._SPANS}, pairs as (select a.user_id, a.event_id id_a, b.event_id id_b, round(epoch_us(least(a.e, b.e)) / 60e6 - epoch_us(greatest(a.s, b.s)) / 60e6, 3) as minutes
    from spans a join spans b on a.user_id = b.user_id and a.event_id < b.event_id and a.s < b.e and b.s < a.e and a.e > a.s and b.e > b.s)"""


@query(f"with {_OVERLAPS} select user_id, case when minutes > 60 then 'high' when minutes > 30 then 'medium' else 'low' end severity, count(*) n from pairs group by 1, 2")
def conflict_severity(spark: SparkSession, folder: str) -> DataFrame:
    """How many conflicts of each severity a user has."""
    pairs = intervals.overlaps(_spans(spark, folder), "user_id", "event_id", "start", "end")
    return pairs.groupBy("user_id", catalog.severity(F.col("minutes")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"with {_OVERLAPS} select event_id, count(*) n_conflicts from (select id_a event_id from pairs union all select id_b from pairs) group by 1")
def events_in_conflict(spark: SparkSession, folder: str) -> DataFrame:
    pairs = intervals.overlaps(_spans(spark, folder), "user_id", "event_id", "start", "end")
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias("n_conflicts"))


@query("""select event_type, count(*) n, count(*) filter (ts::date = date '2024-01-15') n_today, count(*) filter (ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-22') n_week, count(*) filter (ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-29') n_upcoming from events group by 1""")
def calendar_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type: all, of a day, of its week and of the fortnight ahead."""
    ts = F.col("ts")
    until = lambda end: F.count_if((ts >= _time("2024-01-15")) & (ts < _time(end)))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), until("2024-01-16").alias("n_today"), until("2024-01-22").alias("n_week"), until("2024-01-29").alias("n_upcoming"))


@query("select user_id, event_id, ts, place from (select *, row_number() over (partition by user_id order by ts, event_id) place from events where ts >= timestamp '2024-01-10') where place <= 3")
def next_events(spark: SparkSession, folder: str) -> DataFrame:
    ahead = table(spark, folder, "events").filter(F.col("ts") >= _time("2024-01-10"))
    return catalog.newest(ahead, "user_id", F.col("ts"), F.col("event_id"), most=3).select("user_id", "event_id", "ts", "place")


@query(f"""with {sql._SPANS}, b as (select user_id, bool_or(s < timestamp '2024-01-10 12:00:00' + interval 1 hour and e > timestamp '2024-01-10 12:00:00') busy from spans where e > s group by 1) select user_id, not busy is_free from b""")
def free_at_noon(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a user has no event in an hour."""
    s = _spans(spark, folder).filter(F.col("end") > F.col("start"))
    return s.groupBy("user_id").agg((~F.bool_or((F.col("start") < _time("2024-01-10 13:00:00")) & (F.col("end") > _time("2024-01-10 12:00:00")))).alias("is_free"))


@query("""select distinct ts::date as day, (ts::date + (7 - isodow(ts)::int))::date as week_end, last_day(ts::date) as month_end, (date_trunc('quarter', ts) + interval 3 month - interval 1 day)::date as quarter_end, (date_trunc('year', ts) + interval 12 month - interval 1 day)::date as year_end from events""")
def period_ends(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.to_date("ts").alias("day"), *[c.alias(k) for k, c in catalog.period_ends(F.col("ts")).items()]).distinct()


_DAYS = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"


@query(rf"""with m as (select doc_id doc, modified_at::date d, lower(unnest(regexp_extract_all(text, '(?i)\b((by|due|before|until) (monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b', 1))) mention from documents where modified_at is not null)
    select doc, mention, (d + ((((list_position({_DAYS}, split_part(mention, ' ', 2)) - isodow(d) - 1) % 7 + 7) % 7 + 1))::int)::date as day from m""")
def deadline_days(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.deadlines(table(spark, folder, "documents"), "doc_id", "text", "modified_at")


@query(r"""with m as (select doc_id doc, modified_at::date d, unnest(regexp_extract_all(lower(text), '\b(today|tomorrow|yesterday)\b', 1)) mention from documents where modified_at is not null)
    select doc, mention, (d + case mention when 'tomorrow' then 1 when 'yesterday' then -1 else 0 end)::date as day from m""")
def relative_days(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.relative_days(table(spark, folder, "documents"), "doc_id", "text", "modified_at")


# -- versions and chunks ---------------------------------------------------------------------------------------------------------------------


@query("select document_id, version_id, created_at, place from (select *, row_number() over (partition by document_id order by created_at desc, version_number desc, version_id desc) place from doc_versions) where place <= 5")
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest versions of every document."""
    return catalog.newest(table(spark, folder, "doc_versions"), "document_id", *[F.desc(c) for c in ORDER], most=5).select("document_id", "version_id", "created_at", "place")


@query(f"with r as ({sql.ORACLES['retention_decisions']}) select decision, count(*) n_versions, sum(size_bytes)::bigint n_bytes from r join doc_versions using (version_id) group by 1")
def retention_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What a clean-up keeps and frees."""
    kept = changes.retention(table(spark, folder, "doc_versions"), "document_id", "created_at", ORDER)
    return kept.groupBy("decision").agg(F.count("*").alias("n_versions"), F.sum("size_bytes").alias("n_bytes"))


@query("select document_id, count(*) n_versions, count(*) filter (storage_kind = 'delta') n_deltas, coalesce(sum(size_bytes), 0)::bigint n_bytes, max(created_at) last_at from doc_versions group by 1")
def version_sizes(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "doc_versions")
    return v.groupBy("document_id").agg(F.count("*").alias("n_versions"), F.count_if(F.col("storage_kind") == "delta").alias("n_deltas"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.max("created_at").alias("last_at"))


@query("""with b as (select document_id, arg_max(created_at, (created_at, version_number, version_id)) t, arg_max(size_bytes, (created_at, version_number, version_id)) z from doc_versions where created_at <= '2024-06-30' group by 1),
    n as (select document_id, arg_max(created_at, (created_at, version_number, version_id)) t, arg_max(size_bytes, (created_at, version_number, version_id)) z from doc_versions group by 1)
    select document_id, case when b.t is null then 'new' when n.t is null then 'deleted' when b.t = n.t and b.z is not distinct from n.z then 'unchanged' else 'modified' end change from b full join n using (document_id)""")
def changed_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every document since a day, told by time and size instead of by hash."""
    v = table(spark, folder, "doc_versions").withColumn("stamp", F.struct("created_at", "size_bytes"))
    before = changes.as_of(v, "document_id", F.col("created_at"), ORDER, _time("2024-06-30 00:00:00"))
    return changes.classify_changes(before, changes.as_of(v, "document_id", F.col("created_at"), ORDER), "document_id", "stamp")


@query("select document_id, count(distinct chunk_id) n_chunks, sum(strlen(text))::bigint n_bytes from (select distinct document_id, chunk_id, text from vectors) group by 1")
def chunks_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vectors").select("document_id", "chunk_id", "text").distinct()
    return v.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("select (select count(*) from documents) n_documents, (select count(distinct chunk_id) from vectors) n_chunks, (select count(*) from documents) * 1024 + (select count(distinct chunk_id) from vectors) * 512 n_bytes")
def storage_statistics(spark: SparkSession, folder: str) -> DataFrame:
    # fixed values: a document is reckoned at 1024 bytes and a chunk at 512
    d = table(spark, folder, "documents").agg(F.count("*").alias("n_documents"))
    c = table(spark, folder, "vectors").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return d.crossJoin(c).withColumn("n_bytes", F.col("n_documents") * 1024 + F.col("n_chunks") * 512)  # a single row


@query(f"select {sql._source('source')} source, mime_type, count(*) n, count(*) filter (text is null or trim(text) = '') n_blank from documents where starts_with(mime_type, 'text/') group by 1, 2")
def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter(catalog.mime_matches(F.col("mime_type"), "text/*"))
    return d.groupBy(source_key(F.col("source")).alias("source"), "mime_type").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_blank"))


@query(r"""with p as (select doc_id doc, unnest(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: length(trim(x)) > 0)) p, generate_subscripts(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: length(trim(x)) > 0), 1) - 1 n from documents)
    select doc, n::int n, length(trim(p)) chars, md5(trim(p)) md5 from p""")
def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    p = catalog.paragraphs(table(spark, folder, "documents"), "doc_id", "text")
    return p.select("doc", "n", F.length("paragraph").alias("chars"), F.md5(F.col("paragraph").cast("binary")).alias("md5"))


@query(r"select doc_id doc, md5(regexp_replace(regexp_replace(text, '[ \t]*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g')) md5 from documents where text is not null")
def tidy_texts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select(F.col("doc_id").alias("doc"), F.md5(catalog.tidy(F.col("text")).cast("binary")).alias("md5"))


# -- hits and clusters -----------------------------------------------------------------------------------------------------------------------


@query(f"""with a as (select query_id, document_id, max(score) score from (select distinct * from fulltext_results) group by all having max(score) >= 0.5),
    r as (select a.*, row_number() over (partition by query_id order by round(score, 6) desc, document_id) place from a join documents on doc_id = document_id where author is null or author = 'u0014' or mime_type = 'text/markdown')
    select query_id, document_id, round(score, 6) score, place from r where place <= 10""")
def permitted_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best full-text hits of each query that score enough and that a user may read: its own, those of nobody, and markdown."""
    hits = table(spark, folder, "fulltext_results").distinct().groupBy("query_id", "document_id").agg(F.max("score").alias("score")).filter("score >= 0.5")
    may = table(spark, folder, "documents").filter("author is null or author = 'u0014' or mime_type = 'text/markdown'").select(F.col("doc_id").alias("document_id"))
    return search.best(hits.join(may, "document_id", "left_semi"), "query_id", F.round("score", 6), "document_id", 10).select("query_id", "document_id", "score", "place")


@query(f"""with {sql._CENTROID}, s as (select q.vec_id, c.label cluster, round(round(list_cosine_similarity(q.embedding::double[], c.c), 6), 5) similarity from (select * from embeddings where vec_id % 100 = 0) q, cent c)
    select * from (select *, row_number() over (partition by vec_id order by similarity desc, cluster) place from s) where place <= 3""")
def nearest_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The three clusters whose centroids are most similar to each stated query."""
    points = table(spark, folder, "embeddings")
    asked = points.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.vector_topk(topics.centroids(points, "label", "embedding", DIM).select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("item"), "centroid"), "item", "centroid", asked, k=10)
    near = found.select(F.col("query_id").alias("vec_id"), F.substring("item_id", F.lit(2), F.lit(20)).cast("int").alias("cluster"), F.round("score", 5).alias("similarity"))
    return search.best(near.withColumnRenamed("similarity", "score"), "vec_id", F.col("score"), "cluster", 3).withColumnRenamed("score", "similarity")


@query(f"""with {sql._CENTROID}, far as (select p.label, p.vec_id, p.dist, min(list_distance(e.embedding::double[], o.c)) other from placed p join embeddings e using (vec_id) join cent o on o.label <> p.label group by all)
    select label, count(*) n, round(avg((other - dist) / greatest(other, dist)), 4) silhouette from far group by 1""")
def cluster_silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    """The silhouette of every cluster, by the distances to centroids, so that no two points meet."""
    points = table(spark, folder, "embeddings")
    own = topics.with_centroid(points, "label", "vec_id", "embedding", DIM).select("id", "label", "distance")
    return topics.silhouettes(points, own, "label", "vec_id", "embedding", DIM)
