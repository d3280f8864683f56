"""Chunks, outlines, linked names, versions and expansions over the given tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators import changes, chunking, dedup, intervals, linkage, outlines, search
from foliant.plans import oracles as sql
from foliant.plans.lookups import query
from foliant.plans.queries import ORDER, _spans, _usable
from foliant.session import saved
from foliant.tables import table

# -- texts -----------------------------------------------------------------------------------------------------------------------------------

_STOP = r"""case when {s} + 512 >= n then n
        when instr(reverse(substr(t, {s} + 463, 51)), chr(10) || chr(10)) > 0 then {s} + 514 - instr(reverse(substr(t, {s} + 463, 51)), chr(10) || chr(10))
        when regexp_matches(reverse(substr(t, {s} + 463, 51)), '[ \t\r\n][.!?]') then {s} + 512 - length(regexp_extract(reverse(substr(t, {s} + 463, 51)), '(?s)^(.*?)[ \t\r\n][.!?]', 1))
        when regexp_matches(substr(t, {s} + 463, 50), '[ \t\r\n]') then {s} + 512 - length(regexp_extract(reverse(substr(t, {s} + 463, 50)), '(?s)^(.*?)[ \t\r\n]', 1))
        else {s} + 512 end"""


@query(rf"""with recursive d as (select row_number() over () id, doc_id doc, text t, length(text) n from documents where length(text) > 0),
    c as (select *, 0::bigint s, {_STOP.format(s='0')} e from d union all select id, doc, t, n, e - 64, {_STOP.format(s='(e - 64)')} from c where e < n),
    m as (select *, lead(e) over w - lead(s) over w < 100 and lead(e) over w = n joins, row_number() over w > 1 and e = n and e - s < 100 gone from c window w as (partition by id order by s)),
    p as (select id, doc, s, case when joins then n else e end e, substr(t, s + 1, case when joins then n else e end - s) x from m where not gone)
    select doc, (row_number() over (partition by id order by s) - 1)::int n, s::int as start, e::int as stop, md5(x) md5 from p where trim(x, ' ' || chr(9) || chr(13) || chr(10)) <> ''""")
def natural_chunks(spark: SparkSession, folder: str) -> DataFrame:
    c = chunking.natural_chunks(table(spark, folder, "documents"), "doc_id", "text")
    return c.select("doc", "n", "start", "stop", F.md5(F.col("chunk").cast("binary")).alias("md5"))


@query(None)
def duplicate_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What each near-duplicate document has changed against the first one of its group, in lines."""
    documents = table(spark, folder, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    groups = saved(dedup.minhash_classes(documents, "doc_id", "text").filter("id <> group_id"), "groups")
    pairs = groups.select("id", "group_id").join(documents.withColumnsRenamed({"doc_id": "id", "text": "new"}), "id").join(documents.withColumnsRenamed({"doc_id": "group_id", "text": "old"}), "group_id")
    return chunking.line_changes(pairs, ["group_id", "id"], "old", "new").withColumn("similarity", F.round("similarity", 6))


# fixed values: words of technical notes and their synonyms
SYNONYMS = {
    "error": ["exception", "failure", "fault"],
    "create": ["make", "new", "add", "generate"],
    "delete": ["remove", "drop", "erase"],
    "update": ["modify", "change", "edit"],
    "find": ["search", "lookup", "locate", "query"],
    "config": ["configuration", "settings", "options"],
    "auth": ["authentication", "authorization", "login"],
    "api": ["endpoint", "service", "interface"],
    "db": ["database", "storage"],
    "async": ["asynchronous", "concurrent"],
    "sync": ["synchronous", "blocking"],
}
_SYNONYMS = ", ".join(f"('{h}', '{s}')" for h, ss in SYNONYMS.items() for s in ss)


@query(rf"""with s(head, synonym) as (values {_SYNONYMS}),
    q as (select distinct doc_id query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)) term from documents where doc_id % 100 = 0),
    t as (select distinct term, regexp_replace(term, '[^a-z0-9]', '?', 'g') plain from q), h as (select distinct head from s),
    x as (select query_id, synonym as "new", 0.9 score from q join s on term = head union all
        select query_id, synonym, 0.7 from q join (select term, head from t, h where levenshtein(plain, head) between 1 and 2) using (term) join s using (head)),
    b as (select query_id, "new" term, max(score)::double score from x where not exists (select 1 from q where q.query_id = x.query_id and q.term = x."new") group by all)
    select * from (select *, row_number() over (partition by query_id order by score desc, term) place from b) where place <= 5""")
def expanded_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Synonyms of the words of each stated text (id divisible by 100)."""
    asked = table(spark, folder, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    words = spark.createDataFrame([(h, s) for h, ss in SYNONYMS.items() for s in ss], "head string, synonym string")
    return search.synonym_terms(asked, words)


# -- names and vectors -----------------------------------------------------------------------------------------------------------------------


@query(None)
def duplicate_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of one type whose names are alike by Jaro-Winkler."""
    found = linkage.similar_names(table(spark, folder, "entities"), "entity_id", "name", "entity_type", 0.92)
    return found.withColumn("similarity", F.round("similarity", 6))


_USABLE = "vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0"


@query(f"""with u as (select distinct chunk_id, document_id, vector::double[] v from vectors where {_USABLE}),
    s as (select q.chunk_id query_id, u.chunk_id item_id, round(list_cosine_similarity(q.v, u.v), 6) score from u q join u on q.chunk_id <> u.chunk_id where q.document_id % 100 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, item_id) place from s)
    select query_id, item_id, round(score, 5) score, case when score >= 0.99 then 'skip' when score >= 0.97 then 'flag' else 'update' end as action from r where place = 1 and score >= 0.95""")
def semantic_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk that is most similar to each stated one (of documents divisible by 100), where it is similar enough to be the same, and what to do."""
    vectors = table(spark, folder, "vectors")
    asked = _usable(vectors.filter("document_id % 100 = 0")).select(F.col("chunk_id").alias("query_id"), "vector")
    found = search.vector_topk(vectors, "chunk_id", "vector", asked, k=1).filter("score >= 0.95")
    action = F.when(F.col("score") >= 0.99, "skip").when(F.col("score") >= 0.97, "flag").otherwise("update")
    return found.select("query_id", "item_id", F.round("score", 5).alias("score"), action.alias("action"))


@query("""with p as (select distinct label, embedding[1]::double x, embedding[2]::double y from embeddings where label is not null and isfinite(embedding[1]) and isfinite(embedding[2])),
    a as (select p.label, p.x, p.y, atan2(q.y - p.y, q.x - p.x) t from p join p q on p.label = q.label and (p.x <> q.x or p.y <> q.y)),
    g as (select *, coalesce(lead(t) over w, min(t) over (partition by label, x, y) + 2 * pi()) - t gap from a window w as (partition by label, x, y order by t)),
    c as (select label, x, y from g group by all having max(gap) > pi() + 1e-12),
    f as (select label, min((x, y)) o from c group by 1)
    select label, (row_number() over (partition by label order by case when (x, y) = o then -9 else atan2(y - o[2], x - o[1]) end))::int place, round(x, 5) x, round(y, 5) y from c join f using (label)""")
def cluster_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """The outline of each cluster in the plane of the first two numbers of its vectors."""
    points = table(spark, folder, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return outlines.outlines(points, "label", "x", "y").withColumns({c: F.round(c, 5) for c in ("x", "y")})


# -- time and versions -----------------------------------------------------------------------------------------------------------------------


@query("""with r as (select event_id, ts, user_id % 3 u, 1 + event_id % 3 every, unnest(range(0, 100)) nth from events where event_id % 2 = 0),
    o as (select *, case u when 0 then ts + to_days((nth * every)::int) when 1 then ts + to_days((7 * nth * every)::int) else ts + to_months((nth * every)::int) end at_ from r)
    select event_id, nth::int nth, at_ as "at" from o where at_ between timestamp '2024-01-10' and timestamp '2024-02-10' and (event_id % 4 <> 0 or at_ <= ts + interval 20 day) and at_ <> ts + interval 14 day""")
def rule_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """What rules made from the events of even id bring in a month: some end after 20 days, none is held after a fortnight."""
    unit = F.get(F.array(F.lit("day"), F.lit("week"), F.lit("month")), (F.col("user_id") % 3).cast("int"))
    day = lambda n: F.col("start") + F.make_dt_interval(days=F.lit(n))
    time = lambda x: F.lit(x).cast("timestamp_ntz")
    rules = _spans(spark, folder).filter("event_id % 2 = 0").select(
        "event_id", "start", unit.alias("unit"), (1 + F.col("event_id") % 3).alias("every"), F.when(F.col("event_id") % 4 == 0, day(20)).alias("until"),
        F.array(day(14)).alias("exceptions"), time("2024-01-10").alias("first"), time("2024-02-10").alias("last"),
    )
    return intervals.occurrences(rules, "event_id", "start", "unit", "every", "until", "exceptions", "first", "last")


@query("""with b as (select document_id, arg_max(struct_pack(t := created_at, z := size_bytes, h := content_hash), (created_at, version_number, version_id)) w from doc_versions where created_at <= '2024-06-30' group by 1),
    n as (select document_id, arg_max(struct_pack(t := created_at, z := size_bytes, h := content_hash), (created_at, version_number, version_id)) w from doc_versions group by 1)
    select document_id, case when b.w is null then 'new' when n.w is null then 'deleted' when (coalesce(n.w.t > b.w.t, b.w.t is null and n.w.t is not null) or n.w.z is distinct from b.w.z)
        and coalesce(n.w.h <> b.w.h, coalesce(n.w.t > b.w.t, b.w.t is null and n.w.t is not null)) then 'modified' else 'unchanged' end change from b full join n using (document_id)""")
def changed_by_both(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every document since a day: by time or size first, by hash where these differ."""
    v = table(spark, folder, "doc_versions")
    before = changes.as_of(v, "document_id", F.col("created_at"), ORDER, F.lit("2024-06-30").cast("timestamp_ntz"))
    return changes.changed_by(before, changes.as_of(v, "document_id", F.col("created_at"), ORDER), "document_id", "created_at", "size_bytes", "content_hash")


@query("""select version_id, 'number' reason from doc_versions where version_number = 1 or version_number % 10 = 0
    union select arg_min(version_id, (created_at, version_id)), 'day' from doc_versions where created_at is not null group by document_id, date_trunc('day', created_at)
    union select arg_min(version_id, (created_at, version_id)), 'week' from doc_versions where created_at is not null group by document_id, date_trunc('week', created_at)
    union select arg_min(version_id, (created_at, version_id)), 'month' from doc_versions where created_at is not null group by document_id, date_trunc('month', created_at)""")
def versions_kept_by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return changes.first_of_periods(table(spark, folder, "doc_versions"), "document_id", "created_at", "version_id", "version_number")


@query("""with v as (select version_id, version_number n, storage_kind, lag(storage_kind) over (partition by document_id order by version_number, version_id) before from doc_versions)
    select storage_kind, case when n = 1 or n % 10 = 0 or (before = 'delta' and n % 6 = 0) then 'full' else 'delta' end due, count(*) n_versions from v group by 1, 2""")
def storage_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """How versions are stored, against how they would be by the rule."""
    from pyspark.sql import Window as W

    before = F.lag("storage_kind").over(W.partitionBy("document_id").orderBy("version_number", "version_id"))
    due = table(spark, folder, "doc_versions").select("storage_kind", changes.storage_kind(F.col("version_number"), before).alias("due"))
    return due.groupBy("storage_kind", "due").agg(F.count("*").alias("n_versions"))


@query("""with w as (select document_id, min(version_number) version_number from doc_versions group by 1 having count(*) > 1)
    select document_id, max(l.n) + 1 new_number, max(content_hash) hash, version_number restored_from from w join doc_versions v using (document_id, version_number)
        join (select document_id, max(version_number) n from doc_versions group by 1) l using (document_id) group by 1, 4""")
def restored_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The version that each document with more than one gets when its first is restored."""
    v = table(spark, folder, "doc_versions")
    wanted = v.groupBy("document_id").agg(F.min("version_number").alias("version_number"), F.count("*").alias("n")).filter("n > 1")
    return changes.restored(v, "document_id", "version_number", "content_hash", wanted)
