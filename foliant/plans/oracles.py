"""The same results as SQL for DuckDB, for every query that SQL can express."""

from __future__ import annotations

WORDS = r"[^\p{L}\p{N}]+"


def _tokens(text: str, least: int = 1) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '{WORDS}'), lambda t: length(t) >= {least})"


def _source(col: str) -> str:
    return f"replace(lower(trim({col})), '_', '-')"


HEADING = r"nullif(trim(regexp_extract(text, '(?m)^#{1,6} ([^\n]*)$', 1)), '')"
LANG = "case when lower(trim(lang)) in ('und', '') then null else lower(substr(trim(lang), 1, 2)) end"
FAULT = "case when vector is null then 'missing' when len(vector) <> 64 then 'length' when len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not_finite' when len(list_filter(vector, lambda x: x <> 0)) = 0 then 'zero' end"

_ARMS = """
    v as (select query_id, document_id, max(score) score from (select distinct * from vector_results) group by all),
    f as (select query_id, document_id, max(score) score from (select distinct * from fulltext_results) group by all)"""
_RRF = f"""with {_ARMS},
    parts as (
        select query_id, document_id, 0.6 / (60 + row_number() over (partition by query_id order by score desc, document_id)) part from v where score is not null
        union all
        select query_id, document_id, 0.4 / (60 + row_number() over (partition by query_id order by score desc, document_id)) from f where score is not null),
    fused as (select query_id, document_id, round(sum(part), 8) score, count(*) n_arms from parts group by all)"""

_PROMISES = """
    acts as (select * from (select *, row_number() over (partition by action_id order by ingested_at desc, detected_at desc) nth from detected_actions) where nth = 1),
    named as (select entity_id, lower(trim(name)) name from entities where entity_type in ('person', 'organization')),
    edges as (select b.entity_id src, t.entity_id dst, document_id, coalesce(confidence, 0.5) confidence from acts
        join named b on lower(trim(commitment_by)) = b.name join named t on lower(trim(commitment_to)) = t.name where b.entity_id <> t.entity_id)"""

_SPANS = "spans as (select event_id, user_id, ts as s, ts + to_microseconds(cast(round(value * 60, 0) * 1000000 as bigint)) as e from events)"
_ISLANDS = f"""{_SPANS},
    marked as (select user_id, s, e, case when s > max(e) over w or max(e) over w is null then 1 else 0 end as new from spans where e > s
        window w as (partition by user_id order by s, e rows between unbounded preceding and 1 preceding)),
    numbered as (select *, sum(new) over (partition by user_id order by s, e rows unbounded preceding) n from marked),
    islands as (select user_id, min(s) as start, max(e) as "end" from numbered group by user_id, n)"""

_CENTROID = """
    parts as (select label, vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings where len(embedding) = 64),
    means as (select label, i, avg(x) m from parts group by all),
    cent as (select label, list(m order by i) c from means group by label),
    placed as (select e.label, vec_id, list_cosine_similarity(embedding::double[], c) sim, list_distance(embedding::double[], c) dist, c from embeddings e join cent using (label))"""

_MENTIONS = {
    "context": "@[a-z]+", "ticket": r"\b[A-Z]{2}-[0-9]{3,6}\b", "money": r"€[0-9]+|\b[0-9]+(?:\.[0-9]{2})? (?:EUR|credits)\b",
    "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "dotted_date": r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b", "time": r"\b[0-9]{1,2}:[0-9]{2}\b", "checkbox": r"- \[[ x]\]",
}

_SHINGLES = f"""
    one as (select doc_id id, {_tokens("coalesce(min(text), '')")} t from documents group by doc_id),
    sets as (select id, list_sort(list_distinct(case when len(t) > 5 then list_transform(range(1, len(t) - 3), lambda i: list_aggregate(t[i:i + 4], 'string_agg', ' ')) when len(t) > 0 then [list_aggregate(t, 'string_agg', ' ')] else [] end)) s from one),
    members as (select id, case when len(s) = 0 then id else min(id) over (partition by s) end class_id, s from sets),
    classes as (select distinct class_id, s from members where len(s) > 0),
    flat as (select class_id, len(s) n, unnest(s) x from classes),
    met as (select a.class_id a, b.class_id b, a.n na, b.n nb, count(*) n from flat a join flat b on a.x = b.x and a.class_id < b.class_id group by all),
    links as (select a, b from met where n >= 0.8 * (na + nb - n)),
    ways as (select a, b from links union select b, a from links),
    walk as (select a node, a reached from ways union select node, b from walk join ways on reached = a),
    parts as (select node, min(reached) component from walk group by node)"""

ORACLES: dict[str, str] = {
    "bm25_search": f"""
        with t as (select doc_id doc, {_tokens("text")} t from documents), l as (select doc, len(t) dl, t from t where len(t) > 0),
        p as (select doc, dl, unnest(t) term from l), tf as (select doc, dl, term, count(*) tf from p group by all),
        df as (select term, count(*) df from tf group by term), c as (select count(*) n, avg(dl) a from l),
        q as (select distinct query_id, term from (select doc_id query_id, unnest(case when len({_tokens(HEADING)}) > 0 then {_tokens(HEADING)} else {_tokens("text")} end) term from documents where doc_id % 100 = 0)),
        s as (select query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from q join tf using (term) join df using (term), c group by all)
        select * from (select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) place from s) where place <= 10""",
    "vector_search_cosine": f"""
        with u as (select chunk_id, document_id, min(vector)::double[] v from vectors where ({FAULT}) is null group by all),
        s as (select q.chunk_id query_id, u.chunk_id item_id, round(list_cosine_similarity(q.v, u.v), 6) score from u q join u on q.document_id % 100 = 0 and q.chunk_id <> u.chunk_id)
        select * from (select *, row_number() over (partition by query_id order by score desc, item_id) place from s) where place <= 10""",
    "vector_search_l2": """
        with s as (select q.vec_id query_id, u.vec_id item_id, round(1 / (1 + power(list_distance(q.embedding::double[], u.embedding::double[]), 2)), 6) score
            from embeddings q join embeddings u on q.vec_id % 100 = 0 and q.vec_id <> u.vec_id)
        select * from (select *, row_number() over (partition by query_id order by score desc, item_id) place from s) where place <= 10""",
    "chunk_max_pool": """
        select query_id, document_id, score, text best_text, n_hits from (select *, count(*) over w n_hits, row_number() over (w order by score desc nulls last, text) nth
        from (select distinct * from vector_results) window w as (partition by query_id, document_id)) where nth = 1""",
    "rrf_fusion": f"{_RRF} select * from fused",
    "dbsf_fusion": f"""with {_ARMS},
        parts as (select query_id, document_id, 0.6 / (1 + exp(-(score - avg(score) over w) / greatest(stddev_pop(score) over w, 0.001))) part from v where score is not null window w as (partition by query_id)
            union all select query_id, document_id, 0.4 / (1 + exp(-(score - avg(score) over w) / greatest(stddev_pop(score) over w, 0.001))) from f where score is not null window w as (partition by query_id))
        select query_id, document_id, round(sum(part), 6) score, count(*) n_arms from parts group by all""",
    "minmax_scores": f"""with {_ARMS} select *, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) normalized
        from f window w as (partition by query_id)""",
    "hybrid_search": f"""{_RRF},
        top as (select * from (select *, row_number() over (partition by query_id order by score desc, document_id) place from fused) where place <= 10),
        n as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end normalized from top window w as (partition by query_id))
        select query_id, place, document_id, score, round(normalized, 4) normalized, n_arms, {_source("source")} source, {HEADING} heading from n join documents on doc_id = document_id""",
    "reranked_hits": f"""
        with p as (select query_id, document_id, score, snippet from (select *, row_number() over (partition by query_id, document_id order by score desc nulls last, snippet) nth from (select distinct * from fulltext_results)) where nth = 1 and score is not null),
        m as (select query_id, document_id, score, list_distinct({_tokens("snippet")}) own, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end norm,
            row_number() over (partition by query_id order by score desc, document_id) nth from p window w as (partition by query_id)),
        b as (select m.*, t.own wanted, len(list_intersect(m.own, t.own)) n from m join m t on m.query_id = t.query_id and t.nth = 1),
        s as (select query_id, document_id, round(0.4 * norm + 0.6 * n / greatest(len(own) + len(wanted) - n, 1), 6) score from b)
        select * from (select *, row_number() over (partition by query_id order by score desc, document_id) place from s) where place <= 10""",
    "readable_documents": f"""
        with d as (select doc_id doc, author o, {_source("source")} source_id, mime_type from documents),
        users as (select distinct o from d where o is not null),
        may as (select o, doc from d where o is not null
            union select u.o, doc from users u, d where source_id in (select source_id from sources where watching)
            union select u.o, doc from users u join d on substr(u.o, 1, 4) = substr(d.o, 1, 4) where mime_type = 'text/markdown')
        select o "user", count(*) n_documents from may group by 1""",
    "feedback_terms": f"""
        with p as (select query_id, document_id, score, snippet from (select *, row_number() over (partition by query_id, document_id order by score desc nulls last, snippet) nth from (select distinct * from fulltext_results)) where nth = 1 and score is not null),
        h as (select * from (select *, row_number() over (partition by query_id order by score desc, document_id) place from p) where place <= 10),
        t as (select query_id, unnest({_tokens("snippet", 3)}) term from h), c as (select query_id, term, count(*) tf from t group by all having count(*) > 1),
        s as (select *, round(tf / max(tf) over (partition by query_id), 6) score from c)
        select * from (select *, row_number() over (partition by query_id order by score desc, term) place from s) where place <= 3""",
    "filtered_documents": f"""
        select doc_id, {_source("source")} source, {LANG} lang, modified_at from documents
        where {_source("source")} in ('src-pension', 'src-cargo') and mime_type = 'text/markdown' and {LANG} in ('en', 'de') and modified_at between '2024-03-01' and '2025-03-01'""",
    "document_metadata": f"""
        select doc_id, {HEADING} heading, length(text) chars, strlen(text) bytes, len({_tokens("text")}) words, {LANG} lang, trim(coalesce(text, '')) = '' blank from documents""",
    "source_statistics": f"""
        with d as (select {_source("source")} source_id, count(*) n_documents, count(distinct author) n_authors, sum(n_chars) n_chars from documents group by 1)
        select source_id, source_type, status, coalesce(n_documents, 0) n_documents, coalesce(n_authors, 0) n_authors, coalesce(n_chars, 0)::bigint n_chars from sources left join d using (source_id)""",
    "fixed_chunks": """
        with d as (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 64) / 448.0), 1)::bigint)) n from documents where length(text) > 0)
        select doc_id doc, n::int n, (n * 448)::int start, length(substr(text, n * 448 + 1, 512)) chars, md5(substr(text, n * 448 + 1, 512)) md5 from d""",
    "vector_faults": f"select coalesce({FAULT}, 'usable') state, count(*) n_rows, count(distinct chunk_id) n_chunks from vectors group by 1",
    "vocabulary": f"""
        with t as (select doc_id, unnest({_tokens("text", 3)}) term from documents) select term, count(*) tf, count(distinct doc_id) df from t group by term""",
    "source_keywords": f"""
        with t as (select {_source("source")} source, unnest({_tokens("text", 3)}) term from documents where source is not null),
        c as (select source, term, count(*) tf from t group by all), d as (select term, count(*) df from c group by term), n as (select count(distinct source) n from c),
        s as (select source, term, tf, df, round(tf * (ln(n / df) + 1), 6) score from c join d using (term), n)
        select * from (select *, row_number() over (partition by source order by score desc, term) place from s) where place <= 5""",
    "jsonl_round_trip": "select doc_id, lang, source, n_chars, sha256(text) hash, modified_at from documents",
    "exact_duplicates": "select doc_id id, sha256(text) hash, min(doc_id) over (partition by text) kept_id, doc_id <> min(doc_id) over (partition by text) is_duplicate from documents where text is not null",
    "near_duplicate_documents": f"""with recursive {_SHINGLES}
        select id, class_id, coalesce(component, class_id) group_id, coalesce(n, 0) n_links from members left join parts on node = class_id left join (select a, count(*) n from ways group by a) on a = class_id""",
    "changed_documents": """
        with b as (select document_id, arg_max(content_hash, (created_at, version_number, version_id)) h from doc_versions where created_at <= '2024-06-30' group by 1),
        n as (select document_id, arg_max(content_hash, (created_at, version_number, version_id)) h from doc_versions group by 1)
        select document_id, case when b.h is null then 'new' when n.h is null then 'deleted' when b.h = n.h then 'unchanged' else 'modified' end change from b full join n using (document_id)""",
    "change_summary": """
        with b as (select document_id, arg_max(content_hash, (created_at, version_number, version_id)) h from doc_versions where created_at <= '2024-06-30' group by 1),
        n as (select document_id, arg_max(content_hash, (created_at, version_number, version_id)) h from doc_versions group by 1)
        select case when b.h is null then 'new' when n.h is null then 'deleted' when b.h = n.h then 'unchanged' else 'modified' end change, count(*) n from b full join n using (document_id) group by 1""",
    "version_numbers": """
        with v as (select *, lag(content_hash) over (partition by document_id order by created_at, version_number, version_id) was from doc_versions)
        select version_id, document_id, version_number, row_number() over (partition by document_id order by created_at, version_number, version_id) new_number from v where was is distinct from content_hash or was is null""",
    "retention_decisions": """
        with v as (select *, row_number() over (partition by document_id order by created_at desc, version_number desc, version_id desc) nth, row_number() over (partition by document_id order by created_at, version_number, version_id) first,
            row_number() over (partition by document_id, created_at::date order by created_at, version_number, version_id) d, row_number() over (partition by document_id, date_trunc('week', created_at) order by created_at, version_number, version_id) w,
            date_diff('day', created_at::date, (max(created_at) over ())::date) age from doc_versions)
        select version_id, document_id, case when nth <= 5 then 'keep_newest' when age <= 30 then 'keep_recent' when first = 1 then 'keep_first' when d = 1 and age <= 365 then 'keep_daily' when w = 1 then 'keep_weekly' when len(tags) > 0 then 'keep_tagged' else 'delete' end decision from v""",
    "stale_chunks": """
        select chunk_id, x.document_id, x.version_id, x.created_at from (select chunk_id, arg_max({'document_id': document_id, 'version_id': version_id, 'created_at': created_at}, (created_at, version_id)) x from chunk_versions group by 1)
        where chunk_id not in (select chunk_id from vectors)""",
    "orphaned_hits": "select query_id, count(*) n_hits, count(distinct document_id) n_documents from (select distinct * from vector_results) where chunk_id not in (select chunk_id from vectors) group by 1",
    "text_drift": f"""
        with n as (select chunk_id, min(text) now from vectors group by 1), t as (select distinct query_id, chunk_id, text from vector_results),
        b as (select query_id, chunk_id, text = now same, list_distinct({_tokens("text")}) a, list_distinct({_tokens("now")}) b from t join n using (chunk_id)), s as (select *, len(list_intersect(a, b)) n from b)
        select query_id, chunk_id, same, (len(a) - n)::int removed, (len(b) - n)::int added, round(n / greatest(len(a) + len(b) - n, 1), 6) similarity from s""",
    "mention_counts": "with m as (" + " union all ".join(f"select doc_id, '{k}' kind, unnest(regexp_extract_all(text, '{p}')) mention from documents" for k, p in _MENTIONS.items()) + ") select kind, mention, count(*) n, count(distinct doc_id) n_docs from m group by all",
    "entity_statistics": "select entity_type, count(*) n, round(sum(confidence::decimal(18,6))::double / count(confidence), 6) confidence, count(*) filter (len(aliases) > 0) n_with_alias, max(updated_at) last_update from entities group by 1",
    "latest_actions": f"with {_PROMISES} select action_type, date_trunc('month', detected_at)::timestamp as month, count(*) n, count(distinct document_id) n_documents, round(sum(confidence::decimal(18,6))::double / count(confidence), 6) confidence from acts group by 1, 2",
    "promise_degrees": f"with {_PROMISES}, e as (select distinct src, dst from edges), x as (select src node, 1 o, 0 i from e union all select dst, 0, 1 from e) select node, sum(o)::bigint n_out, sum(i)::bigint n_in from x group by 1",
    "promise_reach": f"""with recursive {_PROMISES}, e as (select distinct src, dst from edges),
        walk as (select distinct src seed, src node, 0 depth from e union select seed, dst, depth + 1 from walk join e on node = src where depth < 3) select seed, node, min(depth) depth from walk group by all""",
    "promise_paths": f"""with recursive {_PROMISES}, e as (select src, dst, max(confidence) w from edges group by all),
        walk as (select distinct src seed, src node, [src] path, 0 depth, 0.0::double logs from e
            union all select seed, dst, list_append(path, dst), depth + 1, logs + ln(w) from walk join e on node = src where depth < 3 and not list_contains(path, dst))
        select seed, array_to_string(path, '>') path, depth, round(exp(logs / depth), 6) strength from walk where depth > 0""",
    "promise_cycles": f"""with recursive {_PROMISES}, e as (select distinct src, dst from edges), walk as (select src a, dst b from e union select a, dst from walk join e on b = src),
        c as (select a node from walk where a = b), ahead as (select a node from walk where b in (select node from c) union select node from c), back as (select b node from walk where a in (select node from c) union select node from c)
        select src, dst from e where src in (select node from back) and dst in (select node from ahead)""",
    "promise_components": f"""with recursive {_PROMISES}, ways as (select src a, dst b from edges union select dst, src from edges), walk as (select a node, a reached from ways union select node, b from walk join ways on reached = a),
        p as (select node, min(reached) component from walk group by node) select component, count(*) n_nodes from p group by 1""",
    "unlinked_promises": f"""with {_PROMISES}, r as (select distinct src, dst, document_id from edges), c as (select src, dst, count(*) n_refs, count(*) filter (document_id not in (select doc_id from documents where mime_type is null)) n_left from r group by all)
        select *, case when n_left = 0 then 'orphaned' when n_left < n_refs then 'updated' else 'kept' end fate from c""",
    "cluster_coherence": f"with {_CENTROID} select label, count(*) n, round(avg(sim), 5) coherence, round(avg(dist), 5) spread from placed group by 1",
    "cluster_representatives": f"""with {_CENTROID}, s as (select label, vec_id id, round(-dist, 6) score from placed)
        select label, id, round(score, 5) score, place from (select *, row_number() over (partition by label order by score desc, id) place from s) where place <= 3""",
    "cluster_quality": f"""with {_CENTROID}, per as (select label, count(*) n, avg(dist) spread, sum(dist * dist) inside, any_value(c) c from placed group by 1),
        mid as (select list(m order by i) m from (select i, avg(x) m from parts group by i)), ratio as (select a.label, max((a.spread + b.spread) / list_distance(a.c, b.c)) worst from per a join per b on a.label <> b.label group by 1)
        select sum(n)::bigint n, count(*) n_clusters, round((sum(n * power(list_distance(c, m), 2)) / (count(*) - 1)) / (sum(inside) / (sum(n) - count(*))), 4) calinski_harabasz, (select round(avg(worst), 4) from ratio) davies_bouldin from per, mid""",
    "overlapping_events": f"""with {_SPANS} select a.user_id, a.event_id id_a, b.event_id id_b, round(epoch_us(least(a.e, b.e)) / 60e6 - epoch_us(greatest(a.s, b.s)) / 60e6, 3) as minutes
        from spans a join spans b on a.user_id = b.user_id and a.event_id < b.event_id and a.s < b.e and b.s < a.e and a.e > a.s and b.e > b.s""",
    "busy_islands": f'with {_ISLANDS} select user_id, start, "end" from islands',
    "free_time": f"""with {_ISLANDS}, days as (select user_id, unnest(generate_series(min(start)::date::timestamp, max("end")::date::timestamp, interval 1 day))::date as day from islands group by 1),
        work as (select *, day + interval 9 hour o, day + interval 17 hour c from days where isodow(day) < 6),
        marks as (select w.user_id, day, greatest(start, o) s, least("end", c) e from work w join islands i on w.user_id = i.user_id and start < c and "end" > o
            union all select user_id, day, o, o from work union all select user_id, day, c, c from work),
        g as (select user_id, day, max(e) over (partition by user_id, day order by s, e rows between unbounded preceding and 1 preceding) free_from, s free_until from marks)
        select * from g where free_until - free_from >= interval 30 minute""",
    "recurring_events": """
        with r as (select event_id, ts, user_id % 3 u, 1 + event_id % 3 every, unnest(range(0, 5)) nth from events)
        select event_id, nth::int nth, case u when 0 then ts + to_days((nth * every)::int) when 1 then ts + to_days((7 * nth * every)::int) else ts + to_months((nth * every)::int) end "at" from r""",
    "daily_share": "select *, round(n / sum(n) over (partition by day), 6) share from (select ts::date as day, event_type, count(*) n, count(distinct user_id) n_users from events group by all)",
    "stream_hourly": "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 2) total from events group by all",
    "stream_sessions": """
        with a as (select user_id, ts, case when ts > lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end new from events window w as (partition by user_id order by ts)),
        b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from a) select user_id, min(ts) session_start, max(ts) + interval 6 hour session_end, count(*) n from b group by user_id, k""",
    "stream_first_seen": "select distinct user_id, event_type from events",
}
