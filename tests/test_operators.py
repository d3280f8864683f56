"""Operators on small literal tables: ties, nulls, empty tables, repeated rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.text import heading, snippet
from foliant.functions.vectors import cosine, fault
from foliant.operators import access, changes, dedup, extract, graph, intervals, search, topics
from foliant.operators.components import connected_components
from foliant.plans.queries import QUERIES
from foliant.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_rrf_prefers_items_in_both_arms(spark):
    a = spark.createDataFrame([(1, "x", 3.0), (1, "y", 2.0), (1, "z", None)], "q int, item string, score double")
    b = spark.createDataFrame([(1, "y", 9.0), (1, "w", 1.0)], "q int, item string, score double")
    got = {r.item: r for r in search.rrf([(a, 0.5), (b, 0.5)], "q", "item").collect()}
    assert max(got, key=lambda i: got[i].score) == "y" and got["y"].n_arms == 2 and "z" not in got
    assert math.isclose(got["x"].score, 0.5 / 61)
    assert search.rrf([(a, 0), (b, 1)], "q", "item").count() == 2
    with pytest.raises(ValueError):
        search.rrf([(a, 0)], "q", "item")


def test_min_max_of_equal_scores(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0), (2, 2.0)], "q int, score double")
    assert rows(search.min_max(a, "q"), "q", "normalized") == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.5), (2, 1.0)]


def test_vector_topk_leaves_out_unusable(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])], "id int, v array<double>")
    asked = items.filter("id in (1, 3, 4)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = rows(search.vector_topk(items, "id", "v", asked, k=2), "query_id", "item_id", "place")
    assert got == [(1, 2, 1), (1, 7, 2)]
    assert search.vector_topk(items, "id", "v", asked.filter("false")).count() == 0
    every = items.select(F.col("id").alias("query_id"), F.col("v").alias("vector")).filter("id in (1, 2, 7)")
    want = rows(search.vector_topk(items, "id", "v", every, k=2), "query_id", "item_id", "place")
    assert len(want) == 6 and rows(search.vector_topk(items, "id", "v", every, k=2, max_queries=1), "query_id", "item_id", "place") == want


def test_edit_neighbours_against_brute_force(spark):
    words = ["kesilrick", "kesilrik", "keslirick", "dave", "dav", "davee", "a", "", "ab", "ba"]
    a = spark.createDataFrame([(w,) for w in words], "term string")
    got = rows(search.edit_neighbours(a, a, 2), "term", "near")
    want = rows(a.crossJoin(a.withColumnRenamed("term", "near")).filter(F.levenshtein("term", "near").between(1, 2)), "term", "near")
    assert got == want


def test_name_typos_of_any_letters(spark, tmp_path):
    known = [("person", "Søren Thaligård"), ("person", "Łukasz Bo"), ("organization", "Hafen Jürgen 24"), ("topic", "Sailing"), ("person", None)]
    typed = [("soren thaligard", "Sören", None), ("Łukas", "Thaligåd", "bø"), ("Jurgen", "Hafem 25", "Søren"), ("sailin", "Jürgn", "z")]
    spark.createDataFrame(known, "entity_type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame(typed, "commitment_by string, commitment_to string, follow_up_with string").write.parquet(f"{tmp_path}/detected_actions.parquet")

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
            line = new
        return line[-1]

    words = {w for kind, name in known if name and kind != "topic" for w in name.lower().split()}
    near = {w for row in typed for name in row if name for w in name.lower().split()}
    want = sorted((a, b, 1) for a in words for b in near if edits(a, b) == 1)
    assert rows(QUERIES["name_typos"](spark, str(tmp_path)), "term", "near", "edits") == want
    assert {("søren", "soren", 1), ("łukasz", "łukas", 1), ("bo", "bø", 1), ("jürgen", "jurgen", 1), ("hafen", "hafem", 1), ("24", "25", 1)} <= set(want)


def test_snippet_and_heading(spark):
    text = "## Title here\n" + " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(text, "word150"), ("short word1", "word1"), (None, "x")], "t string, q string")
    got = df.select(snippet(F.col("t"), F.col("q")).alias("s"), heading(F.col("t")).alias("h")).collect()
    assert got[0].s.startswith("...") and got[0].s.endswith("...") and "word150" in got[0].s and 190 < len(got[0].s) < 230
    assert got[1].s == "short word1" and got[2].s is None and got[0].h == "Title here" and got[1].h is None


def test_documents_without_heading_are_queries(spark, tmp_path):
    texts = {100: "# Red Boat\nleft the harbour", 200: "blue boat in the harbour", 300: "# ---\ngreen tree", 400: None, 500: "", 7: "red tree by the boat", 8: "blue harbour blue"}
    asked = {100: {"red", "boat"}, 200: {"blue", "boat", "in", "the", "harbour"}, 300: {"green", "tree"}}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = {d: [w for w in re.split("[^a-z]+", t.lower()) if w] for d, t in texts.items() if t}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    want = {}
    for q, terms in asked.items():
        for d, words in docs.items():
            parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in terms if t in words]
            if parts:
                want[q, d] = round(sum(parts), 5)
    folder = str(tmp_path)
    assert {(r.query_id, r.doc): round(r.score, 5) for r in QUERIES["bm25_search"](spark, folder).collect()} == pytest.approx(want, abs=2e-5)
    snippets = QUERIES["bm25_snippets"](spark, folder).collect()
    assert {r.query_id for r in snippets} == set(asked) and {r.term for r in snippets if r.query_id == 200} == {"harbour"}
    marked = QUERIES["highlighted_hits"](spark, folder).collect()
    assert {texts[r.doc][r.start : r.stop].lower() for r in marked if r.query_id == 300 and r.doc == 7} == {"tree"} and {r.query_id for r in marked} == set(asked)


def test_bm25_of_repeated_ids_ties_and_passes(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(i % 40 if i % 7 else None, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.choice([0, 1, 1, 3, 3, 9])))) for i in range(150)]
    asked = {(q, w) for q in range(12) for w in rng.sample(words, 1 + q % 5)} | {(12, "unknown"), (None, "w1")}
    docs = [(d, t.split()) for d, t in texts if t]
    mean, counts = sum(len(t) for _, t in docs) / len(docs), Counter()
    for d, t in docs:  # rows of one id and length are one document
        for w in t:
            counts[d, len(t), w] += 1
    df = Counter(w for _, _, w in counts)
    scores = Counter()
    for q, w in asked:
        for (d, n, x), tf in counts.items():
            if x == w:
                scores[q, d] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    want = []
    for query in {q for q, _ in scores}:
        ranked = sorted((-round(s, 6), d is not None, d or 0, d) for (q, d), s in scores.items() if q == query)
        want += [(query, d, -s, i) for i, (s, _, _, d) in enumerate(ranked[:5], 1)]
    index = search.postings(spark.createDataFrame(texts, "id int, text string").repartition(3), "id", "text")
    queries = spark.createDataFrame(list(asked), "query_id int, term string")
    for most in (1_000_000, 7):
        got = {(r.query_id, r.place): (r.doc, r.score) for r in search.bm25(index, queries, k=5, max_terms=most).collect()}
        assert {p: d for p, (d, _) in got.items()} == {(q, i): d for q, d, _, i in want}
        assert [got[q, i][1] for q, _, _, i in want] == pytest.approx([s for _, _, s, _ in want], abs=2e-6)
    assert search.bm25(index, queries.filter("false")).collect() == [] == search.bm25(index.filter("false"), queries).collect()


def test_bm25_exchanges_no_postings(spark, tmp_path):
    spark.createDataFrame([(i, f"# tree {i % 3}\nred boat {i}") for i in range(300)], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["bm25_search"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+?)#\d+L?, \d+\)", plan) == ["query_id"] and plan.count("hashpartitioning(") == 1


def _exchanged(df):
    return set(re.findall(r"hashpartitioning\((.+?), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())))


def test_snippets_exchange_texts_and_hits_only(spark, tmp_path):
    texts = [(i, f"# tree {i % 3}\nred boat {i} " + "far " * 60 + f"harbour{i % 5} at sea " + "wide " * 60) for i in range(100, 320)] + [(400, "harbour4")]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["bm25_snippets"](spark, str(tmp_path))
    assert _exchanged(got) <= {"query_id", "doc", "query_id, term"}
    own = [r for r in got.collect() if r.query_id == 400]
    assert [(r.doc, r.term) for r in sorted(own, key=lambda r: r.place)] == [(400, "harbour4"), (104, "harbour4"), (109, "harbour4")]
    assert all("harbour4 at sea" in r.snippet and r.snippet.startswith("...far") and r.snippet.endswith("wide...") for r in own if r.doc != 400)


def test_snippets_exchange_no_texts(spark, tmp_path):
    texts = [(i if i % 9 else None, f"# tree {i % 3}\nred boat {i} " + "far " * 60 + f"harbour{i % 5} at sea") for i in range(100, 320)] + [(301, "tree of another 301"), (400, "harbour4")]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    hits = spark.createDataFrame([(1, 301, 1), (2, 301, 1), (2, 400, 2), (3, 999, 1), (3, None, 2)], "query_id int, doc bigint, place int")
    want = sorted((q, p, d, t) for q, d, p in [(1, 301, 1), (2, 301, 1), (2, 400, 2)] for i, t in texts if i == d)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        assert "doc" not in _exchanged(QUERIES["bm25_snippets"](spark, str(tmp_path)))
        for most_hits, exchanged in ((5, set()), (4, {"doc"})):
            got = search.with_texts(hits, documents, "doc_id", "text", most_hits)
            assert _exchanged(got) == exchanged and rows(got, "query_id", "place", "doc", "text") == want and len(want) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_highlighted_hits_exchange_texts_and_hits_only(spark, tmp_path):
    texts = [(i, f"# tree {i % 3}\nRed tree-boat {i}") for i in range(100, 320)]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["highlighted_hits"](spark, str(tmp_path))
    assert _exchanged(got) <= {"query_id", "doc", "query_id, term"}
    assert {(r.start, r.stop) for r in got.collect() if (r.query_id, r.doc) == (300, 102)} == {(2, 6), (7, 8), (13, 17), (24, 25)}


def test_highlights_of_very_many_places(spark):
    rng = random.Random(5)
    texts = ["ab " * 100_000, *["".join(rng.choices("aAbBcé𝔘 -", k=300)) for _ in range(40)]]
    asked = ["ab", "BA", "c", "é𝔘", "aa", "\\E", "-", "a-b"]
    got = [[(h.start, h.stop) for h in r.h] for r in spark.createDataFrame([(i, t, asked) for i, t in enumerate(texts)], "i int, t string, q array<string>").select("i", search.highlights(F.col("t"), F.col("q")).alias("h")).orderBy("i").collect()]
    assert got[0] == [(i, i + 2) for i in range(0, 300_000, 3)]
    for text, spans in zip(texts[1:], got[1:]):
        spots, ends = set(), set()
        for m in (m for t in asked for m in re.finditer(re.escape(t.lower()), text.lower())):
            spots |= {*range(2 * m.start(), 2 * m.end() + 1)}  # halves, so that adjacent places meet and others don't
        ends = sorted(x for x in spots if x - 1 not in spots), sorted(x for x in spots if x + 1 not in spots)
        assert spans == [(a // 2, z // 2) for a, z in zip(*ends)]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    assert [r.f for r in df.select(fault(F.col("a"), 2).alias("f")).collect()] == [None, "zero", "length"]


def test_components_on_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 30)] + [(50, 50), (None, 3), (40, 41), (41, 40)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = dict(rows(connected_components(df)))
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(1, 30)} == {1} and got[41] == 40 and 50 not in got
    assert connected_components(df.filter("false")).count() == 0


def test_reach_paths_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 1, 1.0), (3, 4, 1.0), (1, 2, 0.8), (5, 5, 1.0)], "src int, dst int, confidence double")
    seeds = spark.createDataFrame([(1,), (9,)], "seed int")
    assert rows(graph.reachable(edges, seeds, 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)]
    paths = {tuple(r.path): r.strength for r in graph.simple_paths(edges, seeds, 3).collect()}
    assert set(paths) == {(1, 2), (1, 2, 3), (1, 2, 3, 4)} and math.isclose(paths[(1, 2, 3)], math.sqrt(0.4))
    assert rows(graph.in_cycles(edges)) == [(1, 2), (2, 3), (3, 1), (5, 5)]
    assert graph.in_cycles(edges.filter("src < dst")).count() == 0
    assert (3, 2, 1) in rows(graph.degrees(edges))


def test_promise_paths_start_at_every_entity(spark, tmp_path):
    names = {1: "Ann", 7: "Bob", 100: "Cy", 205: "Dee", 9: "Eve"}
    said = [("ann", "Bob", 0.5), ("Ann ", "bob", 0.8), ("bob", "cy", None), ("cy", "ann", 1.0), ("Cy", "DEE", 0.9), ("dee", "eve", 0.4), ("dee", "dee", 1.0), ("eve", "nobody", 1.0)]
    spark.createDataFrame([(k, "person", v) for k, v in names.items()], "entity_id bigint, entity_type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    acts = [(i, i, a, b, c, 1, 1) for i, (a, b, c) in enumerate(said)]
    spark.createDataFrame(acts, "action_id bigint, document_id bigint, commitment_by string, commitment_to string, confidence double, ingested_at int, detected_at int").write.parquet(f"{tmp_path}/detected_actions.parquet")
    edges = {(1, 7): 0.8, (7, 100): 0.5, (100, 1): 1.0, (100, 205): 0.9, (205, 9): 0.4}
    want = {}
    for n in (2, 3, 4):
        for path in itertools.permutations(names, n):
            w = [edges.get(e) for e in itertools.pairwise(path)]
            if all(w):
                want[">".join(map(str, path))] = (path[0], n - 1, round(math.prod(w) ** (1 / (n - 1)), 6))
    got = {r.path: (r.seed, r.depth, r.strength) for r in QUERIES["promise_paths"](spark, str(tmp_path)).collect()}
    assert got == want and {v[0] for v in want.values()} == {1, 7, 100, 205}


def test_merge_and_unlink(spark):
    same = spark.createDataFrame([(2, 1), (3, 2)], "a int, b int")
    edges = spark.createDataFrame([(2, 3, "d1", 0.4), (3, 9, "d1", 0.4), (1, 9, "d2", 0.9), (8, 9, None, 0.1)], "src int, dst int, document_id string, confidence double")
    assert rows(graph.redirected(edges, graph.merged_ids(same, "a", "b"))) == [(1, 9, 2, 0.9), (8, 9, 1, 0.1)]
    gone = spark.createDataFrame([("d1",), ("d1",)], "document_id string")
    assert rows(graph.unlink_documents(edges, gone), "src", "dst", "n_left", "fate") == [(1, 9, 1, "kept"), (2, 3, 0, "orphaned"), (3, 9, 0, "orphaned"), (8, 9, 1, "kept")]


def test_minhash_classes_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base, base.replace("w30 ", "x "), base + " more", "tiny text", "tiny text", "", None, "other " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in dedup.minhash_classes(df, "id", "text").collect()}

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    alike = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= 0.8
    for i, j in itertools.combinations(range(9), 2):
        a, b = shingles(texts[i]), shingles(texts[j])
        assert (got[i].group_id == got[j].group_id) == (bool(a) and alike(a, b)), (i, j)
    assert got[1].class_id == 0 and got[0].n_links == 2 and got[6].group_id == 6


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "id int, t string")
    assert rows(dedup.exact_duplicates(df, "id", "t"), "id", "kept_id", "is_duplicate") == [(1, 1, False), (2, 2, False), (3, 1, True)]


def test_changes_and_versions(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    now = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, h string")
    assert rows(changes.classify_changes(before, now, "k", "h")) == [(1, "unchanged"), (2, "modified"), (3, "unchanged"), (4, "new")]
    assert rows(changes.classify_changes(now, before.filter("false"), "k", "h"))[0] == (1, "deleted")
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "k int, n int, h string")
    assert rows(changes.numbered_versions(v, "k", "h", ["n"]), "n", "new_number") == [(1, 1), (3, 2), (4, 3)]


def test_retention_keeps_first_newest_and_tagged(spark):
    v = spark.sql("select 1 k, id n, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) at, if(id = 9, array('release'), cast(array() as array<string>)) tags from range(400)")
    got = dict(rows(changes.retention(v, "k", "at", ["at", "n"], newest=3, days=0), "n", "decision"))
    assert [got[n] for n in (397, 398, 399, 0)] == ["keep_newest"] * 3 + ["keep_first"] and got[24] == "keep_daily" and got[9] == "keep_tagged" and got[25] == "delete"


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(int(rng.integers(3)), i, float(s), float(s + rng.integers(0, 4000))) for i, s in enumerate(rng.integers(0, 20000, 60))]
    df = spark.createDataFrame(data, "k int, id int, s double, e double").select("k", "id", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds(F.col("e") * 1).alias("e"))
    want = sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(data, 2) if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2])
    for bucket in ("hour", "day"):
        assert rows(intervals.overlaps(df, "k", "id", "s", "e", bucket), "k", "id_a", "id_b") == want


def test_islands_and_recurrences(spark):
    t = lambda m: f"timestamp_ntz'2024-01-01 10:{m:02d}:00'"
    df = spark.sql(f"select 1 k, {t(0)} s, {t(30)} e union all select 1, {t(10)}, {t(20)} union all select 1, {t(30)}, {t(40)} union all select 1, {t(50)}, {t(55)} union all select 1, {t(58)}, {t(57)}")
    assert [(r.start.minute, r.end.minute) for r in intervals.islands(df, "k", "s", "e").orderBy("start").collect()] == [(0, 40), (50, 55)]
    rules = spark.sql("select 1 id, timestamp_ntz'2024-01-31 08:00:00' s, 'month' u, 1 e, 3 c union all select 2, timestamp_ntz'2024-01-31 08:00:00', 'year', 1, 3 union all select 3, timestamp_ntz'2024-01-31 08:00:00', 'week', 2, 2")
    assert [(r.id, str(r["at"])[:10]) for r in intervals.recurrences(rules, "id", "s", "u", "e", "c").orderBy("id", "nth").collect()] == [(1, "2024-01-31"), (1, "2024-02-29"), (1, "2024-03-31"), (3, "2024-01-31"), (3, "2024-02-14")]


def test_mentions_together_against_brute_force(spark):
    text = "@office at 9:15 " + "x" * 190 + " 10:30 " + "y" * 400 + " @home 8:00"
    spans = extract.mention_spans(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", ["context", "time"])
    got = rows(extract.together(spans, "context", "time"), "a", "b", "n_pairs")
    assert got == [("@home", "8:00", 1), ("@office", "10:30", 1), ("@office", "9:15", 1)]


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 13), (2, ""), (3, None), (4, "abc")], "id int, t string")
    got = extract.chunks(df, "id", "t", 50, 10).orderBy("doc", "n").collect()
    assert [(r.doc, r.start, len(r.chunk)) for r in got] == [(1, 0, 50), (1, 40, 50), (1, 80, 50), (4, 0, 3)]


def test_cluster_measures(spark):
    pts = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [0.0, 3.0]), (3, 1, [10.0, 1.0]), (4, 1, [10.0, 3.0]), (5, 1, None)], "id int, l int, v array<double>")
    q = topics.quality(pts, "l", "id", "v", 2).first()
    assert q.n == 4 and math.isclose(q.davies_bouldin, 0.2) and math.isclose(q.calinski_harabasz, (4 * 25 / 1) / (4 / 2))
    assert rows(topics.representatives(pts, "l", "id", "v", 2, 1), "l", "id") == [(0, 1), (1, 3)]


def test_globs(spark):
    df = spark.createDataFrame([("a.txt",), ("d/b.txt",), ("d/_c.txt",), ("d/e/f.md",)], "p string")
    pick = lambda *a: [r.p for r in df.filter(files.glob_filter(F.col("p"), *a)).collect()]
    assert pick(["*.txt"]) == ["a.txt"] and pick(["**/*.txt"], ["**/_*"]) == ["a.txt", "d/b.txt"] and pick([], ["d/**"]) == ["a.txt"]


def test_highlights_merge(spark):
    df = spark.createDataFrame([("An Alert, an alert.an ALERTan", ["alert", "an"]), ("a+b a+b", ["a+b", ""]), ("none", ["x"]), (None, ["x"]), ("x", None)], "t string, q array<string>")
    got = [[(h.start, h.stop) for h in r.h] if r.h is not None else None for r in df.select(search.highlights(F.col("t"), F.col("q")).alias("h")).collect()]
    assert got == [[(0, 2), (3, 8), (10, 12), (13, 18), (19, 21), (22, 29)], [(0, 3), (4, 7)], [], [], []]


def test_access(spark):
    members = spark.createDataFrame([("ann", "editor"), ("bob", "guest"), ("cy", None), (None, "guest")], "user string, role string")
    inherits = spark.createDataFrame([("editor", "viewer"), ("viewer", "guest"), ("guest", "viewer"), (None, "x")], "role string, parent string")
    who = access.effective_principals(members, inherits)
    assert [p for u, p in rows(who) if u == "ann"] == ["ann", "editor", "everyone", "guest", "viewer"] and [p for u, p in rows(who) if u == "cy"] == ["cy", "everyone"]
    chain = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(25)], "role string, parent string")
    assert len(rows(access.effective_principals(spark.createDataFrame([("dee", "r0")], "user string, role string"), chain))) == 28
    docs = spark.createDataFrame([(1, "cy"), (2, None), (3, "ann")], "doc int, owner string")
    entries = spark.createDataFrame([(1, "editor"), (1, "editor"), (3, "guest")], "doc int, principal string")
    assert rows(access.readable(docs, entries, who)) == [("ann", 1), ("ann", 3), ("bob", 3), ("cy", 1)]
    assert ("bob", 2) in rows(access.readable(docs, entries, who, open_by_default=True))


def test_readable_counts(spark):
    members = spark.createDataFrame([("ann", "r"), ("bob", "q")], "user string, role string")
    who = access.effective_principals(members, spark.createDataFrame([], "role string, parent string"))
    docs = spark.createDataFrame([(i, "ann" if i % 3 == 0 else None) for i in range(12)], "doc int, owner string")
    entries = spark.createDataFrame([(i, access.EVERYONE) for i in range(0, 12, 2)] + [(1, "q"), (2, "q"), (99, access.EVERYONE)], "doc int, principal string")
    want = access.readable(docs, entries.filter("doc < 99"), who).groupBy("user").count()
    assert rows(access.readable_counts(docs, entries, who)) == rows(want)


def test_malformed_lines_are_returned(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    lines = files.import_jsonl(spark, str(tmp_path / "x.json"), "a int").cache()
    assert rows(files.sound_lines(lines)) == [(1,), (2,)] and rows(files.rejected_lines(lines)) == [("not json",)]


def test_saved_tables_are_removed(spark):
    import os

    from foliant.session import _written, remove_saved, saved

    df = saved(spark.range(3), "some")
    path = _written[-1][1].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    remove_saved()
    assert not os.path.exists(path) and not _written


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 0.5, 1.0), (1, 3, 0.9, None)], "query_id int, item_id int, score double, s double")
    assert [r.item_id for r in search.reranked(hits, F.col("s"), k=2).orderBy("place").collect()] == [2, 1]
