"""Chunks, outlines, alike names, versions and expansions against brute force and on odd rows."""

import random
from datetime import datetime as T
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import changes, chunking, intervals, linkage, outlines, search


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_natural_chunks(spark):
    sentences = "One sentence stands here. " * 60
    df = spark.createDataFrame([(1, sentences, 7), (2, "x" * 1200, 7), (3, None, 7), (4, "", 7), (5, " \n ", 7), (6, "Short.", 7), (None, "Short.", 7), (6, "Short.", 7)], "id int, text string, chunk int")
    got = chunking.natural_chunks(df, "id", "text").collect()
    assert {r.doc for r in got} == {1, 2, 6, None} and sum(r.doc == 6 for r in got) == 2
    for doc, text in ((1, sentences), (2, "x" * 1200)):
        part = sorted((r for r in got if r.doc == doc), key=lambda r: r.n)
        assert part[0].start == 0 and part[-1].stop == len(text)
        assert all(r.chunk == text[r.start : r.stop] for r in part)
        assert all(b.start == a.stop - 64 for a, b in zip(part, part[1:]))
        assert all(r.stop - r.start <= 513 for r in part[:-1])
    assert all(r.chunk.endswith(".") for r in got if r.doc == 1 and r.stop < len(sentences))
    assert [r.stop - r.start for r in sorted((r for r in got if r.doc == 2), key=lambda r: r.n)] == [512, 512, 304]
    assert chunking.break_point("aaaa\n\n\nbbbb. cc dd", 0, 8, 5) == 7
    assert chunking.break_point("aa bb. cc", 0, 7, 5) == 6
    assert chunking.natural_chunks(df.filter("false"), "id", "text").count() == 0
    with pytest.raises(ValueError):
        chunking.natural_chunks(df, "id", "text", 100, 60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert chunking.common_lines(a, b) == table[-1][-1]


def test_line_changes(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n", "a\nx\nc\nd"), (2, None, "a\nb"), (3, None, None), (4, "same\n", "same"), (None, "a", "b")], "key int, was string, n_same string")
    assert rows(chunking.line_changes(df, ["key"], "was", "n_same"), "key", "n_same", "n_added", "n_removed") == [(1, 2, 2, 1), (2, 0, 2, 0), (3, 0, 0, 0), (4, 1, 0, 0), (None, 0, 1, 1)]
    assert chunking.line_changes(df.filter("false"), ["key"], "was", "n_same").count() == 0


def test_jaro_winkler():
    assert linkage.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert linkage.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert linkage.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert linkage.jaro_winkler("abc", "xyz") == 0 and linkage.jaro_winkler("", "a") == 0


def test_similar_names_lose_nothing(spark):
    rng = random.Random(3)
    base = ["Søren Kraft", "Anna Weiss", "Robotics Guild", "Ada", "Al", "Harbour Society"]
    names = base + ["".join(c for c in n if rng.random() > 0.1) for n in base * 8] + [n[:-2] + n[-1] + n[-2] for n in base]
    data = [(i, n, "ab"[i % 2]) for i, n in enumerate(names)] + [(900, None, "a"), (901, "", "a"), (902, "Ada", None), (903, "ADA", "a"), (903, "ADA", "a")]
    df = spark.createDataFrame(data, "similarity int, name string, kind string")
    want = set()
    for (i, a, p), (j, b, q) in combinations(sorted(set(data), key=lambda r: r[0]), 2):
        if a and b and p and p == q and linkage.jaro_winkler(a.lower(), b.lower()) >= 0.9:
            want.add((p, i, j))
    got = linkage.similar_names(df, "similarity", "name", "kind", 0.9).collect()
    assert {(r.kind, r.id_a, r.id_b) for r in got} == want and len(got) == len(want) > 20
    assert linkage.similar_names(df.filter("false"), "similarity", "name", "kind").count() == 0
    with pytest.raises(ValueError):
        linkage.similar_names(df, "similarity", "name", "kind", 0.5)


def test_outlines(spark):
    square = [("s", float(x), float(y)) for x in range(5) for y in range(5)]
    odd = [("o", 1.0, 2.0), ("o", 1.0, 2.0), (None, 9.0, 9.0), ("s", None, 99.0), ("s", float("nan"), 99.0), ("s", float("inf"), 0.0), ("l", 0.0, 0.0), ("l", 1.0, 1.0), ("l", 2.0, 2.0)]
    df = spark.createDataFrame(square + odd, "g string, x double, place double").repartition(5)
    got = rows(outlines.outlines(df, "g", "x", "place"), "g", "place", "x", "y")
    assert got == sorted([("s", 1, 0.0, 0.0), ("s", 2, 4.0, 0.0), ("s", 3, 4.0, 4.0), ("s", 4, 0.0, 4.0), ("o", 1, 1.0, 2.0), ("l", 1, 0.0, 0.0), ("l", 2, 2.0, 2.0)], key=str)
    assert outlines.outlines(df.filter("false"), "g", "x", "place").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=3, max_size=40))
def test_corners_hold_all_points(points):
    p = np.array(points, float)
    c = outlines.corners(p)
    turn = lambda a, b, x: (b[0] - a[0]) * (x[1] - a[1]) - (b[1] - a[1]) * (x[0] - a[0])
    assert all(turn(a, b, x) >= 0 for a, b in zip(c, np.roll(c, -1, axis=0)) for x in p)
    assert {tuple(x) for x in c} <= {tuple(x) for x in p}


def test_changed_by(spark):
    kind = "id int, t int, z int, h string"
    was = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "a"), (3, 1, 1, "a"), (4, 1, 1, "a"), (5, 1, 1, None), (6, None, None, None)], kind)
    now = spark.createDataFrame([(1, 1, 1, "a"), (2, 2, 1, "a"), (3, 1, 1, "b"), (5, 2, 1, None), (6, None, None, None), (7, 1, 1, "a")], kind)
    told = {s: dict(rows(changes.changed_by(was, now, "id", "t", "z", "h", s), "id", "change")) for s in ("hash", "time", "both")}
    sure = {4: "deleted", 5: "modified", 6: "unchanged", 7: "new", 1: "unchanged"}
    assert told["hash"] == sure | {2: "unchanged", 3: "modified"}
    assert told["time"] == sure | {2: "modified", 3: "unchanged"}
    assert told["both"] == sure | {2: "unchanged", 3: "unchanged"}


def test_version_rules(spark):
    v = spark.createDataFrame([(1, "a", T(2024, 1, 1, 8), 1), (1, "b", T(2024, 1, 1, 9), 2), (1, "c", T(2024, 1, 2), 3), (1, "d", None, 10), (2, "e", T(2024, 1, 1, 8), 2), (2, "f", T(2024, 1, 1, 8), 3)], "doc int, id string, at timestamp, no int")
    kept = rows(changes.first_of_periods(v, "doc", "at", "id", "no"), "id", "reason")
    assert kept == sorted([("a", "number"), ("a", "day"), ("a", "week"), ("a", "month"), ("c", "day"), ("d", "number"), ("e", "day"), ("e", "week"), ("e", "month")])
    kinds = v.select("id", changes.storage_kind(F.col("no"), F.when(F.col("id") != "e", "delta"), 4).alias("k"), changes.storage_kind(F.col("no"), F.lit(None), 0).alias("all"))
    assert rows(kinds, "id", "k") == [("a", "full"), ("b", "delta"), ("c", "full"), ("d", "delta"), ("e", "delta"), ("f", "full")] and {r.all for r in kinds.collect()} == {"full"}
    wanted = spark.createDataFrame([(1, 2), (2, 9)], "doc int, no int")
    assert rows(changes.restored(v, "doc", "no", "id", wanted), "doc", "new_number", "hash", "restored_from") == [(1, 11, "b", 2)]


def test_occurrences(spark):
    rules = spark.createDataFrame([
        (1, T(2024, 1, 1), "day", 1, T(2024, 1, 5), [T(2024, 1, 3)]), (2, T(2024, 1, 31), "month", 1, None, None), (3, T(2024, 1, 1), "year", 1, None, None), (4, None, "day", 1, None, None),
    ], "id int, start timestamp, unit string, every int, until timestamp, nots array<timestamp>").withColumn("a", F.lit(T(2024, 1, 2))).withColumn("z", F.lit(T(2024, 3, 31)))
    got = rows(intervals.occurrences(rules, "id", "start", "unit", "every", "until", "nots", "a", "z"), "id", "nth", "at")
    assert got == [(1, 1, T(2024, 1, 2)), (1, 3, T(2024, 1, 4)), (1, 4, T(2024, 1, 5)), (2, 0, T(2024, 1, 31)), (2, 1, T(2024, 2, 29)), (2, 2, T(2024, 3, 31))]


def test_synonym_terms(spark):
    words = spark.createDataFrame([("find", "search"), ("find", "query"), ("error", "fault")], "head string, synonym string")
    terms = spark.createDataFrame([(1, "find"), (1, "query"), (2, "fnd"), (2, "eror"), (3, None), (4, "other")], "query_id int, term string")
    assert rows(search.synonym_terms(terms, words), "query_id", "term", "score", "place") == [(1, "search", 0.9, 1), (2, "fault", 0.7, 1), (2, "query", 0.7, 2), (2, "search", 0.7, 3)]
    assert search.synonym_terms(terms.filter("false"), words).count() == 0
