import hashlib
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.queries import p1_pieces
from foliant.llm.split import PARAGRAPH, WORD, boundary_levels, cuts, placed_pieces, split_oversized


def one_by_one(raw, limit, overlap):
    """The same rules, a piece after the other."""
    n, level = len(raw), np.zeros(len(raw) + 1, int)
    at, kind = boundary_levels(raw)
    level[at] = kind
    whole = [i for i in range(n + 1) if i == n or raw[i] & 0xC0 != 0x80]
    s, out = 0, []
    while True:
        e = n
        if s + limit < n:
            e = max(i for i in whole if i <= s + limit)
            e = e if e > s else n
            for k in range(WORD, PARAGRAPH + 1):
                least = s + (limit // 2 if k > WORD else 2 * overlap)
                some = [i for i in range(least + 1, s + limit + 1) if level[i] >= k]
                e = some[-1] if some else e
        out.append((s, e))
        if e >= n:
            return out
        want = e - overlap
        low = max([i for i in range(want + 1) if level[i] >= WORD])
        high = min([i for i in range(want, n + 1) if level[i] >= WORD])
        near = high if high < e and high - want < want - low else low
        if not (s < near < e and near >= e - 2 * overlap):
            near = max(i for i in whole if i <= want)
        s = near if near > s else e


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n。é😀!"), max_size=300))
def test_cuts_equal_the_sequential_rules(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    for limit, overlap in ((8, 2), (8, 0), (13, 3), (30, 0)):
        start, end = cuts(raw, limit, overlap)
        assert list(zip(start.tolist(), end.tolist())) == one_by_one(raw, limit, overlap)
    start, end = cuts(raw, 40, 8)
    assert list(zip(start.tolist(), end.tolist())) == one_by_one(raw, 40, 8)
    assert start[0] == 0 and end[-1] == len(raw) and all(b >= a for a, b in zip(start[1:], start)) is (len(start) == 1) or (np.diff(start) > 0).all()
    assert ((end - start) <= 40).all() and (start[1:] <= end[:-1]).all()
    for a, b in zip(start, end):
        raw[a:b].tobytes().decode("utf-8")


def test_memory_goes_with_boundaries():
    """Below 40 bytes for each byte of the text, whether it has words or not."""
    for word in ("several words here ", "文字"):
        raw = np.frombuffer((word * 200_000).encode(), np.uint8)
        tracemalloc.start()
        start, end = cuts(raw, 1000, 100)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert end[-1] == len(raw) and ((end - start) <= 1000).all()
        assert peak < 40 * len(raw), peak / len(raw)


def test_prefers_paragraphs_and_overlaps(spark):
    text = "\n\n".join("Sentence one here. Sentence two there." + " filler" * 40 for _ in range(12))
    df = spark.createDataFrame([("a", text, 1), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, "é" * 900, 1), ("a", text, 1)], "id string, text string, piece_no int")
    got = split_oversized(df, "id", "text").collect()
    assert {r.item_id for r in got} == {"a", None}
    first = sorted({(r.piece_no, r.byte_start, r.byte_length, r.piece_text) for r in got if r.item_id == "a"})
    assert all(n <= 1000 for _, _, n, _ in first) and [r[0] for r in first] == list(range(len(first)))
    assert all(p[3].endswith("\n\n") for p in first[:-1])
    assert all(abs(a[1] + a[2] - b[1] - 100) <= 30 for a, b in zip(first, first[1:]))
    assert len(got) == 2 * len(first) + 2
    assert split_oversized(df.filter("false"), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", 100, 50)


def test_places_move_back(spark):
    pieces = spark.createDataFrame([("d-0", 0, 0, 900, "x"), ("d-0", 1, 800, 900, "y"), ("d-2", 0, 0, 1000, "z"), ("d-2", 1, 900, 200, "w"), ("e-0", 0, 0, 5, "q")], "item_id string, piece_no int, byte_start bigint, byte_length bigint, piece_text string")
    placed = spark.createDataFrame([("v1", 7, "d-0", 0, 0, 1), ("v1", 7, "d-1", 1, 1700, 1), ("v1", 7, "d-2", 2, 1800, 1), ("v0", 7, "d-2", 9, 9, 0)], "version_id string, document_id bigint, chunk_id string, position int, byte_offset bigint, created_at int")
    got = sorted((r.chunk_id, r.document_id, r.position, r.byte_offset) for r in placed_pieces(pieces, placed).collect())
    assert got == [("d-0", 7, 0, 0), ("d-0", 7, 1, 800), ("d-2", 7, 3, 1800), ("d-2", 7, 4, 2700), ("e-0", None, 0, 0)]


def test_found_texts_are_cut_and_placed_too(spark, tmp_path):
    """Chunk a is indexed and found, with two texts; b is found only; c is indexed behind both."""
    now, then, gone = "now " * 400, "then " * 500, "gone " * 300
    spark.createDataFrame([("a", now), ("a", now), ("c", now), ("s", "short")], "chunk_id string, text string").write.parquet(f"{tmp_path}/vectors.parquet")
    spark.createDataFrame([("a", now), ("a", then), ("a", then), ("b", gone), ("d", gone), ("s", "short")], "chunk_id string, text string").write.parquet(f"{tmp_path}/vector_results.parquet")
    placed = [("v", 7, c, k, 2000 * k, 1) for k, c in enumerate("abcd")]
    spark.createDataFrame(placed, "version_id string, document_id bigint, chunk_id string, position int, byte_offset bigint, created_at int").write.parquet(f"{tmp_path}/chunk_versions.parquet")
    got = {}
    for r in sorted(p1_pieces(spark, str(tmp_path)).collect(), key=lambda r: r.byte_offset):
        got.setdefault((r.record_table, r.chunk_id, r.text_hash), []).append(r)
    key = lambda t, c, text: (t, c, hashlib.md5(text.encode()).hexdigest())
    first = {key("vectors", "a", now): 0, key("vectors", "c", now): 3, key("vector_results", "a", now): 0, key("vector_results", "a", then): 0, key("vector_results", "b", gone): 2, key("vector_results", "d", gone): 6}
    assert set(got) == set(first)
    for (_, chunk, digest), part in got.items():
        text = next(t for t in (now, then, gone) if hashlib.md5(t.encode()).hexdigest() == digest)
        assert [r.position for r in part] == list(range(first[part[0].record_table, chunk, digest], first[part[0].record_table, chunk, digest] + len(part)))
        assert all(r.text == text[r.byte_offset - 2000 * "abcd".index(chunk) :][: r.byte_length] and r.byte_length <= 1000 for r in part)
        assert part[0].byte_offset == 2000 * "abcd".index(chunk) and part[-1].byte_offset + part[-1].byte_length == part[0].byte_offset + len(text)
