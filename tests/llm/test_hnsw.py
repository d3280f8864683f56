import numpy as np
import pytest

from foliant.llm.hnsw import Cells, Graph, most_similar


def groups(seed, n, dim=16, k=12, spread=0.35):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(k, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[rng.integers(k, size=n)] + spread * rng.normal(size=(n, dim))
    x[: n // 20] = rng.normal(size=(n // 20, dim))
    x[n // 2 : n // 2 + 80] = x[n // 2]  # a knot of copies
    return x.astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)


def best(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.sort(s, axis=1)[:, ::-1][:, k - 1]


def test_graph_recall():
    x = groups(1, 3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, edge = best(x, 10)
    found, score = Graph(u).search(u, 11, 64)
    hit = [sum(1 for j in set(f) - {i, -1} if s[i, j] >= edge[i] - 1e-6) for i, f in enumerate(found)]
    assert np.minimum(hit, 10).mean() / 10 > 0.95
    assert all(len(set(f[f >= 0])) == (f >= 0).sum() for f in found)


@pytest.mark.parametrize(("shard_rows", "fan"), [(150, 256), (100, 4), (4096, 256)])
def test_recall_over_shards(spark, shard_rows, fan):
    x = groups(2, 1500)
    rows = [(f"c{i}", [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [("z0", [0.0] * 16, 0), ("z1", None, 0), ("z2", [1.0] * 15, 0), ("z3", [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + rows[:50] + bad, "chunk_id string, vector array<float>, cell int")
    got = {}
    for r in most_similar(df, "chunk_id", "vector", dim=16, shard_rows=shard_rows, fan=fan, margin=0.6).collect():
        got.setdefault(r.query_id, []).append((r.place, int(r.item_id[1:]), r.similarity))
    s, edge = best(x, 10)
    assert set(got) == {f"c{i}" for i in range(1500)} and all(sorted(p for p, _, _ in v) == list(range(1, 11)) for v in got.values())
    hit = [sum(s[i, j] >= edge[i] - 1e-6 for _, j, _ in got[f"c{i}"]) for i in range(1500)]
    assert np.mean(hit) / 10 > 0.98
    assert all(abs(s[i, j] - v) < 1e-5 and i != j for i in range(0, 1500, 50) for _, j, v in got[f"c{i}"])


def test_stated_queries_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 2.0])], "id string, v array<double>")
    asked = spark.createDataFrame([("a",), ("a",), ("nobody",), (None,)], "q string")
    got = [(r.query_id, r.item_id, r.place) for r in most_similar(df, "id", "v", asked, dim=2).orderBy("place").collect()]
    assert got == [("a", "b", 1), ("a", "c", 2)]
    assert most_similar(df.filter("false"), "id", "v", asked, dim=2).count() == 0
    assert most_similar(df.limit(1), "id", "v", dim=2).count() == 0


def test_crowds_of_copies(spark):
    """A vector that a third of all rows share: its items have each other, the rest finds them once."""
    x = groups(3, 300)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in x[0]]) for i in range(150)]
    got = {}
    for r in most_similar(spark.createDataFrame(rows + rows[-20:], "id int, v array<float>"), "id", "v", dim=16, shard_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.place, r.item_id, r.similarity))
    copies = [0, *range(1000, 1150)]
    for i in copies:
        assert [j for _, j, _ in sorted(got[i])] == [j for j in copies[:12] if j != i][:10] and all(s == 1 for _, _, s in got[i])
    assert len(got) == 450 and all(len({j for _, j, _ in v}) == len(v) == 10 for v in got.values())
    asked = spark.createDataFrame([(1149,), (5,)], "q int")
    few = most_similar(spark.createDataFrame(rows, "id int, v array<float>"), "id", "v", asked, dim=16, shard_rows=100).collect()
    assert {(r.query_id, r.item_id) for r in few if r.query_id == 1149} == {(1149, j) for j in copies[:10]} and sum(r.query_id == 5 for r in few) == 10


def test_cells_on_two_levels_agree_with_one():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 8)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    x = m[rng.integers(40, size=500)] + 0.05 * rng.normal(size=(500, 8)).astype(np.float32)
    two, one = Cells(m[::10], [m[k * 10 : k * 10 + 10] for k in range(4)]), Cells(m)
    for a, b in zip(two.near(x, 0.2, 5, reach=4), one.near(x, 0.2, 5)):
        assert (a == b).all()
