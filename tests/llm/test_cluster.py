import numpy as np

from foliant.llm.cluster import direction_groups, group_report, merge_middles


def test_groups_knots_and_strays(spark):
    rng = np.random.default_rng(4)
    middle = np.linalg.qr(rng.normal(size=(64, 64)))[0][:8]
    size = [900, 400, 300, 200, 150, 100, 60, 40]
    x, label = [], []
    for k, n in enumerate(size):
        part = middle[k] + 0.1 * rng.normal(size=(n, 64))
        part[: n // 5] = part[0] + 0.02 * rng.normal(size=(n // 5, 64))  # a denser knot
        x.append(part)
        label += [k] * n
    stray = rng.normal(size=(60, 64))
    stray -= stray @ middle.T @ middle  # at right angles to all groups
    x = np.vstack([*x, stray]) * rng.uniform(0.2, 5, (sum(size) + 60, 1))
    rows = [(f"c{i}", i % 7, [float(v) for v in r], "x") for i, r in enumerate(x)]
    bad = [("b0", 1, None, "x"), ("b1", 1, [0.0] * 64, "x"), ("b2", 1, [1.0], "x"), (None, 1, [1.0] * 64, "x")]
    df = spark.createDataFrame(rows + rows[:30] + bad, "chunk_id string, document_id int, vector array<double>, group_no string")
    groups = direction_groups(df, "chunk_id", "vector", dim=64, anchors=64)
    got = {r.item_id: r.group_no for r in groups.collect()}
    assert set(got) == {f"c{i}" for i in range(len(x))}
    for i, k in enumerate(label):
        assert got[f"c{i}"] == k
    assert all(got[f"c{i}"] is None for i in range(sum(size), len(x)))
    report = {r.group_no: r for r in group_report(groups, df, "chunk_id", "document_id").collect()}
    assert report[0].n_rows == 900 and report[0].n_documents == 7 and len(report[3].typical) == 3 and report[None].n_rows == 60


def test_small_groups_beside_large_ones(spark):
    rng = np.random.default_rng(5)
    middle = np.linalg.qr(rng.normal(size=(64, 64)))[0][:4]
    size = [3000, 2000, 40, 15]
    x = np.vstack([middle[k] + 0.1 * rng.normal(size=(n, 64)) for k, n in enumerate(size)])
    stray = rng.normal(size=(200, 64))
    stray -= stray @ middle.T @ middle
    label = np.repeat(np.arange(4), size).tolist() + [None] * len(stray)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.vstack([x, stray]))], "id int, v array<double>")
    got = {r.item_id: r.group_no for r in direction_groups(df, "id", "v", min_rows=8).collect()}
    assert [got[i] for i in range(len(label))] == label


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01])], "id string, v array<double>")
    assert {r.group_no for r in direction_groups(df, "id", "v", dim=2, min_rows=2).collect()} == {0}
    assert {r.group_no for r in direction_groups(df, "id", "v", dim=2).collect()} == {None}
    assert direction_groups(df.filter("false"), "id", "v", dim=2).count() == 0


def test_merging_middles():
    m = np.array([[1.0, 0.0], [0.9, 0.435], [0.0, 1.0]])
    assert len(merge_middles(m, np.array([1, 5, 2]), 0.8)) == 2 and merge_middles(m, np.array([1, 5, 2]), 0.8)[0][0] > 0.9


def test_group_of_a_two_thousandth(spark):
    """A group of 0.05 % of all rows is found."""
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    middle = [axes[0], axes[1], 0.2 * axes[0] + 0.98 * axes[2]]
    x = np.vstack([m + 0.08 * rng.normal(size=(n, 64)) for m, n in zip(middle, (12000, 8000, 10))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<float>")
    got = {r.item_id: r.group_no for r in direction_groups(df, "id", "v", min_rows=8).collect()}
    assert len({got[i] for i in range(20000, 20010)}) == 1 and got[20000] not in (None, got[0], got[12000]) and len({got[i] for i in range(20000)}) == 2
