"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        kind = out[c].dtype.kind
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif kind in "iuf":
            out[c] = out[c].astype(float)
        elif kind == "O" and any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in out[c].dropna()):
            out[c] = out[c].astype(float)
        else:
            out[c] = out[c].map(lambda x: "null" if x is None or x != x else str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    got, want = plain(entry.queries()[name](spark, FOLDER).toPandas()), plain(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_without_llm():
    """Nothing outside the subpackage llm imports it."""
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "foliant").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"foliant\.llm|from \.+llm|import llm", path.read_text()), path
