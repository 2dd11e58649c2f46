"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from sendegraph.plans import further, more, problems, registry  # noqa: E402, F401

QUERIES = {**registry.QUERIES, **problems.QUERIES}
ORACLE = {**registry.ORACLE, **problems.ORACLE}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(str([None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE:
        e = duck.execute(ORACLE[name])
        cols = [d[0] for d in e.description]
        assert sorted(cols) == sorted(df.columns)
        assert plain(got) == plain([[r[cols.index(c)] for c in df.columns] for r in e.fetchall()])
