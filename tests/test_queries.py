"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from spindrift.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(frame):
    out = []
    for r in frame:
        out.append(tuple("" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    assert rows([tuple(r[c] for c in columns) for r in got.collect()]) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert {"profile_id", "job_id", "score", "travel", "place", "review", "shown_rank"} <= set(got.columns) and got.count() > 0
    assert set(Q.queries()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=100)
    assert said.returncode == 0, said.stderr
