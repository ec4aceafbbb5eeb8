import glob
import os

import duckdb
import pandas as pd
import pytest

from sievework.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Their SQL has experiments that the smallest tables cannot support.
BIG = {"all_splits", "locked_split_counts"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - BIG))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    try:
        got = catalogue.queries()[name](spark, SF)
    except ValueError:
        pytest.skip("too few rows at this size")
    got, want = got.toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def plain(d):
        cell = lambda v: None if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
        return sorted((tuple(cell(v) for v in row) for row in d[sorted(d.columns)].itertuples(index=False)), key=str)

    assert plain(got) == plain(want)


def test_every_query_is_callable():
    assert all(callable(f) for f in catalogue.queries().values())
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_needs_no_session():
    """The catalogue can be read before there is a session."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
