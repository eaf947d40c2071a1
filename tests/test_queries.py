import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("driver tables are absent", allow_module_level=True)

duckdb = pytest.importorskip("duckdb")

from strandline.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


SQL = registry.oracle_sql() | registry.small_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(SQL[name])
    assert got == table(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000 and set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
