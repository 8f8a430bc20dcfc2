import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["flagship", "clip_median", "reference_closest", "flag_smooth_multi", "interpolate_linear", "smooth_runningmedian_1d", "p3_found", "p3_coverage"])
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    norm = lambda rows, names: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in (r[names.index(c)] for c in cols)) for r in rows)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
