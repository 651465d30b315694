import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from granthika import queries as core

BASE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, name):
    rows = entry.queries()[name](spark, BASE).collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in rows) == want


def test_entry(spark):
    if os.path.isdir(BASE):
        rows = entry.entry(spark)
        assert rows.columns == ["book_id", "chapter_id", "batch_no", "n", "prior_context"] and rows.count() > 0
