"""Every query of the catalogue that has SQL against that SQL, on the smallest tables."""

import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from gaugeworks.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def found(spark, request):
    """Columns and rows of each query that a test asks for, several at a time."""

    def run(name):
        df = QUERIES[name](spark, SF)
        return df.columns, df.collect()

    wanted = [i.callspec.params["name"] for i in request.session.items if i.nodeid.startswith(request.node.nodeid + "::") and hasattr(i, "callspec")]
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in wanted}
        pool.shutdown(cancel_futures=True)


def _key(values):
    return tuple(round(v, 5) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(found, sql, name):
    names, rows = found[name].result()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = sql.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(names) == columns
    place = [want.columns.index(c) for c in columns]
    assert Counter(_key(r[c] for c in columns) for r in rows) == Counter(_key(r[k] for k in place) for r in want.fetchall())
