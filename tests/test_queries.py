"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rasterflow.plans import queries as Q
from rasterflow.plans import standins as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(f"{v:.12g}") + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, con, name):
    got = Q.QUERIES[name](spark, SMALL)
    cur = con.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(k)]) for k in order]) for r in cur.fetchall())
    have = sorted(repr([plain(r[k]) for k in order]) for r in got.collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark):
    plan = Q.QUERIES["history_totals"](spark, SMALL)._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema") :]
    assert "props" not in read.split("\n")[0]
    plan = T.table(spark, SMALL, "lineitem").where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan and "l_tax" not in plan[plan.rindex("ReadSchema") :].split("\n")[0]
