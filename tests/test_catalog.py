"""Every catalog query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from chronofold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted(names), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = sql.execute(catalog.ORACLE_SQL[name])
    assert plain(found.collect(), found.columns) == plain(wanted.fetchall(), [c[0] for c in wanted.description])


def test_every_query_has_rows(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_topics_are_filters_that_reach_the_scan(spark):
    plan = catalog.mr_multimap_monthly(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(event_type), EqualTo(event_type,") == 2 and "props" not in plan
    assert "PushedFilters" in (p := catalog.kv_prefix(spark, SF)._jdf.queryExecution().executedPlan().toString()) and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p
