"""Every catalogue query against its SQL on DuckDB, and independence of the number of partitions."""

import os

import duckdb
import pytest

from harfmill import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    if name in plans.ORACLES:
        cursor = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=str)
    else:
        assert got


def test_partitions_do_not_matter(spark):
    for name in ("word_vocab_topk", "early_stop_fold", "size_metrics_by_lang"):
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, plans.QUERIES[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert results[0] == results[1]


def test_filters_reach_the_scan(spark):
    plan = plans.QUERIES["exclude_all_config"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Not(" in plan.replace("IsNotNull(source), ", "") or "PushedFilters" in plan
    assert "ReadSchema: struct<source:string>" in plan
