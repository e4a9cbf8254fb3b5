"""Estimates against their SQL on planted customers, and what their plans read."""

import duckdb
import pytest

from ondol.functions import values as V
from ondol.functions.dialect import Duck
from ondol.plans import estimates, quotes, registry

SF = "/root/testdata/sf0.001"


def planted(folder, orders: str):
    for t in ("customer", "lineitem"):
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet'")
    duckdb.sql(f"COPY ({orders}) TO '{folder}/orders.parquet'")
    return str(folder)


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]}) z").fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want, key=repr) and rows
    return rows


@pytest.mark.parametrize("name", ["retrieved_cases", "partial_retrieval", "leak_check"])
def test_one_customer_has_most_records(spark, tmp_path, name):
    """Its own request leaves out the first 15 of every cell, and more."""
    folder = planted(tmp_path, f"SELECT * REPLACE (CASE WHEN o_orderkey % 5 < 4 THEN 20 ELSE o_custkey END AS o_custkey) FROM '{SF}/orders.parquet'")
    same(spark, folder, name)


def test_few_records_take_later_stages(spark, tmp_path):
    stages = set()
    for i, n in enumerate((9, 40, 160)):
        (tmp_path / str(i)).mkdir()
        folder = planted(tmp_path / str(i), f"SELECT * FROM '{SF}/orders.parquet' ORDER BY o_orderkey LIMIT {n}")
        stages |= {r[1] for r in same(spark, folder, "retrieved_cases")}
    assert stages == {1, 2, 3, 4}


@pytest.mark.parametrize("name", ["retrieved_cases", "reference_cases", "estimate_trades", "estimate_totals", "partial_retrieval", "leak_check", "suggested_relevance"])
def test_records_are_made_once(spark, name):
    """Records are made from lines by one stored plan; each mention of them made them again before."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_records_read_each_line_once_and_match_the_sql(spark, tmp_path):
    """Lines were shuffled several times with their rules; odd keys, prices and repeated orders keep the SQL's records."""
    text = registry.STORED["record_cases"]
    orders = f"""SELECT * REPLACE (CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN -5.0 WHEN 2 THEN 15000000.0 ELSE o_totalprice END AS o_totalprice) FROM '{SF}/orders.parquet'
      UNION ALL SELECT * REPLACE (o_totalprice * 3 AS o_totalprice) FROM '{SF}/orders.parquet' WHERE o_orderkey % 3 = 0 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM '{SF}/orders.parquet' WHERE o_orderkey % 9 = 0"""
    folder = planted(tmp_path, orders)
    lines = f"""SELECT * REPLACE (CASE WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
      CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM '{SF}/lineitem.parquet'"""
    duckdb.sql(f"COPY ({lines}) TO '{folder}/lineitem.parquet'")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    works = " + ".join(f"CASE WHEN has_{i} THEN {1 << i} ELSE 0 END" for i in range(len(V.FLAG_WORDS)))
    read = ["article_id", "request", "region", "size_pyeong", "total_cost", "cost_per_pyeong", "partial", "non_residential", works, *estimates.cost_columns().split(", ")]
    want = con.sql(f"WITH {quotes.cases(Duck)} SELECT {', '.join(read)} FROM case_".replace("regexp_like(", "regexp_matches(")).fetchall()
    got = spark.sql(text, **registry.named(spark, folder, text))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    rows = got.select(*("works" if c == works else c for c in read)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr) and rows
