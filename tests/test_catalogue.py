"""Every registered plan against its SQL on the smallest tables."""

import duckdb
import pytest

from ondol.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    g, w = got.collect(), want.fetchall()
    order = [want.columns.index(c) for c in sorted(want.columns)]
    tidy = lambda v: None if v is None else round(float(v), 5) if not isinstance(v, (str, bool)) and not hasattr(v, "year") else v
    left = sorted((repr([tidy(r[c]) for c in sorted(got.columns)]) for r in g))
    right = sorted((repr([tidy(r[i]) for i in order]) for r in w))
    assert left == right
