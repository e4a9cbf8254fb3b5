"""Vector searches against their SQL on odd vectors: copies, ties, zeros, nulls, repeated ids, small blocks."""

import math

import duckdb
import pytest

from ondol.plans import registry, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vector_topk", "leave_out_topk", "vector_topk_postfilter"])
def test_odd_vectors(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "ASKED", 8)
    first = f"(SELECT embedding FROM '{SF}/embeddings.parquet' WHERE vec_id = 3)"
    duckdb.sql(f"""COPY (SELECT vec_id, CASE WHEN vec_id BETWEEN 100 AND 350 THEN {first} WHEN vec_id IN (7, 60) THEN list_transform(embedding, lambda x: 0::FLOAT)
      WHEN vec_id IN (9, 80) THEN NULL WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: (2 * x)::FLOAT) ELSE embedding END AS embedding, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE label END AS label
      FROM '{SF}/embeddings.parquet' UNION ALL SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id IN (5, 41)) TO '{tmp_path}/embeddings.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]}) z").fetchall()
    tidy = lambda rows: sorted(repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)
    assert tidy(got.collect()) == tidy(want)


def test_rounding_is_that_of_decimals():
    import numpy as np

    assert list(vectors.rounded(np.array([0.1234565, -0.1234565, 0.0000005, -0.0000004, 1.0000000000000002]))) == [0.123457, -0.123457, 0.000001, 0.0, 1.0]


@pytest.mark.parametrize("name", ["rrf_fusion", "rerank_chain", "rank_ablation"])
def test_lists_are_made_once(spark, name):
    """Both lists are stored, so a fusion that mentions them again does not rank again."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "text" not in plan
