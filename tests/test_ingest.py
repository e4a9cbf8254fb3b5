"""Ingest plans against plain Python, since a plan and its oracle share one text."""

import duckdb

from ondol.plans import registry

SF = "/root/testdata/sf0.001"


def test_overlap_and_occurrence(spark, tmp_path):
    turns = {1: [["a", "b", "c"], ["b", "c", "d", "d"], [], ["d"], ["d", "d", "e"]], 2: [["x"], ["x"], ["y", "x", "y"]]}
    rows = [(conv, i, "user", " ".join(w)) for conv, ws in turns.items() for i, w in enumerate(ws)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shared, kept = set(), set()
    for conv, ws in turns.items():
        for i, w in enumerate(ws):
            before = ws[i - 1] if i else []
            if i:
                shared.add((conv, i, max((k for k in range(1, min(len(before), len(w)) + 1) if before[-k:] == w[:k]), default=0)))
            kept |= {(conv, i, x, w.count(x) - before.count(x)) for x in set(w) if w.count(x) > before.count(x)}
    got = registry.QUERIES["overlap_alignment"](spark, str(tmp_path)).select("conv_id", "turn", "n_shared").collect()
    assert {tuple(r) for r in got} == shared
    got = registry.QUERIES["occurrence_dedup"](spark, str(tmp_path)).select("conv_id", "turn", "word", "kept").collect()
    assert {tuple(r) for r in got} == kept


def test_staged_retrieval(spark):
    parts = duckdb.sql(f"SELECT p_partkey, p_type, p_brand, p_size FROM '{SF}/part.parquet'").fetchall()
    got = {r.p_partkey: (r.stage, r.n_found) for r in registry.QUERIES["staged_retrieval"](spark, SF).collect()}
    stages = (
        lambda p, q: p[1:3] == q[1:3] and abs(p[3] - q[3]) <= 6,
        lambda p, q: p[1] == q[1] and abs(p[3] - q[3]) <= 6,
        lambda p, q: p[1] == q[1],
        lambda p, q: True,
    )
    for p in parts:
        counts = [sum(q[0] != p[0] and s(p, q) for q in parts) for s in stages]
        stage = next((i for i, n in enumerate(counts) if n >= 3), 3)
        assert got[p[0]] == (stage + 1, counts[stage])
