"""Tables that change, tolerant scans, streams and matching against plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ondol.operators import matching
from ondol.sources import tables
from ondol.streaming import events


def test_table(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/t", "id long, user string, at long, status string")
    assert t.read().count() == 0 and t.delete(F.col("id") == 1) == 0
    frame = lambda *rows: spark.createDataFrame(rows, "id long, user string, at long, status string")
    t.insert(frame((1, "a", 1, "saved"), (2, "b", 1, "saved"), (3, None, 1, "saved")))
    t.upsert(frame((2, "b", 5, "late"), (2, "b", 7, "last"), (4, "c", 1, "saved")), ["id"], "at")
    t.put_if_absent(frame((1, "z", 9, "no"), (5, "e", 3, "second"), (5, "e", 2, "first")), ["id"], "at")
    assert t.update((F.col("id") == 1) & (F.col("user") == "a"), status=F.lit("contracted")) == 1
    assert t.update(F.col("user") == "nobody", status=F.lit("x")) == 0
    got = {r.id: (r.user, r.status) for r in t.read().collect()}
    assert got == {1: ("a", "contracted"), 2: ("b", "last"), 3: (None, "saved"), 4: ("c", "saved"), 5: ("e", "first")}
    assert t.delete(F.col("user") == "c") == 1  # a null user is no match
    assert [r.id for r in t.take(F.col("id") == 5).collect()] == [5] and t.take(F.col("id") == 5).count() == 0
    assert sorted(r.id for r in t.read().collect()) == [1, 2, 3] and len(t.versions()) == 2


def test_logs_and_labels(spark, tmp_path):
    (tmp_path / "log").write_text('{"event": "a", "level": "error"}\nnot json\n\n{"event": "b"}\n', encoding="utf-8")
    rows = tables.read_logs(spark, f"{tmp_path}/log", "event string, level string").collect()
    assert sorted((r.event or "", r.level, r.malformed or "") for r in rows) == [("", "info", "not json"), ("a", "error", ""), ("b", "info", "")]
    (tmp_path / "l.csv").write_text("q,a,label\n1,x,1\n", encoding="utf-8-sig")
    old = tables.read_labels(spark, f"{tmp_path}/l.csv", "q int, a string, label int")
    new = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "y", 1)], old.schema)
    assert sorted(tuple(r) for r in tables.append_unseen(old, new, ["q", "a"]).collect()) == [(1, "x", 1), (1, "y", 1)]
    tables.write_routed(spark.createDataFrame([(1, 0.7), (2, 0.6), (3, None)], "id long, confidence double"), f"{tmp_path}/routed")
    assert {r.id: r.target for r in spark.read.parquet(f"{tmp_path}/routed").collect()} == {1: "cases", 2: "review", 3: "review"}


def test_streams(spark, tmp_path):
    random.seed(3)
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=random.randrange(7200)), i % 3, random.choice([None, 1.25, 3.5])) for i in range(300)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    table.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", table.schema)
    events.append_to(events.windowed(stream, ["user_id"], "10 minutes", late="3 hours"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    later = spark.createDataFrame([(999, base + timedelta(days=1), 0, 1.0)], table.schema)
    later.write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark beyond every window
    for _ in range(2):
        events.append_to(events.windowed(stream, ["user_id"], "10 minutes", late="3 hours"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    got = {(r.start, r.user_id): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want: dict = {}
    for _, ts, user, value in rows:
        start = ts - timedelta(minutes=ts.minute % 10, seconds=ts.second)
        n, total = want.get((start, user), (0, 0))
        want[start, user] = (n + 1, total + round((value or 0) * 100))
    assert got == want
    found = events.sessions(table, ["user_id"], "2 minutes").agg(F.sum("n")).first()[0]
    assert found == 300
    kept = tables.Table(spark, f"{tmp_path}/kept", table.schema)
    events.upsert_to(stream, kept, ["user_id"], "event_id", f"{tmp_path}/c2").awaitTermination()
    assert {r.user_id: r.event_id for r in kept.read().collect()} == {0: 999, 1: 298, 2: 299}


def test_matching(spark):
    random.seed(9)
    defects = [(r, p, random.choice("abc")) for r in range(6) for p in range(4)]
    found = [(r, p, random.choice("abc")) for r in range(5) for p in range(5)]
    d = spark.createDataFrame(defects, "record long, pos long, kind string")
    f = spark.createDataFrame(found, "record long, pos long, kind string")
    matched = matching.greedy_match(d, f, F.col("d.kind") == F.col("f.kind"))
    taken, want = set(), {}
    for r, p, k in defects:
        want[r, p] = next((q for s, q, j in found if s == r and j == k and (s, q) not in taken), None)
        taken.add((r, want[r, p]))
    assert {(r.record, r.pos): r.found for r in matched.collect()} == want
    s = matching.match_summary(matched, f).first()
    hits = sum(v is not None for v in want.values())
    assert (s.n_defects, s.n_found, s.n_findings) == (24, hits, 25) and abs(s.precision - hits / 25) < 1e-12
    clean = spark.createDataFrame([(0, 0, "a"), (0, 1, None)], "record long, pos long, kind string")
    planted = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, None), (0, 3, "b")], clean.schema)
    assert sorted(r.pos for r in matching.new_findings(planted, clean, ["record", "kind"], "pos").collect()) == [1, 3]
