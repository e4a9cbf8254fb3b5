"""Files in and out."""

import json

from pyspark.sql import functions as F

from ondol.sources import files
from ondol.sources.tables import Table


def test_folders_arrays_points(spark, tmp_path):
    for region, article, row in (("서울", "11", {"total": 5}), ("경기", "12", {"article_id": "x12", "total": 6})):
        (tmp_path / "a" / region / article).mkdir(parents=True)
        (tmp_path / "a" / region / article / f"{article}.json").write_text(json.dumps(row, indent=1))
    (tmp_path / "a" / "서울" / "11" / "other.json").write_text('{"total": 9}')
    got = {(r.article_id, r.total) for r in files.read_articles(spark, f"{tmp_path}/a", "article_id string, region string, total long").collect()}
    assert got == {("11", 5), ("x12", 6)}
    (tmp_path / "b.json").write_text('[{"k": 1},\n {"k": 2}]')
    assert sorted(r.k for r in files.read_array(spark, f"{tmp_path}/b.json", "k long").collect()) == [1, 2]
    point = {"type": "Point", "metric": "ms", "data": {"time": "2026-01-01T00:00:00Z", "value": 3.5, "tags": {"scenario": "s1"}}}
    (tmp_path / "c.json").write_text("\n".join([json.dumps(point), '{"type": "Metric"}', "{broken", ""]))
    assert [(r.metric, r.value, r.scenario) for r in files.read_points(spark, f"{tmp_path}/c.json").collect()] == [("ms", 3.5, "s1")]


def test_labels(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.csv").write_bytes("질의,글\nq1,서울\n".encode("utf-8-sig"))
    (tmp_path / "l" / "b.csv").write_bytes("질의,글\r\nq2,경기\r\n".encode("cp949"))
    rows = files.read_label_files(spark, f"{tmp_path}/l", "query string, text string")
    assert {tuple(r) for r in rows.collect()} == {("q1", "서울"), ("q2", "경기")}
    files.write_labels(rows.coalesce(1), f"{tmp_path}/out")
    assert {tuple(r) for r in files.read_label_files(spark, f"{tmp_path}/out/*.csv", "query string, text string").collect()} == {("q1", "서울"), ("q2", "경기")}


def test_logs_and_backup(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("n"))
    files.log_events(rows, f"{tmp_path}/log", "made", request_id=F.lit("r"))
    files.follow_log(spark, f"{tmp_path}/log", f"{tmp_path}/to", f"{tmp_path}/ck").awaitTermination()
    files.log_events(rows.limit(1), f"{tmp_path}/log", "made")
    files.follow_log(spark, f"{tmp_path}/log", f"{tmp_path}/to", f"{tmp_path}/ck").awaitTermination()
    seen = [json.loads(r.value) for r in spark.read.parquet(f"{tmp_path}/to").collect()]
    assert len(seen) == 4 and {e["event"] for e in seen} == {"made"} and sorted(e["n"] for e in seen) == [0, 0, 1, 2]
    files.backup(rows, f"{tmp_path}/bak")
    assert spark.read.json(f"{tmp_path}/bak").count() == 3


def test_stores(spark, tmp_path):
    cache = Table(spark, f"{tmp_path}/cache", "key string, last_used_at timestamp")
    cache.insert(spark.createDataFrame([("a",), ("b",)], "key string").withColumn("last_used_at", F.lit("2026-01-01").cast("timestamp")))
    got = files.get_many(cache, spark.createDataFrame([("a",), ("z",)], "key string"), "key", now=F.lit("2026-02-02").cast("timestamp"))
    assert [r.key for r in got.collect()] == ["a"] and {(r.key, r.last_used_at.month) for r in cache.read().collect()} == {("a", 2), ("b", 1)}
    good, review = (Table(spark, f"{tmp_path}/{n}", "id string, v long, confidence double") for n in ("good", "review"))
    files.upsert_routed(spark.createDataFrame([("1", 1, 0.7), ("1", 2, 0.9), ("2", 1, 0.69), ("3", 1, None)], "id string, v long, confidence double"), good, review, "id", "v")
    assert [(r.id, r.v) for r in good.read().collect()] == [("1", 2)] and {r.id for r in review.read().collect()} == {"2", "3"}
    rows = spark.createDataFrame([("u", (1, 2)), ("u", (3, 4)), ("w", (5, 6))], "user_id string, result struct<a: long, b: long>")
    assert files.listed(rows, "u", without={"result": ["b"]}).collect()[0].result.asDict().keys() == {"a"}
    assert files.repeated_keys(rows, ["user_id"]).collect()[0].n == 2
    made = files.pending(rows).collect()
    assert len({r.token for r in made}) == 3


def test_documents_and_batches(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.png", b"%PDF-1.4 x"), ("b.pdf", b"\x89PNG...."), ("c", b""), ("d", b"hello")):
        (tmp_path / "d" / name).write_bytes(data)
    assert sorted(r.kind for r in files.documents(spark, f"{tmp_path}/d").collect()) == ["other", "pdf", "png"]
    assert files.batches(spark.range(301), ["id"]).groupBy("batch").count().count() == 3
    done, failed = files.regroup(spark.createDataFrame([("x", 1, 1, True, "b"), ("x", 0, 2, True, "a"), ("y", 0, 0, False, None)], "article_id string, image int, chunk int, ok boolean, output string"))
    assert [[p.output for p in r.results] for r in done.collect()] == [["a", "b"]] and failed.count() == 1
    fields = "article_id string, region string, crawled_at int, body_text string, request_body_text string, post_title string, images array<string>, linked_images array<string>"
    rows = [("1", "서울", 1, "x", "24 py", "30평", [], ["l"]), ("1", "경기", 2, "pyramid 7pyramid", None, "31평", ["i"], ["l"]), ("2", "서울", 1, None, None, None, None, ["l"])]
    got = {r.article_id: (r.region, r.size_pyeong, r.images) for r in files.crawl_records(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"1": ("경기", 31, ["i"]), "2": ("서울", 0, ["l"])}
