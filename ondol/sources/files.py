"""Files in and out: article folders, JSON arrays and points, label CSVs, logs, backups, documents, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .tables import Table


def read_articles(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of region/article/article.json; article_id and region come from the folders where the record lacks them."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(path)
    parts = F.split(F.input_file_name(), "/")
    folder = raw.select("*", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -3).alias("folder_region"), F.element_at(parts, -1).alias("file"))
    own = folder.where(F.col("file") == F.concat("folder", F.lit(".json")))
    named = {"article_id": "folder", "region": "folder_region"}
    return own.select(*(F.coalesce(F.col(c).cast("string"), F.col(named[c])).alias(c) if c in named else F.col(c) for c in raw.columns))


def read_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a load test's JSON lines: metric, time, value and scenario; other lines and broken ones are left out."""
    fields = "type string, metric string, data struct<time: timestamp, value: double, tags: map<string, string>>"
    parsed = spark.read.text(path).select(F.from_json("value", fields, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return parsed.where("type = 'Point'").select("metric", F.col("data.time").alias("time"), F.col("data.value").alias("value"), F.col("data.tags")["scenario"].alias("scenario"))


def decoder(fallback: str):
    """Bytes of a file to text: UTF-8, with or without byte order mark, where they are valid, else the fallback."""

    @F.pandas_udf("string")
    def text(content):
        def one(data: bytes) -> str:
            try:
                return data.decode("utf-8-sig")
            except UnicodeDecodeError:
                return data.decode(fallback, errors="replace")

        return content.map(one)

    return text


def read_label_files(spark: SparkSession, path: str, schema: StructType | str, fallback: str = "cp949") -> DataFrame:
    """Label CSVs with a header, each in its own encoding; label files are small, so each is read whole."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = spark.read.format("binaryFile").load(path).select("content")
    line = whole.select(F.posexplode(F.split(decoder(fallback)("content"), "\r?\n")).alias("at", "line")).where("at > 0 AND trim(line) <> ''")
    return line.select(F.from_csv("line", fields.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")


def write_labels(rows: DataFrame, path: str) -> None:
    """A label CSV with a header; the first header begins with a byte order mark, as spreadsheets expect it."""
    marked = [F.col(c).alias("﻿" + c if i == 0 else c) for i, c in enumerate(rows.columns)]
    rows.select(marked).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def backup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def log_events(rows: DataFrame, path: str, event: str, level: str = "info", request_id: Column | None = None) -> None:
    """One JSON object a row, with time, event, level and request."""
    head = [F.current_timestamp().alias("timestamp"), F.lit(event).alias("event"), F.lit(level).alias("level"), (F.lit(None).cast("string") if request_id is None else request_id).alias("request_id")]
    rows.select(F.to_json(F.struct(*head, *rows.columns)).alias("value")).write.mode("append").text(path)


def follow_log(spark: SparkSession, path: str, to: str, checkpoint: str) -> StreamingQuery:
    """What came to a folder of logs since the last call; the checkpoint keeps the place, and a rotated file is a new one."""
    return spark.readStream.text(path).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would break a unique index, with their number."""
    return rows.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1")


def listed(rows: DataFrame, user: str, user_col: str = "user_id", without: dict[str, list[str]] | None = None, limit: int = 100) -> DataFrame:
    """A user's rows, 100 at most, without the nested fields named."""
    found = rows.where(F.col(user_col) == user).limit(limit)
    for column, fields in (without or {}).items():
        found = found.withColumn(column, F.col(column).dropFields(*fields))
    return found


def get_many(table: Table, keys: DataFrame, key: str, used: str = "last_used_at", now: Column | None = None) -> DataFrame:
    """Rows of a cache that are asked for; their time of use becomes now."""
    at = F.current_timestamp() if now is None else now
    old = table.read()
    asked = keys.select(F.col(key).alias("_asked")).distinct()
    mark = old.join(asked, F.col(key) == F.col("_asked"), "left")
    touched = mark.withColumn(used, F.when(F.col("_asked").isNotNull(), at).otherwise(F.col(used))).select(table.schema.names)
    table.replace_all(touched)
    return table.read().join(asked, F.col(key) == F.col("_asked"), "left_semi")


def pending(rows: DataFrame, minutes: int = 15) -> DataFrame:
    """Rows with a token of their own and the time until which it holds."""
    return rows.select(F.expr("uuid()").alias("token"), "*", (F.current_timestamp() + F.expr(f"interval {minutes} minutes")).alias("expires_at"))


def upsert_routed(rows: DataFrame, cases: Table, review: Table, key: str, order: str, confidence: str = "confidence", least: float = 0.7) -> None:
    """Records go to the cases or, under the least confidence or without one, to the review queue; the last of a key wins."""
    good = F.coalesce(F.col(confidence) >= least, F.lit(False))
    cases.upsert(rows.where(good), [key], order)
    review.upsert(rows.where(~good), [key], order)


def reference_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Price and quantity references of one table, by kind."""
    rows = spark.read.parquet(path)
    return rows.where("kind = 'unit_price'").drop("kind"), rows.where("kind = 'quantity'").drop("kind")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files with their digest and kind, told by the first bytes and not by the name; empty ones are left out."""
    raw = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = lambda hexed: F.hex(F.substring("content", 1, 4)).startswith(hexed)
    kind = F.when(starts("25504446"), "pdf").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpeg").when(starts("52494646"), "webp").otherwise("other")
    return raw.select("path", "length", F.sha2("content", 256).alias("digest"), kind.alias("kind"))


def batches(rows: DataFrame, order: list[str], size: int = 150) -> DataFrame:
    """Numbers requests by batches of that size."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size))


def regroup(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (article_id, image, chunk, ok, output) as articles with their outputs in order, and the requests that failed."""
    done = results.where("ok").groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("image", "chunk", "output"))).alias("results"))
    return done, results.where("NOT ok OR ok IS NULL").select("article_id", "image", "chunk")


def crawl_records(rows: DataFrame) -> DataFrame:
    """One record an article: area from its body, else its request, else its title; linked images only where it has none of its own."""
    area = lambda c: F.when(F.col(c).rlike(r"(?i)\d+\s*(평|py\b)"), F.regexp_extract(c, r"(?i)(\d+)\s*(평|py\b)", 1).cast("int"))
    images = F.when(F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0, F.col("images")).otherwise(F.col("linked_images"))
    found = rows.withColumn("size_pyeong", F.coalesce(area("body_text"), area("request_body_text"), area("post_title"), F.lit(0))).withColumn("images", images).drop("linked_images")
    newest = Window.partitionBy("article_id").orderBy(F.desc("crawled_at"), "region")
    return found.withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i")
