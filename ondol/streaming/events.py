"""Structured Streaming over event rows: windows with late data, sessions, expiry, and streamed upserts.

An extension beyond batch plans.  Every function maps a streaming (or batch) DataFrame to another,
so the same code runs over a table or a stream; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import Table


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder; what was read is in the checkpoint, so a restart goes on from there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by key and tumbling (or sliding) window; rows later than `late` are dropped."""
    parts = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys)
    return _totals(parts, value).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by key and session: a session ends when a key is silent for `gap`."""
    parts = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)
    return _totals(parts, value).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")


def _totals(parts, value: str) -> DataFrame:
    cents = F.round(F.coalesce(F.col(value), F.lit(0.0)) * 100).cast("long")  # whole numbers: sums do not depend on order
    return parts.agg(F.count("*").alias("n"), F.sum(cents).alias("total"))


def limited(events: DataFrame, key: str, calls: int, width: str = "1 minute", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Windows in which a key made more than that many calls."""
    return windowed(events, [key], width, late=late, ts=ts).where(F.col("n") > calls)


def first_within(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first row of each key until its state expires, as a store with a time to live keeps it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def expired(rows: DataFrame, until: str, now: Column | None = None) -> DataFrame:
    """Rows whose time has come; a null time never expires."""
    return rows.where(F.col(until) < (F.current_timestamp() if now is None else now))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now to Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_to(stream: DataFrame, table: Table, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Last writer wins, a micro-batch at a time; a batch that is repeated after a loss changes nothing more."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        newest = batch.unionByName(table.read())  # an older row that comes late must not replace a newer one
        table.upsert(newest, keys, order)

    each: Callable[[DataFrame, int], None] = apply
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
