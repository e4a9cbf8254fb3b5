"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  Every page becomes one record; among payloads of at least least_bytes that are equal, the
smallest page id is the response and the others are revisits without a body.  Records are written by
Spark's text writer with the record terminator as line separator, so archives go to any store.  Pages
are written in parts by a hash of the payload, so equal payloads meet in one part and the disk holds
the shuffled pages of one part only beside the archives.

Reading.  Archives are split anywhere, at any store, by Spark's text reader with the record magic as
separator; every piece after a magic is a candidate record.  A task knows each piece's offset from
the start of its split, reads the header of the candidate, and thereby the offset of its successor.
Inside a split successors are followed to where they leave it; prefix sums of the splits' lengths
make offsets absolute; pointer jumping from the start of each file then finds, in as many rounds as
the logarithm of a file's splits, the first true record of every split; a last walk inside each
split keeps the reachable records only.  A magic inside a payload is never reachable; payloads that
hold one are put together from their pieces in a second pass, which runs only if there are any.

A task holds one candidate record and the numbers of one split.  A damaged record ends the chain of
its file; records behind it are not returned.

Nulls and odd inputs: a null payload is empty; a null page id is written without a record id, is
never anyone's original, and reads back as null; rows that repeat both id and payload are all
responses; a null address is left out; line breaks in an address are dropped; an empty table makes
no archive and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, shuffle_files_go, write_out

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
NODE = "path string, block long, rel long, size long, succ long, exit long, whole boolean, type string, id string, refers string, said string, digest string, n long"


def as_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """One text column: the records without their terminator."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    revisit = (F.col("n") >= least_bytes) & (F.col("id") != F.col("first"))
    revisit = F.coalesce(revisit, F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.when(revisit, "0").otherwise((F.octet_length(http) + F.col("n")).cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.concat(http, F.col("html"))),
    )
    return joined.select(record.alias("value"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, parts: int = 4) -> None:
    """Write the archives of all pages into the folder path, a part of the payloads after another."""
    part = F.pmod(F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))), F.lit(parts))
    with shuffle_files_go(pages.sparkSession):
        for k in range(parts):
            as_records(pages.where(part == k), id_col, url_col, html_col, least_bytes).write.mode("append").option("lineSep", END).text(path)


def parse(record: bytes) -> dict | None:
    """Fields of a candidate that starts after its magic; None if it has no complete header."""
    stop = record.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for row in record[:stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not length.isascii() or not length.isdigit() or b"warc-type" not in fields:
        return None
    fields["body"], fields["length"] = stop + 4, int(length)
    return fields


def described(record: bytes, fields: dict) -> dict:
    """Type, id, reference, digests and payload size of a whole record."""
    body = record[fields["body"] : fields["body"] + fields["length"]]
    name = lambda key: unquote(v[10:-1].replace("+", " ")) if (v := fields.get(key, "")).startswith("<urn:page:") else None
    said = fields.get(b"warc-payload-digest", "").removeprefix("sha256:")
    out = {"type": fields[b"warc-type"], "id": name(b"warc-record-id"), "refers": name(b"warc-refers-to"), "said": said}
    if out["type"] == "revisit":
        size = fields.get(b"x-payload-length", "")
        return out | {"digest": said, "n": int(size) if size.isdigit() else None}
    if "application/http" in fields.get(b"content-type", ""):
        body = body[max(body.find(b"\r\n\r\n") + 4, 4) :]
    return out | {"digest": hashlib.sha256(body).hexdigest(), "n": len(body)}


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def splits(batches):
    """(path, block, [(offset in the split, piece), ...] lazily) for pieces in the order of their splits."""
    for batch in batches:
        for path, block, value in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
            yield path, block, value.as_py()


def candidates(batches):
    """Candidates of each split with their successors, as rows of NODE."""
    rows: list = []
    now, at = None, 0
    names = [c.split()[0] for c in NODE.split(", ")]

    def closed():
        index = {r["rel"]: r for r in rows}
        for r in reversed(rows):
            s = r["succ"]
            r["exit"] = s if s >= at else index[s]["exit"] if s in index and s > r["rel"] else -1
            r["size"] = at
        head = {"path": now[0], "block": now[1], "rel": -1, "size": at, "succ": -1, "exit": -1, "whole": False}
        table = [head, *rows]
        return pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in table], SCHEMA)

    for path, block, piece in splits(batches):
        if (path, block) != now:
            if now is not None:
                yield closed()
            now, at, rows = (path, block), 0, []
        fields = parse(piece)
        if fields is not None:
            end = fields["body"] + fields["length"]
            row = {"path": path, "block": block, "rel": at, "succ": at + end + 4 + len(MAGIC), "whole": end <= len(piece)}
            rows.append(row | (described(piece, fields) if row["whole"] else {}))
        at += len(piece) + len(MAGIC)
    if now is not None:
        yield closed()


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in NODE.split(", ")])


def walk(table: pa.Table) -> pa.Table:
    """Of one split's candidates those on the chain from its entry."""
    where = {r: k for k, r in enumerate(table["rel"].to_pylist())}
    succ, at, keep = table["succ"].to_pylist(), table["entry"][0].as_py(), []
    while at in where:
        keep.append(where[at])
        at = succ[where[at]]
    return table.take(pa.array(keep, pa.int64()))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every true record: path, start (offset behind its magic), type, id, refers, said, digest, n."""
    nodes = write_out(pieces_of(spark, path).mapInArrow(candidates, NODE), "warc-nodes")
    lengths = nodes.where("rel = -1").select("path", "block", "size")
    order = Window.partitionBy("path").orderBy("block")
    bases = lengths.select("path", "block", (F.sum("size").over(order) - F.col("size")).alias("base"))
    bases = write_out(bases, "warc-bases")
    node = nodes.where("rel >= 0").join(bases, ["path", "block"]).withColumn("start", F.col("base") + F.col("rel"))
    jump = node.where("exit >= 0").select("path", "start", (F.col("base") + F.col("exit")).alias("to"))
    reached = bases.where("block = 0").select("path", F.lit(len(MAGIC)).cast("long").alias("start"))
    most = bases.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(0, (most - 1).bit_length())):
        jump, reached = write_out(jump, "warc-jump"), write_out(reached, "warc-reached")
        reached = reached.union(reached.join(jump, ["path", "start"]).select("path", F.col("to").alias("start"))).distinct()
        jump = jump.join(jump.select("path", F.col("start").alias("to"), F.col("to").alias("next")), ["path", "to"]).select("path", "start", F.col("next").alias("to"))
    entry = node.join(reached, ["path", "start"]).groupBy("path", "block").agg(F.min("rel").alias("entry"))
    fields = node.select(*[c.split()[0] for c in NODE.split(", ")], "base", "start").join(entry, ["path", "block"])
    kept = fields.groupBy("path", "block").applyInArrow(walk, fields.schema)
    kept = write_out(kept, "warc-kept")
    out = ["path", "start", "type", "id", "refers", "said", "digest", "n"]
    odd = kept.where("not whole")
    if odd.isEmpty():
        return kept.select(out)
    return kept.where("whole").select(out).union(whole_again(spark, path, odd, bases).select(out))


def whole_again(spark: SparkSession, path: str, odd: DataFrame, bases: DataFrame) -> DataFrame:
    """Records that hold a magic, put together from all their pieces."""

    def number(batches):
        now, at = None, 0
        for p, block, piece in splits(batches):
            if (p, block) != now:
                now, at = (p, block), 0
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([piece], pa.binary())], ["path", "block", "rel", "value"])
            at += len(piece) + len(MAGIC)

    ends = bases.select("path", "block", "base", F.lead("base").over(Window.partitionBy("path").orderBy("block")).alias("next"))
    spans = odd.select("path", "start", (F.col("base") + F.col("succ") - len(MAGIC)).alias("stop"))
    over = spans.join(ends, "path").where((F.col("base") < F.col("stop")) & (F.col("next").isNull() | (F.col("next") > F.col("start")))).select("path", "block", "base", "start", "stop")
    parts = pieces_of(spark, path).mapInArrow(number, "path string, block long, rel long, value binary").join(over, ["path", "block"])
    at = F.col("base") + F.col("rel")
    parts = parts.where((at >= F.col("start")) & (at < F.col("stop"))).select("path", "start", at.alias("at"), "value")

    def join(table: pa.Table) -> pa.Table:
        record = MAGIC.join(x.as_py() for x in table.sort_by("at")["value"])
        fields = parse(record)
        row = {"path": table["path"][0].as_py(), "start": table["start"][0].as_py()} | described(record, fields)
        return pa.Table.from_pylist([row], SCHEMA_OUT)

    return parts.groupBy("path", "start").applyInArrow(join, "path string, start long, type string, id string, refers string, said string, digest string, n long")


SCHEMA_OUT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("refers", pa.string()), ("said", pa.string()), ("digest", pa.string()), ("n", pa.int64())])


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: one row per page."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least_bytes=least_bytes)
    found = read_warc(spark, path)
    return found.select(
        F.col("id").cast(kind).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
        (F.col("said") == F.col("digest")).alias("digest_verified"),
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to, true AS digest_verified FROM f"""
