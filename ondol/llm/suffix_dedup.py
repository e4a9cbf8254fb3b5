"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte is removed when a string of `length` bytes that covers it also starts in a document with a
smaller id.  Suffixes are sorted into buckets to that depth.  Sorting every suffix of the corpus would
move each position several times; here only sampled suffixes are dealt between tasks, and the sampling
loses no string: of every window of `length` bytes the smallest-hashed q-gram is an anchor (ties all
count), so equal windows have the same anchor at the same place.

Bucket identifiers.  The bucket of a suffix at depth q is named by its q-gram.  Every deeper name is
made from two names of the level before: that of the suffix itself and, the pointer, that of the suffix
at a later offset; 8 bytes, as they are, give 16, these 32, and 32 give 50 (`refined`; `names` where only
some suffixes are asked).  Names of contexts and half windows are pairs of such identifiers too.

1. Initial buckets: the q-grams at the anchors.  Buckets that hold one document are finished.
2. Refinement: an anchor's context - all windows through it - is a finer bucket.  Where the bucket's
   smallest document is smaller than an anchor's own, its whole context goes.  Of each context only the
   smallest document goes on.
3. Contexts of an anchor that differ can share windows only if they share the bytes left or right of
   it up to half a window; buckets of these two refine again, and single ones are finished.
4. Last, the windows themselves of what is left are bucketed at the full depth.

Every level only passes on the members of buckets that are still mixed, and hands each document
only what concerns it: names of buckets to go on with, or of contexts and windows to remove, which the
document finds again in its own text; so rows that share an id need no further key.  A document names
a bucket once however often it holds it, so a bucket has at most one row per document, while documents
hold many anchors; Spark keeps a bucket's first rows in memory and spills the rest.

Nulls and odd inputs: a null text is empty; a row with a null id neither removes nor loses bytes;
rows that repeat an id do not remove each other's bytes; shorter texts keep all bytes; empty tables
give no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, U, discard, mixed, pieces, text_buffer, write_out

GRAM = 16
PIECE, BLOCK = 256 << 10, 8 << 10  # bytes of texts, and suffixes named, at once: what is made of them stays in a core's cache


def hold_memory() -> None:
    """In a worker: after a large block went once, the allocator keeps freed memory for the next arrays instead of returning it each time."""
    np.empty(31 << 20, np.uint8)


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op, a minimum or maximum, over every w consecutive values: spans double until they reach w."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = op(x[:-step], x[step:])
        span += step
    return x


def refined(name: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Bucket identifiers of every suffix at the length: of each level the identifiers of two offsets name the next."""
    out = np.empty(max(len(name) - (length - depth), 0), np.uint64)
    for a in range(0, len(out), BLOCK):
        part, d = name[a : a + BLOCK + length - depth], depth
        while d < length:
            step = min(d, length - d)
            part = mixed(part[:-step] * U(3) + part[step:])
            d += step
        out[a : a + BLOCK] = part
    return out


def grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """Names of every q-gram, 16 bytes at most: of two names of eight bytes at most, which are made of the bytes as they are."""
    depth = min(8, gram)
    out = np.empty(max(len(buf) - gram + 1, 0), np.uint64)
    for a in range(0, len(out), BLOCK):
        part = np.zeros(BLOCK + gram + 8, np.uint8)
        part[: min(BLOCK + gram - 1, len(buf) - a)] = buf[a : a + BLOCK + gram - 1]
        n = min(BLOCK, len(out) - a)
        words = np.ndarray(n + gram - depth, "<u8", part, strides=(1,)) & U((1 << 8 * depth) - 1)
        name = mixed(words)
        out[a : a + n] = name[:n] * U(BASE) + name[gram - depth :] if gram > depth else name
    return out


class Slice:
    """Anchors of the texts of one slice."""

    def __init__(self, batch: pa.RecordBatch, length: int, gram: int = GRAM):
        self.buf, self.at = text_buffer(batch.column("text"))
        self.length, self.gram = length, min(gram, length)
        n = len(self.buf)
        self.depths = [self.gram]
        while self.depths[-1] < length:
            self.depths.append(min(2 * self.depths[-1], length))
        self.place = np.zeros(0, np.int64)
        self.codes = self.code = np.zeros(0, np.uint64)
        if n >= length:
            w = length - self.gram + 1
            self.codes = grams(self.buf, self.gram)
            rank = np.maximum(self.codes.view("<u4")[1::2], np.uint32(1))  # equal ranks are ties
            low = sliding(rank, w, np.minimum)
            across = (self.at[1:-1, None] - np.arange(1, length)).ravel()
            low[across[(across >= 0) & (across < len(low))]] = 0  # windows over the end of a text are void
            padded = np.zeros(len(low) + 2 * (w - 1), np.uint32)
            padded[w - 1 : w - 1 + len(low)] = low
            self.place = np.flatnonzero(sliding(padded, w, np.maximum) == rank)
            self.code = self.codes[self.place]
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(np.searchsorted(self.place, self.at)))

    def keep(self, which: np.ndarray) -> None:
        self.place, self.code, self.row = self.place[which], self.code[which], self.row[which]

    def names(self, start: np.ndarray, depth: int) -> np.ndarray:
        """Bucket identifiers at the depth of the suffixes at the starts, as refined() has them for all."""
        if depth == self.gram:
            return self.codes[start]
        before = max(d for d in self.depths if d < depth)
        return mixed(self.names(start, before) * U(3) + self.names(start + (depth - before), before))

    def cover(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Names of the spans lo to hi, of depth to twice the depth, by the buckets at their two ends."""
        return mixed(self.names(lo, depth) * U(3) + mixed(self.names(hi - depth, depth) + (hi - lo).astype(np.uint64)))

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first byte, end) of each anchor's context."""
        if not len(self.place):
            return self.code, self.place, self.place
        reach = self.length - self.gram
        lo = np.maximum(self.place - reach, self.at[self.row])
        hi = np.minimum(self.place + self.length, self.at[self.row + 1])
        return mixed(self.cover(lo, hi, self.length) + (self.place - lo).astype(np.uint64)), lo, hi

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the half windows to the left and right of each anchor; 0 where the text ends before."""
        if not len(self.place):
            return self.code, self.code
        half = (self.length - self.gram + 1) // 2
        depth = max(d for d in self.depths if d <= self.gram + half)
        lo, hi = self.place - half, self.place + self.gram + half
        names = []
        for start, stop, inside, salt in ((lo, hi - half, lo >= self.at[self.row], 1), (lo + half, hi, hi <= self.at[self.row + 1], 2)):
            name = np.zeros(len(lo), np.uint64)
            name[inside] = mixed(self.cover(start[inside], stop[inside], depth) + U(salt))
            names.append(name)
        return names[0], names[1]

    def windows(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of the windows through the anchors that hold the marked halves."""
        reach, half = self.length - self.gram, (self.length - self.gram + 1) // 2
        change = np.zeros(len(self.buf) + 1, np.int32)
        for which, most, least in ((left, reach, half), (right, reach - half, 0)):
            place, row = self.place[which], self.row[which]
            first = np.maximum(place - most, self.at[row])
            end = np.minimum(place - least, self.at[row + 1] - self.length) + 1
            some = first < end
            np.add.at(change, first[some], 1)
            np.add.at(change, end[some], -1)
        start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        return np.repeat(np.arange(len(self.at) - 1), np.diff(np.searchsorted(start, self.at))), start

    def gone(self, whole: pa.Array, windows: pa.Array) -> np.ndarray:
        """Which bytes go, by the names of the contexts and of the windows to remove."""
        change = np.zeros(len(self.buf) + 1, np.int32)
        name, lo, hi = self.contexts()
        hit = members(whole, self.row, name)
        np.add.at(change, lo[hit], 1)
        np.add.at(change, hi[hit], -1)
        asked = listed(windows)[0]
        if len(asked) and len(self.codes):
            name = refined(self.codes, self.gram, self.length)
            shift = U(64 - slots(len(asked)))
            table = np.zeros(1 << slots(len(asked)), bool)
            table[asked >> shift] = True
            start = np.flatnonzero(table.take((name >> shift).view(np.int64)))  # names of any row asked, and some others
            row = np.searchsorted(self.at, start, "right") - 1
            start = start[members(windows, row, name[start]) & (start + self.length <= self.at[row + 1])]
            np.add.at(change, start, 1)
            np.add.at(change, start + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def slots(n: int) -> int:
    """Bits of a table in which n names seldom meet."""
    return max(4, int(n).bit_length() + 3)


def listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) of the members of all lists; a null is empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    return np.asarray(lists.flatten(), np.int64).view(np.uint64), np.repeat(np.arange(len(size)), size)


def members(lists: pa.Array, row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether each (row, name) is in the row's list: a table of slots, and one more for the names that lost theirs."""
    tag = lambda x, r: x + r.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    keys, wanted = tag(*listed(lists)), tag(name, row)
    found, ask = np.zeros(len(wanted), bool), np.arange(len(wanted))
    while len(keys) and len(ask):
        shift = U(64 - slots(len(keys)))
        table = np.full(1 << slots(len(keys)), -1, np.int32)
        slot = (keys >> shift).view(np.int64)
        table[slot] = np.arange(len(keys), dtype=np.int32)
        at = table[(wanted[ask] >> shift).view(np.int64)]
        ask, at = ask[at >= 0], at[at >= 0]
        same = keys[at] == wanted[ask]
        found[ask[same]] = True
        ask = ask[~same]
        keys = keys[keys[table[slot]] != keys]
    return found


def distinct_rows(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Index of one occurrence of each (row, name); rows ascend."""
    order = np.argsort(name, kind="stable")
    r, x = row[order], name[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return order[new]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary), spans (starts and ends in turn)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sized = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    bucket = Window.partitionBy("name")  # sorted by one number, which Spark does without comparisons

    def initial(batches):
        hold_memory()
        for b in pieces(batches, PIECE):
            s = Slice(b, length)
            one = distinct_rows(s.row, s.code)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(s.row[one])), signed(s.code[one])], ["id", "name"])

    def mixed_buckets(table: DataFrame) -> DataFrame:
        """(id, name) of the buckets that hold several documents."""
        ranked = table.select("id", "name", F.min("id").over(bucket).alias("first"), F.max("id").over(bucket).alias("last"))
        return ranked.where("first != last").select("id", "name")

    grams = write_out(mixed_buckets(sized.mapInArrow(initial, f"id {kind}, name long")), "suffix-grams")
    per_doc = grams.groupBy("id").agg(F.collect_list("name").alias("grams"))

    def contexts(batches):
        hold_memory()
        for b in pieces(batches, PIECE):
            s = Slice(b, length)
            s.keep(members(b.column("grams"), s.row, s.code))
            name, _, _ = s.contexts()
            one = distinct_rows(s.row, name)
            left, right = s.sides()
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(s.row[one])), *(signed(x[one]) for x in (name, left, right))], ["id", "name", "left", "right"])

    found = sized.join(per_doc, "id").mapInArrow(contexts, f"id {kind}, name long, left long, right long")
    found = found.select("*", (F.min("id").over(bucket) != F.col("id")).alias("later"))
    found = found.select("id", "name", *(F.when(~F.col("later"), F.col(c)).alias(c) for c in ("left", "right")), "later")
    found = write_out(found, "suffix-contexts")
    discard(grams)
    gone = write_out(found.where("later").groupBy("id").agg(F.collect_list("name").alias("whole")), "suffix-gone")
    first = found.where("not later").select("id", "name", "left", "right")
    shared = {side: first.where(f"{side} != 0").groupBy(side).agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select(side, F.lit(True).alias(f"is_{side}")) for side in ("left", "right")}
    still = first.join(shared["left"], "left", "left").join(shared["right"], "right", "left").where("is_left OR is_right")
    still = still.select("id", F.when(F.col("is_left"), F.col("name")).alias("l"), F.when(F.col("is_right"), F.col("name")).alias("r"))
    asked = write_out(still.groupBy("id").agg(F.collect_list("l").alias("lefts"), F.collect_list("r").alias("rights")), "suffix-asked")
    discard(found)

    def last(batches):
        hold_memory()
        for b in pieces(batches, PIECE):
            s = Slice(b, length)
            name, _, _ = s.contexts()
            left, right = members(b.column("lefts"), s.row, name), members(b.column("rights"), s.row, name)
            which = left | right
            s.keep(which)
            row, start = s.windows(left[which], right[which])
            name = s.names(start, length)
            one = distinct_rows(row, name)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[one])), signed(name[one])], ["id", "name"])

    windows = sized.join(asked, "id").mapInArrow(last, f"id {kind}, name long")
    windows = windows.select("id", "name", F.min("id").over(bucket).alias("first")).where("id > first")
    windows = write_out(windows.groupBy("id").agg(F.collect_list("name").alias("windows")), "suffix-windows")
    discard(asked)
    told = gone.join(windows, "id", "full")

    def cut(batches):
        hold_memory()
        for b in pieces(batches, PIECE):
            s = Slice(b, length)
            buf, at, gone_bytes = s.buf, s.at, s.gone(b.column("whole"), b.column("windows"))
            before = np.concatenate([[0], np.cumsum(gone_bytes)])[at]
            inner = gone_bytes[:-1] & gone_bytes[1:]
            inner[at[(at > 0) & (at < len(buf))] - 1] = False
            start = np.flatnonzero(gone_bytes & ~np.concatenate([[False], inner])[: len(buf)])
            end = np.flatnonzero(gone_bytes & ~np.concatenate([inner, [False]])[: len(buf)]) + 1
            until = np.searchsorted(start, at)
            spans = np.stack([start, end], 1) - np.repeat(at[:-1], np.diff(until))[:, None]
            kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((at - before).astype(np.int32)), pa.py_buffer(buf[~gone_bytes])])
            spans = pa.ListArray.from_arrays(pa.array((2 * until).astype(np.int32)), pa.array(spans.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(at)), pa.array(np.diff(before), pa.int64()), pa.array(np.diff(until), pa.int64()), kept, spans], ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
            )

    joined = rows.join(told, "id", "left").select("id", "text", "whole", "windows")
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
