"""Benchmark decontamination: block-max WAND over a BM25 index of the test items.

The items are indexed once: postings with BM25 weights divided by the item's own score, so that a
passage holding the whole item scores 1, and for each term and block of 16 items the largest such
weight.  Every text is cut into overlapping passages of twice the longest item; each passage is a
query of its distinct words.  Retrieval of all items above a threshold, for a whole slice of
passages at a time:

1. terms of a passage are ordered by their largest weight; those whose sum stays under the
   threshold cannot lift an item alone, so only the others (behind the pivot) open postings;
2. for each (passage, block) opened, the sum of the block maxima of all the passage's terms bounds
   its items; blocks under the threshold are skipped;
3. the items that remain are scored in full, and kept at or above the threshold.

A retrieved item is verified in its passage: at least `similarity` of the five-word shingles of the
question (the first three quarters of the item; of an item under six words the whole) and of the
words of the answer (the rest) must occur there.  An item of any length fits a passage, since every
run of words of half a passage's length lies inside one.

Document frequencies, the number of items, their mean and greatest length are those of all items,
counted once.  Only then are items taken in blocks of block_items, each with its own postings, so the
result does not depend on the blocks.  One block is matched in the scan of the texts; several are
matched one after the other, each in a written pass that keeps its hits alone, so that no more than
one block's index is held at a time.  Words here: lower-case A-Z, runs of bytes other than ASCII
punctuation and white space, so that attached symbols hide no passage; compared by 64-bit hash.

Nulls and odd inputs: a null or wordless text and a null or wordless item match nothing (an item under five words
must occur as a whole); repeated items all match, rows equal in item and text once; repeated rows are
judged alike; with no items every text is clean; an input column `_items` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U, Lookup, discard, mixed, pieces, temporary, text_buffer, words_of, write_out

SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 16
NARROW = 64  # blocks up to which all block bounds of a passage are summed
DENSE = 1 << 23  # cells of a flat weight table
CELLS = 1 << 18  # terms of (passage, block) or (passage, item) that are summed at once, for a worker's memory
SLICE = 1 << 20  # bytes of texts that are matched at once, likewise


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every run of k words."""
    if len(h) < k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * U(3) + h[i : i + len(out)])
    return out


def parts_of(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(shingle length, question shingles, answer words): the answer is the last quarter of an item."""
    cut = len(h) - len(h) // 4
    cut = len(h) if cut < SHINGLE else cut
    k = min(SHINGLE, cut)
    return k, shingles(h[:cut], k), h[cut:]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., for each run one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    return np.arange(total) - np.repeat(start - first, size)


@dataclass
class Index:
    """Postings and block maxima of some items."""

    ids: pa.Array
    terms: np.ndarray
    cut: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_key: np.ndarray
    block_max: np.ndarray
    largest: np.ndarray
    span: int
    parts: list = field(repr=False)
    flat: dict = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array, counts: "ItemCounts") -> "Index":
        h, _, at = words_of(*text_buffer(texts), ALNUM)
        n, size = len(ids), np.diff(at)
        item = np.repeat(np.arange(n), size)
        pair = np.zeros(len(h), dtype=[("h", np.uint64), ("i", np.int64)])
        pair["h"], pair["i"] = h, item
        pair, tf = np.unique(pair, return_counts=True)
        terms, term = np.unique(pair["h"], return_inverse=True)
        df = counts.df(terms)
        idf = np.log1p((counts.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / counts.mean)
        w = idf[term] * tf * (K1 + 1) / (tf + norm[pair["i"]])
        w /= np.bincount(pair["i"], w, n)[pair["i"]]
        key = term * ((n + BLOCK - 1) // BLOCK) + pair["i"] // BLOCK
        block_key, first = np.unique(key, return_index=True)
        block_max = np.maximum.reduceat(w, first) if len(w) else w
        largest = np.maximum.reduceat(w, np.searchsorted(term, np.arange(len(terms)))) if len(w) else w
        parts = [parts_of(h[a:b]) for a, b in zip(at[:-1], at[1:])]
        first_posting = np.searchsorted(term, np.arange(len(terms) + 1))
        span = max(64, 2 * counts.longest)
        return cls(ids, terms, first_posting, pair["i"], w, block_key, block_max, largest, span, parts)

    def at(self, keys, values, wanted):
        """Values of the wanted keys, 0 where there is none; by a flat table while that is small."""
        if not len(keys):
            return np.zeros(len(wanted))
        if keys[-1] < DENSE:
            flat = self.flat.get(id(values))
            if flat is None:
                flat = self.flat[id(values)] = np.zeros(len(self.terms) * (len(self.ids) + 1))
                flat[keys] = values
            return flat[wanted]
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], 0.0)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) with score >= threshold; the input has distinct pairs sorted by passage."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = np.bincount(passage, self.largest[term]) if len(passage) else np.zeros(0)
        live = bound[passage] >= threshold if len(passage) else np.zeros(0, bool)
        passage, term = passage[live], term[live]
        n_blocks = (len(self.ids) + BLOCK - 1) // BLOCK
        if len(passage) and n_blocks <= NARROW:  # then the block bounds of all passages come at once
            start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            most = np.add.reduceat(self.block_table[term], start, axis=0).max(axis=1)
            live = np.repeat(most >= threshold - 1e-5, np.diff(np.append(start, len(passage))))
            passage, term = passage[live], term[live]
        if not len(passage):
            return none
        order = np.lexsort((self.largest[term], passage))
        passage, term = passage[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        size = np.diff(np.append(first, len(passage)))
        run = np.cumsum(self.largest[term])
        run -= np.repeat(run[first] - self.largest[term[first]], size)
        opens = np.flatnonzero(run >= threshold - 1e-9)
        n = len(self.ids)
        slot = np.repeat(np.arange(len(first)), size)
        long = self.cut[term[opens] + 1] - self.cut[term[opens]]
        found = np.unique(np.repeat(slot[opens], long) * n + self.items[runs(self.cut[term[opens]], long)])
        group, item = found // n, found % n
        blocks, which = np.unique(group * n_blocks + item // BLOCK, return_inverse=True)

        def sums(groups, key_of):
            out = []
            step = max(1, CELLS // max(1, int(size.max())))
            for i in range(0, len(groups), step):
                g = groups[i : i + step]
                at = runs(first[g], size[g])
                out.append(np.bincount(np.repeat(np.arange(len(g)), size[g]), key_of(term[at], np.repeat(np.arange(i, i + len(g)), size[g])), len(g)))
            return np.concatenate(out) if out else np.zeros(0)

        block = blocks % n_blocks
        most = sums(blocks // n_blocks, lambda t, k: self.at(self.block_key, self.block_max, t * n_blocks + block[k]))
        keep = most[which] >= threshold - 1e-9
        group, item = group[keep], item[keep]
        score = sums(group, lambda t, k: self.at(self.posting_key, self.weights, t * n + item[k]))
        keep = score >= threshold - 1e-9
        return passage[first][group[keep]], item[keep], score[keep]

    @property
    def block_table(self):
        if not hasattr(self, "_table"):
            n_blocks = (len(self.ids) + BLOCK - 1) // BLOCK
            self._table = np.zeros((len(self.terms), n_blocks), np.float32)
            self._table.ravel()[self.block_key] = self.block_max
        return self._table

    @property
    def posting_key(self):
        if not hasattr(self, "_key"):
            self._key = np.repeat(np.arange(len(self.terms)), np.diff(self.cut)) * len(self.ids) + self.items
        return self._key


def match_slice(index: Index, find: Lookup, batch: pa.RecordBatch, threshold: float, similarity: float):
    """Verified (row, item, score) of a slice of texts."""
    h, _, at = words_of(*text_buffer(batch.column("text")), ALNUM)
    term = find(h).astype(np.int64)
    size, half = np.diff(at), index.span // 2
    windows = np.maximum(1, (size + half - 1) // half)  # window k of a text starts at its word k * half
    first_window = np.cumsum(windows) - windows
    doc = np.repeat(np.arange(len(size)), size)
    at_word = np.arange(len(h)) - at[:-1][doc]
    hit = np.flatnonzero(term >= 0)
    later = at_word[hit] // half
    own = first_window[doc[hit]]
    before = later > 0
    key = np.concatenate([own + later, (own + later - 1)[before]]) * len(index.terms) + np.concatenate([term[hit], term[hit][before]])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    passage, item, score = index.retrieve(key // len(index.terms), key % len(index.terms), threshold)
    row = np.searchsorted(first_window, passage, "right") - 1
    out: dict = {}
    for p, i, s, r in zip(passage.tolist(), item.tolist(), score.tolist(), row.tolist()):
        a = at[r] + (p - first_window[r]) * half
        words = h[a : min(a + index.span, at[r + 1])]
        k, question, answer = index.parts[i]
        if np.isin(question, shingles(words, k)).mean() >= similarity and (not len(answer) or np.isin(answer, words).mean() >= similarity):
            out[r, i] = max(s, out.get((r, i), 0.0))
    return out


def hit_lists(index: Index, texts: pa.Array, threshold: float, similarity: float) -> pa.ListArray:
    """Verified (item, score) of each text; the texts stay in Arrow's buffers and are matched by slices."""
    found, done = [], 0
    for b in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], SLICE):
        found += [(done + r, i, s) for (r, i), s in match_slice(index, index.find, b, threshold, similarity).items()]
        done += b.num_rows
    found.sort(key=lambda hit: hit[0])
    row, item, score = zip(*found) if found else ((), (), ())
    hits = pa.StructArray.from_arrays([index.ids.take(pa.array(item, pa.int64())), pa.array(score, pa.float64())], ["item", "score"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), hits)


class ItemCounts:
    """Counts over all items: their number, mean and greatest length, and the items that hold each word."""

    def __init__(self, listed: DataFrame):
        def words(batches):
            for b in pieces(batches):
                h, _, at = words_of(*text_buffer(b.column("text")), ALNUM)
                size = np.diff(at)
                pair = np.zeros(len(h), dtype=[("i", np.int64), ("h", np.uint64)])
                pair["i"], pair["h"] = np.repeat(np.arange(len(size)), size), h
                word = np.unique(pair)["h"].view(np.int64)
                long = np.concatenate([size, np.zeros(len(word), np.int64)])
                every = np.concatenate([np.zeros(len(size), np.int64), word])
                is_item = np.arange(len(every)) < len(size)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(long), pa.array(is_item)], ["h", "size", "is_item"])

        found = write_out(listed.select("text").mapInArrow(words, "h long, size long, is_item boolean"), "bench-words")
        total = found.where("is_item").agg(F.count("*"), F.avg("size"), F.max("size")).first()
        self.items, self.mean, self.longest = total[0], max(total[1] or 1.0, 1e-9), total[2] or 1
        self.table = write_out(found.where("NOT is_item").groupBy("h").agg(F.count("*").alias("df")), "bench-df")
        discard(found)

    def df(self, terms: np.ndarray) -> np.ndarray:
        """Document frequencies of the sorted terms of one block."""
        wanted = self.table.sparkSession.createDataFrame(pa.table({"h": pa.array(terms.view(np.int64))}))
        found = self.table.join(wanted, "h").toArrow()
        h, df = found["h"].to_numpy().view(np.uint64), found["df"].to_numpy()
        return df[np.argsort(h)]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    threshold: float = 0.5,
    similarity: float = 0.8,
    block_items: int = 4096,
) -> DataFrame:
    """All columns of docs, and _items: struct (item, score) of each verified item; empty for clean texts."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    hits = f"array<struct<item:{kind},score:double>>"
    listed = items.select(F.col(item_col).alias("item"), "text").where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).distinct()
    own = [F.col(c) for c in docs.columns if c.lower() != "_items"]
    blocks = -(-listed.count() // block_items)
    if not blocks:
        return docs.select(*own, F.array().cast(hits).alias("_items"))
    counts = ItemCounts(listed)

    def index(k: int):
        block = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").toArrow()
        return spark.sparkContext.broadcast(Index.build(block["item"].combine_chunks(), block["text"], counts)) if block.num_rows else None

    def matcher(shared):
        @F.arrow_udf(hits)
        def match(texts):
            index = shared.value
            if not hasattr(index, "find"):
                index.find = Lookup(index.terms)
            return hit_lists(index, texts, threshold, similarity)

        return match

    if blocks == 1:
        found = docs.select(*own, matcher(index(0))(F.col(text_col)).alias("_items"))
        discard(counts.table)
        return found
    passes = []
    for k in range(blocks):
        shared = index(k)
        if shared is None:
            continue
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
        hit = texts.select("id", "body", matcher(shared)("text").alias("hits")).where(F.size("hits") > 0)
        passes.append(write_out(hit.distinct(), "bench-hits"))
        shared.unpersist()
    discard(counts.table)
    each = reduce(DataFrame.union, passes).select("id", "body", F.explode("hits").alias("hit"))
    key, body, all_hits = (temporary(docs, name) for name in ("hit_id", "hit_body", "hit_list"))
    by_text = each.groupBy(F.col("id").alias(key), F.col("body").alias(body)).agg(F.collect_list("hit").alias(all_hits))
    by_text = write_out(by_text, "bench-found")
    discard(*passes)
    joined = docs.join(by_text, docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(body)), "left")
    return joined.select(*own, F.coalesce(all_hits, F.array().cast(hits)).alias("_items"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.col("_items.item"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.concat_ws(",", items.cast("array<string>")).alias("item_ids"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the texts that hold a test item.

    Null texts and null ids stay; repeated rows are judged alike; without items nothing goes; all columns pass through.
    """
    kept = [c for c in docs.columns if c.lower() != "_items"]
    aside = temporary(docs, "aside")
    named = docs.select(*kept, *(F.col(c).alias(aside) for c in docs.columns if c not in kept))
    found = decontaminate(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("_items") == 0)
    return found.select(*(F.col(c if c in kept else aside).alias(c) for c in docs.columns))


ORACLE_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS raw FROM benchmark WHERE regexp_matches(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')),
b2 AS (SELECT item_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w,
   CASE WHEN len(raw) - len(raw) // 4 < {SHINGLE} THEN len(raw) ELSE len(raw) - len(raw) // 4 END AS cut FROM b),
p AS (SELECT greatest(32, max(len(w))) AS half FROM b2),
q AS (SELECT item_id, unnest(CASE WHEN cut < {SHINGLE} THEN [array_to_string(w[1:cut], ' ')]
   ELSE list_transform(range(1, cut - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM b2),
a AS (SELECT item_id, unnest(w[cut + 1:]) AS g FROM b2),
qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), an AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g, w[i] AS x, i + {SHINGLE - 1} <= len(w) AS whole FROM t),
gw AS (SELECT doc_id, g, (i - 1) // half AS win FROM g, p WHERE whole AND g IN (SELECT g FROM q)
   AND (i + {SHINGLE - 2}) // half < (i - 1) // half + 2
  UNION SELECT doc_id, g, (i - 1) // half - 1 FROM g, p WHERE whole AND g IN (SELECT g FROM q) AND i > half AND (i + {SHINGLE - 2}) // half < (i - 1) // half + 1),
qh AS (SELECT doc_id, win, q.item_id, count(*) AS n FROM gw JOIN q USING (g) GROUP BY ALL),
qk AS (SELECT doc_id, win, item_id FROM qh JOIN qn USING (item_id) WHERE qh.n >= 0.8 * qn.n),
ww AS (SELECT DISTINCT doc_id, x AS g, win FROM (SELECT doc_id, x, (i - 1) // half AS win FROM g, p UNION ALL SELECT doc_id, x, (i - 1) // half - 1 FROM g, p WHERE i > half)
   WHERE (doc_id, win) IN (SELECT (doc_id, win) FROM qk)),
ah AS (SELECT qk.doc_id, qk.win, a.item_id, count(*) AS n FROM qk JOIN a USING (item_id) JOIN ww ON ww.doc_id = qk.doc_id AND ww.win = qk.win AND ww.g = a.g GROUP BY ALL),
hit AS (SELECT DISTINCT qk.doc_id, qk.item_id FROM qk LEFT JOIN an USING (item_id) LEFT JOIN ah ON ah.doc_id = qk.doc_id AND ah.win = qk.win AND ah.item_id = qk.item_id
   WHERE an.n IS NULL OR coalesce(ah.n, 0) >= 0.8 * an.n)
SELECT d.doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS item_ids
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id"""
