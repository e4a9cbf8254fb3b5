"""The k most similar rows of every query vector, by blocks: a matrix product picks candidates, doubles rank them.

The product is in single precision; whatever its error and the rounding to six decimals may have moved below the
k-th place is kept and worked out again as the SQL text does it: sums in order of the elements, in double precision.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, ASKED, CHUNK, PAIRS = 16384, 4096, 256, 1 << 18  # rows and queries of a block, queries a product, pairs ranked at once
BLOCK = "ids binary, labels binary, known binary, vectors binary"
HITS = "query_id long, vec_id long, label int, similarity double"


def to_blocks(size: int):
    def run(batches):
        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held)
            ids, labels = t["vec_id"].combine_chunks(), t["label"].combine_chunks()
            rows = t["embedding"].combine_chunks()
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            lengths = np.unique(rows.value_lengths().drop_null().to_numpy(zero_copy_only=False))
            flat = rows.flatten()
            if len(lengths) > 1 or flat.null_count:
                raise ValueError("embeddings differ in length or hold nulls")
            vectors = np.full((len(rows), int(lengths[0]) if len(lengths) else 1), np.nan, dtype=np.float32)
            vectors[rows.is_valid().to_numpy(zero_copy_only=False)] = flat.to_numpy(zero_copy_only=False).reshape(-1, vectors.shape[1])
            parts = (ids.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64), labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32), labels.is_valid().to_numpy(zero_copy_only=False), vectors)
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["ids", "labels", "known", "vectors"])

        for batch in batches:
            while len(batch):
                piece = batch.slice(0, size - n)
                held.append(piece)
                n, batch = n + len(piece), batch.slice(len(piece))
                if n == size:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def opened(row: dict, prefix: str = ""):
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    vectors = np.frombuffer(row[prefix + "vectors"], np.float32).reshape(len(ids), -1)
    return ids, np.frombuffer(row[prefix + "labels"], np.int32), np.frombuffer(row[prefix + "known"], bool), vectors


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero, as of the shortest decimal form; only values near a half need that form."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5), x) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i].astype(np.float64) * b[:, i]
    return total


def spare(ids: np.ndarray, labels: np.ndarray, known: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best: of equal vectors with equal labels the k least ids, and as many more as one id has rows."""
    more = np.unique(ids, return_counts=True)[1].max()
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, labels, known, same))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(same[order]) != 0) | (np.diff(labels[order]) != 0) | (known[order][1:] != known[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < k + more])


def best_pairs(k: int, other_label: bool):
    def ranked(q, v, qv, qn, ids, vectors, norms):
        """The k best pairs (q, v) of each query, with their similarity: not a number (a vector of zeros) comes first, as in SQL, null last."""
        sim = np.empty(len(q))
        for a in range(0, len(q), PAIRS):
            s = slice(a, a + PAIRS)
            with np.errstate(invalid="ignore", divide="ignore"):
                sim[s] = in_order(vectors[v[s]], qv[q[s]]) / np.sqrt(norms[v[s]] * qn[q[s]])
        none = np.isnan(vectors).all(axis=1)[v] | np.isnan(qv).all(axis=1)[q]
        fine = np.isfinite(sim)
        sim[fine] = rounded(sim[fine])
        order = np.lexsort((ids[v], np.where(none, np.inf, np.where(fine, -sim, -np.inf)), q))
        q = q[order]
        first = np.searchsorted(q, q)
        order = order[np.arange(len(order)) - first < k]
        return order, sim, none

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, known, vectors = opened(row)
                keep = spare(ids, labels, known, vectors, k)
                ids, labels, known, vectors = ids[keep], labels[keep], known[keep], vectors[keep]
                qids, qlabels, qknown, qvectors = opened(row, "q_")
                if vectors.shape[1] != qvectors.shape[1] and not (np.isnan(vectors).all() or np.isnan(qvectors).all()):
                    raise ValueError("embeddings differ in length")
                norms, qnorms = in_order(vectors, vectors), in_order(qvectors, qvectors)
                usable, absent, width = norms > 0, np.isnan(vectors).all(axis=1), vectors.shape[1]
                unit = np.where(usable[:, None], vectors / np.sqrt(np.where(usable, norms, 1))[:, None], 0).astype(np.float32)
                slack = np.float32(2 * (width + 8) * 2.0**-23 + 2e-6)
                by_id = np.argsort(ids, kind="stable")
                for a in range(0, len(qids), CHUNK):
                    s = slice(a, a + CHUNK)
                    qid, ql, qk, qv, qn = qids[s], qlabels[s], qknown[s], qvectors[s], qnorms[s]
                    good = qn > 0
                    near = np.where(good[:, None], qv / np.sqrt(np.where(good, qn, 1))[:, None], 0).astype(np.float32) @ unit.T
                    near[:, ~usable], near[~good] = 9, 9  # not a number: before all others
                    near[:, absent], near[np.isnan(qv).all(axis=1)] = -2, -2  # null: after all others
                    low, high = np.searchsorted(ids[by_id], qid), np.searchsorted(ids[by_id], qid, "right")
                    for i in np.flatnonzero(high > low):
                        near[i, by_id[low[i] : high[i]]] = -9  # itself
                    if other_label:
                        near[(ql[:, None] == labels[None, :]) | ~known[None, :] | ~qk[:, None]] = -9
                    if near.shape[1] > k:
                        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - slack
                    else:
                        least = np.full(len(qid), -3, dtype=np.float32)
                    q, v = np.nonzero(near >= np.maximum(least, np.float32(-3))[:, None])
                    if len(q) == 0:
                        continue
                    order, sim, none = ranked(q, v, qv, qn, ids, vectors, norms)
                    q, v, sim, none = q[order], v[order], sim[order], none[order]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qid[q]), pa.array(ids[v]), pa.array(labels[v], mask=~known[v]), pa.array(sim, mask=none)],
                        ["query_id", "vec_id", "label", "similarity"],
                    )

    return run


def hits(rows: DataFrame, every: int, k: int, other_label: bool = False) -> DataFrame:
    """Rows (query_id, vec_id, label, similarity): of every query (id divisible by `every`) at least its k best other rows, the best first, then by id."""
    rows = rows.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where(F.col("vec_id") % every == 0).repartition(2).mapInArrow(to_blocks(ASKED), BLOCK)
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    return rows.repartition(parts).mapInArrow(to_blocks(ROWS), BLOCK).crossJoin(asked).mapInArrow(best_pairs(k, other_label), HITS)
