"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1, derived from its code point; the first letters of an
n-gram are rotated by their place (permutation) and multiplied together (binding).  A text's
vector is the sum of its n-gram vectors (bundling); a language's prototype is the sum of its
training texts' vectors, made a unit vector and centred on the mean of all prototypes.  A text gets the
language whose prototype has the largest cosine with its own centred vector.

Bundling is linear, so a prototype needs only the n-gram counts of its language: tasks count
n-grams, sum their vectors, and emit one vector a language, which a grouped sum adds up.
What is collected and broadcast is one vector per language; with more than max_languages distinct
labels the fit raises an error.  A text is read whole; its vector is the sum over its distinct
n-grams, weighted by their counts.

Letters are lower-cased; runs of other characters become one space.  Nulls and odd inputs: a null
text or one without a letter is "und" with score 0; rows with a null label or text teach nothing;
with no labels at all every text is "und"; ties go to the label that sorts first; repeated rows
are predicted alike.  Label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mixed, pieces, remainder

DIMENSIONS = 512
GRAM = 3
RARE = 32  # how the vectors of an n-gram are added up, see bundles; no effect on results
TABLE = 1 << 21  # cells of a count matrix
PLACES = 1 << 13  # vectors gathered at a time


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """One row of +-1 for each code point, the same everywhere."""
    words = mixed(mixed(codes.astype(np.uint64) + U(0xA5A5))[:, None] + np.arange(dims // 64, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(codes), -1), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind: rows of letter indexes to rows of +-1."""
    out = letters[grams[:, -1]]
    for k in range(1, grams.shape[1]):
        out = out * np.roll(letters, k, axis=1)[grams[:, -1 - k]]
    return out


def grams_of(texts: list[str], gram: int = GRAM):
    """(code points, gram index of each place, text of each place, letter indexes of each gram); places are in text order."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n\n\n".join(low) + "\n\n\n").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 3
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    seen = np.flatnonzero(np.bincount(code))
    letter_at = np.zeros(int(seen[-1]) + 1, bool)
    letter_at[seen] = [chr(c).isalpha() for c in seen]
    letter = letter_at[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters only the first after a letter stays, as a space
    code, doc = np.where(letter, code, np.uint32(32))[keep], doc[keep]
    if len(code) < gram:
        return seen, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, gram), np.int64)
    seen = np.flatnonzero(np.bincount(code))
    place_at = np.zeros(int(seen[-1]) + 1, np.int64)
    place_at[seen] = np.arange(len(seen))
    place = place_at[code]
    n = len(code) - gram + 1
    key = np.zeros(n, np.int64)
    for k in range(gram):
        key = key * len(seen) + place[k : n + k]
    whole = doc[:n] == doc[gram - 1 :]
    key, doc = key[whole], doc[:n][whole]
    if len(seen) ** gram <= 4 * TABLE:  # few letters: a table instead of a sort
        table = np.flatnonzero(np.bincount(key, minlength=1))
        index_at = np.zeros(len(seen) ** gram, np.int64)
        index_at[table] = np.arange(len(table))
        index = index_at[key]
    else:
        table, index = np.unique(key, return_inverse=True)
    parts = np.stack([table // len(seen) ** (gram - 1 - k) % len(seen) for k in range(gram)], axis=1)
    return seen, index, doc, parts


def bundles(texts: list[str], dims: int, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """Sum of the n-gram vectors of each group of texts; groups must not decrease.

    N-grams found in the piece about once in RARE groups or more are counted in a dense matrix, a block of groups at a
    time, and multiplied with their vectors; vectors of the rarer ones are added place by place.
    """
    seen, index, doc, parts = grams_of(texts)
    out = np.zeros((n_groups, dims), np.float32)
    if not len(index):
        return out
    vectors = gram_vectors(parts, letter_vectors(seen, dims))
    group = groups[doc]
    common = np.bincount(index, minlength=len(vectors)) * RARE >= n_groups
    column = np.cumsum(common) - 1
    n_common = int(common.sum())
    is_common = common[index]
    if n_common:
        dense = vectors[common].astype(np.float32)
        at, col = group[is_common], column[index[is_common]]
        step = max(1, TABLE // n_common)
        for a in range(0, n_groups, step):
            b = min(n_groups, a + step)
            i, j = np.searchsorted(at, [a, b])
            if j > i:
                count = np.bincount((at[i:j] - a) * n_common + col[i:j], minlength=(b - a) * n_common)
                out[a:b] = count.astype(np.float32).reshape(b - a, n_common) @ dense
    at, gram = group[~is_common], index[~is_common]
    for i in range(0, len(at), PLACES):
        here = at[i : i + PLACES]
        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        out[here[first]] += np.add.reduceat(vectors[gram[i : i + PLACES]], first, axis=0, dtype=np.float32)
    return out


def fit_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS, max_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """Languages in order, and one summed vector each."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in pieces(batches, 1 << 20):
            langs, codes = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            order, texts = np.argsort(codes, kind="stable"), b.column("text").to_pylist()
            v = bundles([texts[i] for i in order], dims, codes[order], len(langs))
            for name, x in zip(langs.tolist(), v):
                sums[name] = sums[name] + x if name in sums else x.astype(np.float64)
            if len(sums) > max_languages:
                raise ValueError(f"more than {max_languages} languages")
        if sums:  # one vector a language and task, however long the task's input
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "v"])

    def total(table: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x.as_py()) for x in table["v"].combine_chunks()], axis=0)
        return pa.table({"lang": table["lang"][:1], "part": pa.array([0], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sliced = rows.mapInArrow(bundle, "lang string, v binary").withColumn("part", (F.rand(7) * 64).cast("int"))
    first = sliced.groupBy("lang", "part").applyInArrow(total, "lang string, part int, v binary")
    found = first.groupBy("lang").applyInArrow(total, "lang string, part int, v binary").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([np.frombuffer(r["v"]) for r in found]).reshape(len(found), dims)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every text: doc_id, lang_pred, score (cosine, at least 0), margin to the second."""
    dims = prototypes.shape[1] if len(languages) else DIMENSIONS
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12) if len(languages) else np.zeros((0, dims))
    centre = unit.mean(0) if len(languages) > 1 else np.zeros(dims)
    own = unit - centre
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((languages, own.astype(np.float32), centre.astype(np.float32)))
    fields = "doc_id {}, lang_pred string, score double, margin double".format(docs.schema[id_col].dataType.simpleString())

    def predict(batches):
        names, own, centre = shared.value
        names = np.array([*names, "und"], object)
        for b in pieces(batches, 1 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            v = bundles(texts, dims, np.arange(len(texts)), len(texts))
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.maximum(norm, 1e-12) - np.where(norm > 0, centre, 0)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            cos = v @ own.T if len(own) else np.zeros((len(texts), 1))
            best = np.where(lettered & (len(own) > 0), cos.argmax(1), len(names) - 1)
            rank = np.sort(cos, axis=1)
            top = np.where(best < len(own), np.clip(rank[:, -1], 0, 1), 0.0)
            gap = np.where(best < len(own), rank[:, -1] - (rank[:, -2] if rank.shape[1] > 1 else 0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(top.astype(np.float64)), pa.array(gap.astype(np.float64))], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, fields)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, prototypes = fit_prototypes(docs.where(remainder("doc_id", 5) != 0))
    found = identify(docs, languages, prototypes)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin")
