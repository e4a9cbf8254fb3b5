"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | subclass, history).
The most frequent words of the training tokens are model words, dealt by frequency into width
classes of width subclasses of width words; the width is the cube root of the vocabulary, up to
`width`, so a token costs three short softmax layers whatever the number of words.  All other words
form one tail class, inside which a word has its smoothed unigram share, so unseen words keep a
probability and the whole stays normalised.  Every layer sums weights of hashed features: the
previous word, the word before it (skip) and, in the first layer, both together.  The rows of
weights grow with the training tokens, up to `rows`; both bounds are for the memory of a worker.
The biases start at the unigram model.

Training is distributed: every trainer streams its share of the texts, takes mini-batch AdaGrad
steps on a copy of the model, and the token-weighted mean of the copies starts the next round
(iterative parameter mixing).  The number of trainers follows the number of tokens, not of cores.
Counts cover all training tokens.  What is broadcast is bounded:
the model (of bounded size) and the words with more than N / head_words of the N tokens, of which there
can be at most head_words.  Counts of all other words reach their documents by a join; no such
word has more than N / head_words occurrences, so that join has no hot key.

Nulls and ties: a null text is an empty one (a single end token); a null id is kept and takes
part in training; repeated rows are scored alike, each counting in training; an empty training
set gives log10(0.5 / 0.5) = 0 for every token, in the base and in the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Lookup, discard, mixed, pieces, remainder, text_buffer, words_of, write_out

END = U(0x5851F42D4C957F2D)  # hash of the end token
BEGIN = U(0x14057B7EF767814F)


@dataclass(frozen=True)
class Settings:
    width: int = 32  # classes, subclasses of a class, and words of a subclass, at most
    rows: int = 1 << 16  # rows of hashed weights, at most
    tokens_a_row: int = 64
    tokens_a_trainer: int = 3_000_000
    trainers: int = 4096
    rounds: int = 2
    head_words: int = 1 << 18
    batch: int = 1 << 13
    rate: float = 0.25


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with the end tokens, first token of each document and the end)."""
    words, _, first = words_of(*text_buffer(batch.column("text")))
    n = len(first) - 1
    out = np.full(len(words) + n, END, dtype=np.uint64)
    at = first + np.arange(n + 1)
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = words
    return out, at


def features(tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, two = np.empty_like(tok), np.empty_like(tok)
    one[1:], two[2:] = tok[:-1], tok[:-2]
    one[at[:-1]] = BEGIN
    two[at[:-1]] = BEGIN
    second = at[:-1] + 1
    two[second[second < at[1:]]] = BEGIN
    return one, mixed(one * U(3) + two * U(0xD6E8FEB86659FD93)), mixed(two + U(77))


def most(z: np.ndarray) -> np.ndarray:
    """Largest value of each row, by halves of the columns, which is faster than a reduction of short rows."""
    while (n := z.shape[1]) > 1:
        half = n // 2
        m = np.maximum(z[:, :half], z[:, half : 2 * half])
        if n % 2:
            np.maximum(m[:, :1], z[:, -1:], out=m[:, :1])
        z = m
    return z


class Model:
    """Biases and weights of the three layers; words: hashes of the model words by falling count."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: float, tail_mass: float, width: int, rows: int):
        self.width, self.rows, self.tail = width, rows, width**3
        order = np.argsort(words)
        self.find, self.slot = Lookup(words[order]), order.astype(np.int32)
        mass = np.zeros(self.tail)
        mass[: len(counts)] = counts + 0.5
        words_of_class = mass.reshape(width * width, width)
        classes = words_of_class.sum(1).reshape(width, width)
        layers = [np.append(classes.sum(1), tail_mass)[None] / max(total, 1e-9), classes, words_of_class]
        self.bias = []
        for shares in layers:
            bias = np.log(np.maximum(shares, 1e-30))
            bias -= bias.max(1, keepdims=True)
            self.bias.append(np.where(shares == 0, -80, bias).astype(np.float32))
        self.weight = [np.zeros((rows, b.shape[1]), np.float32) for b in self.bias]

    def parts(self):
        return [*self.weight, *self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for p in self.parts():
            p.ravel()[:] = flat[at : at + p.size]
            at += p.size
        return self

    def code(self, tok: np.ndarray) -> np.ndarray:
        """Place of each token among the model words, or the tail's code."""
        found = self.find(tok)
        return np.where(found >= 0, self.slot[np.maximum(found, 0)] if len(self.slot) else 0, self.tail)

    def layers(self, code: np.ndarray, f):
        """For each layer: its number, the tokens that reach it, their context, outcome, feature rows and probabilities."""
        every = np.arange(len(code))
        head = np.flatnonzero(code < self.tail)
        w = self.width
        for layer, at in enumerate((every, head, head)):
            if not len(at):
                continue
            c = code[at]
            context, outcome = ((np.zeros_like(c), c // (w * w)), (c // (w * w), c // w % w), (c // w, c % w))[layer]
            salt = context.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(layer + 1)
            used = f if layer == 0 else (f[0], f[2])
            rows = [(mixed(x[at] + salt) >> U(18)).astype(np.int64) & (self.rows - 1) for x in used]
            z = self.bias[layer].take(context, axis=0)
            for r in rows:
                z += self.weight[layer].take(r, axis=0)
            z -= most(z)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            yield layer, at, context, outcome, rows, z

    def log10(self, code: np.ndarray, f) -> np.ndarray:
        """log10 of the model word or of the tail class; the tail's share of a word comes later."""
        out = np.zeros(len(code))
        for _, at, _, outcome, _, p in self.layers(code, f):
            out[at] += np.log10(np.maximum(p[np.arange(len(at)), outcome], 1e-30))
        return out


class Trainer:
    """AdaGrad steps on a model, with one rate a row."""

    def __init__(self, model: Model, rate: float):
        self.m, self.rate = model, rate
        self.seen = {id(table): np.ones(len(table), np.float32) for table in model.parts()}

    def move(self, table: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        size = np.diff(first, append=len(rows))
        g = grad.take(order.take(first), axis=0)  # a row met once needs no sum
        many = np.flatnonzero(size > 1)
        if len(many):
            k = size.take(many)
            g[many] = np.add.reduceat(grad.take(order.compress(np.repeat(size > 1, size)), axis=0), np.cumsum(k) - k, axis=0)
        rows, seen = rows.take(first), self.seen[id(table)]
        now = seen.take(rows) + np.einsum("ij,ij->i", g, g)
        seen[rows] = now
        g *= (self.rate / np.sqrt(now))[:, None]
        np.subtract(table.take(rows, axis=0), g, out=g)
        table[rows] = g

    def step(self, code: np.ndarray, f) -> None:
        for layer, at, context, outcome, rows, p in self.m.layers(code, f):
            p[np.arange(len(at)), outcome] -= 1
            for r in rows:
                self.move(self.m.weight[layer], r, p)
            self.move(self.m.bias[layer], context, p)


def shape_of(vocabulary: int, total: int, s: Settings) -> tuple[int, int]:
    """(width, rows): the cube root of the vocabulary and a power of two near the tokens, within their bounds."""
    width = min(s.width, max(2, math.ceil(round(vocabulary ** (1 / 3), 6))))
    return width, min(s.rows, 1 << max(8, math.ceil(math.log2(max(total, 1) / s.tokens_a_row))))


def token_counts(train: DataFrame) -> DataFrame:
    """(h, c): every token's hash and count over all texts."""

    def count(batches):
        for b in pieces(batches):
            h, c = np.unique(tokens(b)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def lm_score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Score every text; train: Column that is true for rows to learn from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary.
    """
    s, spark = settings, docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    learn = rows.where("train")
    counts = write_out(token_counts(learn), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    N, V = int(total["n"]), int(total["v"])
    bar = N // s.head_words
    head = counts.where(F.col("c") > bar).toArrow()  # at most head_words rows
    hh, hc = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(hh)
    hh, hc = hh[order], hc[order]
    width, n_rows = shape_of(V, N, s)
    top = np.lexsort((hh, -hc))[: width**3]
    spread = N + 0.5 * (V + 1)
    tail_mass = max(spread - float((hc[top] + 0.5).sum()), 0.5)
    start = (hh[top], hc[top], spread, tail_mass, width, n_rows)
    weights = Model(*start).flat()
    trainers = min(s.trainers, -(-N // s.tokens_a_trainer))
    for r in range(s.rounds if N else 0):
        shared = sc.broadcast((start, weights))

        def fit(batches, shared=shared):
            model = Model(*shared.value[0]).load(shared.value[1])
            trainer, seen = Trainer(model, s.rate), 0
            for b in pieces(batches):
                tok, at = tokens(b)
                f, code = features(tok, at), model.code(tok)
                for i in range(0, len(tok), s.batch):
                    trainer.step(code[i : i + s.batch], [x[i : i + s.batch] for x in f])
                seen += len(tok)
            out, size = model.flat(), 1 << 16
            for block in range(0, len(out) if seen else 0, size):
                part = pa.array([out[block : block + size].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([float(seen)]), part], ["block", "n", "w"])

        def mean(table: pa.Table) -> pa.Table:
            total, sums = 0.0, 0.0
            for k, x in zip(table["n"].to_pylist(), table["w"]):
                total, sums = total + k, sums + k * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
            w = (sums / total).astype(np.float32).tobytes()
            return pa.table({"block": table["block"][:1], "w": pa.array([w], pa.binary())})

        shard = learn.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.rounds)) == r)
        copies = shard.select("text").coalesce(trainers).mapInArrow(fit, "block long, n double, w binary")
        mixture = write_out(copies.groupBy("block").applyInArrow(mean, "block long, w binary"), "lm-model")
        found = mixture.toArrow().sort_by("block")
        if found.num_rows:
            weights = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in found["w"]])
        del found
        discard(mixture)
        shared.unpersist()
    shared = sc.broadcast((hh, hc, start, weights))
    fields = "doc_id {}, held_out boolean, rid long, n_tokens long, head_known long, head_base double, head_score double, n_tail long, rare_h binary, rare_n binary".format(rows.schema["doc_id"].dataType.simpleString())

    def score(batches):
        hh, hc, start, flat = shared.value
        model, find = Model(*start).load(flat), Lookup(hh)
        head_log = np.log10(hc + 0.5) if len(hc) else np.zeros(1)
        for b in pieces(batches):
            tok, at = tokens(b)
            f, code = features(tok, at), model.code(tok)
            lp = np.concatenate([model.log10(code[i : i + s.batch], [x[i : i + s.batch] for x in f]) for i in range(0, len(tok), s.batch)])
            found = find(tok)
            known = found >= 0
            base = np.where(known, head_log[np.maximum(found, 0)], 0.0)
            tailed = code == model.tail
            lp += np.where(tailed, base, 0.0)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            rare = ~known
            key = np.empty(int(rare.sum()), dtype=[("d", np.int64), ("h", np.uint64)])
            key["d"], key["h"] = doc[rare], tok[rare]
            order = np.lexsort((key["h"], key["d"]))
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], (key["d"][1:] != key["d"][:-1]) | (key["h"][1:] != key["h"][:-1])])) if len(key) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(key))).astype(np.int32)
            cut = np.searchsorted(key["d"][first], np.arange(len(at)))
            kh = key["h"][first]
            add = lambda x: np.add.reduceat(x, at[:-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("rid"), pa.array(np.diff(at)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(lp)), pa.array(add(tailed.astype(np.int64))),
                 pa.array([kh[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([tf[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())],
                ["doc_id", "held_out", "rid", "n_tokens", "head_known", "head_base", "head_score", "n_tail", "rare_h", "rare_n"],
            )

    scored = write_out(rows.select("doc_id", "text", (~F.col("train")).alias("held_out"), F.xxhash64("doc_id", "text").alias("rid")).mapInArrow(score, fields), "lm-head")

    def unpack(batches):
        for b in batches:
            hs, ns = b.column("rare_h").to_pylist(), b.column("rare_n").to_pylist()
            k = np.fromiter((len(x) // 4 for x in ns), np.int64, len(ns))
            h, n = np.frombuffer(b"".join(hs), np.int64), np.frombuffer(b"".join(ns), np.int32)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("rid")), k)), pa.array(h), pa.array(n)], ["rid", "h", "tf"])

    once = scored.groupBy("rid").agg(F.count("*").alias("copies"))
    rare = scored.select("rid", "rare_h", "rare_n").mapInArrow(unpack, "rid long, h long, tf int")
    known = rare.join(counts.where(F.col("c") <= bar), "h", "left")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    tails = known.groupBy("rid").agg(F.sum(F.col("tf") * log_c).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"))
    extra = once.join(tails, "rid", "left").select("rid", *((F.coalesce(F.col(c), F.lit(0)) / F.col("copies")).alias(c) for c in ("rare_log", "rare_known")))
    found = scored.join(extra, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(spread))).alias("base_score"),
        (F.col("head_score") + F.col("rare_log") - F.col("n_tail") * float(np.log10(tail_mass if N else 0.5))).alias("score"),
        F.lit(V).cast("long").alias("vocabulary"),
    )
    found = write_out(found, "lm-result")
    discard(counts, scored)
    return found


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_score(docs, remainder("doc_id", 5) != 1)
