"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K share one weight vector: P(grade >= k) = sigmoid(w.x - theta_k),
with thresholds theta_1 <= ... <= theta_K.  Features are hashed words (letters only, lower case)
and their beginnings of 4 to 7 letters, which let compounds share a stem; each is present or
absent, so that long texts are judged whole.  The result carries the probability of each
threshold and the expected severity, their sum.

The model is fitted on a bounded sample of labelled texts: at most max_rows, those with the
smallest hash of their id; features seen in fewer than least_docs of them are left out, and an L1
penalty that falls with the sample's size keeps the weights sparse; weights that the penalty holds
at zero after the first steps leave the fit.  Fitting is one task over the sampled texts' feature
numbers, so the driver gets the weights alone; the task holds these numbers once, four bytes each,
and works on them by parts.  Scoring reads all texts.

Nulls and odd inputs: a null or wordless text has no features and gets the prior severity; a null
id is scored; null grades and labels without a text teach nothing; several grades of one id all
count; with no labelled text, or only grade 0, nothing is rejected; ids with equal hashes are taken
in the order of id and grade; an input column named like a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, setting, temporary

BUCKETS = 1 << 20
MAX_ROWS = 12_000
LEAST_DOCS = 5
STEMS = (4, 5, 6, 7)
WORD = regex.compile(r"\p{L}+")
PART = 1 << 20  # feature numbers that the fit reads at once; their sums are added part by part, so it shows in the last digits
BATCH = 4 << 20  # bytes of a batch on its way to the fit's workers


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers."""
    from zlib import crc32

    words = set(WORD.findall((text or "").lower()))
    words |= {"^" + w[:k] for w in words for k in STEMS if len(w) >= k}
    return np.unique(np.fromiter((crc32(w.encode()) & (BUCKETS - 1) for w in words), np.int32, len(words)))


@dataclass
class OrdinalModel:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    table: np.ndarray | None = field(default=None, repr=False, compare=False)  # made once a worker

    def severity(self, texts: list[str | None]) -> np.ndarray:
        """(texts, thresholds): probability of reaching each grade."""
        if not self.thresholds:
            return np.zeros((len(texts), 0))
        if self.table is None:
            self.table = np.zeros(BUCKETS)
            self.table[list(self.weights)] = list(self.weights.values())
        z = np.array([self.table[text_features(t)].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(self.thresholds), -40, 40)))


class Rows:
    """Feature numbers of rows, end to end; read and cut by parts, so that little but the numbers themselves is held."""

    def __init__(self, rows: Iterable[np.ndarray]):
        held, sizes = bytearray(), []
        for r in rows:
            held.extend(r)
            sizes.append(len(r))
        self.flat, self.sizes = np.frombuffer(held, np.int32), np.array(sizes, np.int64)

    def parts(self):
        """Each part's place in flat, and the row of each of its numbers."""
        ends = np.cumsum(self.sizes)
        for i in range(0, len(self.flat), PART):
            j = min(i + PART, len(self.flat))
            a, b = np.searchsorted(ends, [i, j - 1], "right")
            yield slice(i, j), np.repeat(np.arange(a, b + 1), np.diff(ends[a:b], prepend=i, append=j))

    def cut(self, live: np.ndarray) -> None:
        """Leave the live features alone, numbered anew."""
        number, sizes, n = (np.cumsum(live) - 1).astype(np.int32), np.zeros_like(self.sizes), 0
        for here, doc in self.parts():
            keep = live[self.flat[here]]
            found = number[self.flat[here][keep]]
            sizes += np.bincount(doc[keep], minlength=len(sizes))
            self.flat[n : n + len(found)] = found
            n += len(found)
        self.flat, self.sizes = self.flat[:n] if 2 * n > len(self.flat) else self.flat[:n].copy(), sizes

    def counts(self, features: int) -> np.ndarray:
        """Rows that hold each feature."""
        out = np.zeros(features, np.int64)
        for here, _ in self.parts():
            out += np.bincount(self.flat[here], minlength=features)
        return out

    def by_row(self, w: np.ndarray) -> np.ndarray:
        """Sum of the features' weights in each row."""
        out = np.zeros(len(self.sizes))
        for here, doc in self.parts():
            out += np.bincount(doc, w[self.flat[here]], len(out))
        return out

    def by_feature(self, values: np.ndarray, features: int) -> np.ndarray:
        """Sum of the values of the rows that hold each feature."""
        out = np.zeros(features)
        for here, doc in self.parts():
            out += np.bincount(self.flat[here], values[doc], features)
        return out


def fit_ordinal(rows: Rows | list[np.ndarray], grades: np.ndarray, least_docs: int = LEAST_DOCS, penalty: float = 2.0, steps: int = 240, rate: float = 0.5, first: float = 0.01) -> OrdinalModel:
    """Proximal gradient (AdaGrad steps, L1) on the negative log-likelihood of the cumulative links; Rows are used up."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1:
        return OrdinalModel()
    rows = rows if isinstance(rows, Rows) else Rows(rows)
    use = rows.counts(BUCKETS) >= least_docs
    rows.cut(use)
    n, m = len(grades), int(use.sum())
    names, w = np.flatnonzero(use), np.zeros(m)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)))
    hw, ht = np.full(m, first**2), np.full(top, first**2)
    l1 = penalty / n
    for step in range(steps):
        if step in (40, 80, 160):  # the zeroed weights leave
            live = w != 0
            rows.cut(live)
            w, hw, names = w[live], hw[live], names[live]
            m = len(w)
        z = rows.by_row(w)
        ge = np.ones((n, top + 2))  # P(grade >= k), k = 0 .. top + 1
        ge[:, 1 : top + 1] = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))
        ge[:, top + 1] = 0
        p = np.maximum(ge[np.arange(n), grades] - ge[np.arange(n), grades + 1], 1e-12)
        slope = ge * (1 - ge)
        up, down = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        dz = (down - up) / n
        gw = rows.by_feature(dz, m)
        gt = np.bincount(grades, up / n, top + 2)[1 : top + 1] - np.bincount(grades + 1, down / n, top + 2)[1 : top + 1]
        hw += gw**2
        ht += gt**2
        pace = rate / np.sqrt(hw)
        w -= pace * gw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        theta = np.maximum.accumulate(theta - rate / np.sqrt(ht) * gt)
    return OrdinalModel({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, theta.tolist())


def sampled(labelled: DataFrame, max_rows: int) -> DataFrame:
    """The max_rows rows with the smallest hash of their id; few rows reach the sort, whatever the number of partitions."""
    order = F.xxhash64(F.lit(11), "doc_id")
    n = labelled.count()
    wanted = min(n, max_rows)
    bar = int(-(2**63) + min(1.0, (1.5 * max_rows + 100) / max(n, 1)) * (2**64 - 1))
    low = labelled.where(order <= F.lit(min(bar, 2**63 - 1)))
    if low.count() < wanted:  # ids that repeat can crowd above the bar
        low = labelled
    return low.orderBy(order, "doc_id", "grade").limit(max_rows)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS
) -> OrdinalModel:
    """Fit on at most max_rows labelled texts; grade: Column of labels, a whole number from 0."""
    known = labels.select(F.col(id_col).alias("doc_id"), grade.cast("int").alias("grade"))
    sample = sampled(known.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()), max_rows)

    def number(batches):
        for b in pieces(batches):
            found = [text_features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(found, pa.binary())], ["grade", "f"])

    def fit(batches):
        """All sampled rows, sorted, in one task: the weights, then the thresholds under negative numbers."""
        grades: list[int] = []

        def found():
            for b in batches:
                grades.extend(b.column("grade").to_pylist())
                yield from (np.frombuffer(f.as_buffer(), np.int32) for f in b.column("f"))

        rows = Rows(found())
        model = fit_ordinal(rows, np.array(grades, np.int64))
        names = [*model.weights, *range(-1, -1 - len(model.thresholds), -1)]
        values = [*model.weights.values(), *model.thresholds]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.float64())], ["name", "value"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    numbered = rows.select("grade", "text").mapInArrow(number, "grade int, f binary")
    found = numbered.repartition(1).sortWithinPartitions("grade", "f").mapInArrow(fit, "name long, value double")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
        fitted = {r["name"]: r["value"] for r in found.collect()}
    thresholds = [fitted[k] for k in sorted((k for k in fitted if k < 0), reverse=True)]
    return OrdinalModel({k: v for k, v in fitted.items() if k >= 0}, thresholds)


def judge_with(spark: SparkSession, model: OrdinalModel):
    """Text column -> struct of the expected severity and P(grade >= 1)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected:double,toxic:double>")
    def judge(text):
        found = [shared.value.severity(b.column("text").to_pylist()) for b in pieces([pa.RecordBatch.from_arrays([text], ["text"])])]
        p = np.concatenate(found) if found else np.zeros((0, 0))
        toxic = p[:, 0] if p.shape[1] else np.zeros(len(p))
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(toxic)], ["expected", "toxic"])

    return judge


def toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Score every text; keeps all columns of docs and adds _expected_severity, _toxic (P(grade >= 1)) and _rejected."""
    name = temporary(docs, "judged")
    toxic = F.col(name)["toxic"]
    found = {"_expected_severity": F.col(name)["expected"], "_toxic": toxic, "_rejected": toxic >= reject_at}
    own = [F.col(c) for c in docs.columns if c.lower() not in found]
    judged = docs.withColumn(name, judge_with(docs.sparkSession, model)(F.col(text_col)))
    return judged.select(*own, *(c.alias(new) for new, c in found.items()))


def severity_grade() -> Column:
    """Grades of the labels table: 0 clean, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), severity_grade())
    return toxicity(docs, model).select("doc_id", F.col("_expected_severity").alias("expected_severity"), F.col("_toxic").alias("toxic_score"), F.col("_rejected").alias("rejected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the texts that are rejected.

    A null or wordless text, a null id and repeated rows are judged like any other; without labels nothing goes; an empty
    table stays empty; all columns pass through.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), severity_grade())
    return docs.where(judge_with(spark, model)("text")["toxic"] < 0.5)
