"""Repeated and null ids, clashing column names, empty tables, blocks, and models against plain computation."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ondol.llm import common, decontaminate, line_dedup, lm_score, near_dup, suffix_dedup, toxicity

random.seed(23)
WORDS = [f"word{i}" for i in range(70)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def test_near_stage_rows(spark):
    a, b = prose(40), prose(40)
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (5, b, "r"), (None, a, "s"), (6, None, "t"), (7, " ", "u"), (7, " ", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fate_id string")
    kept = Counter(map(tuple, near_dup.stage(spark, docs, "").collect()))
    assert kept == Counter([rows[0], rows[2], rows[5], rows[6], rows[7]])
    assert near_dup.stage(spark, docs.where("false"), "").columns == docs.columns


def test_equal_sets_meet_at_any_place_of_a_slice(spark):
    same = ["a b", "b c d e f g h"]
    docs = spark.createDataFrame([(i, same[i % 2] if i % 3 else prose(300)) for i in range(400)], "doc_id long, text string").coalesce(1)
    found = {r.id: r.component_id for r in near_dup.near_duplicates(docs, k=4, similarity=0.85).collect()}
    for k in (0, 1):
        ids = [i for i in range(400) if i % 3 and i % 2 == k]
        assert {found[i] for i in ids} == {min(ids)}


def test_line_dedup_names(spark):
    text = prose(12)
    docs = spark.createDataFrame([(1, text, 3, "x"), (2, text + "\n" + prose(12), 4, "y")], "doc_id long, text string, _n_lines long, row_id string")
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "row_id", "_n_lines", "_n_dropped"]
    assert {(r.doc_id, r.row_id, r._n_lines, r._n_dropped) for r in got.collect()} == {(1, "x", 1, 0), (2, "y", 2, 1)}
    kept = line_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r._n_lines for r in kept.collect()} == {3, 4}


def test_line_names_have_two_seeds(spark):
    got = line_dedup.numbered_lines(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), "doc_id", "text", 10).first()
    again = spark.sql(f"SELECT xxhash64('one two') AS h1, xxhash64('one two', 1) AS chained").first()
    assert got.h1 == again.h1 and got.h2 != again.chained


def test_toxicity_names_and_fit(spark):
    docs = spark.createDataFrame([(i, prose(15) + (" vileword" if i % 4 == 0 else ""), i, "k") for i in range(160)], "doc_id long, text string, _rejected long, judged string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(120)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels, toxicity.severity_grade())
    got = toxicity.toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "judged", "_expected_severity", "_toxic", "_rejected"]
    assert all(r._rejected == (r.doc_id % 4 == 0) and r.judged == "k" for r in got.collect())
    few = toxicity.sampled(labels.select("doc_id", labels.toxic.alias("grade")), 30)
    assert few.count() == 30 and toxicity.sampled(labels.select("doc_id", labels.toxic.alias("grade")), 500).count() == 120


def test_ordinal_fit_against_a_grid():
    """One feature, three grades: the fitted loss is that of the best grid point."""
    rng = np.random.default_rng(3)
    has = rng.random(400) < 0.5
    grades = np.where(has, rng.choice(3, 400, p=[0.2, 0.3, 0.5]), rng.choice(3, 400, p=[0.7, 0.2, 0.1]))
    rows = [np.array([7], np.int32) if h else np.zeros(0, np.int32) for h in has]

    def loss(w, theta):
        z = w * has
        ge = np.ones((400, 4))
        ge[:, 1:3] = 1 / (1 + np.exp(-(z[:, None] - np.array(theta))))
        ge[:, 3] = 0
        p = ge[np.arange(400), grades] - ge[np.arange(400), grades + 1]
        return -np.log(np.maximum(p, 1e-12)).mean() + 2.0 / 400 * abs(w)

    model = toxicity.fit_ordinal(rows, grades, steps=600)
    best = min(loss(w, (a, a + b)) for w in np.arange(0, 4, 0.1) for a in np.arange(-1, 2, 0.1) for b in np.arange(0.1, 2.5, 0.1))
    assert loss(model.weights.get(7, 0.0), model.thresholds) < best + 0.005


def test_ordinal_fit_holds_its_numbers_about_once():
    """At most three times the bytes of the rows' feature numbers; cut rows sum and count as plain arrays do."""
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 1 << 16, 6000, dtype=np.int32)) for _ in range(1500)]
    grades = np.array([int(r[0] < 3) + int(r[0] < 1) for r in rows])
    tracemalloc.start()
    try:
        model = toxicity.fit_ordinal(rows, grades, steps=45)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights and peak < 3 * sum(r.nbytes for r in rows)
    held, w = toxicity.Rows([np.zeros(0, np.int32), *rows[:300], np.zeros(0, np.int32)]), rng.random(1 << 16)
    live = w < 0.3
    held.cut(live)
    assert np.allclose(held.by_row(w[live]), [0, *(w[r[live[r]]].sum() for r in rows[:300]), 0])
    assert held.counts(int(live.sum())).tolist() == np.bincount(np.concatenate(rows[:300]), minlength=1 << 16)[live].tolist()


def test_items_do_not_depend_on_blocks(spark):
    short, long = prose(100), [prose(900) for _ in range(4)]
    words = short.split()
    apart = " ".join(words[:50]) + " " + prose(200) + " " + " ".join(words[50:])
    docs = spark.createDataFrame([(1, apart), (2, prose(60) + " " + short), (3, long[2]), (4, None), (4, short)], "doc_id long, text string")
    items = spark.createDataFrame([(1, short), *((i + 2, t) for i, t in enumerate(long)), (9, short), (9, short)], "item_id long, text string")
    results = []
    for size in (1, 3, 4096):
        found = decontaminate.decontaminate(docs, items, block_items=size)
        results.append(sorted((r.doc_id, r.text, sorted((x.item, round(x.score, 9)) for x in r._items)) for r in found.where("text is not null").collect()))
    assert results[0] == results[1] == results[2] and any(r[2] for r in results[0])
    named = decontaminate.decontaminate(docs.selectExpr("*", "1 AS _items"), items)
    assert named.columns == ["doc_id", "text", "_items"]


def test_matching_holds_little(monkeypatch):
    rng = random.Random(3)
    items = [" ".join(f"t{rng.randrange(400)}" for _ in range(35)) for _ in range(200)]
    texts = [" ".join(f"t{rng.randrange(400)}" for _ in range(500)) for _ in range(44)]
    texts[7], texts[20], texts[30] = texts[7] + " " + items[9], None, items[50] + " " + texts[30] + " " + items[3]
    shared = SimpleNamespace(items=200, mean=35.0, longest=35, df=lambda terms: np.full(len(terms), 16))
    index = decontaminate.Index.build(pa.array(range(1000, 1200)), pa.array(items), shared)
    index.find = common.Lookup(index.terms)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    decontaminate.match_slice(index, index.find, batch.slice(0, 1), 0.5, 0.8)
    tracemalloc.start()
    try:
        found = decontaminate.match_slice(index, index.find, batch, 0.5, 0.8)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found) == [(7, 9), (30, 3), (30, 50)] and peak < 50e6
    monkeypatch.setattr(decontaminate, "SLICE", 5000)
    lists = decontaminate.hit_lists(index, pa.array(["", *texts]).slice(1), 0.5, 0.8).to_pylist()
    want = [sorted((1000 + i, round(s, 9)) for (r, i), s in found.items() if r == row) for row in range(len(texts))]
    assert [sorted((x["item"], round(x["score"], 9)) for x in hits) for hits in lists] == want


def test_suffix_rows_that_share_an_id(spark):
    common, long = prose(20), prose(20000)
    rows = [(1, common), (5, "x" + common), (5, "completely other " + common + " end"), (5, None), (None, common), (7, long), (8, "new " + long[70000:90000])]
    got = Counter((r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(common)
    assert got[(5, n + 1, n)] == got[(5, n + 21, n + 0)] == 1 or got[(5, n + 21, n)] == 1
    assert got[(None, n, 0)] == 1 and got[(5, 0, 0)] == 1 and got[(8, 4 + len(long[70000:90000]), len(long[70000:90000]))] == 1


def test_model_is_normalised_and_learns(spark):
    words = [f"w{i}" for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(words), "w1 w2 w3"]})
    tok, at = lm_score.tokens(batch)
    h, c = np.unique(tok, return_counts=True)
    model = lm_score.Model(h, c, len(tok) + 0.5 * (len(h) + 1), 3.0, 4, 256)
    trainer = lm_score.Trainer(model, 0.25)
    f = lm_score.features(tok, at)
    for _ in range(5):
        trainer.step(model.code(tok), f)
    every = np.append(model.code(h), model.tail)
    one = [np.repeat(x[5:6], len(every)) for x in f]
    assert abs((10 ** model.log10(every, one)).sum() - 1) < 1e-4
    pairs = [(i, " ".join(f"a{k} b{k}" for k in (random.randrange(40) for _ in range(60)))) for i in range(300)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = lm_score.lm_score(docs, lm_score.remainder("doc_id", 5) != 1).where("held_out").selectExpr("sum(score - base_score) AS gain", "sum(n_tokens) AS n").first()
    assert got.gain / got.n > 0.15 and math.isfinite(got.gain)


@pytest.mark.parametrize("stage", [line_dedup.stage, near_dup.stage])
def test_empty_stages(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs, "").isEmpty()
