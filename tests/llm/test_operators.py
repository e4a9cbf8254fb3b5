"""Each operator against a brute-force version on small tables with nulls, ties, copies and odd texts."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ondol.llm import bpe, common, decontaminate, language, line_dedup, lm_score, near_dup, quality, suffix_dedup, toxicity, warc

random.seed(5)
WORDS = [f"word{i}" for i in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


BASE = prose(90)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("word1 ", "other ", 1)),
    (4, prose(80) + "\n" + BASE[:200]),
    (5, None),
    (6, ""),
    (7, "  \n\t "),
    (8, "short text"),
    (9, "\n".join([prose(14)] * 3) + "\n" + prose(20)),
    (10, "aaaa" * 60),
    (11, "é漢😀 " * 40 + "<|endoftext|> x"),
    (12, BASE + " " + prose(5)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "row") for i, t in TEXTS], "doc_id long, text string, lang string, row string")


def sql(text, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return con.sql(text).df()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(repr, got[names].astype(str).values.tolist())) == sorted(map(repr, want[names].astype(str).values.tolist()))


def words(t):
    return (t or "").encode().lower().split()


def test_lm_base_and_gain(docs):
    got = lm_score.lm_score(docs, lm_score.remainder("doc_id", 5) != 1).toPandas().set_index("doc_id")
    seen = Counter()
    for i, t in TEXTS:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            seen.update([*words(t), None])
    total, kinds = sum(seen.values()), len(seen)
    import math

    for i, t in TEXTS:
        tok = [*words(t), None]
        want = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tok)
        r = got.loc[i]
        assert abs(r.base_score - want) < 1e-6 and r.n_tokens == len(tok) and r.n_known == sum(seen[w] > 0 for w in tok) and r.train_tokens == total
        assert r.score < 0


@pytest.mark.parametrize("k,t", [(4, 85), (5, 80)])
def test_near_duplicates(docs, k, t):
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=k, similarity=t / 100).collect()}
    sets = {i: (lambda w: {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})(words(x)) for i, x in TEXTS}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= t * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_shared_ids(spark):
    own = [prose(90) for _ in range(12)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in own]
    rows = [(None if i < 6 else 50, t) for i, t in enumerate(own)] + [(i, t) for i, t in enumerate(near)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.id, r.component_id) for r in found)
    assert got == Counter([(None if i < 6 else 50, i) for i in range(12)] + [(i, i) for i in range(12)])


def test_line_dedup_sql(docs):
    got = line_dedup.line_dedup(docs).where("text is not null")
    assert got.columns[:4] == docs.columns
    dropped = {r.doc_id: r._n_dropped for r in got.collect()}
    assert dropped[1] == 0 and dropped[2] == 1 and dropped[3] == 1 and dropped[9] == 2


def test_line_dedup_white_space(spark):
    line = prose(12)
    w = line.split(" ")
    odd = [line + " ", line + "\r", "  " + line, line.replace(" ", "  ", 3), "\t".join(w), " \v".join(w) + "\f", "\t".join(["new", *w[1:]]), "\t".join(w[:6])]
    texts = [line, *odd, " ".join(w[:6]) + "  ", "\n \n\t\n", "\n \n"]
    got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    assert got._n_dropped.tolist() == [0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0]
    assert got.text[8] == texts[8] and got.text[9] == "" and got.text[10] == texts[10]


def test_line_dedup_stage(spark):
    text = prose(12) + "\nAll rights reserved.\n\nword"
    rows = [(1, text, "a"), (2, text, "b"), (3, "word\n\nnew", "c"), (4, None, "d"), (5, " ", "e"), (6, "word", "f")]
    got = line_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(map(tuple, got.collect())) == [rows[0], (3, "\nnew", "c"), rows[3], rows[4]]


def test_quality_sql(docs):
    got = quality.quality_rules(docs).toPandas()
    same(got.drop(columns=["kept"]), sql(quality.ORACLE_SQL, docs).drop(columns=["kept"]))


def test_suffix_dedup(docs):
    got = {r.id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    seen = set()
    for i, t in TEXTS:
        b, gone, own = (t or "").encode(), set(), set()
        for s in range(len(b) - 49):
            own.add(b[s : s + 50])
            if b[s : s + 50] in seen:
                gone.update(range(s, s + 50))
        seen |= own
        assert got[i].n_removed == len(gone) and bytes(got[i].kept) == bytes(c for k, c in enumerate(b) if k not in gone)


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r.doc_id: r for r in bpe.token_digests(bpe.bpe_encode(docs, bpe.vocabulary_path())).collect()}
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language(spark):
    de, en = ["der", "und", "nicht", "schule", "größe"], ["the", "and", "which", "thing", "other"]
    rows = [(i, " ".join(random.choices(de if i % 2 else en, k=30)), "de" if i % 2 else "en") for i in range(40)] + [(50, None, "de"), (51, "123 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, protos = language.fit_prototypes(docs.where("doc_id < 30"))
    got = {r.doc_id: r for r in language.identify(docs, langs, protos).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40]) and got[50].lang_pred == got[51].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs, *language.fit_prototypes(docs.where("false"))).where("lang_pred <> 'und'").isEmpty()


def test_toxicity(spark):
    rows = [(i, prose(20) + (" vileword" if i % 4 == 0 else ""), i % 4 == 0) for i in range(200)] + [(300, None, False)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t), 1) for i, _, t in rows if i < 150], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.fit_toxicity(docs, labels, toxicity.severity_grade())).collect()}
    assert all(got[i]._rejected == t for i, _, t in rows)
    none = toxicity.fit_toxicity(docs, labels.where("false"), toxicity.severity_grade())
    assert toxicity.toxicity(docs, none).where("_rejected").isEmpty()


def test_decontaminate(spark, docs):
    item = prose(30)
    more = docs.union(spark.createDataFrame([(20, prose(200) + " " + item + "*** " + prose(100), "en", "x"), (21, prose(50) + " " + " ".join(item.split()[:10]), "en", "x")], docs.schema))
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: [x.item for x in r._items] for r in decontaminate.decontaminate(more, items).collect()}
    assert got.pop(20) == [1] and not any(got.values())
    assert decontaminate.decontaminate(docs, items.where("false")).where("size(_items) > 0").isEmpty()


def test_warc_round_trip(spark):
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    body = "x" * 120
    pages = spark.createDataFrame([(1, "http://a", body), (2, None, body), (3, "http://b", None), (4, "h", "y" + fake * 3), (5, "h", "é" * 50), (6, "h", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 6 and got[2].record_type == "revisit" and got[2].refers_to == 1 and got[1].record_type == "response"
    for r in pages.collect():
        data = (r.html or "").encode()
        assert got[r.page_id].payload_bytes == len(data) and got[r.page_id].payload_digest == hashlib.sha256(data).hexdigest() and got[r.page_id].digest_verified
    assert warc.round_trip(pages.where("false")).isEmpty()


def test_empty_tables(docs):
    none = docs.where("false")
    assert near_dup.near_duplicates(none).isEmpty()
    assert line_dedup.line_dedup(none).isEmpty()
    assert suffix_dedup.suffix_dedup(none).isEmpty()
    assert lm_score.lm_score(none, lm_score.remainder("doc_id", 5) != 1).isEmpty()
    assert bpe.bpe_encode(none, bpe.vocabulary_path()).isEmpty()


def test_warc_writes_parts_that_keep_equal_payloads_together(spark, tmp_path, monkeypatch):
    """All pages were shuffled at once, which together with the archives was over three times the input."""
    rows = [(i, f"http://a/{i}", None if i % 10 == 0 else f"{i % 40} é " * 60) for i in range(120)]
    pages, made, seen = spark.createDataFrame(rows, "page_id long, url string, html string"), [], warc.as_records
    monkeypatch.setattr(warc, "as_records", lambda part, *a: made.append(part) or seen(part, *a))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert got == {i: ("revisit", first[h]) if h and first[h] != i else ("response", None) for i, _, h in rows}
    held = [{r.page_id for r in part.collect()} for part in made]
    assert len(held) > 1 and max(map(len, held)) < len(rows) and sorted(x for h in held for x in h) == list(range(len(rows)))


def test_training_step_sums_only_repeated_rows():
    """Every row went through the sum by rows before; results are those of plain loops."""
    rng = np.random.default_rng(5)
    for width in (1, 2, 5, 32, 33):
        z = rng.normal(size=(50, width)).astype(np.float32)
        assert (lm_score.most(z) == z.max(1, keepdims=True)).all()
    words = np.sort(rng.integers(0, 1 << 63, 20, dtype=np.uint64))
    for pick in (np.arange(64), np.zeros(64, np.int64), rng.integers(0, 20, 64)):
        model = lm_score.Model(words, np.full(20, 5), 110.0, 0.5, 3, 256)
        trainer, grad, table = lm_score.Trainer(model, 0.25), rng.normal(size=(64, 4)).astype(np.float32), model.weight[0]
        want, seen = table.astype(np.float64), np.ones(256)
        for r in set(pick.tolist()):
            g = grad[pick == r].astype(np.float64).sum(0)
            seen[r] += (g * g).sum()
            want[r] -= 0.25 / np.sqrt(seen[r]) * g
        trainer.move(table, pick, grad)
        assert np.allclose(table, want, atol=1e-5) and np.allclose(trainer.seen[id(table)], seen, rtol=1e-5)


def test_suffix_names_what_is_asked_by_blocks(monkeypatch):
    """Names of all depths were made for every byte, from sums over the whole slice: 1318 CPU seconds a GB."""
    batch = pa.RecordBatch.from_pydict({"text": [prose(9000), None, "short", prose(9000), ""]})
    sizes = []
    for module in (suffix_dedup, common):
        monkeypatch.setattr(module, "mixed", lambda x, seen=module.mixed: sizes.append(len(x)) or seen(x))
    s = suffix_dedup.Slice(batch, 50)
    s.contexts(), s.sides()
    assert sum(sizes) < 2.5 * len(s.buf) and max(sizes) < len(s.buf) / 8


def test_suffix_slices_against_plain_python():
    texts = [prose(40), None, "x" * 130, "short", BASE, "", BASE[7:300]]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for length in (7, 16, 33, 50):
        s = suffix_dedup.Slice(batch, length)
        data, reach = s.buf.tobytes(), length - s.gram
        every = suffix_dedup.refined(s.codes, s.gram, length)
        assert len(set(zip(every.tolist(), (data[i : i + length] for i in range(len(every)))))) == len(set(every.tolist())) == len({data[i : i + length] for i in range(len(every))})
        assert (s.names(np.arange(len(every)), length) == every).all()
        anchors, inside = set(s.place.tolist()), {(r, i) for r in range(len(texts)) for i in range(s.at[r], s.at[r + 1] - length + 1)}
        assert all(anchors & set(range(i, i + reach + 1)) for _, i in inside)
        left, right, half = s.place % 3 == 0, s.place % 2 == 0, (reach + 1) // 2
        want = {p - o for p, a, z in zip(s.place.tolist(), left, right) for o in range(reach + 1) if a and o >= half or z and reach - o >= half}
        row, start = s.windows(left, right)
        assert list(zip(row.tolist(), start.tolist())) == sorted(x for x in inside if x[1] in want)


def test_suffix_members():
    lists = [[5, -7, 5], None, [], [-7, *range(0, 4000, 2)], [5] * 300]
    row, name = np.repeat(np.arange(5), 4100), np.tile(np.arange(-50, 4050), 5)
    got = suffix_dedup.members(pa.array(lists, pa.list_(pa.int64())), row, name.view(np.uint64))
    assert got.tolist() == [n in (lists[r] or []) for r, n in zip(row.tolist(), name.tolist())]


def test_suffix_dedup_other_lengths(spark, docs):
    for length in (7, 33):
        got, seen = {r.id: r for r in suffix_dedup.suffix_dedup(docs, length=length).collect()}, set()
        for i, t in TEXTS:
            b, gone, own = (t or "").encode(), set(), set()
            for s in range(len(b) - length + 1):
                own.add(b[s : s + length])
                if b[s : s + length] in seen:
                    gone.update(range(s, s + length))
            seen |= own
            spans = [k for k in range(len(b) + 1) if (k in gone) != (k - 1 in gone)]
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, list(got[i].spans)) == (len(b), len(gone), len(spans) // 2, spans)
            assert bytes(got[i].kept) == bytes(c for k, c in enumerate(b) if k not in gone)
