"""Rules of quotes and estimates against plain Python, since a plan and its oracle share one text."""

import statistics
from collections import Counter, defaultdict

import duckdb
import pytest

from ondol.functions import values as V
from ondol.functions.dialect import Duck
from ondol.plans import catalogue, estimates, quotes, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.sql(f"WITH {quotes.items(Duck)} SELECT article_id, pos, category, description, quantity, unit_price, amount FROM item ORDER BY article_id, pos").fetchall()
    by_quote = defaultdict(list)
    for a, *rest in got:
        by_quote[a].append(dict(zip(("pos", "category", "description", "quantity", "unit_price", "amount"), rest)))
    return by_quote


def clean(x):
    return (x or "").replace(" ", "").replace("/", "").replace("·", "")


def process(item):
    cat, both = clean(item["category"]), clean(item["category"]) + " " + clean(item["description"])
    for p, words in V.PROCESS_CATEGORIES.items():
        if any(clean(w) in cat for w in words):
            return p
    return next((p for p, words in V.PROCESS_WORDS.items() if any(clean(w) in both for w in words)), None)


def aggregate(item):
    x = clean(item["description"])
    return bool(x) and (x in V.AGGREGATE_WORDS or x.startswith("소계") or x.endswith(tuple(V.AGGREGATE_WORDS[:3])))


def wrong_subtotals(items):
    rows = [i for i in items if clean(i["description"]).startswith("소계") or i["amount"]]
    is_sub = [clean(i["description"]).startswith("소계") for i in rows]
    if not any(is_sub):
        return
    groups, own, header = [], [], is_sub[0]
    for row, sub in zip(rows, is_sub):
        if sub and header:
            own = []
            groups.append((row, own))
        elif sub:
            groups.append((row, own))
            own = []
        else:
            own.append(row)
    for sub, own in groups:
        amounts = [i["amount"] for i in own]
        if not own or sub["amount"] <= 0 or abs(sub["amount"] - sum(amounts)) <= V.SUBTOTAL_TOLERANCE:
            continue
        side = amounts if header else amounts[::-1]
        if not any(abs(sub["amount"] - sum(side[:n])) <= V.SUBTOTAL_TOLERANCE for n in range(1, len(side))):
            yield process(own[0]) or process(sub) or sub["category"]


def findings(items):
    by = defaultdict(list)
    for i in items:
        if process(i):
            by[process(i)].append(i)
    words = clean("".join(i["category"] + i["description"] for i in items if not aggregate(i)))
    for p, groups, need in V.REQUIRED:
        applies = all(any(w in words for w in g) for g in groups) if groups else p in by
        if applies and not any(w in words for w in need):
            yield "누락", p, "필수 항목 누락"
    where = defaultdict(list)
    for p, own in by.items():
        for key in {(i["description"], i["amount"]) for i in own if not aggregate(i)}:
            if key[0] and key[1] > 0 and not any(w in key[0] for w in V.GENERIC_WORDS):
                where[key].append(p)
    for ps in where.values():
        if len(ps) > 1 and not any(set(ps) <= set(s) for s in V.SIBLINGS):
            yield "중복", ps[-1], "다른 공종에 같은 항목"
    for p in wrong_subtotals(items):
        yield "불분명", p, "소계가 품목 합과 다름"
    for p, own in by.items():
        own = [i for i in own if not aggregate(i)]
        twice = Counter((i["description"], i["amount"]) for i in own if i["description"] and not any(w in i["description"] for w in V.GENERIC_WORDS))
        for n in twice.values():
            if n > 1:
                yield "중복", p, "동일 항목 중복 기재"
        if len(own) == 1 and own[0]["amount"] >= V.LUMP_SUM and own[0]["quantity"] <= 1:
            yield "불분명", p, "세부 내역 없이 일괄 금액"
        for i in own:
            if not i["amount"]:
                if not any(w in i["description"] for w in V.FREE_WORDS):
                    yield "불분명", p, "총액에 포함되지 않은 항목"
            elif any(w in i["description"] for w in V.VAGUE_WORDS):
                yield "불분명", p, "모호한 표현 포함"


def test_findings(spark, lines):
    want = Counter((a, *f) for a, items in lines.items() for f in findings(items))
    got = Counter((r.article_id, r.kind, r.process, r.title) for r in registry.QUERIES["quote_findings"](spark, SF).collect())
    assert got == want and len({f[3] for f in want}) >= 6


def test_places_of_a_crowded_group(spark):
    """One key with nine tenths of the rows: exact places, and no window over the key alone."""
    rows = [(("a" if i % 10 else "b"), (i * 7919) % 101) for i in range(3000)] + [(None, 5), (None, 7), ("c", None)]
    spark.createDataFrame(rows, "key string, v long").createOrReplaceTempView("crowd")
    from ondol.functions.dialect import Spark

    text = catalogue.ranked(Spark, "crowd", "key", "v")
    got = spark.sql(text).collect()
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    for r in got:
        have = sorted(groups[r.key])
        assert r.n == len(have) and have[r.i : r.i + r.k] == [r.x] * r.k and have.count(r.x) == r.k
    assert sum(r.k for r in got) == sum(map(len, groups.values()))
    found = spark.sql(catalogue.percentiles(Spark, "crowd", "key", "v", mid=0.5)).collect()
    assert all(r.mid == statistics.median(groups[r.key]) for r in found if groups[r.key])


def test_scope_and_cost_keys():
    assert estimates.full_scope(("도배", "마루", "욕실", "창호", "목공", "전기/조명")) and not estimates.full_scope(("도배", "마루", "욕실", "창호", "도어"))
    assert estimates.cost_keys("창호", ("창호",)) == ["창호", "도어"] and estimates.cost_keys("창호", ("창호", "도어")) == ["창호"]
    assert estimates.cost_keys("욕실", ("욕실", "설비")) == ["욕실", "타일"]
