"""Composite plans against plain Python, since a plan and its oracle share one text."""

import math
from collections import Counter, defaultdict

import duckdb

from ondol.plans import registry

SF = "/root/testdata/sf0.001"
cents = lambda x: math.floor(x * 100 + 0.5)


def cost_range(values):
    v, n = sorted(values), len(values)
    mid = (v[(n - 1) // 2] + v[n // 2]) // 2
    return n, mid


def table(sql):
    return duckdb.sql(sql.replace("$", SF)).fetchall()


def test_estimate_report(spark):
    lines = table("SELECT l_orderkey, p_type, l_extendedprice FROM '$/lineitem.parquet' JOIN '$/part.parquet' ON l_partkey = p_partkey")
    by_type, asked = defaultdict(list), defaultdict(set)
    for o, t, p in lines:
        by_type[t].append(cents(p)), asked[o].add(t)
    ranges = {t: cost_range(v) for t, v in by_type.items()}
    want = {}
    for o, priority in table("SELECT o_orderkey, o_orderpriority FROM '$/orders.parquet'"):
        if o not in asked:
            continue
        factor = {"1": 12, "2": 11}.get(priority[0], 10)
        n, mid = min(ranges[t][0] for t in asked[o]), sum(ranges[t][1] * factor // 10 for t in asked[o])
        below, above = (20, 46) if len(asked[o]) >= 3 else (22, 25)
        below, above = below * (2 if n >= 12 else 8 if n >= 8 else 10 if n >= 5 else 12), above * (5 if n >= 12 else 10 if n >= 5 else 12)
        want[o] = (len(asked[o]), n, mid * (1000 - below) // 1000, mid, mid * (1000 + above) // 1000)
    assert {r.o_orderkey: (r.trades, r.n_cases, r.low, r.mid, r.high) for r in registry.QUERIES["estimate_report"](spark, SF).collect()} == want


def test_risk_report(spark):
    lines = table("SELECT l_orderkey, l_partkey, l_extendedprice FROM '$/lineitem.parquet'")
    pairs, orders = Counter((o, p) for o, p, _ in lines), defaultdict(list)
    for o, _, p in lines:
        orders[o].append(cents(p))
    duplicates = Counter(o for (o, _), n in pairs.items() if n >= 2)
    got = {r.o_orderkey: r for r in registry.QUERIES["risk_report"](spark, SF).collect()}
    assert len(got) == table("SELECT count(*) FROM '$/orders.parquet'")[0][0]
    for o, r in got.items():
        assert r.n_duplicate == duplicates[o] and r.n_lump == (len(orders[o]) == 1 and orders[o][0] >= 2000000)
        assert r.n_issues == r.n_duplicate + r.n_lump + r.n_price


def test_truth_and_chunks(spark):
    direct, unmapped = Counter(), Counter()
    for o, flag, p in table("SELECT l_orderkey, l_returnflag, l_extendedprice FROM '$/lineitem.parquet'"):
        direct[o] += cents(p)
        unmapped[o] += cents(p) if flag == "R" else 0
    want = {}
    for o, total in table("SELECT o_orderkey, o_totalprice FROM '$/orders.parquet'"):
        if direct[o] > 0:
            t = cents(total)
            want[o] = (direct[o] - unmapped[o], t - math.floor(t * unmapped[o] / direct[o]), 100 * direct[o] > 102 * t, direct[o] == unmapped[o])
    assert {r.l_orderkey: tuple(r)[1:] for r in registry.QUERIES["truth_derivation"](spark, SF).select("l_orderkey", "compared_direct", "compared_total", "direct_exceeds", "all_unmapped").collect()} == want
    sizes = dict(table("SELECT doc_id, n_chars FROM '$/documents.parquet'"))
    for r in registry.QUERIES["chunk_counts"](spark, SF).collect():
        assert r.n_chunks == (1 if sizes[r.doc_id] <= 3000 else math.ceil((sizes[r.doc_id] - 2000) / 1800) + 1)
