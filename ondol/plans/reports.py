"""Composite plans: estimates, review reports and their roll-ups, truth derivation, keys of items."""

from __future__ import annotations

from .catalogue import PRICE, cost_range_by_type, duplicate_lines, lump_sum, percentiles
from .ingest import validation
from .measures import price_issues


def estimate_report(d):
    """An order as a request: its trades' ranges times the request's factor, summed, with margins by the least number of cases.

    Factors act on a trade's range after it is found and truncate. Margins are hundredths (full scope from 3 trades on,
    else partial), scaled in tenths, so all is whole numbers.
    """
    low, high = "CASE WHEN n_cases >= 12 THEN 2 WHEN n_cases >= 8 THEN 8 WHEN n_cases >= 5 THEN 10 ELSE 12 END", "CASE WHEN n_cases >= 12 THEN 5 WHEN n_cases >= 5 THEN 10 ELSE 12 END"
    return f"""WITH rng AS ({cost_range_by_type(d)}),
q AS (SELECT DISTINCT l_orderkey, p_type FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey),
f AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 12 WHEN '2' THEN 11 ELSE 10 END AS tenths FROM {d.table('orders')}),
t AS (SELECT o_orderkey, count(*) AS trades, min(n_values) AS n_cases, sum({d.div('mid * tenths', '10')}) AS mid FROM f JOIN q ON o_orderkey = l_orderkey JOIN rng ON q.p_type = rng.p_type GROUP BY o_orderkey),
m AS (SELECT *, CASE WHEN trades >= 3 THEN 20 ELSE 22 END * ({low}) AS below, CASE WHEN trades >= 3 THEN 46 ELSE 25 END * ({high}) AS above FROM t)
SELECT o_orderkey, trades, n_cases, cast({d.div('mid * (1000 - below)', '1000')} as bigint) AS low, cast(mid as bigint) AS mid, cast({d.div('mid * (1000 + above)', '1000')} as bigint) AS high FROM m"""


def issues(d):
    """Rows (l_orderkey, kind, n): what the review rules found in each order."""
    return f"""dup AS ({duplicate_lines(d)}), lump AS ({lump_sum(d)}), price AS ({price_issues(d)}),
issue AS (SELECT l_orderkey, 'duplicate' AS kind, count(*) AS n FROM dup GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 'lump' AS kind, count(*) AS n FROM lump GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey, concat('price_', direction) AS kind, count(*) AS n FROM price GROUP BY l_orderkey, direction),
card AS (SELECT o_orderkey, cast(coalesce(sum(CASE WHEN kind = 'duplicate' THEN n END), 0) as bigint) AS n_duplicate, cast(coalesce(sum(CASE WHEN kind = 'lump' THEN n END), 0) as bigint) AS n_lump,
  cast(coalesce(sum(CASE WHEN kind IN ('price_high', 'price_low') THEN n END), 0) as bigint) AS n_price, cast(coalesce(sum(n), 0) as bigint) AS n_issues FROM {d.table('orders')} LEFT JOIN issue ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


def risk_report(d):
    """Counters of each order's issues; orders without any are rows of zeros."""
    return f"WITH {issues(d)} SELECT * FROM card"


def issue_stats(d):
    """Issues a quote over the corpus, and the share of quotes with each kind."""
    share = lambda c: f"round(100.0 * sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) / count(*), 6)"
    half = percentiles(d, "(SELECT 1 AS one, n_issues FROM card) y", "one", "n_issues", mid=0.5)
    return f"""WITH {issues(d)}, p AS ({half}) SELECT count(*) AS quotes, round(max(mid), 6) AS median_issues, round(avg(n_issues), 6) AS mean_issues,
  cast({share('n_duplicate')} as double) AS pct_duplicate, cast({share('n_lump')} as double) AS pct_lump, cast({share('n_price')} as double) AS pct_price FROM card CROSS JOIN p"""


def validation_rollup(d):
    return f"""WITH {validation(d)} SELECT count(*) AS n, cast(sum(CASE WHEN errors > 0 THEN 1 ELSE 0 END) as bigint) AS with_errors, cast(sum(CASE WHEN warnings > 0 THEN 1 ELSE 0 END) as bigint) AS with_warnings,
  round(cast(sum(tenths) as double) / (10 * count(*)), 6) AS mean_confidence, cast(sum(CASE WHEN tenths < 7 THEN 1 ELSE 0 END) as bigint) AS n_low FROM t"""


def truth_derivation(d):
    """Comparable totals: the share of direct cost that no trade holds (flag R) leaves the total in proportion; flags where direct exceeds it."""
    return f"""WITH s AS (SELECT l_orderkey, sum({PRICE}) AS direct, sum(CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE 0 END) AS unmapped FROM {d.table('lineitem')} GROUP BY l_orderkey),
t AS (SELECT l_orderkey, direct, unmapped, cast(round(o_totalprice * 100) as bigint) AS total FROM s JOIN {d.table('orders')} ON l_orderkey = o_orderkey WHERE direct > 0)
SELECT l_orderkey, cast(direct - unmapped as bigint) AS compared_direct, total - cast(floor(cast(total as double) * cast(unmapped as double) / cast(direct as double)) as bigint) AS compared_total,
  100 * direct > 102 * total AS direct_exceeds, direct = unmapped AS all_unmapped FROM t"""


def cost_diff_rollup(d):
    """By flag: what scaling costs down to the order's total changes in all, and how many costs it changes."""
    return f"""WITH s AS (SELECT l_orderkey, l_returnflag, sum({PRICE}) AS cost FROM {d.table('lineitem')} GROUP BY l_orderkey, l_returnflag),
w AS (SELECT s.*, sum(cost) OVER (PARTITION BY l_orderkey) AS all_cost FROM s),
r AS (SELECT l_returnflag, cost, CASE WHEN 10 * all_cost > 13 * total THEN {d.div('cost * total', 'all_cost')} ELSE cost END AS scaled
  FROM w JOIN (SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) AS total FROM {d.table('orders')}) o ON l_orderkey = o_orderkey)
SELECT l_returnflag, cast(sum(abs(scaled - cost)) as bigint) AS difference, cast(sum(CASE WHEN scaled <> cost THEN 1 ELSE 0 END) as bigint) AS n_changed FROM r GROUP BY l_returnflag"""


def category_shares(d):
    """Percent of each order's amount by flag."""
    return f"""WITH s AS (SELECT l_orderkey, l_returnflag, sum({PRICE}) AS cost FROM {d.table('lineitem')} GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, l_returnflag, round(100.0 * cast(cost as double) / cast(sum(cost) OVER (PARTITION BY l_orderkey) as double), 6) AS pct FROM s"""


def repetition_aggregate(d):
    return f"SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM {d.table('events')} GROUP BY user_id"


def item_keys(d):
    """Names without brackets, digits and signs, 12 characters at most, and their size band."""
    key = d.replace(d.replace("lower(p_name)", "[(][^)]*[)]", ""), "[^a-z]", "")
    return f"SELECT p_partkey, substr({key}, 1, 12) AS item_key, CASE WHEN p_size < 20 THEN '0-20' WHEN p_size < 30 THEN '20-30' WHEN p_size < 40 THEN '30-40' ELSE '40+' END AS band FROM {d.table('part')}"


def chunk_counts(d):
    """Pieces of 2000 with 200 shared that an image of that height is cut into; up to 3000 it stays whole."""
    return f"SELECT doc_id, cast(CASE WHEN n_chars <= 3000 THEN 1 ELSE {d.div('n_chars - 2000 + 1799', '1800')} + 1 END as bigint) AS n_chunks FROM {d.table('documents')} WHERE n_chars IS NOT NULL"


def range_validity(d):
    return f"WITH r AS ({cost_range_by_type(d)}) SELECT p_type, 0 < low AND low <= mid AND mid <= high AS valid FROM r"


def first_number(d):
    """The first run of digits, whole, as a number; 0 without one, null where it has more than 38 digits."""
    found = "regexp_extract(text, '[0-9]+', 0)"
    return f"SELECT doc_id, cast(CASE WHEN {found} = '' THEN 0 ELSE try_cast({found} as decimal(38, 0)) END as varchar(40)) AS number FROM {d.table('documents')} WHERE text IS NOT NULL"


PLANS = (
    estimate_report, risk_report, issue_stats, validation_rollup, truth_derivation, cost_diff_rollup, category_shares, repetition_aggregate, item_keys,
    chunk_counts, range_validity, first_number,
)
