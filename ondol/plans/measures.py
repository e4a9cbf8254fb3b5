"""Plans of retrieval, review rules and evaluation measures."""

from __future__ import annotations

from .catalogue import PRICE, at, percentiles, ranked, unit_prices

THOUSANDTHS = "cast(floor({} * 1000 + 0.5) as double) / 1000"


def quantity_reference(d):
    """Median and p90 of quantity by size, with at least 15 requests."""
    r3 = THOUSANDTHS.format
    return f"""WITH v AS (SELECT p_brand, p_type, o_custkey, l_quantity / p_size AS q FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey JOIN {d.table('orders')} ON l_orderkey = o_orderkey WHERE p_size > 0 AND l_quantity > 0),
c AS (SELECT p_brand, p_type, count(DISTINCT o_custkey) AS requests FROM v GROUP BY p_brand, p_type),
r AS ({ranked(d, 'v', 'p_brand, p_type', 'q')}),
s AS (SELECT p_brand, p_type, max(n) AS n, ({at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}) / 2 AS mid,
  {at(f"(n - 1 - {d.div('n', '10')})")} AS high FROM r GROUP BY p_brand, p_type)
SELECT p_brand, p_type, n, {r3('mid')} AS median, {r3('high')} AS p90 FROM s JOIN c USING (p_brand, p_type) WHERE requests >= 15"""


def price_issues(d):
    """Orders of whose compared lines (two at least) half or more are off in one direction, with the first two as examples."""
    return f"""WITH {unit_prices(d)},
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, p_type, cast(floor(l_extendedprice * 100 / l_quantity) as bigint) AS c FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey WHERE l_quantity > 0),
j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c, CASE WHEN c > 1.3 * p90 THEN 'high' WHEN c < 0.7 * p10 THEN 'low' END AS direction FROM l JOIN ref ON l.p_brand = ref.p_brand AND l.p_type = ref.p_type),
w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n_compared, row_number() OVER (PARTITION BY l_orderkey, direction ORDER BY l_linenumber, l_partkey, l_suppkey, c) AS i FROM j)
SELECT l_orderkey, direction, n_compared, count(*) AS n_off, max(CASE WHEN i = 1 THEN c END) AS example_1, max(CASE WHEN i = 2 THEN c END) AS example_2 FROM w
WHERE direction IS NOT NULL GROUP BY l_orderkey, direction, n_compared HAVING n_compared >= 2 AND 2 * count(*) >= n_compared"""


def prefix_match(d):
    """Does a proper prefix of an order's lines sum to its total, give or take 1000 units."""
    return f"""WITH l AS (SELECT l_orderkey, sum({PRICE}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {d.table('lineitem')})
SELECT l_orderkey, max(CASE WHEN i < n AND abs(upto - cast(round(o_totalprice * 100) as bigint)) <= 100000 THEN 1 ELSE 0 END) AS matched FROM l JOIN {d.table('orders')} ON l_orderkey = o_orderkey GROUP BY l_orderkey"""


def required_missing(d):
    """Rules: when one word of each group occurs, one of the needed words has to."""
    has = lambda *ws: "(" + " OR ".join(f"contains(text, '{w}')" for w in ws) + ")"
    rules = ((("that", "this"), ("with", "for"), ("into", "onto")), (("und",), ("der", "die"), ("nicht",)), (("les",), ("que", "qui"), ("pour",)))
    one = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule FROM {d.table('documents')} WHERE {has(*a)} AND {has(*b)} AND NOT {has(*need)}" for i, (a, b, need) in enumerate(rules))
    return one


def percentile_interp(d):
    found = percentiles(d, d.table("events"), "event_type", "value", p50=0.5, p95=0.95)
    return f"SELECT event_type, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM ({found}) z WHERE p50 IS NOT NULL"


def load_levels(d):
    """Users as load levels (id modulo 5): calls, successes, error share, throughput a minute and latency of successes."""
    calls = f"(SELECT user_id % 5 AS level, CASE WHEN event_type <> 'error' THEN value END AS ms, event_type, ts FROM {d.table('events')}) y"
    return f"""WITH p AS ({percentiles(d, calls, 'level', 'ms', p50=0.5, p90=0.9, p95=0.95)}),
g AS (SELECT level, count(*) AS calls, cast(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) as bigint) AS success, max({d.seconds('ts')}) - min({d.seconds('ts')}) AS window_s, max(ms) AS most FROM {calls} GROUP BY level)
SELECT g.level, calls, success, round(1 - cast(success as double) / calls, 6) AS error_rate, round(cast(success as double) * 60 / greatest(window_s, 1), 6) AS per_minute,
  round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, most FROM g LEFT JOIN p ON g.level = p.level"""


def score_summary(d):
    """Line sums as predictions of order totals: median absolute error, sides, and hits within 20 %; an order without lines is a miss."""
    return f"""WITH s AS (SELECT l_orderkey, sum({PRICE}) AS mid FROM {d.table('lineitem')} GROUP BY l_orderkey),
j AS (SELECT o_orderpriority, mid, cast(round(o_totalprice * 100) as bigint) AS actual FROM {d.table('orders')} LEFT JOIN s ON o_orderkey = l_orderkey),
e AS (SELECT *, cast(abs(mid - actual) as double) / greatest(actual, 1) AS err FROM j),
p AS ({percentiles(d, 'e', 'o_orderpriority', 'err', median_error=0.5)})
SELECT e.o_orderpriority, count(*) AS n, round(max(median_error), 6) AS median_error, cast(sum(CASE WHEN mid > actual THEN 1 ELSE 0 END) as bigint) AS n_over, cast(sum(CASE WHEN mid < actual THEN 1 ELSE 0 END) as bigint) AS n_under,
  round(cast(sum(CASE WHEN 5 * abs(mid - actual) <= actual THEN 1 ELSE 0 END) as double) / count(*), 6) AS hit_rate FROM e LEFT JOIN p ON e.o_orderpriority = p.o_orderpriority GROUP BY e.o_orderpriority"""


def bootstrap_ci(d):
    """Mean over brands of a brand's mean line price: 2000 resamples of the brands by a fixed index rule, 2.5 and 97.5 % bounds.

    Only as many rows as brands are resampled; the lines are aggregated first.
    """
    draws = f"SELECT {d.explode(d.numbers(2000))} AS b"
    return f"""WITH m AS (SELECT p_brand, {d.div(f'sum({PRICE})', 'count(*)')} AS mean FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey GROUP BY p_brand),
r AS (SELECT mean, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM m),
k AS (SELECT b, i AS j, n, ((b * 7919 + i * 104729 + (b * b % 1009) * (i + 1)) % 65537) % n AS pick FROM r CROSS JOIN ({draws}) z),
s AS (SELECT b, {d.div('sum(mean)', 'max(k.n)')} AS mean FROM k JOIN r ON pick = i GROUP BY b),
o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS i FROM s)
SELECT cast(max(CASE WHEN i = 50 THEN mean END) as bigint) AS low, cast(max(CASE WHEN i = 1949 THEN mean END) as bigint) AS high, count(*) AS resamples FROM o"""


def multiset_match(d):
    """Lines of two sides paired one by one on equal (part, quantity)."""
    side = lambda f: f"SELECT l_partkey, l_quantity, l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS i FROM {d.table('lineitem')} WHERE l_returnflag = '{f}'"
    return f"WITH a AS ({side('A')}), b AS ({side('R')}) SELECT a.l_partkey, a.l_quantity, a.i, a.l_orderkey AS left_order, b.l_orderkey AS right_order FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.i = b.i"


def regression_residuals(d):
    """Quality less its linear fit on length by language; groups under 3 rows or without variance keep the raw value."""
    return f"""WITH l AS (SELECT d.doc_id, coalesce(lang, 'none') AS lang, cast(quality as double) AS y, cast(n_chars as double) / 1000 AS x FROM {d.table('documents')} d JOIN {d.table('labels')} q ON d.doc_id = q.doc_id WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
f AS (SELECT lang, count(*) AS n, var_pop(x) AS v, regr_slope(y, x) AS slope, avg(y) AS my, avg(x) AS mx FROM l GROUP BY lang)
SELECT doc_id, l.lang, round(CASE WHEN n < 3 OR v = 0 THEN y ELSE y - (my + slope * (x - mx)) END, 6) AS residual FROM l JOIN f ON l.lang = f.lang"""


def ttl_expiry(d):
    """Newest use of each key; keys not used in the last 7 days of the log expire."""
    e = d.table("events")
    return f"""WITH u AS (SELECT user_id, max({d.seconds('ts')}) AS last_used FROM {e} GROUP BY user_id), m AS (SELECT max(last_used) AS now FROM u)
SELECT user_id, last_used, last_used + 7 * 86400 < now AS expired FROM u CROSS JOIN m"""


def keyed_lookup(d):
    return f"SELECT p_partkey, p_name, p_size FROM {d.table('part')} WHERE p_partkey IN (SELECT l_partkey FROM {d.table('lineitem')} WHERE l_returnflag = 'R')"


def row_counts(d):
    return " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {d.table(t)}" for t in ("orders", "lineitem", "documents", "events"))


PLANS = (
    quantity_reference, price_issues, prefix_match, required_missing, percentile_interp, load_levels,
    score_summary, bootstrap_ci, multiset_match, regression_residuals, ttl_expiry, keyed_lookup, row_counts,
)
