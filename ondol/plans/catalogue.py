"""The registered queries over the star schema: each is one declarative plan, with the same text as its oracle."""

from __future__ import annotations

PRICE = "cast(round(l_extendedprice * 100) as bigint)"


def ranked(d, source: str, keys: str, value: str) -> str:
    """Rows (keys, x, n, i, k): the k equal values x have the 0-based places i to i + k - 1 of the group's n values.

    Spark counts equal values before any shuffle, and finds places in two steps: first of 1024 even ranges
    of the group's values, then inside each range.  No window holds a whole group, so a group may have most
    rows of the table.  The oracle numbers all rows.
    """
    if d.__name__ == "Duck":
        return f"SELECT {keys}, {value} AS x, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS i, 1 AS k FROM {source} WHERE {value} IS NOT NULL"
    names = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in names)
    of = lambda a: ", ".join(f"{a}.{k}" for k in names)
    return f"""WITH equal AS (SELECT {keys}, {value} AS x, count(*) AS k FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, {value}),
ends AS (SELECT {keys}, sum(k) AS n, cast(min(x) as double) AS least, cast(max(x) as double) AS most FROM equal GROUP BY {keys}),
placed AS (SELECT {of('c')}, x, k, n, CASE WHEN most > least THEN cast(floor((cast(x as double) - least) * 1023 / (most - least)) as bigint) ELSE 0 END AS slot FROM equal c JOIN ends e ON {same('c', 'e')}),
parts AS (SELECT {keys}, slot, sum(sum(k)) OVER (PARTITION BY {keys} ORDER BY slot) - sum(k) AS before FROM placed GROUP BY {keys}, slot)
SELECT {of('c')}, x, n, before + sum(k) OVER (PARTITION BY {of('c')}, c.slot ORDER BY x) - k AS i, k FROM placed c JOIN parts p ON {same('c', 'p')} AND c.slot = p.slot"""


def at(place: str) -> str:
    """The value at a place, over rows of `ranked`."""
    return f"max(CASE WHEN {place} >= i AND {place} < i + k THEN x END)"


def percentiles(d, source: str, keys: str, value: str, **points: float) -> str:
    """Rows (keys, points): exact percentiles with linear interpolation; the oracle uses its own."""
    if d.__name__ == "Duck":
        found = ", ".join(f"quantile_cont({value}, {p}) AS {name}" for name, p in points.items())
        return f"SELECT {keys}, {found} FROM {source} GROUP BY {keys}"
    lower = ", ".join(f"{at(f'floor({p} * (n - 1))')} AS {name}_lo, {at(f'ceil({p} * (n - 1))')} AS {name}_hi" for name, p in points.items())
    mixed = ", ".join(f"{n}_lo + ({n}_hi - {n}_lo) * ({p} * (n - 1) - floor({p} * (n - 1))) AS {n}" for n, p in points.items())
    return f"SELECT {keys}, {mixed} FROM (SELECT {keys}, max(n) AS n, {lower} FROM ({ranked(d, source, keys, value)}) r GROUP BY {keys}) z"


def cost_range_by_type(d):
    li, part = d.table("lineitem"), d.table("part")
    low, high = f"CASE WHEN n < 4 THEN 0 ELSE {d.div('n', '4')} END", f"CASE WHEN n < 4 THEN n - 1 ELSE {d.div('3 * n', '4')} END"
    mid = d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", "2")
    return f"""
WITH v AS (SELECT p_type, {PRICE} AS c FROM {li} JOIN {part} ON l_partkey = p_partkey),
r AS ({ranked(d, 'v', 'p_type', 'c')}),
s AS (SELECT p_type, max(n) AS n, {at(low)} AS lo, {at(high)} AS hi, {mid} AS mid FROM r GROUP BY p_type)
SELECT p_type, n AS n_values, CASE WHEN mid > 0 AND hi > lo * 1.8 THEN greatest(lo, {d.long('mid / sqrt(1.8)')}) ELSE lo END AS low, mid,
  CASE WHEN mid > 0 AND hi > lo * 1.8 THEN least(hi, {d.long('mid * sqrt(1.8)')}) ELSE hi END AS high FROM s"""


def unit_prices(d, spread: int = 20):
    li, part, orders = d.table("lineitem"), d.table("part"), d.table("orders")
    return f"""v AS (SELECT p_brand, p_type, o_custkey, cast(floor(l_extendedprice * 100 / l_quantity) as bigint) AS c
  FROM {li} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity > 0),
q AS (SELECT p_brand, p_type, count(DISTINCT o_custkey) AS requests FROM v GROUP BY p_brand, p_type),
r AS ({ranked(d, 'v', 'p_brand, p_type', 'c')}),
u AS (SELECT p_brand, p_type, max(n) AS n, {at(d.div('n', '10'))} AS p10,
  {d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", '2')} AS median,
  {at(f"(n - 1 - {d.div('n', '10')})")} AS p90 FROM r GROUP BY p_brand, p_type),
ref AS (SELECT p_brand, p_type, requests, n, p10, median, p90 FROM u JOIN q USING (p_brand, p_type) WHERE requests >= 15 AND p90 < {spread} * p10)"""


def unit_price_reference(d):
    return f"WITH {unit_prices(d)} SELECT * FROM ref"


def price_judgement(d):
    li, part = d.table("lineitem"), d.table("part")
    return f"""WITH {unit_prices(d)},
l AS (SELECT p_brand, p_type, cast(floor(l_extendedprice * 100 / l_quantity) as bigint) AS c FROM {li} JOIN {part} ON l_partkey = p_partkey WHERE l_quantity > 0),
j AS (SELECT l.p_brand, l.p_type, CASE WHEN c > 1.3 * p90 THEN 'high' WHEN c < 0.7 * p10 THEN 'low' ELSE 'fair' END AS verdict FROM l JOIN ref ON l.p_brand = ref.p_brand AND l.p_type = ref.p_type)
SELECT p_brand, p_type, verdict, count(*) AS n_lines FROM j GROUP BY p_brand, p_type, verdict"""


def extract_costs(d):
    return f"""SELECT o_orderkey, l_returnflag, cast(sum({PRICE}) as bigint) AS cost, count(*) AS n_lines FROM {d.table('orders')} JOIN {d.table('lineitem')} ON o_orderkey = l_orderkey
GROUP BY o_orderkey, l_returnflag HAVING sum({PRICE}) > 0"""


def value_counts(d):
    return f"SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_cases FROM {d.table('lineitem')} WHERE {PRICE} > 0 GROUP BY l_returnflag"


def scope_coverage(d):
    return f"""WITH c AS (SELECT l_orderkey, cast(sum(CASE WHEN l_returnflag IN ('A', 'N') THEN {PRICE} ELSE 0 END) as bigint) AS asked, cast(sum({PRICE}) as bigint) AS total FROM {d.table('lineitem')} GROUP BY l_orderkey),
k AS (SELECT *, 100 * asked >= 40 * total AS covers FROM c), n AS (SELECT count(*) AS n FROM k WHERE covers)
SELECT l_orderkey, asked, total FROM k CROSS JOIN n WHERE covers OR n < 3"""


def latest_per_key(d):
    return f"SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS n_orders FROM {d.table('orders')} GROUP BY o_custkey"


def asof_version(d):
    """For every event the newest version (signup) of its user at that time: newest by (ts, event_id), not by number."""
    e = d.table("events")
    upto = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = f"last_value(version IGNORE NULLS) {upto}" if d.__name__ == "Duck" else f"last_value(version) IGNORE NULLS {upto}"
    return f"""WITH v AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN event_id END AS version, event_id FROM {e})
SELECT event_id, user_id, {last} AS newest_version FROM v"""


def subtotal_islands(d):
    return f"""WITH e AS (SELECT user_id, event_id, ts, event_type, cast(round(coalesce(value, 0) * 100) as bigint) AS cents FROM {d.table('events')}),
i AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e)
SELECT user_id, {d.long('island')} AS island, count(*) AS n_events, {d.long('sum(cents)')} AS cents FROM i GROUP BY user_id, island"""


def duplicate_lines(d):
    return f"SELECT l_orderkey, l_partkey, count(*) AS n_lines, cast(sum({PRICE}) as bigint) AS cents FROM {d.table('lineitem')} GROUP BY l_orderkey, l_partkey HAVING count(*) >= 2"


def cross_duplicates(d):
    return f"SELECT l_partkey, {PRICE} AS cents, count(DISTINCT l_orderkey) AS n_orders FROM {d.table('lineitem')} GROUP BY l_partkey, {PRICE} HAVING count(DISTINCT l_orderkey) >= 2"


def lump_sum(d):
    return f"SELECT l_orderkey, max({PRICE}) AS cents FROM {d.table('lineitem')} GROUP BY l_orderkey HAVING count(*) = 1 AND max({PRICE}) >= 2000000"


def vague_terms(d):
    tests = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in ("that", "est", "und", "que"))
    return f"SELECT doc_id, {tests} AS n_terms FROM {d.table('documents')}"


def boilerplate_hash(d):
    return f"SELECT {d.sha('text')} AS digest, count(*) AS n_docs, min(doc_id) AS first_doc FROM {d.table('documents')} GROUP BY {d.sha('text')} HAVING count(*) >= 3"


def log_report(d):
    e = d.table("events")
    p95 = at("least(cast(floor(0.95 * n) as bigint), n - 1)")
    return f"""WITH r AS ({ranked(d, e, 'event_type', 'value')})
SELECT event_type, cast(sum(k) as bigint) AS n, round(sum(x * k) / sum(k), 6) AS avg_value, {p95} AS p95, max(x) AS max_value FROM r GROUP BY event_type"""


def bag_difference(d):
    li = d.table("lineitem")
    return f"SELECT l_partkey, l_quantity FROM {li} WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, l_quantity FROM {li} WHERE l_returnflag = 'R'"


def stratified_round_robin(d):
    return f"""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS turn FROM {d.table('customer')})
SELECT c_custkey, c_mktsegment, turn FROM r WHERE turn <= 5"""


def status_expire(d):
    return f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < timestamp '1996-01-01' THEN 'expired' WHEN o_orderstatus = 'F' THEN 'contracted' ELSE 'saved' END AS status
FROM {d.table('orders')}"""


def ratelimit_windows(d):
    minute = d.div(d.seconds("ts"), "60")
    return f"SELECT user_id, {minute} AS minute, count(*) AS calls, count(*) > 10 AS limited FROM {d.table('events')} GROUP BY user_id, {minute}"


def accuracy_mape_coverage(d):
    return f"""WITH s AS (SELECT l_orderkey, sum({PRICE}) AS mid FROM {d.table('lineitem')} GROUP BY l_orderkey),
j AS (SELECT o_orderpriority, mid, cast(round(o_totalprice * 100) as bigint) AS actual FROM {d.table('orders')} LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n, count(mid) AS n_used, round(avg(abs(actual - mid) / cast(actual as double)), 6) AS mape,
  cast(sum(CASE WHEN actual BETWEEN 0.8 * mid AND 1.2 * mid THEN 1 ELSE 0 END) as bigint) AS covered FROM j GROUP BY o_orderpriority"""


PLANS = (
    cost_range_by_type, unit_price_reference, price_judgement, extract_costs, value_counts, scope_coverage, latest_per_key, asof_version, subtotal_islands, duplicate_lines, cross_duplicates, lump_sum, vague_terms, boilerplate_hash, log_report,
    bag_difference, stratified_round_robin, status_expire, ratelimit_windows, accuracy_mape_coverage,
)
