"""The estimate: requests against finished records, by staged retrieval, ranges by trade, factors and total.

Every twentieth customer is a request; its trades, size, region and options are dealt by its key.
The oracle joins requests with the records within their sizes.  Spark counts records by cell of size,
region and flags, and cuts cells before requests meet them (`nearest_records`), so no pair of a request
and a record is made that its list cannot hold.  Records and lists are written once and read again.
"""

from __future__ import annotations

from ..functions import values as V
from .catalogue import at
from .quotes import CATEGORIES, CATEGORY_KEY, DESCRIPTION_KEY, DESCRIPTIONS, LINE_AMOUNT, REQUESTS, cases, full_costs, has, is_door, is_sash, items, pick, quoted, scope_tests, trade_of
from .retrieval import EVERY

TRADES = [("도배", "장판"), ("욕실",), ("도배", "마루", "욕실", "창호", "도어", "전기/조명", "목공"), ("창호",), ("주방", "가구"), ("도장", "필름", "철거"), ("장판", "마루", "도배", "욕실", "목공", "전기/조명", "마감/공과잡비")]
FINISHING = "마감/공과잡비"
COSTS = list(dict.fromkeys([*V.CATEGORY_NAMES.values(), "도어"]))


def cost_keys(trade: str, trades: tuple[str, ...], window_has_door: bool = True) -> list[str]:
    """Costs that a request reads for a trade: windows hold doors unless doors are asked for, baths no plumbing if that is asked for."""
    keys = [k for k in V.TRADE_COSTS.get(trade, []) if not (trade == "욕실" and "설비" in trades and k == "설비")]
    return [*keys, "도어"] if trade == "창호" and window_has_door and "도어" not in trades else keys


def full_scope(trades) -> bool:
    """Whether trades make a whole renovation: wallpaper, floor and bath, and six trades or more."""
    own = {"욕실" if k in ("욕실", "설비", "타일") else "창호" if k == "도어" else k for t in trades for k in V.TRADE_COSTS.get(t, [])}
    return {"도배", "바닥", "욕실"} <= own and len(own) >= V.FULL_SCOPE_TRADES


def option(key: str, name: str) -> str:
    return pick(key, list(V.COEFFICIENTS[name]))


def factor(name: str, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN cast({v} as double)" for k, v in V.COEFFICIENTS[name].items()) + " ELSE cast(1 as double) END"


def requests(d) -> str:
    """ask: the requests; want: their trades with the expression number of each."""
    region = pick("c_custkey", list(V.REGIONS))
    scope = f"CASE WHEN c_custkey / {EVERY} % {len(TRADES)} IN ({', '.join(str(i) for i, t in enumerate(TRADES) if full_scope(t))}) THEN '전체' ELSE '부분' END"
    key = d.div("c_custkey", str(EVERY))
    return f"""ask AS (SELECT c_custkey AS request_id, {key} % {len(TRADES)} AS kind, 12 + c_custkey % 35 AS pyeong, {region} AS bucket, {scope.replace(f'c_custkey / {EVERY}', key)} AS scope,
  {option(key, 'material_grade')} AS grade, {option(key + ' + 1', 'building_age')} AS age, {option(key, 'occupancy')} AS occupancy, {option(key + ' + 2', 'timing')} AS timing, {option(key, 'truck_access')} AS truck,
  {option(key + ' + 1', 'demolition_cost')} AS demolition, CASE WHEN {key} % 4 = 0 THEN '없음' ELSE '있음' END AS elevator, {key} % 9 - 2 AS floor, 1 + {key} % 4 AS rooms FROM {d.table('customer')} WHERE c_custkey % {EVERY} = 0)"""


def in_region(case: str = "c", ask: str = "a") -> str:
    return "(" + " OR ".join(f"({ask}.bucket = '{b}' AND {case}.region IN ({quoted(rs)}))" for b, rs in V.REGIONS.items()) + ")"


def flagged(case: str = "c", ask: str = "a") -> str:
    """Whether a record has the flags of all trades that a request names."""
    names = list(V.FLAG_WORDS)
    tests = []
    for i, trades in enumerate(TRADES):
        flags = list(dict.fromkeys(V.TRADE_FLAGS[t] for t in trades if t in V.TRADE_FLAGS))
        tests.append(f"({ask}.kind = {i}" + "".join(f" AND {case}.has_{names.index(f)}" for f in flags) + ")")
    return "(" + " OR ".join(tests) + ")"


def cost_columns() -> str:
    return ", ".join(f"cost_{i}" for i in range(len(COSTS)))


def line_kinds(d) -> str:
    """kind_: each pair of a category and a description with its slot (its cost, or one of the parts of windows) and the bits of its flag words.

    A line's rules read nothing but these two, so they are applied to pairs and not to lines.  A word of a flag holds no
    blank, so it lies in one of them.  The last of each list is null, for keys that no word is dealt to.
    """
    trade = "CASE WHEN trade = '목공' AND door THEN '도어' ELSE trade END"
    slots = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(COSTS))
    bits = " + ".join(f"CASE WHEN {has('category', ws)} OR {has('description', ws)} THEN {1 << i} ELSE 0 END" for i, ws in enumerate(V.FLAG_WORDS.values()))
    return f"""kind_ AS (SELECT c, t, CASE WHEN trade <> '창호' THEN CASE {trade} {slots} END WHEN trade IS NULL THEN NULL WHEN door THEN {DOOR} WHEN sash AND NOT door THEN {SASH} WHEN NOT door AND NOT sash THEN {GENERIC} END AS slot, bits FROM (
  SELECT c, t, {trade_of(d, 'category')} AS trade, {is_door(d)} AS door, {is_sash(d)} AS sash, {bits} AS bits
  FROM (SELECT posexplode(array({quoted(CATEGORIES)}, NULL)) AS (c, category)) x CROSS JOIN (SELECT posexplode(array({quoted(DESCRIPTIONS)}, NULL)) AS (t, description)) y) z)"""


DOOR, SASH, GENERIC = (len(COSTS) + i for i in range(3))


def record_cases(d) -> str:
    """Records as the stored plans read them: `kinds` and `works` are bits, one for each kind of request whose flags a record has and one for each work.

    The same records as `cases`, from one sum of an order's lines; an order's key that repeats has its lines once for each row
    and the largest of its rows' costs.
    """
    names = list(V.FLAG_WORDS)
    kinds = []
    for i, trades in enumerate(TRADES):
        flags = sum(1 << names.index(f) for f in dict.fromkeys(V.TRADE_FLAGS[t] for t in trades if t in V.TRADE_FLAGS))
        kinds.append(f"CASE WHEN works & {flags} = {flags} THEN {1 << i} ELSE 0 END")
    bucket = "CASE " + " ".join(f"WHEN region IN ({quoted(rs)}) THEN '{b}'" for b, rs in V.REGIONS.items()) + " END"
    dealt = lambda key, words: f"CASE WHEN ({key}) % {len(words)} >= 0 THEN ({key}) % {len(words)} ELSE {len(words)} END"
    asked = lambda f: f"CASE o_orderkey % {len(REQUESTS)} " + " ".join(f"WHEN {i} THEN {f(text)}" for i, text in enumerate(REQUESTS)) + " END"
    words = asked(lambda text: sum(1 << i for i, ws in enumerate(V.FLAG_WORDS.values()) if any(w in text for w in ws)))
    shop = asked(lambda text: str(any(w in text for w in V.NON_RESIDENTIAL)).lower())
    part = {DOOR: "door", SASH: "sash", GENERIC: "generic"}
    sums = ", ".join(f"sum(CASE WHEN slot = {i} THEN amount ELSE 0 END) AS {part.get(i, f'sum_{i}')}" for i in range(len(COSTS) + 3))
    own = {t: f"cast(sum_{i} * copies as double)" for i, t in enumerate(COSTS)}
    own["도어"] += " + CASE WHEN door <= 0 THEN 0.0D WHEN sash <= 0 THEN cast((door + generic) * copies as double) ELSE door * copies + generic * copies * (1 - cast(sash as double) / (sash + door)) END"
    own["창호"] = "CASE WHEN door <= 0 THEN cast((sash + generic) * copies as double) WHEN sash <= 0 THEN 0.0D ELSE sash * copies + generic * copies * (cast(sash as double) / (sash + door)) END"
    costs = ", ".join(f"{x} AS part_{i}" for i, x in enumerate(own.values()))
    line_sum = " + ".join(f"part_{i}" for i in range(len(COSTS)))
    scaled = ", ".join(d.long(f"CASE WHEN over THEN part_{i} * scale ELSE part_{i} END") + f" AS cost_{i}" for i in range(len(COSTS)))
    return f"""WITH {line_kinds(d)},
sums AS (SELECT /*+ BROADCAST(k) */ l_orderkey, bit_or(bits) AS bits, {sums} FROM (SELECT l_orderkey, coalesce(greatest({LINE_AMOUNT}, 0), 0) AS amount, {dealt(CATEGORY_KEY, CATEGORIES)} AS c, {dealt(DESCRIPTION_KEY, DESCRIPTIONS)} AS t FROM {d.table('lineitem')}) l
  JOIN kind_ k ON l.c = k.c AND l.t = k.t GROUP BY l_orderkey),
total AS (SELECT o_orderkey AS article_id, o_custkey AS request, 10 + o_orderkey % 40 AS size_pyeong, {pick('o_custkey', [r for rs in V.REGIONS.values() for r in rs])} AS region, {shop} AS non_residential, coalesce({words}, 0) AS asked, cast(floor(o_totalprice * 100) as bigint) AS total_cost FROM {d.table('orders')} WHERE o_orderkey IS NOT NULL),
same AS (SELECT total.*, count(*) OVER (PARTITION BY article_id) AS copies, max(total_cost) OVER (PARTITION BY article_id) AS most_total, min(coalesce(total_cost, 0)) OVER (PARTITION BY article_id) AS least_total FROM total),
part_ AS (SELECT same.*, asked | bits AS works, {costs} FROM same JOIN sums ON article_id = l_orderkey),
rec AS (SELECT article_id, request, size_pyeong, region, non_residential, works, total_cost, {scaled} FROM (SELECT y.*, least_total > 0 AND line_sum > most_total * 1.3 AS over, cast(most_total as double) / nullif(line_sum, 0) AS scale FROM (SELECT part_.*, {line_sum} AS line_sum FROM part_) y) z),
case_ AS (SELECT rec.*, {bucket} AS bucket, CASE WHEN size_pyeong > 0 THEN {d.div('total_cost', 'size_pyeong')} ELSE 0 END AS cost_per_pyeong, NOT ({full_costs('({})'.format(' + '.join(scope_tests())))}) AS partial FROM rec)
SELECT article_id, request, region, bucket, size_pyeong, total_cost, cost_per_pyeong, partial, non_residential, {' + '.join(kinds)} AS kinds, works, {cost_columns()} FROM case_"""


def least(source: str, keys: str, order: str, k: int) -> str:
    """Rows of `source` that are among the k first of a group once any one customer's rows are left out; 2 * k of a group at most.

    A row goes if k rows of its own customer are before it, or k more rows than any one customer has before it.
    """
    return f"""SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i, max(j) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most FROM (
  SELECT y.*, row_number() OVER (PARTITION BY {keys}, request ORDER BY {order}) AS j FROM ({source}) y) x WHERE j <= {k}) z WHERE i <= {2 * k} AND i - 1 - most < {k}"""


def nearest_records(asked: str, k: int) -> str:
    """The k records nearest in size of every row (request_id, stage, kind, pyeong, bucket) of `asked` by its stage, from c (residential records).

    Records are cut by size, region and flags, then by size, region and kind of request, then by equal requests; each
    cut keeps what any customer may need, as a request leaves out the records of its own.
    """
    cell = "article_id, request, size_pyeong, bucket"
    fits = f"(stage > 2 OR abs(size_pyeong - pyeong) <= {V.SIZE_RANGE}) AND (stage > 1 OR o.bucket = n.bucket)"
    return f"""asked AS ({asked}), need AS (SELECT DISTINCT stage, kind, pyeong, CASE WHEN stage = 1 THEN bucket END AS bucket FROM asked),
alike AS (SELECT {cell}, kinds FROM ({least('SELECT * FROM c', 'size_pyeong, bucket, kinds', 'article_id', k)}) a),
of_kind AS (SELECT {cell}, kind FROM (SELECT a.*, explode({KINDS}) AS kind FROM alike a) b WHERE shiftright(kinds, kind) & 1 = 1 UNION ALL SELECT {cell}, -1 FROM alike),
few AS (SELECT {cell}, kind FROM ({least('SELECT * FROM of_kind', 'size_pyeong, bucket, kind', 'article_id', k)}) a),
listed AS (SELECT n.*, o.article_id, o.request, abs(size_pyeong - pyeong) AS gap FROM need n JOIN few o ON o.kind = CASE WHEN stage = 4 THEN -1 ELSE n.kind END AND {fits}),
short AS (SELECT stage, kind, pyeong, bucket, article_id, request, gap FROM ({least('SELECT * FROM listed', 'stage, kind, pyeong, bucket', 'gap, article_id', k)}) a),
told AS (SELECT /*+ BROADCAST(s) */ r.* FROM {{record_cases}} r JOIN (SELECT DISTINCT article_id FROM short) s ON r.article_id = s.article_id)
SELECT p.stage, r.article_id, r.region, r.size_pyeong, r.total_cost, r.cost_per_pyeong, r.partial, {', '.join(f'r.cost_{i}' for i in range(len(COSTS)))}, request_id, pyeong, place FROM (
  SELECT a.request_id, a.stage, a.pyeong, s.article_id, row_number() OVER (PARTITION BY a.request_id ORDER BY gap, s.article_id) AS place FROM asked a
  JOIN short s ON a.stage = s.stage AND a.kind = s.kind AND a.pyeong = s.pyeong AND (CASE WHEN a.stage = 1 THEN a.bucket END) <=> s.bucket AND a.request_id <> s.request) p JOIN told r ON p.article_id = r.article_id WHERE place <= {k}"""


KINDS = f"sequence(0, {len(TRADES) - 1})"
RESIDENTIAL = "c AS (SELECT article_id, request, size_pyeong, bucket, kinds FROM {record_cases} WHERE NOT non_residential AND request IS NOT NULL)"


def chosen_cases(d) -> str:
    """`chosen` of `retrieved`: stages are settled on counts of cells, less those of the request's own records."""
    near = f"abs(size_pyeong - pyeong) <= {V.SIZE_RANGE}"
    count = lambda n, side: f"sum(CASE WHEN {near} AND {side}.bucket = g.bucket THEN {n} ELSE 0 END) AS n1, sum(CASE WHEN {near} THEN {n} ELSE 0 END) AS n2, coalesce(sum({n}), 0) AS n3"
    left = lambda i: f"h.n{i} - coalesce(o.n{i}, 0) >= 3"
    asked = f"""SELECT a.request_id, a.kind, a.pyeong, a.bucket, CASE WHEN {left(2)} THEN CASE WHEN {left(1)} THEN 1 ELSE 2 END WHEN {left(3)} THEN 3 ELSE 4 END AS stage
  FROM ask a JOIN have h ON a.kind = h.kind AND a.pyeong = h.pyeong AND a.bucket <=> h.bucket LEFT JOIN own o ON a.request_id = o.request_id"""
    return f"""WITH {requests(d)}, {RESIDENTIAL}, n AS (SELECT kinds, size_pyeong, bucket, count(*) AS n FROM c GROUP BY kinds, size_pyeong, bucket),
kn AS (SELECT kind, size_pyeong, bucket, n FROM (SELECT n.*, explode({KINDS}) AS kind FROM n) z WHERE shiftright(kinds, kind) & 1 = 1),
have AS (SELECT g.kind, pyeong, g.bucket, {count('n', 'kn')} FROM (SELECT DISTINCT kind, pyeong, bucket FROM ask) g LEFT JOIN kn ON g.kind = kn.kind GROUP BY g.kind, pyeong, g.bucket),
own AS (SELECT request_id, {count('1', 'c')} FROM ask g JOIN c ON c.request = g.request_id AND shiftright(kinds, cast(kind as int)) & 1 = 1 GROUP BY request_id),
{nearest_records(asked, V.FINAL)}"""


def nearby_cases(d) -> str:
    """The nearest records within size and region of the requests for part of a home."""
    asked = "SELECT request_id, kind, pyeong, bucket, 1 AS stage FROM ask WHERE scope = '부분'"
    return f"WITH {requests(d)}, {RESIDENTIAL}, {nearest_records(asked, V.PARTIAL_POOL)}"


STORED = {"record_cases": record_cases, "chosen_cases": chosen_cases, "nearby_cases": nearby_cases}


def retrieved(d) -> str:
    """chosen (request_id, stage, place, record...): the first stage that finds 3 residential records, its 15 nearest in size.

    Stages: size within 6 with region and flags; size with flags; flags; all.
    """
    if d.__name__ == "Spark":
        return f"{requests(d)}, chosen AS (SELECT * FROM {d.table('chosen_cases')})"
    record = ", ".join(["c.article_id", "c.region", "c.size_pyeong", "c.total_cost", "c.cost_per_pyeong", "c.partial", *(f"c.cost_{i}" for i in range(len(COSTS)))])
    return f"""{cases(d)}, {requests(d)},
sized AS (SELECT request_id, step - {V.SIZE_RANGE} + pyeong AS size_pyeong FROM (SELECT a.request_id, a.pyeong, {d.explode(d.numbers(2 * V.SIZE_RANGE + 1))} AS step FROM ask a) z),
near AS (SELECT a.request_id, a.pyeong, {in_region()} AS here, {record} FROM sized s JOIN ask a ON s.request_id = a.request_id JOIN case_ c ON c.size_pyeong = s.size_pyeong WHERE NOT c.non_residential AND c.request <> a.request_id AND {flagged()}),
enough AS (SELECT a.request_id, count(n.request_id) AS n2, sum(CASE WHEN here THEN 1 ELSE 0 END) AS n1 FROM ask a LEFT JOIN near n ON a.request_id = n.request_id GROUP BY a.request_id),
far AS (SELECT a.request_id, a.pyeong, {flagged()} AS fits, {record} FROM ask a JOIN enough e ON a.request_id = e.request_id AND e.n2 < 3 CROSS JOIN case_ c WHERE NOT c.non_residential AND c.request <> a.request_id),
fits AS (SELECT request_id, sum(CASE WHEN fits THEN 1 ELSE 0 END) AS n3 FROM far GROUP BY request_id),
pool AS (SELECT CASE WHEN e.n1 >= 3 THEN 1 ELSE 2 END AS stage, {record.replace('c.', 'n.')}, n.request_id, n.pyeong FROM near n JOIN enough e ON n.request_id = e.request_id WHERE e.n2 >= 3 AND (here OR coalesce(e.n1, 0) < 3)
  UNION ALL SELECT CASE WHEN n3 >= 3 THEN 3 ELSE 4 END, {record.replace('c.', 'f.')}, f.request_id, f.pyeong FROM far f JOIN fits g ON f.request_id = g.request_id WHERE fits OR n3 < 3),
chosen AS (SELECT * FROM (SELECT pool.*, row_number() OVER (PARTITION BY request_id ORDER BY abs(size_pyeong - pyeong), article_id) AS place FROM pool) z WHERE place <= {V.FINAL})"""


def retrieved_cases(d):
    return f"WITH {retrieved(d)} SELECT request_id, stage, cast(place as bigint) AS place, article_id, size_pyeong, region FROM chosen"


def reference_cases(d):
    """The five records nearest in size that an estimate shows, with their cost a pyeong."""
    return f"WITH {retrieved(d)} SELECT request_id, article_id, region, size_pyeong, total_cost, cost_per_pyeong FROM chosen WHERE total_cost > 0 AND place <= 5"


def asked_sum(kind: int) -> str:
    keys = [f"cost_{COSTS.index(k)}" for t in TRADES[kind] if t != FINISHING for k in cost_keys(t, TRADES[kind])]
    return " + ".join(keys) or "0"


def covered(d) -> str:
    """used: the records an estimate is made from; whole renovations leave those out whose asked trades are under 40 % of the total, if 3 stay."""
    asked = "CASE kind " + " ".join(f"WHEN {i} THEN {asked_sum(i)}" for i in range(len(TRADES))) + " END"
    return f"""{retrieved(d)}, rated AS (SELECT h.*, a.kind, a.scope, a.scope = '전체' AND NOT (total_cost > 0 AND 100 * ({asked}) >= 40 * total_cost) AS thin FROM chosen h JOIN ask a ON h.request_id = a.request_id),
kept AS (SELECT rated.*, sum(CASE WHEN thin THEN 0 ELSE 1 END) OVER (PARTITION BY request_id) AS n_kept FROM rated), used AS (SELECT * FROM kept WHERE NOT thin OR n_kept < 3)"""


def ranges(d) -> str:
    """span (request_id, trade, n, low, mid, high): the cost range of each asked trade over the records that have it, times trade and request factors."""
    want, sums = [], []
    for i, trades in enumerate(TRADES):
        for t in dict.fromkeys([*(x for x in trades if x != FINISHING), "철거"]):
            total = " + ".join(f"cost_{COSTS.index(k)}" for k in cost_keys(t, trades))
            if total not in sums:
                sums.append(total)
            want.append(f"SELECT {i} AS kind, '{t}' AS trade, {sums.index(total)} AS number")
    cost = "CASE number " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(sums)) + " END"
    rooms = "CASE rooms " + " ".join(f"WHEN {k} THEN cast({v} as double)" for k, v in V.FLOOR_BY_ROOMS.items()) + " END"
    shared = ", ".join(str(i) for i, t in enumerate(TRADES) if "주방" in t and "가구" in t)
    own = f"CASE WHEN trade IN ('마루', '장판') THEN {rooms} WHEN trade = '주방' AND kind IN ({shared}) THEN cast(0.6 as double) WHEN trade = '가구' AND kind IN ({shared}) THEN cast(0.4 as double) ELSE cast(1 as double) END"
    whole = " * ".join(f"({factor(n, c)})" for n, c in (("material_grade", "grade"), ("building_age", "age"), ("occupancy", "occupancy"), ("timing", "timing"), ("truck_access", "truck")))
    mid = d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", "2")
    low, high = f"CASE WHEN n < 4 THEN 0 ELSE {d.div('n', '4')} END", f"CASE WHEN n < 4 THEN n - 1 ELSE {d.div('3 * n', '4')} END"
    narrow = lambda side: f"CASE WHEN mid > 0 AND hi > lo * 1.8 THEN {side} END"
    return f"""{covered(d)}, want AS ({' UNION ALL '.join(want)}), value AS (SELECT request_id, trade, {cost} AS cost FROM used u JOIN want w ON u.kind = w.kind), asks AS (SELECT ask.*, {whole} AS factor FROM ask),
scaled_value AS (SELECT v.request_id, trade, a.factor, {d.long(f'cost * ({own})')} AS x FROM value v JOIN asks a ON v.request_id = a.request_id WHERE cost > 0),
placed AS (SELECT request_id, trade, factor, x, count(*) OVER (PARTITION BY request_id, trade) AS n, row_number() OVER (PARTITION BY request_id, trade ORDER BY x) - 1 AS i, 1 AS k FROM scaled_value),
three AS (SELECT request_id, trade, max(factor) AS factor, max(n) AS n, {at(low)} AS lo, {at(high)} AS hi, {mid} AS mid FROM placed GROUP BY request_id, trade),
span AS (SELECT request_id, trade, n, mid AS raw_mid, {d.long(f"coalesce({narrow('greatest(lo, ' + d.long('mid / sqrt(1.8)') + ')')}, lo) * factor")} AS low, {d.long('mid * factor')} AS mid, {d.long(f"coalesce({narrow('least(hi, ' + d.long('mid * sqrt(1.8)') + ')')}, hi) * factor")} AS high, factor FROM three)"""


def estimate_trades(d):
    """Range of each asked trade of every request."""
    asked = " OR ".join(f"(a.kind = {i} AND trade IN ({quoted(t)}))" for i, t in enumerate(TRADES))
    return f"WITH {ranges(d)} SELECT s.request_id, trade, cast(n as bigint) AS n, low, s.mid AS mid, high FROM span s JOIN ask a ON s.request_id = a.request_id WHERE {asked}"


def estimate_totals(d):
    """The estimate's total: mids of the asked trades (one floor), lifting, demolition and finishing, with margins by the number of records."""
    asked = " OR ".join(f"(a.kind = {i} AND trade IN ({quoted(t)}))" for i, t in enumerate(TRADES))
    both = ", ".join(str(i) for i, t in enumerate(TRADES) if "마루" in t and "장판" in t)
    tears = ", ".join(str(i) for i, t in enumerate(TRADES) if "철거" in t)
    ends = ", ".join(str(i) for i, t in enumerate(TRADES) if FINISHING in t)
    allowance = "CASE demolition " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.COEFFICIENTS["demolition_cost"].items()) + " END * pyeong"
    low = "CASE WHEN n_cases >= 12 THEN 0.2 WHEN n_cases >= 8 THEN 0.8 WHEN n_cases >= 5 THEN 1.0 ELSE 1.2 END"
    high = "CASE WHEN n_cases >= 12 THEN 0.5 WHEN n_cases >= 5 THEN 1.0 ELSE 1.2 END"
    side = lambda i: f"CASE WHEN scope = '전체' THEN {V.MARGINS['전체'][i]} ELSE {V.MARGINS['부분'][i]} END"
    ratio = V.COEFFICIENTS["finishing_ratio"]
    finish = "cost_" + str(COSTS.index("공과잡비"))
    fmid = d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", "2")
    return f"""WITH {ranges(d)},
mid_sum AS (SELECT s.request_id, sum(CASE WHEN a.kind IN ({both}) AND trade = '마루' AND floors = 2 THEN 0 ELSE s.mid END) AS mids, max(s.factor) AS factor FROM
  (SELECT s.*, sum(CASE WHEN trade IN ('마루', '장판') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS floors FROM span s) s JOIN ask a ON s.request_id = a.request_id WHERE {asked} GROUP BY s.request_id),
n_used AS (SELECT request_id, count(*) AS n_cases FROM used GROUP BY request_id),
tear AS (SELECT request_id, n, mid FROM span WHERE trade = '철거'),
ends AS (SELECT request_id, max(n) AS n, {fmid} AS mid FROM (SELECT request_id, {finish} AS x, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id ORDER BY {finish}) - 1 AS i, 1 AS k FROM used WHERE {finish} > 0) z GROUP BY request_id),
base AS (SELECT a.*, n_cases, mids, m.factor, CASE WHEN elevator = '없음' THEN abs(CASE WHEN floor = 0 THEN 1 ELSE floor END) * {V.COEFFICIENTS['lifting_cost_per_floor']} ELSE 0 END AS lifting,
  CASE WHEN a.kind IN ({tears}) THEN 0 WHEN scope = '전체' AND demolition = '있음' AND coalesce(t.n, 0) >= {V.CASE_AMOUNTS} THEN t.mid ELSE {allowance} END AS tear_cost,
  CASE WHEN scope = '전체' AND coalesce(e.n, 0) >= {V.CASE_AMOUNTS} THEN {d.long('e.mid * m.factor')} END AS finish_cost
  FROM ask a JOIN mid_sum m ON a.request_id = m.request_id JOIN n_used u ON a.request_id = u.request_id LEFT JOIN tear t ON a.request_id = t.request_id LEFT JOIN ends e ON a.request_id = e.request_id),
mid_ AS (SELECT base.*, mids + lifting + tear_cost + coalesce(finish_cost, 0) AS mid FROM base),
total_ AS (SELECT mid_.*, {d.long(f'mid * cast(1 - ({side(0)}) * ({low}) as double)')} AS low, {d.long(f'mid * cast(1 + ({side(1)}) * ({high}) as double)')} AS high, finish_cost IS NULL AND (scope = '전체' OR kind IN ({ends})) AS by_ratio FROM mid_)
SELECT request_id, scope, cast(n_cases as bigint) AS n_cases, cast(lifting as bigint) AS lifting, cast(tear_cost as bigint) AS demolition, cast(finish_cost as bigint) AS finishing,
  {', '.join(f"CASE WHEN by_ratio THEN {d.long(f'{c} * cast({1 + ratio} as double)')} ELSE cast({c} as bigint) END AS {c}" for c in ('low', 'mid', 'high'))} FROM total_"""


def partial_retrieval(d):
    """Requests for part of a home: whether their 150 nearest records within size and region hold 8 partial ones, and how many of the first 15 of these have each trade."""
    pooled = f"SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY request_id ORDER BY abs(size_pyeong - pyeong), article_id) AS place FROM near n WHERE here) z WHERE place <= {V.PARTIAL_POOL}"
    start = f"{requests(d)}, pooled AS (SELECT * FROM {d.table('nearby_cases')})" if d.__name__ == "Spark" else f"{retrieved(d)}, pooled AS ({pooled})"
    return f"""WITH {start},
part AS (SELECT p.*, row_number() OVER (PARTITION BY request_id ORDER BY place) AS i FROM pooled p WHERE partial)
SELECT a.request_id, count(p.request_id) AS n_partial, count(p.request_id) >= {V.PARTIAL_CASES} AS enough, cast(sum(CASE WHEN i <= {V.FINAL} AND ({' OR '.join(f'(a.kind = {k} AND ({asked_sum(k)}) > 0)' for k in range(len(TRADES)))}) THEN 1 ELSE 0 END) as bigint) AS n_with_value
FROM ask a LEFT JOIN part p ON a.request_id = p.request_id WHERE a.scope = '부분' GROUP BY a.request_id"""


def leak_check(d):
    """Records of the request's own customer, which leave before the limit, and how many of them are among its references all the same."""
    return f"""WITH {retrieved(d)}, own AS (SELECT a.request_id, o_orderkey AS article_id FROM ask a JOIN {d.table('orders')} ON o_custkey = a.request_id)
SELECT o.request_id, count(*) AS own, count(h.article_id) AS leaked FROM own o LEFT JOIN chosen h ON o.request_id = h.request_id AND o.article_id = h.article_id GROUP BY o.request_id"""


def line_specs(d):
    """Per request and category: what lines the references hold, by cleaned description: count, range, the 12 most frequent and the ancillary ones.

    A description counts from max(2, 15 % of the records) lines on.
    """
    mid = d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", "2")
    low, high = f"CASE WHEN n < 4 THEN 0 ELSE {d.div('n', '4')} END", f"CASE WHEN n < 4 THEN n - 1 ELSE {d.div('3 * n', '4')} END"
    tidy = d.sub("description", "([0-9]+)[×✕*+]([0-9]+)", r"$1×$2" if d.__name__ == "Spark" else r"\1×\2")
    cut = lambda side: f"CASE WHEN mid > 0 AND hi > lo * 4 THEN {side} END"
    start = f"{items(d)}, {covered(d)}" if d.__name__ == "Spark" else covered(d)
    return f"""WITH {start}, spec AS (SELECT u.request_id, CASE WHEN {trade_of(d, 'category')} IN ('목공', '창호') AND {is_door(d)} THEN '도어' ELSE {trade_of(d, 'category')} END AS trade, {tidy} AS name, amount AS x
  FROM used u JOIN item i ON u.article_id = i.article_id WHERE amount > 0 AND description <> ''),
m AS (SELECT request_id, greatest(2, cast(ceil(count(*) * 0.15) as bigint)) AS least_lines FROM used GROUP BY request_id),
r AS (SELECT request_id, trade, name, x, count(*) OVER (PARTITION BY request_id, trade, name) AS n, row_number() OVER (PARTITION BY request_id, trade, name ORDER BY x) - 1 AS i, 1 AS k FROM spec WHERE trade IS NOT NULL),
s AS (SELECT r.request_id, trade, name, max(n) AS n, {at(low)} AS lo, {at(high)} AS hi, {mid} AS mid FROM r GROUP BY r.request_id, trade, name),
o AS (SELECT s.*, name IN ('인건비', '운송비', '부자재') AS ancillary FROM s JOIN m ON s.request_id = m.request_id WHERE n >= least_lines),
p AS (SELECT o.*, row_number() OVER (PARTITION BY request_id, trade, ancillary ORDER BY n DESC, name) AS place FROM o)
SELECT request_id, trade, name, cast(n as bigint) AS n, coalesce({cut('greatest(lo, ' + d.long('mid / 2.0') + ')')}, lo) AS low, mid, coalesce({cut('least(hi, ' + d.long('mid * 2.0') + ')')}, hi) AS high, ancillary FROM p WHERE place <= 12 OR ancillary"""


PLANS = (retrieved_cases, reference_cases, estimate_trades, estimate_totals, partial_retrieval, leak_check, line_specs)
