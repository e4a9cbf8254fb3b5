"""Plans over quotes: lines with trades, review findings and report, price and quantity references, costs by trade.

`items` and `cases` show the tables' lines and orders as quotes, with categories, descriptions and
units dealt by keys, so that the rules meet the words they look for.
"""

from __future__ import annotations

from ..functions import values as V
from .catalogue import at, percentiles, ranked
from .ingest import LINE_ORDER

CATEGORIES = "도배공사 바닥공사 욕실공사 타일공사 설비공사 가구공사 철거공사 전기공사 창호공사 목공사 도장공사 필름공사 도어공사 목공,도어 기타공사 모름".split()
DESCRIPTIONS = [
    "실크벽지", "강마루", "방수 처리", "양변기 교체", "세면대", "현관 중문", "ABS 방문", "발코니 샷시", "인건비", "부자재", "소계", "폐기물 처리", "붙박이장", "싱크대 상판",
    "철거 일식", "조명 서비스", "타일 540*540", "별도 협의", "합계", "LED 등기구(20W)", "몰딩", "콘센트", "욕실 소계", "",
]
UNITS = ["식", "평", "㎡", "EA", "", "M/D"]
CATEGORY_KEY, DESCRIPTION_KEY = "l_partkey", "l_suppkey * 3 + l_partkey + l_linenumber"
LINE_AMOUNT = "CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN 0 ELSE cast(floor(l_extendedprice / 5000) + 1 as bigint) * 500000 END"
REQUESTS = ["도배 장판 견적 부탁", "상가 리모델링", "욕실 타일 교체", "", "32평 아파트 창호 도어"]


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def pick(key: str, words: list[str]) -> str:
    return f"CASE ({key}) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def has(x: str, words) -> str:
    """Whether one of the words occurs; the words hold no sign of a pattern.  The registry names the oracle's function."""
    return f"regexp_like({x}, '{'|'.join(words)}')"


def mapped(x: str, names: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


def clean(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), ' ', ''), '/', ''), '·', '')"


def items(d) -> str:
    """item: the lines of all quotes."""
    unit_price = f"CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 13 = 0 THEN amount + 1 ELSE {d.div('amount', 'quantity')} END"
    return f"""raw_item AS (SELECT l_orderkey AS article_id, o_custkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS pos,
  {pick(CATEGORY_KEY, CATEGORIES)} AS category, {pick(DESCRIPTION_KEY, DESCRIPTIONS)} AS description, {pick('cast(l_quantity as bigint)', UNITS)} AS unit,
  cast(greatest(l_quantity, 1) as bigint) AS quantity, {LINE_AMOUNT} AS amount, l_suppkey, 10 + o_orderkey % 40 AS size_pyeong FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey),
item AS (SELECT article_id, request, pos, category, description, unit, quantity, {unit_price} AS unit_price, amount, size_pyeong FROM raw_item)"""


def process_of(cat: str, dsc: str) -> str:
    """First category rule that the category holds, else the first word rule that category and description hold."""
    strip = lambda w: w.replace(" ", "").replace("/", "").replace("·", "")
    rules = [(has(cat, map(strip, words)), p) for p, words in V.PROCESS_CATEGORIES.items()]
    rules += [(has(f"concat({cat}, ' ', {dsc})", map(strip, words)), p) for p, words in V.PROCESS_WORDS.items()]
    return "CASE " + " ".join(f"WHEN {test} THEN '{p}'" for test, p in rules) + " END"


def lines(d) -> str:
    """line: items with their process, null where none is found, and marks of aggregate and generic rows."""
    ends = " OR ".join(f"dsc LIKE '%{w}'" for w in V.AGGREGATE_WORDS[:3])
    return f"""{items(d)}, tidy AS (SELECT item.*, {clean('category')} AS cat, {clean('description')} AS dsc FROM item),
line AS (SELECT tidy.*, {process_of('cat', 'dsc')} AS process, dsc LIKE '{V.AGGREGATE_WORDS[0]}%' AS is_subtotal,
  dsc <> '' AND (dsc IN ({quoted(V.AGGREGATE_WORDS)}) OR dsc LIKE '{V.AGGREGATE_WORDS[0]}%' OR {ends}) AS is_aggregate, {has('description', V.GENERIC_WORDS)} AS is_generic FROM tidy)"""


def quote_processes(d):
    """Process of every line; where no rule finds one, its category."""
    return f"WITH {lines(d)} SELECT article_id, pos, process, coalesce(process, category) AS shown_process, is_subtotal, is_aggregate, is_generic FROM line"


def detected_processes(d):
    """Processes of each quote, in order of name."""
    return f"WITH {lines(d)} SELECT article_id, {d.joined('process', ',', 'process')} AS processes, count(*) AS n FROM (SELECT DISTINCT article_id, process FROM line WHERE process IS NOT NULL) z GROUP BY article_id"


def subtotal_groups(d) -> str:
    """wrong: subtotals that differ from their lines' sum, when no proper run of lines next to them sums to it.

    Quotes that begin with a subtotal have it before its lines, others after.
    """
    group = "PARTITION BY article_id, part"
    return f"""row_ AS (SELECT * FROM line WHERE is_subtotal OR amount <> 0),
style AS (SELECT row_.*, first_value(is_subtotal) OVER (PARTITION BY article_id ORDER BY pos) AS header, sum(CASE WHEN is_subtotal THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM row_),
island AS (SELECT style.*, CASE WHEN header OR NOT is_subtotal THEN upto ELSE upto - 1 END AS part FROM style),
written AS (SELECT article_id, part, amount AS written, process AS own_process, category AS own_category FROM island WHERE is_subtotal),
near AS (SELECT island.*, sum(amount) OVER ({group} ORDER BY CASE WHEN header THEN pos ELSE -pos END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
  row_number() OVER ({group} ORDER BY CASE WHEN header THEN pos ELSE -pos END) AS i, count(*) OVER ({group}) AS n, sum(amount) OVER ({group}) AS summed, first_value(process) OVER ({group} ORDER BY pos) AS first_process FROM island WHERE NOT is_subtotal),
wrong AS (SELECT near.article_id, near.part, written, max(summed) AS summed, coalesce(max(first_process), own_process, own_category) AS process,
  max(CASE WHEN i < n AND abs(written - run) <= {V.SUBTOTAL_TOLERANCE} THEN 1 ELSE 0 END) AS explained
  FROM near JOIN written ON near.article_id = written.article_id AND near.part = written.part WHERE written > 0 GROUP BY near.article_id, near.part, written, own_process, own_category
  HAVING abs(written - max(summed)) > {V.SUBTOTAL_TOLERANCE})"""


def subtotal_mismatches(d):
    return f"WITH {lines(d)}, {subtotal_groups(d)} SELECT article_id, cast(part as bigint) AS part, process, cast(written as bigint) AS written, cast(summed as bigint) AS summed, explained FROM wrong"


def found(d) -> str:
    """finding (article_id, kind, process, title, detail): what the rules find; kinds are missing, duplicate and unclear."""
    base = "SELECT * FROM line WHERE process IS NOT NULL AND NOT is_aggregate"
    text = d.joined("concat(cat, dsc)", "", "pos")
    siblings = " AND ".join(f"sum(CASE WHEN process IN ({quoted(s)}) THEN 1 ELSE 0 END) < count(*)" for s in V.SIBLINGS)
    missing = []
    for process, groups, need in V.REQUIRED:
        when = " AND ".join(has("words", g) for g in groups) if groups else f"{'has_' + str(len(missing))} = 1"
        missing.append(f"SELECT article_id, '누락' AS kind, '{process}' AS process, '필수 항목 누락' AS title, '{need[0]}' AS detail FROM words WHERE {when} AND NOT {has('words', need)}")
    present = ", ".join(f"max(CASE WHEN process = '{p}' THEN 1 ELSE 0 END) AS has_{i}" for i, (p, _, _) in enumerate(V.REQUIRED))
    return f"""part_ AS ({base}), words AS (SELECT b.article_id, coalesce(words, '') AS words, {', '.join(f'has_{i}' for i in range(len(V.REQUIRED)))} FROM (SELECT article_id, {present} FROM line GROUP BY article_id) b
  LEFT JOIN (SELECT article_id, {text} AS words FROM line WHERE NOT is_aggregate GROUP BY article_id) a ON a.article_id = b.article_id),
same AS (SELECT article_id, process, description, amount, count(*) AS n FROM part_ WHERE description <> '' AND NOT is_generic GROUP BY article_id, process, description, amount HAVING count(*) >= 2),
seen AS (SELECT article_id, process, min(pos) AS place FROM line WHERE process IS NOT NULL GROUP BY article_id, process),
wide AS (SELECT c.article_id, description, amount, count(*) AS n, max_by(c.process, place) AS process FROM (SELECT DISTINCT article_id, process, description, amount FROM part_ WHERE description <> '' AND amount > 0 AND NOT is_generic) c
  JOIN seen ON c.article_id = seen.article_id AND c.process = seen.process GROUP BY c.article_id, description, amount HAVING count(*) >= 2 AND {siblings.replace('process IN', 'c.process IN')}),
lump AS (SELECT article_id, process, max(description) AS description, max(amount) AS amount, max(quantity) AS quantity FROM part_ GROUP BY article_id, process HAVING count(*) = 1 AND max(amount) >= {V.LUMP_SUM} AND max(quantity) <= 1),
finding AS ({' UNION ALL '.join(missing)}
  UNION ALL SELECT article_id, '중복', process, '동일 항목 중복 기재', concat(description, ' ', cast(n as varchar(20))) FROM same
  UNION ALL SELECT article_id, '중복', process, '다른 공종에 같은 항목', concat(description, ' ', cast(amount as varchar(20))) FROM wide
  UNION ALL SELECT article_id, '불분명', process, '세부 내역 없이 일괄 금액', concat(description, ' ', cast(amount as varchar(20))) FROM lump
  UNION ALL SELECT article_id, '불분명', process, '총액에 포함되지 않은 항목', description FROM part_ WHERE amount = 0 AND NOT {has('description', V.FREE_WORDS)}
  UNION ALL SELECT article_id, '불분명', process, '모호한 표현 포함', description FROM part_ WHERE amount <> 0 AND {has('description', V.VAGUE_WORDS)}
  UNION ALL SELECT article_id, '불분명', process, '소계가 품목 합과 다름', concat(cast(written as varchar(20)), ' ', cast(summed as varchar(20))) FROM wrong WHERE explained = 0)"""


def review(d) -> str:
    return f"{lines(d)}, {subtotal_groups(d)}, {found(d)}"


def quote_findings(d):
    """Every finding of the review rules, one row each."""
    return f"WITH {review(d)} SELECT article_id, kind, process, title, detail FROM finding"


def duplicate_items(d):
    """Lines of one process with equal description and amount, generic lines left out."""
    return f"WITH {review(d)} SELECT article_id, process, description, amount, n FROM same"


def process_duplicates(d):
    """Lines equal in description and amount in several processes that are not all of one kin."""
    return f"WITH {review(d)} SELECT article_id, process, description, amount, n FROM wide"


def lump_sums(d):
    return f"WITH {review(d)} SELECT article_id, process, description, amount FROM lump"


def quote_cards(d):
    """Counters of the report: findings by kind; quotes without any have zeros."""
    count = lambda kind, name: f"cast(sum(CASE WHEN kind = '{kind}' THEN 1 ELSE 0 END) as bigint) AS {name}"
    return f"""WITH {review(d)} SELECT q.article_id, {count('누락', 'missing')}, {count('중복', 'duplicate')}, {count('불분명', 'unclear')}, count(kind) AS total
FROM (SELECT DISTINCT article_id FROM item) q LEFT JOIN finding f ON q.article_id = f.article_id GROUP BY q.article_id"""


def quote_sections(d):
    """Report by process: its normal lines in order (their own category's process, no subtotals or lines without amount), then its findings."""
    own = "CASE " + " ".join(f"WHEN category IN ({quoted(words)}) THEN '{p}'" for p, words in V.PROCESS_CATEGORIES.items()) + " END"
    return f"""WITH {review(d)},
card AS (SELECT article_id, {own} AS process, 0 AS part, pos, '정상' AS status, description AS title FROM line WHERE NOT is_subtotal AND amount <> 0
  UNION ALL SELECT article_id, process, 1, row_number() OVER (PARTITION BY article_id, process ORDER BY kind, title, detail), kind, title FROM finding)
SELECT article_id, process, count(*) AS n_cards, cast(sum(part) as bigint) AS n_issues, {d.joined("concat(status, ':', title)", '|', 'part, pos, title')} AS cards FROM card WHERE process IS NOT NULL GROUP BY article_id, process"""


def issue_titles(d):
    """Findings by title over the corpus: how many, and in what share of quotes."""
    return f"""WITH {review(d)}, q AS (SELECT count(DISTINCT article_id) AS quotes FROM item)
SELECT title, count(*) AS n, count(DISTINCT article_id) AS n_quotes, round(100.0 * cast(count(DISTINCT article_id) as double) / max(quotes), 6) AS pct FROM finding CROSS JOIN q GROUP BY title"""


def result_signature(d):
    """A quote's review as one text: sorted findings, counters and the number of normal lines."""
    return f"""WITH {review(d)}, n AS (SELECT article_id, cast(sum(CASE WHEN NOT is_subtotal AND amount <> 0 THEN 1 ELSE 0 END) as bigint) AS normal FROM line GROUP BY article_id),
f AS (SELECT article_id, count(*) AS n, {d.joined("concat(kind, '/', process, '/', title)", ';', 'kind, process, title')} AS issues FROM finding GROUP BY article_id)
SELECT n.article_id, normal, coalesce(f.n, 0) AS n_issues, {d.sha("concat(coalesce(issues, ''), '#', cast(normal as varchar(20)))")} AS signature FROM n LEFT JOIN f ON n.article_id = f.article_id"""


def finding_kinds(d):
    """Kind of a finding for scoring, and its direction, from title words."""
    kind = "CASE WHEN contains(title, '누락') THEN 'missing' WHEN contains(title, '중복') OR contains(title, '다른 공종') THEN 'duplicate' WHEN contains(title, '소계') THEN 'subtotal' WHEN contains(title, '일괄') THEN 'lump' WHEN contains(title, '포함되지') THEN 'not_charged' WHEN contains(title, '모호한') THEN 'vague' ELSE 'other' END"
    return f"WITH {review(d)} SELECT {kind} AS finding, kind, count(*) AS n FROM finding GROUP BY {kind}, kind"


def keyed(d) -> str:
    """keyed: items with bucket, name, unit, usable unit price and the quantity that price and amount give."""
    stem = "CASE WHEN trim(category) LIKE '%공사' THEN substr(trim(category), 1, length(trim(category)) - 2) ELSE trim(category) END"
    unit = "lower(replace(unit, ' ', ''))"
    name = d.sub(d.sub("description", V.BRACKETS, ""), V.NOISE, "")
    return f"""{items(d)}, stem AS (SELECT item.*, {stem} AS stem, {unit} AS u, substr({name}, 1, {V.KEY_LENGTH}) AS name FROM item),
keyed AS (SELECT stem.*, coalesce({mapped('stem', V.BUCKETS)}, stem) AS bucket, coalesce({mapped('u', V.UNIT_ALIASES)}, u) AS unit_name, CASE WHEN unit_price > 0 AND unit_price <= amount THEN unit_price END AS price FROM stem)"""


def item_reference_keys(d):
    """Bucket, name and unit of each line, its usable unit price, its quantity, and whether its unit is measured."""
    return f"""WITH {keyed(d)} SELECT article_id, pos, bucket, name, unit_name, price, CASE WHEN price IS NULL THEN NULL ELSE round(cast(amount as double) / price, 3) END AS quantity,
  bucket <> '' AND name <> '' AND unit_name IN ({quoted(V.MEASURED_UNITS)}) AS measured FROM keyed"""


def price_table(d, spread: int, requests: int = 15) -> str:
    """price_ref: n, p10, median, p90 by (bucket, name, unit); the dominant unit's row again under unit '' where it holds 80 % of the lines."""
    key = "bucket, name, unit_name"
    return f"""{keyed(d)}, priced AS (SELECT * FROM keyed WHERE bucket <> '' AND name <> '' AND unit_name <> '' AND price IS NOT NULL),
asked AS (SELECT {key}, count(DISTINCT request) AS requests, count(*) AS n_lines FROM priced GROUP BY {key}), r AS ({ranked(d, 'priced', key, 'price')}),
spread AS (SELECT {key}, max(n) AS n, {at(d.div('n', '10'))} AS p10, {d.div(f"{at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}", '2')} AS median, {at(f"(n - 1 - {d.div('n', '10')})")} AS p90 FROM r GROUP BY {key}),
own_ref AS (SELECT s.bucket, s.name, s.unit_name, n, p10, median, p90 FROM spread s JOIN asked a ON s.bucket = a.bucket AND s.name = a.name AND s.unit_name = a.unit_name WHERE requests >= {requests} AND p90 < {spread} * p10),
dominant AS (SELECT * FROM (SELECT {key}, n_lines, sum(n_lines) OVER (PARTITION BY bucket, name) AS all_lines, row_number() OVER (PARTITION BY bucket, name ORDER BY n_lines DESC, unit_name) AS i FROM asked) z WHERE i = 1 AND 10 * n_lines >= 8 * all_lines),
price_ref AS (SELECT * FROM own_ref UNION ALL SELECT o.bucket, o.name, '', n, p10, median, p90 FROM own_ref o JOIN dominant x ON o.bucket = x.bucket AND o.name = x.name AND o.unit_name = x.unit_name)"""


WIDE = 1000  # prices of the tables spread far; the service's limit is 5


def quote_price_reference(d):
    return f"WITH {price_table(d, WIDE)} SELECT bucket, name, unit_name, n, p10, median, p90 FROM price_ref"


def judged_prices(d) -> str:
    """judged: lines with a reference and the direction they are off in: beyond p90 or p10 and 1.3 or 0.7 times the median."""
    return f"""{price_table(d, WIDE)}, judged AS (SELECT k.article_id, k.pos, k.category, k.description, k.price, k.stem, f.p10, f.p90, f.median,
  CASE WHEN price > f.p90 AND 10 * price > 13 * f.median THEN '높음' WHEN price < f.p10 AND 10 * price < 7 * f.median THEN '낮음' END AS direction
  FROM keyed k JOIN price_ref f ON k.bucket = f.bucket AND k.name = f.name AND k.unit_name = f.unit_name WHERE price IS NOT NULL)"""


def quote_price_judgement(d):
    return f"WITH {judged_prices(d)} SELECT article_id, pos, price, direction, p10, p90 FROM judged"


def quote_price_issues(d):
    """Processes with two or more compared lines, half or more of them off in one direction, and the first two as examples."""
    process = process_of("cat", "dsc")
    return f"""WITH {judged_prices(d)}, p AS (SELECT *, coalesce({process}, category) AS process FROM (SELECT j.*, {clean('category')} AS cat, {clean('description')} AS dsc FROM judged j) z),
w AS (SELECT p.*, count(*) OVER (PARTITION BY article_id, process) AS compared, row_number() OVER (PARTITION BY article_id, process, direction ORDER BY pos) AS i FROM p)
SELECT article_id, process, direction, compared, count(*) AS n_off, max(CASE WHEN i = 1 THEN price END) AS example_1, max(CASE WHEN i = 2 THEN price END) AS example_2 FROM w
WHERE direction IS NOT NULL GROUP BY article_id, process, direction, compared HAVING compared >= 2 AND 2 * count(*) >= compared"""


def quantity_table(d, requests: int = 15) -> str:
    """amount_ref: median and p90 of quantity by pyeong, of measured units."""
    key = "bucket, name, unit_name"
    r3 = "cast(floor({} * 1000 + 0.5) as double) / 1000".format
    return f"""{keyed(d)}, measured AS (SELECT {key}, request, cast(amount as double) / price / size_pyeong AS ratio FROM keyed WHERE bucket <> '' AND name <> '' AND unit_name IN ({quoted(V.MEASURED_UNITS)}) AND price IS NOT NULL AND size_pyeong > 0),
enough AS (SELECT {key}, count(DISTINCT request) AS requests FROM measured GROUP BY {key}), r AS ({ranked(d, 'measured', key, 'ratio')}),
two AS (SELECT {key}, max(n) AS n, ({at(d.div('n - 1', '2'))} + {at(d.div('n', '2'))}) / 2 AS median, {at(f"(n - 1 - {d.div('n', '10')})")} AS p90 FROM r GROUP BY {key}),
amount_ref AS (SELECT t.bucket, t.name, t.unit_name, n, {r3('median')} AS median, {r3('p90')} AS p90 FROM two t JOIN enough e ON t.bucket = e.bucket AND t.name = e.name AND t.unit_name = e.unit_name WHERE requests >= {requests})"""


def quote_quantity_reference(d):
    return f"WITH {quantity_table(d)} SELECT bucket, name, unit_name, n, median, p90 FROM amount_ref"


def quote_quantity_issues(d):
    """Lines whose quantity by pyeong exceeds 1.5 times the reference's p90."""
    return f"""WITH {quantity_table(d)} SELECT article_id, pos, round(cast(amount as double) / price, 3) AS quantity, f.median, f.p90 FROM keyed k JOIN amount_ref f ON k.bucket = f.bucket AND k.name = f.name AND k.unit_name = f.unit_name
WHERE price IS NOT NULL AND size_pyeong > 0 AND cast(amount as double) / price / size_pyeong > f.p90 * 1.5"""


def trade_of(d, x: str) -> str:
    """A category's trade: itself if it is one, its mapped name, or that of the first known name between commas."""
    name = lambda t: mapped(t, V.CATEGORY_NAMES)
    return f"CASE WHEN {x} IN ({quoted(sorted(set(V.CATEGORY_NAMES.values())))}) THEN {x} ELSE coalesce({name(x)}, CASE WHEN contains({x}, ',') THEN {d.first_token(x, name)} END) END"


def category_names(d):
    return f"WITH {items(d)} SELECT category, {trade_of(d, 'category')} AS trade, count(*) AS n FROM item GROUP BY category"


def is_door(d, x: str = "description") -> str:
    """The oracle's engine has no look-around, so there the two exceptions are taken out of the text first."""
    if d.__name__ == "Duck":
        plain = V.DOORS.replace("(?<![a-z])door", "(^|[^a-z])door").replace(r"ABS(?!\s*몰딩)", "ABS")
        return f"(regexp_matches(regexp_replace({x}, '(?i)ABS\\s*몰딩', '', 'g'), '(?i){plain}') AND NOT {d.rlike(x, V.NOT_DOORS)})"
    return f"({d.rlike(x, '(?i)' + V.DOORS)} AND NOT {d.rlike(x, V.NOT_DOORS)})"


def is_sash(d, x: str = "description") -> str:
    if d.__name__ == "Duck":
        return f"regexp_matches(replace({x}, '창고', ''), '(?i){V.SASHES.replace('(?!고)', '')}')"
    return d.rlike(x, "(?i)" + V.SASHES)


def trade_sums(d) -> str:
    """costs (article_id, trade, cost): sums by trade, doors apart, scaled down to the total where they exceed it by 1.3; doors always present."""
    total = "SELECT o_orderkey AS article_id, cast(floor(o_totalprice * 100) as bigint) AS total_cost, 10 + o_orderkey % 40 AS size_pyeong, o_custkey AS request FROM " + d.table("orders")
    return f"""{items(d)}, total AS ({total}), named AS (SELECT item.*, {trade_of(d, 'category')} AS trade, {is_door(d)} AS door, {is_sash(d)} AS sash FROM item WHERE amount > 0),
split AS (SELECT article_id, sum(CASE WHEN door THEN amount ELSE 0 END) AS door, sum(CASE WHEN sash AND NOT door THEN amount ELSE 0 END) AS sash, sum(CASE WHEN NOT door AND NOT sash THEN amount ELSE 0 END) AS generic FROM named WHERE trade = '창호' GROUP BY article_id),
share AS (SELECT article_id, CASE WHEN door <= 0 THEN 0.0 WHEN sash <= 0 THEN cast(door + generic as double) ELSE door + generic * (1 - cast(sash as double) / (sash + door)) END AS door_part,
  CASE WHEN door <= 0 THEN cast(sash + generic as double) WHEN sash <= 0 THEN 0.0 ELSE sash + generic * (cast(sash as double) / (sash + door)) END AS sash_part FROM split),
summed AS (SELECT article_id, trade, sum(cost) AS cost, sum(sum(cost)) OVER (PARTITION BY article_id) AS line_sum FROM (
  SELECT article_id, CASE WHEN trade = '목공' AND door THEN '도어' ELSE trade END AS trade, cast(amount as double) AS cost FROM named WHERE trade <> '창호'
  UNION ALL SELECT article_id, '도어', door_part FROM share UNION ALL SELECT article_id, '창호', sash_part FROM share UNION ALL SELECT article_id, '도어', 0.0 FROM total) z GROUP BY article_id, trade),
scaled AS (SELECT s.article_id, trade, {d.long('CASE WHEN total_cost > 0 AND line_sum > total_cost * 1.3 THEN cost * (cast(total_cost as double) / line_sum) ELSE cost END')} AS cost FROM summed s JOIN total t ON s.article_id = t.article_id),
costs AS (SELECT article_id, trade, cost FROM scaled WHERE cost > 0 OR trade = '도어')"""


def door_items(d):
    return f"WITH {items(d)} SELECT description, {is_door(d)} AS door, {is_sash(d)} AS sash, count(*) AS n FROM item GROUP BY description"


def trade_costs(d):
    return f"WITH {trade_sums(d)} SELECT article_id, trade, cast(cost as bigint) AS cost FROM costs"


def wide_costs() -> str:
    trades = list(dict.fromkeys([*V.CATEGORY_NAMES.values(), "도어"]))
    return ", ".join(f"cast(coalesce(max(CASE WHEN trade = '{t}' THEN cost END), 0) as bigint) AS cost_{i}" for i, t in enumerate(trades))


def scope_costs() -> dict[str, str]:
    """Of each group of costs that tells the scope, whether a record has any."""
    trades = list(dict.fromkeys([*V.CATEGORY_NAMES.values(), "도어"]))
    read = list(dict.fromkeys(k for keys in V.TRADE_COSTS.values() for k in keys))  # only these trades tell the scope
    own = lambda t: "욕실" if t in ("욕실", "타일", "설비") else "창호" if t == "도어" else t
    groups: dict[str, list[str]] = {}
    for t in read:
        groups.setdefault(own(t), []).append(f"cost_{trades.index(t)}")
    return {g: "(" + " OR ".join(f"{c} > 0" for c in cs) + ")" for g, cs in groups.items()}


def scope_tests() -> list[str]:
    return [f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in scope_costs().values()]


def full_costs(n_trades: str) -> str:
    """Whether a record is a whole renovation."""
    have = scope_costs()
    return f"{have['도배']} AND {have['바닥']} AND {have['욕실']} AND {n_trades} >= {V.FULL_SCOPE_TRADES}"


def cases(d) -> str:
    """case_ : finished records, one a quote: total, size, region, cost_i by trade, flags, cost a pyeong, partial or full scope."""
    trades = list(dict.fromkeys([*V.CATEGORY_NAMES.values(), "도어"]))
    n_trades, full = " + ".join(scope_tests()), full_costs("n_trades")
    flags = ", ".join(f"{has('words', ws)} AS has_{i}" for i, ws in enumerate(V.FLAG_WORDS.values()))
    regions = [r for rs in V.REGIONS.values() for r in rs]
    text = d.joined("concat(category, ' ', description)", " ", "pos")
    return f"""{trade_sums(d)}, flat AS (SELECT article_id, {wide_costs()} FROM costs GROUP BY article_id), told AS (SELECT article_id, {text} AS words FROM item GROUP BY article_id),
rec AS (SELECT t.article_id, t.request, t.size_pyeong, t.total_cost, {pick('t.request', regions)} AS region, {pick('t.article_id', REQUESTS)} AS request_text, concat({pick('t.article_id', REQUESTS)}, ' ', w.words) AS words, f.* EXCLUDED
  FROM total t JOIN flat f ON t.article_id = f.article_id JOIN told w ON t.article_id = w.article_id),
case0 AS (SELECT rec.*, {n_trades} AS n_trades, {flags}, CASE WHEN size_pyeong > 0 THEN {d.div('total_cost', 'size_pyeong')} ELSE 0 END AS cost_per_pyeong, {has('request_text', V.NON_RESIDENTIAL)} AS non_residential FROM rec),
case_ AS (SELECT case0.*, NOT ({full}) AS partial FROM case0)""".replace("f.* EXCLUDED", ", ".join(f"f.cost_{i}" for i in range(len(trades))))


def finished_records(d):
    """The records as the estimate reads them."""
    flags = ", ".join(f"has_{i}" for i in range(len(V.FLAG_WORDS)))
    return f"WITH {cases(d)} SELECT article_id, request, region, size_pyeong, total_cost, cost_per_pyeong, n_trades, partial, non_residential, {flags} FROM case_"


def scope_share(d):
    """Cases by scope: how many, and the median cost a pyeong."""
    return f"WITH {cases(d)}, p AS ({percentiles(d, 'case_', 'partial', 'cost_per_pyeong', mid=0.5)}) SELECT c.partial, count(*) AS n, round(max(mid), 6) AS median_per_pyeong FROM case_ c JOIN p ON c.partial = p.partial GROUP BY c.partial"


PLANS = (
    quote_processes, detected_processes, subtotal_mismatches, quote_findings, duplicate_items, process_duplicates, lump_sums, quote_cards, quote_sections, issue_titles,
    result_signature, finding_kinds, item_reference_keys, quote_price_reference, quote_price_judgement, quote_price_issues, quote_quantity_reference, quote_quantity_issues,
    category_names, door_items, trade_costs, finished_records, scope_share,
)
