"""Plans of the ingest side: repair, merging, classification, validation and routing of parsed lines."""

from __future__ import annotations

from .catalogue import PRICE

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def column_swap(d):
    """Three ordered repairs of lines whose columns were read in the wrong place; the first that applies wins."""
    return f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) AS q, cast(floor(l_extendedprice) as bigint) AS a FROM {d.table('lineitem')}),
i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a AS amount,
  CASE l_linenumber % 4 WHEN 0 THEN a * q WHEN 1 THEN a WHEN 2 THEN q ELSE {d.div('a', 'greatest(q, 1)')} END AS price, CASE WHEN l_linenumber % 4 = 2 THEN {d.div('a', 'greatest(q, 1)')} ELSE q END AS quantity FROM r),
c AS (SELECT *, CASE WHEN price <= 0 OR amount <= 0 OR quantity <= 1 THEN 0
  WHEN price > amount THEN CASE WHEN 10 * abs(amount * quantity - price) < price THEN 1 ELSE 0 END
  WHEN price = amount THEN CASE WHEN (2 * amount) % (2 * quantity) <> quantity THEN 2 ELSE 0 END
  WHEN price < 1000 AND quantity >= 1000 AND 100 * abs(quantity * price - amount) < amount THEN 3 ELSE 0 END AS repair FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, repair,
  CASE repair WHEN 1 THEN amount WHEN 2 THEN {d.div('2 * amount + quantity', '2 * greatest(quantity, 1)')} WHEN 3 THEN quantity ELSE price END AS unit_price,
  CASE WHEN repair = 3 THEN price ELSE quantity END AS quantity, CASE WHEN repair = 1 THEN price ELSE amount END AS amount FROM c"""


def aggregate_removal(d):
    """Where the lines of an order exceed its total by a fifth, drop lines within 5 % of the sum of their group's others."""
    return f"""WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, {PRICE} AS cents FROM {d.table('lineitem')}),
w AS (SELECT l.*, sum(cents) OVER (PARTITION BY l_orderkey) AS all_cents, sum(cents) OVER (PARTITION BY l_orderkey, l_returnflag) - cents AS others,
  count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM l),
m AS (SELECT w.*, cast(round(o_totalprice * 100) as bigint) AS total FROM w JOIN {d.table('orders')} ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, cents FROM m WHERE NOT (5 * all_cents > 6 * total AND n >= 3 AND 20 * abs(cents - others) <= others)"""


def occurrence_dedup(d):
    """Words of a turn beyond their count in the turn before."""
    return f"""WITH w AS (SELECT conv_id, turn, {d.explode(d.words('text'))} AS word FROM {d.table('conversations')}),
c AS (SELECT conv_id, turn, word, count(*) AS n FROM w GROUP BY conv_id, turn, word)
SELECT a.conv_id, a.turn, a.word, a.n - coalesce(b.n, 0) AS kept FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.word = b.word WHERE a.n > coalesce(b.n, 0)"""


def overlap_alignment(d):
    """Longest run of words that ends one turn and begins the next."""
    return f"""WITH w AS (SELECT conv_id, turn, {d.words('text')} AS words FROM {d.table('conversations')}),
p AS (SELECT conv_id, turn, words, lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS last_words FROM w)
SELECT conv_id, turn, cast({d.overlap('last_words', 'words')} as bigint) AS n_shared FROM p WHERE last_words IS NOT NULL AND words IS NOT NULL"""


def category_normalise(d):
    """Ordered rules: a category's own name, a mapped name, the first mapped token, else none."""
    return f"""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type WHEN p_type = 'STANDARD' THEN 'BASE'
  WHEN p_name LIKE '%widget%' THEN 'WIDGET' WHEN p_name LIKE '%bolt%' THEN 'BOLT' END AS category FROM {d.table('part')}"""


def region_detect(d):
    """The first rule that the location meets, else the first that the name meets, else a default."""
    rule = lambda x: f"CASE WHEN contains({x}, 'AFRICA') THEN 'south' WHEN contains({x}, 'ASIA') THEN 'east' WHEN contains({x}, 'AMERICA') THEN 'west' WHEN contains({x}, '_2') THEN 'named' END"
    return f"SELECT n_nationkey, coalesce({rule('r_name')}, {rule('n_name')}, 'other') AS region FROM {d.table('nation')} JOIN {d.table('region')} ON n_regionkey = r_regionkey"


def category_sums(d):
    return f"""c AS (SELECT l_orderkey, sum(CASE WHEN p_type = 'ECONOMY' AND p_name NOT LIKE '%widget%' THEN {PRICE} ELSE 0 END) AS wood,
  sum(CASE WHEN p_type = 'ECONOMY' AND p_name LIKE '%widget%' THEN {PRICE} ELSE 0 END) AS moved, sum(CASE WHEN p_type = 'PROMO' AND p_name LIKE '%bolt%' THEN {PRICE} ELSE 0 END) AS sash,
  sum(CASE WHEN p_type = 'PROMO' AND p_name LIKE '%gear%' THEN {PRICE} ELSE 0 END) AS door,
  sum(CASE WHEN p_type = 'PROMO' AND p_name NOT LIKE '%bolt%' AND p_name NOT LIKE '%gear%' THEN {PRICE} ELSE 0 END) AS generic
  FROM {d.table('lineitem')} JOIN {d.table('part')} ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def door_split(d):
    """Door items leave the joinery; an amount that names neither sash nor door is split by their ratio, to sashes if there is none."""
    part = f"CASE WHEN sash + door > 0 THEN {d.div('generic * door', 'greatest(sash + door, 1)')} ELSE 0 END"
    return f"""WITH {category_sums(d)}
SELECT l_orderkey, cast(wood as bigint) AS wood, cast(moved + door + {part} as bigint) AS door, cast(sash + generic - {part} as bigint) AS sash FROM c"""


def cost_rescale(d):
    """Costs that exceed 1.3 times the total shrink to it; only positive costs stay."""
    return f"""WITH s AS (SELECT l_orderkey, l_returnflag, sum({PRICE}) AS cost FROM {d.table('lineitem')} GROUP BY l_orderkey, l_returnflag),
w AS (SELECT s.*, sum(cost) OVER (PARTITION BY l_orderkey) AS all_cost FROM s),
r AS (SELECT l_orderkey, l_returnflag, CASE WHEN 10 * all_cost > 13 * total THEN {d.div('cost * total', 'all_cost')} ELSE cost END AS cost
  FROM w JOIN (SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) AS total FROM {d.table('orders')}) o ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_returnflag, cast(cost as bigint) AS cost FROM r WHERE cost > 0"""


def validation(d):
    """Errors and warnings of each order; tenths of confidence, so that 0.7 is met exactly."""
    return f"""s AS (SELECT l_orderkey, sum({PRICE}) AS cents, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS unknown, sum(cast(l_quantity as bigint)) AS area FROM {d.table('lineitem')} GROUP BY l_orderkey),
o AS (SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) AS total FROM {d.table('orders')}),
v AS (SELECT o_orderkey, n IS NOT NULL AS parsed, CASE WHEN n IS NULL THEN 1 ELSE 0 END + CASE WHEN area NOT BETWEEN 5 AND 200 THEN 1 ELSE 0 END + CASE WHEN 2 * unknown > n THEN 1 ELSE 0 END AS errors,
  CASE WHEN 5 * abs(cents - total) > total THEN 1 ELSE 0 END + CASE WHEN 5 * unknown > n AND 2 * unknown <= n THEN 1 ELSE 0 END AS warnings FROM o LEFT JOIN s ON o_orderkey = l_orderkey),
t AS (SELECT *, greatest(10 - 3 * errors - warnings, 0) AS tenths FROM v)"""


def validation_confidence(d):
    return f"WITH {validation(d)} SELECT o_orderkey, errors, warnings, cast(tenths as double) / 10 AS confidence FROM t"


def routing(d):
    return f"WITH {validation(d)} SELECT o_orderkey, CASE WHEN parsed AND tenths >= 7 THEN 'cases' ELSE 'review' END AS target FROM t"


def merge_pick_best(d):
    """Of a customer's orders with differing totals, the one whose lines come nearest its total, in relation to it."""
    return f"""WITH s AS (SELECT l_orderkey, sum({PRICE}) AS cents FROM {d.table('lineitem')} GROUP BY l_orderkey),
o AS (SELECT o_custkey, o_orderkey, cast(round(o_totalprice * 100) as bigint) AS total FROM {d.table('orders')}),
g AS (SELECT o_custkey, count(DISTINCT total) AS totals FROM o GROUP BY o_custkey),
r AS (SELECT o_custkey, o_orderkey, totals, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN totals > 1 THEN cast(abs(coalesce(cents, 0) - total) as double) / greatest(total, 1) END, o_orderkey) AS place
  FROM o JOIN g USING (o_custkey) LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT o_custkey, o_orderkey, totals FROM r WHERE place = 1"""


def html_links(d):
    pattern = 'href="([^"]*)"'
    return f"SELECT page_id, link, count(*) AS n FROM (SELECT page_id, {d.explode(d.groups('html', pattern))} AS link FROM {d.table('pages')}) z GROUP BY page_id, link"


def page_text(d, html="html"):
    bare = d.replace(d.replace(d.replace(html, "(?is)<!--.*?-->", " "), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return f"trim({d.replace(bare, '[ \t\r\n]+', ' ')})"


def html_text(d):
    return f"SELECT page_id, {d.sha('body')} AS text_sha256, length(body) AS n_chars FROM (SELECT page_id, {page_text(d)} AS body FROM {d.table('pages')}) z"


def content_mismatch(d):
    """Pages of whose title's telling words (3 letters, no stop word) none is in the text."""
    title = d.groups("html", "(?i)<title>([^<]*)</title>")
    words = d.keep_long(d.words("title"), 3, "'the', 'and', 'und', 'les', 'des', 'que'")
    return f"""WITH p AS (SELECT page_id, {title}[{{first}}] AS title, lower({page_text(d, d.replace('html', '(?is)<title>[^<]*</title>', ' '))}) AS body FROM {d.table('pages')}),
w AS (SELECT page_id, body, {words} AS words FROM p WHERE title IS NOT NULL)
SELECT page_id, cast({d.size('words')} as bigint) AS n_words, {d.size('words')} > 0 AND {d.none_in('words', 'body')} AS suspect FROM w""".replace("[{first}]", "[0]" if d.__name__ == "Spark" else "[1]")


PLANS = (
    column_swap, aggregate_removal, occurrence_dedup, overlap_alignment, category_normalise, region_detect, door_split, cost_rescale,
    validation_confidence, routing, merge_pick_best, html_links, html_text, content_mismatch,
)
