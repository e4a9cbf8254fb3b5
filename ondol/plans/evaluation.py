"""Plans of evaluation: scores of estimates, grouped summaries, tolerance, graded runs, load tests and matched events."""

from __future__ import annotations

from .catalogue import PRICE, percentiles
from .ingest import LINE_ORDER
from .quotes import items, pick


def scored(d) -> str:
    """score: line sums as predicted mids of order totals, with a range of 20 % below and 30 % above; orders without lines failed."""
    return f"""s AS (SELECT l_orderkey, sum({PRICE}) AS mid FROM {d.table('lineitem')} GROUP BY l_orderkey),
score AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '전체' ELSE '부분' END AS scope, o_orderkey % 5 = 0 AS flagged, o_orderpriority AS trade, mid, truth, mid IS NULL AS failed, cast(mid - truth as double) / truth AS err,
  10 * truth BETWEEN 8 * mid AND 13 * mid AS hit, 20 * truth BETWEEN 17 * mid AND 23 * mid AS hit_common FROM (SELECT *, cast(round(o_totalprice * 100) as bigint) AS truth FROM {d.table('orders')}) o LEFT JOIN s ON o_orderkey = l_orderkey WHERE truth > 0)"""


def record_scores(d):
    return f"WITH {scored(d)} SELECT id, scope, failed, round(err, 6) AS err, CASE WHEN failed THEN false ELSE hit END AS hit, CASE WHEN failed THEN false ELSE hit_common END AS hit_common FROM score"


def grouped_summary(d):
    """Scores by overlapping groups (all, full, partial, unflagged, each trade): failures miss, but have no error."""
    groups = " UNION ALL ".join(f"SELECT '{n}' AS part, score.* FROM score WHERE {w}" for n, w in (("all", "true"), ("full", "scope = '전체'"), ("partial", "scope = '부분'"), ("unflagged", "NOT flagged")))
    n = lambda test: f"cast(sum(CASE WHEN {test} THEN 1 ELSE 0 END) as bigint)"
    return f"""WITH {scored(d)}, g AS ({groups} UNION ALL SELECT concat('trade ', trade), score.* FROM score), p AS ({percentiles(d, '(SELECT part, abs(err) AS e FROM g) y', 'part', 'e', mid_error=0.5)})
SELECT g.part, count(err) AS n, {n('failed')} AS failures, round(max(mid_error), 6) AS median_error, {n('err > 0')} AS n_over, {n('err < 0')} AS n_under, round(cast({n('hit AND NOT failed')} as double) / count(*), 6) AS hit_rate,
  round(cast({n('hit_common AND NOT failed')} as double) / count(*), 6) AS common_hit_rate FROM g LEFT JOIN p ON g.part = p.part GROUP BY g.part"""


def trade_ratios(d):
    """Predicted by actual amounts, by trade: median and mean error of those with five or more, and which are under 0.85 or over 1.15."""
    rows = "(SELECT trade, cast(mid as double) / truth AS ratio FROM score WHERE mid IS NOT NULL) y"
    return f"""WITH {scored(d)}, p AS ({percentiles(d, rows, 'trade', 'ratio', mid_ratio=0.5)}), m AS (SELECT trade, count(*) AS n, avg(abs(ratio - 1)) AS mape FROM {rows} GROUP BY trade)
SELECT m.trade, n, round(mid_ratio, 6) AS median_ratio, round(mape, 6) AS mape, CASE WHEN mid_ratio < 0.85 THEN 'low' WHEN mid_ratio > 1.15 THEN 'high' ELSE 'fair' END AS verdict FROM m JOIN p ON m.trade = p.trade WHERE n >= 5"""


def worst_errors(d):
    """The ten records with the largest absolute error."""
    return f"WITH {scored(d)} SELECT id, round(err, 6) AS err, place FROM (SELECT id, err, row_number() OVER (ORDER BY abs(err) DESC, id) AS place FROM score WHERE err IS NOT NULL) z WHERE place <= 10"


def parse_metrics(d):
    """Lines and sums of each quote without subtotals, and the total: of each image's chunks the largest, summed over images."""
    return f"""WITH {items(d)}, n AS (SELECT article_id, count(*) AS n_lines, sum(amount) AS amount FROM item WHERE description NOT LIKE '소계%' GROUP BY article_id),
t AS (SELECT article_id, sum(most) AS total FROM (SELECT article_id, pos % 2 AS image, max(amount) AS most FROM item GROUP BY article_id, pos % 2) z GROUP BY article_id)
SELECT n.article_id, n_lines, cast(amount as bigint) AS amount_sum, cast(total as bigint) AS total_cost FROM n JOIN t ON n.article_id = t.article_id"""


def tolerance_judgement(d):
    """Is the candidate runs' median within the base runs' range, widened by a tenth of their median; by event type, odd users as base."""
    side = lambda k: f"(SELECT event_type, value FROM {d.table('events')} WHERE user_id % 2 = {k} AND value IS NOT NULL) y"
    return f"""WITH b AS ({percentiles(d, side(1), 'event_type', 'value', mid=0.5)}), e AS (SELECT event_type, min(value) AS least, max(value) AS most FROM {side(1)} GROUP BY event_type), c AS ({percentiles(d, side(0), 'event_type', 'value', cand=0.5)})
SELECT b.event_type, round(least(least, mid * 0.9), 6) AS low, round(greatest(most, mid * 1.1), 6) AS high, round(cand, 6) AS candidate, cand BETWEEN least(least, mid * 0.9) AND greatest(most, mid * 1.1) AS ok FROM b JOIN e ON b.event_type = e.event_type LEFT JOIN c ON b.event_type = c.event_type"""


def graded_runs(d):
    """Runs against a truth of (code, amount) pairs, equal pairs used one by one: correct, missing, accuracy; by case its median."""
    side = lambda flag: f"SELECT l_orderkey % 50 AS case_id, l_partkey % 40 AS code, {PRICE} % 7 AS amount, row_number() OVER (PARTITION BY l_orderkey % 50, l_partkey % 40, {PRICE} % 7 ORDER BY {LINE_ORDER}, l_orderkey) AS i FROM {d.table('lineitem')} WHERE l_returnflag = '{flag}'"
    return f"""WITH t AS ({side('A')}), r AS ({side('N')}), m AS (SELECT t.case_id, t.code, t.amount, r.code IS NOT NULL AS correct FROM t LEFT JOIN r ON t.case_id = r.case_id AND t.code = r.code AND t.amount = r.amount AND t.i = r.i)
SELECT case_id, count(*) AS total, cast(sum(CASE WHEN correct THEN 1 ELSE 0 END) as bigint) AS n_correct, cast(sum(CASE WHEN correct THEN 0 ELSE 1 END) as bigint) AS missing, round(cast(sum(CASE WHEN correct THEN 1 ELSE 0 END) as double) / count(*), 6) AS accuracy FROM m GROUP BY case_id"""


def server_medians(d):
    """Medians of three inner times of the requests of a level, to three places."""
    rows = f"(SELECT user_id % 4 AS level, value AS a, value * 0.4 AS b, value * 1.7 AS c FROM {d.table('events')} WHERE value IS NOT NULL) y"
    one = lambda c: percentiles(d, rows, "level", c, **{f"p_{c}": 0.5})
    r3 = "cast(floor({} * 1000 + 0.5) as double) / 1000".format
    return f"WITH pa AS ({one('a')}), pb AS ({one('b')}), pc AS ({one('c')}) SELECT pa.level, {r3('p_a')} AS parse_s, {r3('p_b')} AS price_s, {r3('p_c')} AS total_s FROM pa JOIN pb ON pa.level = pb.level JOIN pc ON pa.level = pc.level"


def threshold_results(d):
    """Thresholds of metrics by the scenario in their name; a test passes where its threshold was not crossed."""
    name = "concat('http_req[scenario:s', cast(user_id % 6 as varchar(9)), ']')"
    return f"""SELECT {d.found('metric', 'scenario:([^]]+)', 1)} AS scenario, metric, NOT max(crossed) AS passed FROM (SELECT {name} AS metric, value > 19 AS crossed FROM {d.table('events')} WHERE value IS NOT NULL) z GROUP BY metric"""


def repetition_scores(d):
    """Findings of each repetition; an answer that cannot be read counts as none found, and as failed."""
    return f"""WITH rep AS (SELECT DISTINCT user_id, user_id % 4 = 3 AS unreadable FROM {d.table('events')}), f AS (SELECT user_id, count(*) AS n FROM {d.table('events')} WHERE event_type = 'error' GROUP BY user_id)
SELECT rep.user_id % 10 AS model, count(*) AS reps, cast(sum(CASE WHEN unreadable THEN 1 ELSE 0 END) as bigint) AS failed, cast(sum(CASE WHEN unreadable THEN 0 ELSE coalesce(n, 0) END) as bigint) AS found FROM rep LEFT JOIN f ON rep.user_id = f.user_id GROUP BY rep.user_id % 10"""


def retry_costs(d):
    """Calls with a retry: time and tokens of both, the result of the last."""
    return f"""SELECT conv_id, count(*) AS calls, cast(sum(length(text)) as bigint) AS tokens, max_by({d.sha('text')}, turn) AS result FROM {d.table('conversations')} WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id"""


def request_events(d):
    """Events of each request: how many, when the first came, and how long after the request began its last call ended."""
    e = d.table("events")
    return f"""WITH r AS (SELECT user_id, min({d.seconds('ts')}) AS began FROM {e} GROUP BY user_id) SELECT r.user_id, count(*) AS n, cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) as bigint) AS errors,
  max({d.seconds('ts')} - cast(floor(coalesce(value, 0)) as bigint) - began) AS last_offset FROM {e} x JOIN r ON x.user_id = r.user_id GROUP BY r.user_id"""


def window_events(d):
    """Events inside each load test's time window; windows are days, so events meet them by the day and not all by all."""
    day = d.div(d.seconds("ts"), "86400")
    return f"""WITH w AS (SELECT {day} AS day, min({d.seconds('ts')}) + 3600 AS began, max({d.seconds('ts')}) - 3600 AS ended FROM {d.table('events')} GROUP BY {day})
SELECT w.day, began, ended, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM (SELECT e.*, {day} AS day, {d.seconds('ts')} AS at_s FROM {d.table('events')} e) e JOIN w ON e.day = w.day AND e.at_s BETWEEN began AND ended GROUP BY w.day, began, ended"""


def section_matches(d):
    """Written sections to groups of lines: equal sums first, each used once, then what is left in order."""
    return f"""WITH g AS (SELECT o_custkey, l_orderkey AS group_id, sum({PRICE}) % 50 AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS pos FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey),
s AS (SELECT o_custkey, o_orderkey AS section_id, cast(floor(o_totalprice) as bigint) % 50 AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM {d.table('orders')}),
gn AS (SELECT g.*, row_number() OVER (PARTITION BY o_custkey, amount ORDER BY pos) AS i FROM g), sn AS (SELECT s.*, row_number() OVER (PARTITION BY o_custkey, amount ORDER BY pos) AS i FROM s),
m AS (SELECT sn.o_custkey, section_id, group_id FROM sn JOIN gn ON sn.o_custkey = gn.o_custkey AND sn.amount = gn.amount AND sn.i = gn.i),
gr AS (SELECT g.o_custkey, g.group_id, row_number() OVER (PARTITION BY g.o_custkey ORDER BY pos) AS i FROM g LEFT JOIN m ON g.group_id = m.group_id WHERE m.group_id IS NULL),
sr AS (SELECT s.o_custkey, s.section_id, row_number() OVER (PARTITION BY s.o_custkey ORDER BY pos) AS i FROM s LEFT JOIN m ON s.section_id = m.section_id WHERE m.section_id IS NULL)
SELECT section_id, group_id, true AS by_sum FROM m UNION ALL SELECT sr.section_id, gr.group_id, false FROM sr LEFT JOIN gr ON sr.o_custkey = gr.o_custkey AND sr.i = gr.i"""


def size_bands(d):
    """Both bandings of sizes."""
    return f"SELECT p_partkey, {pick('CASE WHEN p_size < 20 THEN 0 WHEN p_size < 30 THEN 1 WHEN p_size < 40 THEN 2 ELSE 3 END', ['0-20', '20-30', '30-40', '40+'])} AS four, CASE WHEN p_size < 30 THEN '<30' WHEN p_size < 40 THEN '<40' ELSE '40+' END AS three FROM {d.table('part')}"


def truth_checks(d):
    """Consistency of truths: parts that don't sum to the direct cost, direct cost above the total, empty quotes."""
    return f"""WITH s AS (SELECT l_orderkey, l_returnflag, sum({PRICE}) AS part FROM {d.table('lineitem')} GROUP BY l_orderkey, l_returnflag), t AS (SELECT l_orderkey, sum(part) AS direct, count(*) AS parts FROM s GROUP BY l_orderkey)
SELECT o_orderkey, t.l_orderkey IS NULL AS no_lines, coalesce(100 * direct > 102 * cast(round(o_totalprice * 100) as bigint), false) AS direct_exceeds, coalesce(parts, 0) AS parts, coalesce(cast(round(o_totalprice * 100) as bigint) - direct < 0, false) AS negative_indirect FROM {d.table('orders')} LEFT JOIN t ON o_orderkey = t.l_orderkey"""


PLANS = (
    record_scores, grouped_summary, trade_ratios, worst_errors, parse_metrics, tolerance_judgement, graded_runs, server_medians, threshold_results, repetition_scores,
    retry_costs, request_events, window_events, section_matches, size_bands, truth_checks,
)
