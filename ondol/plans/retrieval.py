"""Plans of retrieval: every query row (id divisible by 20) against all rows, with the query's id in the result.

Vector searches cross the stated query set with all rows; in Spark by blocks (`vectors`), of which only
the best of each query travel.
"""

from __future__ import annotations

MOST = 15  # results of a query in the end
POOL = 40  # candidates of a query before fusion
EVERY = 20  # every twentieth row is a query


def vector_hits(d, k: int, keep: str = "true") -> str:
    """Rows (query_id, vec_id, label, similarity) of every query with all other rows that `keep` allows; in Spark with those that can be among its k best."""
    if d.__name__ == "Spark":
        return f"SELECT * FROM {d.table(f'hits_{k}' + ('_other' if keep != 'true' else ''))}"
    e = d.table("embeddings")
    return f"""SELECT query_id, vec_id, label, round({d.cosine('embedding', 'qv')}, 6) AS similarity
  FROM {e} CROSS JOIN (SELECT vec_id AS query_id, label AS ql, embedding AS qv FROM {e} WHERE vec_id % {EVERY} = 0) q WHERE vec_id <> query_id AND {keep}"""


def nearest(hits: str, k: int, score: str = "similarity", row: str = "vec_id") -> str:
    return f"""SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {row}) AS place FROM ({hits}) h) p WHERE place <= {k}"""


def vector_topk(d):
    return f"SELECT query_id, vec_id, similarity, place FROM ({nearest(vector_hits(d, MOST), MOST)}) t"


def leave_out_topk(d):
    """Rows of the query's own label leave before the limit."""
    return f"SELECT query_id, vec_id, label, similarity FROM ({nearest(vector_hits(d, MOST, 'label <> ql'), MOST)}) t"


def vector_topk_postfilter(d):
    """The filter comes after the 150 nearest, so fewer than asked for may be left."""
    kept = f"SELECT query_id, vec_id, label, similarity FROM ({nearest(vector_hits(d, 150), 150)}) t WHERE label <> 1"
    return f"SELECT query_id, vec_id, label, similarity FROM ({nearest(kept, MOST)}) u"


def bm25_scores(d, k1="1.5", b="0.75", epsilon="0.25"):
    """bm (query_id, doc_id, score): BM25Okapi with its floor for negative idf, over all documents, for every query item.

    Lengths stay with their text; document frequencies are counted before the shuffle; only the words of queries become
    postings, so more queries add little.
    """
    doc, item = d.table("documents"), d.table("benchmark")
    return f"""w AS (SELECT doc_id, {d.words('text')} AS words FROM {doc} WHERE text IS NOT NULL),
al AS (SELECT count(*) AS docs FROM {doc}), av AS (SELECT sum({d.size('words')}) / max(docs) AS avg_len FROM w CROSS JOIN al),
df AS (SELECT t, count(*) AS held FROM (SELECT {d.explode(d.distinct('words'))} AS t FROM w) z GROUP BY t),
raw AS (SELECT t, ln((docs - held + 0.5) / (held + 0.5)) AS raw FROM df CROSS JOIN al), fl AS (SELECT {epsilon} * avg(raw) AS least FROM raw),
q AS (SELECT query_id, t, count(*) AS qf FROM (SELECT item_id AS query_id, {d.explode(d.words('text'))} AS t FROM {item} WHERE item_id % {EVERY} = 0) z GROUP BY query_id, t),
asked AS (SELECT DISTINCT t FROM q), idf AS (SELECT raw.t, CASE WHEN raw < 0 THEN least ELSE raw END AS idf FROM raw JOIN asked ON raw.t = asked.t CROSS JOIN fl),
post AS (SELECT doc_id, n, x.t, count(*) AS f FROM (SELECT doc_id, {d.size('words')} AS n, {d.explode('words')} AS t FROM w) x JOIN asked ON x.t = asked.t GROUP BY doc_id, n, x.t),
bm AS (SELECT query_id, doc_id, round(sum(qf * idf * f * ({k1} + 1) / (f + {k1} * (1 - {b} + {b} * n / avg_len))), 6) AS score
  FROM post JOIN q ON post.t = q.t JOIN idf ON post.t = idf.t CROSS JOIN av GROUP BY query_id, doc_id)"""


def lexical(k: int) -> str:
    return nearest("SELECT * FROM bm", k, "score", "doc_id")


def bm25_topk(d):
    return f"WITH {bm25_scores(d)} SELECT query_id, doc_id, score, place FROM ({lexical(20)}) t"


def pool_hits(d) -> str:
    """The vector list of each query; Spark writes it once, as a fusion reads it more than once."""
    return nearest(vector_hits(d, POOL), POOL)


def pool_words(d) -> str:
    """The list by words of each query, written once like the vectors' one."""
    return f"WITH {bm25_scores(d)} {lexical(POOL)}"


def fused(d) -> str:
    """Rank fusion, sum of 1 / (60 + rank), of the two lists of each query; ties keep the order of vectors."""
    pool = f"SELECT * FROM {d.table('pool_hits')}" if d.__name__ == "Spark" else pool_hits(d)
    words = f"lex AS (SELECT * FROM {d.table('pool_words')})" if d.__name__ == "Spark" else f"{bm25_scores(d)}, lex AS ({lexical(POOL)})"
    return f"""{words}, vec AS (SELECT query_id, vec_id AS doc_id, place FROM ({pool}) t),
a AS (SELECT query_id, doc_id, place, place AS vec_place FROM vec UNION ALL SELECT query_id, doc_id, place, NULL FROM lex WHERE query_id IN (SELECT query_id FROM vec)),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + place)), 9) AS score, max(vec_place) AS vec_place FROM a GROUP BY query_id, doc_id)"""


def rrf_fusion(d):
    return f"WITH {fused(d)} SELECT query_id, doc_id, score, vec_place FROM f"


def rerank_chain(d):
    """40 candidates, fused to 20, of which the first 15 stay."""
    order = "ORDER BY score DESC, coalesce(vec_place, 1000000), doc_id"
    return f"WITH {fused(d)} SELECT query_id, doc_id, score, place FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id {order}) AS place FROM f) z WHERE place <= 20 AND place <= {MOST}"


def judged(d, k: int) -> str:
    """The k best of each query with their labels, null where there is none."""
    return f"""{bm25_scores(d)}, top AS ({lexical(k)}), l AS (SELECT doc_id, max(quality) AS quality FROM {d.table('labels')} GROUP BY doc_id),
j AS (SELECT top.query_id, top.doc_id, top.place, quality FROM top LEFT JOIN l ON top.doc_id = l.doc_id)"""


def precision_at_k(d):
    """By query: relevant share of the first 20, and what of it nobody labelled."""
    return f"""WITH {judged(d, 20)} SELECT query_id, count(*) AS returned, count(quality) AS labelled, cast(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) as bigint) AS relevant,
  round(cast(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) as double) / count(*), 6) AS precision_at_k FROM j GROUP BY query_id"""


def pool_recall(d):
    """By query: relevant rows of the pool of 200 that are among the first 50; 0 where the pool holds none."""
    return f"""WITH {judged(d, 200)}, r AS (SELECT query_id, count(*) AS pooled, cast(sum(CASE WHEN place <= 50 AND quality = 1 THEN 1 ELSE 0 END) as bigint) AS hits,
  cast(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) as bigint) AS relevant FROM j GROUP BY query_id)
SELECT query_id, pooled, hits, relevant, CASE WHEN relevant = 0 THEN 0 ELSE round(cast(hits as double) / relevant, 6) END AS recall FROM r"""


def precision_summary(d):
    """Over all queries: micro precision (of all results), macro precision (mean of queries), labelled share and queries without any label."""
    return f"""WITH {judged(d, 20)}, r AS (SELECT query_id, count(*) AS n, count(quality) AS labelled, cast(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) as double) AS hits FROM j GROUP BY query_id)
SELECT count(*) AS queries, round(sum(hits) / sum(n), 6) AS micro, round(avg(hits / n), 6) AS macro, round(cast(sum(labelled) as double) / sum(n), 6) AS coverage,
  cast(sum(CASE WHEN labelled = 0 THEN 1 ELSE 0 END) as bigint) AS unjudged FROM r"""


def rank_ablation(d):
    """By query: of the 15 best by words and the 15 best by fusion, how many are the same."""
    order = "ORDER BY score DESC, coalesce(vec_place, 1000000), doc_id"
    return f"""WITH {fused(d)}, b AS (SELECT query_id, doc_id FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id {order}) AS place FROM f) z WHERE place <= {MOST}),
base AS (SELECT query_id, doc_id FROM vec WHERE place <= {MOST})
SELECT a.query_id, count(*) AS n, count(b.doc_id) AS same, count(*) = count(b.doc_id) AS identical FROM base a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id
WHERE a.query_id IN (SELECT query_id FROM lex) GROUP BY a.query_id"""


def stage_of_cell(d) -> str:
    """k (p_type, p_brand, p_size, stage, n_found): stages are settled on cells, so counts are joined and not parts."""
    return f"""c AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM {d.table('part')} GROUP BY p_type, p_brand, p_size),
t AS (SELECT p_type, p_size, sum(n) AS n FROM c GROUP BY p_type, p_size),
s1 AS (SELECT a.p_type, a.p_brand, a.p_size, sum(b.n) - 1 AS n1 FROM c a JOIN c b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 6 GROUP BY a.p_type, a.p_brand, a.p_size),
s2 AS (SELECT a.p_type, a.p_size, sum(b.n) - 1 AS n2 FROM t a JOIN t b ON a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 6 GROUP BY a.p_type, a.p_size),
s3 AS (SELECT p_type, sum(n) - 1 AS n3 FROM t GROUP BY p_type), s4 AS (SELECT sum(n) - 1 AS n4 FROM t),
k AS (SELECT p_type, p_brand, p_size, CASE WHEN n1 >= 3 THEN 1 WHEN n2 >= 3 THEN 2 WHEN n3 >= 3 THEN 3 ELSE 4 END AS stage,
  cast(CASE WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 WHEN n3 >= 3 THEN n3 ELSE n4 END as bigint) AS n_found FROM s1 JOIN s2 USING (p_type, p_size) JOIN s3 USING (p_type) CROSS JOIN s4)"""


def staged_retrieval(d):
    """The rows that each query part's first sufficient stage finds, nearest in size first, 40 at most.

    Stages: brand and type with size within 6; type with size; type; all; the first that finds 3 others.  Of a cell of equal
    keys no more than 41 rows can be among a query's 40, so cells are cut to those before queries meet them.
    """
    part = d.table("part")

    def cell(keys: str) -> str:
        return f"SELECT * FROM (SELECT p_partkey, p_type, p_brand, p_size, row_number() OVER (PARTITION BY {keys} ORDER BY p_partkey) AS i FROM {part}) z WHERE i <= {POOL + 1}"

    near = "abs(f.p_size - q.p_size) <= 6"
    stages = ((1, "p_type, p_brand, p_size", f"f.p_type = q.p_type AND f.p_brand = q.p_brand AND {near}"), (2, "p_type, p_size", f"f.p_type = q.p_type AND {near}"),
              (3, "p_type, p_size", "f.p_type = q.p_type"), (4, "p_size", "true"))
    met = " UNION ALL ".join(f"SELECT q.p_type, q.p_brand, q.p_size, f.p_partkey AS found, abs(f.p_size - q.p_size) AS gap FROM (SELECT * FROM qc WHERE stage = {s}) q JOIN ({cell(keys)}) f ON {on}" for s, keys, on in stages)
    return f"""WITH {stage_of_cell(d)}, q AS (SELECT p_partkey AS query_id, p_type, p_brand, p_size, stage, n_found FROM {part} JOIN k USING (p_type, p_brand, p_size) WHERE p_partkey % {EVERY} = 0),
qc AS (SELECT DISTINCT p_type, p_brand, p_size, stage FROM q),
m AS (SELECT * FROM (SELECT z.*, row_number() OVER (PARTITION BY p_type, p_brand, p_size ORDER BY gap, found) AS i FROM ({met}) z) y WHERE i <= {POOL + 1}),
r AS (SELECT query_id, stage, n_found, found, gap, row_number() OVER (PARTITION BY query_id ORDER BY gap, found) AS place FROM q JOIN m USING (p_type, p_brand, p_size) WHERE found <> query_id)
SELECT query_id, stage, n_found, place, found AS p_partkey, gap FROM r WHERE place <= {POOL}"""


def filter_pass_counts(d):
    """By query part: rows that meet its first stage's filter, and those that meet the stage it settles on."""
    return f"""WITH {stage_of_cell(d)} SELECT p_partkey AS query_id, stage, n_found, cast(n1 as bigint) AS n_first FROM {d.table('part')} JOIN k USING (p_type, p_brand, p_size) JOIN s1 USING (p_type, p_brand, p_size) WHERE p_partkey % {EVERY} = 0"""


def size_gap_histogram(d):
    """Pairs of query parts and other parts by gap in size, and how many are of one type; counted on cells."""
    return f"""WITH c AS (SELECT p_type, p_size, count(*) AS n, sum(CASE WHEN p_partkey % {EVERY} = 0 THEN 1 ELSE 0 END) AS nq FROM {d.table('part')} GROUP BY p_type, p_size),
s AS (SELECT p_size, sum(n) AS n, sum(nq) AS nq FROM c GROUP BY p_size), own AS (SELECT sum(nq) AS q FROM c),
a AS (SELECT abs(x.p_size - y.p_size) AS gap, sum(x.nq * y.n) AS n FROM s x CROSS JOIN s y GROUP BY abs(x.p_size - y.p_size)),
r AS (SELECT abs(x.p_size - y.p_size) AS gap, sum(x.nq * y.n) AS n FROM c x JOIN c y ON x.p_type = y.p_type GROUP BY abs(x.p_size - y.p_size))
SELECT a.gap, cast(a.n - CASE WHEN a.gap = 0 THEN q ELSE 0 END as bigint) AS n, cast(coalesce(r.n, 0) - CASE WHEN a.gap = 0 THEN q ELSE 0 END as bigint) AS relevant FROM a LEFT JOIN r ON a.gap = r.gap CROSS JOIN own"""


PLANS = (
    vector_topk, leave_out_topk, vector_topk_postfilter, bm25_topk, rrf_fusion, rerank_chain, precision_at_k, pool_recall, precision_summary, rank_ablation,
    staged_retrieval, filter_pass_counts, size_gap_histogram,
)
STORED = {"pool_hits": pool_hits, "pool_words": pool_words}
