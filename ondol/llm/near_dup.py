"""Near-duplicate groups by a parity-sketch join on word shingles.

A text's set holds the distinct k-word shingles (fewer words: the whole as one), as 64-bit hashes.
Two texts link when their sets' Jaccard similarity is at least t; then their symmetric difference
has at most d = (1-t)/(1+t) * (|A|+|B|) elements.

Sketch.  Every element toggles (XOR) one bit of a wide parity sketch, so that the Hamming distance
of two sketches never exceeds the symmetric difference.  The sketch is kept sparse and by bands:
band j holds the parity of the elements that hash to it, and is represented by the XOR of the
64-bit codes of its set bits.  With d differing elements at least m - d of m bands are equal
(pigeonhole).  Of its m bands a text emits the d + 1 fullest: of the bands that two linked texts
have in common the fullest is emitted by both, as equal bands are equally full.  Empty and nearly
empty bands, which would be equal by chance, are those left out.

Size bands.  Sizes are dealt into bands that grow by 1/t; d and m are fixed by the band, and a text
emits into its own band and the next, so every linked pair meets in the band of its larger text.

Every set also has a dense sketch of 512 bits, whose Hamming distance bounds the symmetric difference
from below too; it is compared before any text is.

Join.  Texts with equal sets are collapsed first, by grouped minimum, so thousands of copies are one
representative.  Representatives that share a band key form a bucket; within it only pairs with the
bucket's first are verified, on the texts themselves; what links is one component and needs no
further pairs.  Only buckets that still span components go on: once more with their most central
member (the one with the fullest buckets) as pivot, and in the end across components, where the join
itself compares the dense sketches, so that only pairs of different components under the bound leave
it, and members of a bucket's largest component are not compared with each other.  Components of later
links are found between the roots of the earlier ones.  So no link that joins components is lost, and
no bucket emits all its pairs.  Since a text emits d + 1 distinct keys, one key can hold at most one
row per text.  A key that k texts share of which none link costs k^2 comparisons of sketches.

Nulls and odd inputs: a null or wordless text has an empty set and links with nothing; rows that
repeat an id are separate texts, fetched by id and a hash of the text; component_id is the smallest non-null id of the component; an empty
table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U, discard, mixed, pieces, temporary, text_buffer, words_of, write_out

BITS = [f"b{i}" for i in range(8)]
SPARE = 0.3  # bands beyond d + 1, as a share of d + 1


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes by text, first of each text and the end)."""
    h, _, at = words_of(*text_buffer(batch.column("text")))
    size = np.diff(at)
    n = np.where(size == 0, 0, np.maximum(size - k + 1, 1))
    total = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(at[:-1] - total[:-1], n) + np.arange(total[-1])
    doc = np.repeat(np.arange(len(size)), n)
    code = np.zeros(len(start), np.uint64)
    stop = at[1:][doc]
    for i in range(k):
        at_i = np.minimum(start + i, len(h) - 1)
        word = np.where(start + i < stop, h[at_i] if len(h) else U(0), U(0))
        code = mixed(code * U(3) + word + U(i))
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[new], doc[new]
    return code, np.searchsorted(doc, np.arange(len(size) + 1))


def size_band(n: np.ndarray, t: float) -> np.ndarray:
    """Band b holds the sizes s with floor(log(s) / log(1/t)) = b; sizes a >= t * b differ by at most one band."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1 / t) + 1e-9).astype(np.int64)


def most_different(band: np.ndarray, t: float) -> np.ndarray:
    """Largest symmetric difference of linked sets of which the larger is in the band."""
    largest = np.ceil((1 / t) ** (band + 1.0))
    return np.floor((1 - t) / (1 + t) * 2 * largest + 1e-9).astype(np.int64)


def band_keys(code: np.ndarray, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) rows: the fullest d + 1 bands of each text, for its size band and the next."""
    size = np.diff(at)
    keys, owner = [], []
    for step in (0, 1):
        band = size_band(size, t) + step
        d = most_different(band, t)
        m = d + 1 + np.ceil(SPARE * (d + 1)).astype(np.int64)
        m[(size == 0) | (d == 0)] = 0  # no difference allowed: equal sets only, and those are collapsed
        base = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(size)), size)
        in_band = (m > 0)[doc]
        doc, code_ = doc[in_band], code[in_band]
        place = base[:-1][doc] + (mixed(code_ + U(0x51ED)) >> U(11)).astype(np.int64) % m[doc]
        order = np.argsort(place, kind="stable")
        filled, first, full = np.unique(place[order], return_index=True, return_counts=True)
        parity = np.zeros(base[-1], np.uint64)
        parity[filled] = np.bitwise_xor.reduceat(mixed(code_[order] ^ U(0x7F4A7C15)), first) if len(first) else 0
        fullness = np.zeros(base[-1], np.int64)
        fullness[filled] = full
        text = np.repeat(np.arange(len(size)), m)
        number = np.arange(base[-1]) - base[:-1][text]
        rank = np.lexsort((number, -fullness, text))
        emit = rank[(np.arange(base[-1]) - base[:-1][text]) <= d[text]]
        keys.append(mixed(mixed(parity[emit]) + mixed((band[text[emit]] << 24).astype(np.uint64) + number[emit].astype(np.uint64))))
        owner.append(text[emit])
    return np.concatenate(owner), np.concatenate(keys)


def sketches(docs: DataFrame, k: int, t: float) -> DataFrame:
    """(id, body, n, set1, keys) and the dense sketch of every text; set1 names the set, body the text."""

    def sketch(batches):
        for b in pieces(batches):
            code, at = shingle_sets(b, k)
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(mixed(code + U(1)), dtype=np.uint64, out=total[1:])
            owner, keys = band_keys(code, at, t)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(len(at)))
            flat = keys[order].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat))
            sums = pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            odd = np.bincount(doc * 512 + (mixed(code + U(3)) >> U(55)).astype(np.int64), minlength=512 * (len(at) - 1)).astype(np.uint8) & 1
            dense = np.packbits(odd).view(np.int64).reshape(-1, len(BITS))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), pa.array(np.diff(at)), sums, lists, *(pa.array(dense[:, i]) for i in range(len(BITS)))], ["id", "body", "n", "set1", "keys", *BITS])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"id {kind}, body long, n long, set1 long, keys array<long>, " + ", ".join(f"{b} long" for b in BITS))


def close(x: str, y: str, t: float):
    """Whether the dense sketches of x and y allow a link."""
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))
    return apart <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - t) / (1 + t)) + 1e-6


def allowed(pairs: DataFrame, shapes: DataFrame, t: float) -> DataFrame:
    """Those (a, b) of pairs whose dense sketches allow a link."""
    x, y = shapes.alias("x"), shapes.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.set1")).join(y, (F.col("b") == F.col("y.set1")) & close("x", "y", t)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, k: int, t: float) -> DataFrame:
    """Those (a, b) of pairs whose texts link."""

    def judge(batches):
        for batch in batches:
            for b in pieces([batch], text="x"):
                keep = []
                for s in (b.column("x"), b.column("y")):
                    keep.append(shingle_sets(pa.RecordBatch.from_arrays([s], ["text"]), k))
                (ca, aa), (cb, ab) = keep
                ok = []
                for i in range(b.num_rows):
                    x, y = ca[aa[i] : aa[i + 1]], cb[ab[i] : ab[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(len(x) > 0 and 100 * both >= round(100 * t) * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(texts.select(F.col("set1").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("set1").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link; by label jumping until nothing moves."""
    edges = write_out(links.select("a", "b").union(links.select("b", "a")).distinct(), "dup-edges")
    label = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
    written = write_out(label, "dup-label")
    while True:
        label = written.select("node", "root")
        near = edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = label.join(near, "node").select("node", F.least("root", "low").alias("up"), F.col("root").alias("old"))
        roots = label.select(F.col("node").alias("up"), F.col("root").alias("far"))
        jumped = hooked.join(roots, "up", "left").select("node", F.least("up", F.coalesce("far", "up")).alias("root"), "old")
        before, written = written, write_out(jumped, "dup-label")
        discard(before)
        if written.where("root != old").isEmpty():
            discard(edges)
            return written


def spanning(named: DataFrame) -> DataFrame:
    """The rows (key, set1, root) of the buckets that hold several roots."""
    bucket = Window.partitionBy("key")
    both = named.select("key", "set1", "root", F.min("root").over(bucket).alias("lo"), F.max("root").over(bucket).alias("hi"))
    return both.where("lo != hi").select("key", "set1", "root")


def renamed(table: DataFrame, step: DataFrame) -> DataFrame:
    """table with its roots replaced by those that step gives them."""
    far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return table.join(far, "root", "left").select(*(F.coalesce("far", "root").alias(c) if c == "root" else F.col(c) for c in table.columns))


def through_pivot(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's most central member with those of other roots."""
    sizes = open_.groupBy("key").agg(F.count("*").alias("size"))
    central = open_.join(sizes, "key").groupBy("set1").agg(F.sum("size").alias("weight"))
    pivot = open_.join(central, "set1").groupBy("key").agg(F.max(F.struct("weight", "set1", "root")).alias("p"))
    apart = open_.join(pivot, "key").where(F.col("root") != F.col("p.root"))
    return apart.select(F.least("set1", "p.set1").alias("a"), F.greatest("set1", "p.set1").alias("b")).distinct()


def across(open_: DataFrame, shapes: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of different roots in a bucket whose dense sketches allow a link; members of a bucket's largest root don't meet each other."""
    of_root = open_.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = of_root.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m")).select("key", F.col("m.root").alias("major"))
    shaped = open_.join(largest, "key").join(shapes, "set1")
    x, y = shaped.where("root != major").alias("x"), shaped.alias("y")
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.set1") < F.col("y.set1"))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & close("x", "y", t)
    return x.join(y, met).select(F.least("x.set1", "y.set1").alias("a"), F.greatest("x.set1", "y.set1").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per text: id, n_shingles, component_id, body (hash of the text), leader (id and body of the component's first row)."""
    t = similarity
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    each = write_out(sketches(rows, k, t), "dup-sets")  # a set is named by set1
    full = each.where("n > 0")
    keyed = full.groupBy("set1").agg(F.min("keys").alias("keys")).select("set1", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key").orderBy("set1")
    first = F.first("set1").over(bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = keyed.select("key", "set1", first.alias("first"), F.lead("set1").over(bucket).alias("after"))
    shared = write_out(ranked.where(F.col("after").isNotNull() | (F.col("first") != F.col("set1"))).select("key", "set1", "first"), "dup-buckets")
    members = shared.select("set1").distinct()
    leader = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "body", "n", *BITS))
    chosen = full.groupBy("set1").agg(leader.alias("r")).join(members, "set1", "left_semi")
    chosen = write_out(chosen.select("set1", "r.*"), "dup-chosen")
    shapes = chosen.select("set1", "n", *BITS)
    wanted = chosen.select("set1", F.col("id").alias("key_id"), F.col("body").alias("key_body")).hint("merge")
    own = rows["id"].eqNullSafe(wanted["key_id"]) & (rows["body"] == wanted["key_body"])
    texts = write_out(rows.join(wanted, own).select("set1", "text").dropDuplicates(["set1"]), "dup-texts")

    def check(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("set1")).union(pairs.select("b")).distinct()
        return write_out(verified(pairs, texts.join(needed, "set1", "left_semi"), k, t), "dup-links")

    tested = shared.where("first != set1").select(F.col("first").alias("a"), F.col("set1").alias("b")).distinct()
    tested = write_out(allowed(tested, shapes, t), "dup-pairs")
    links = check(tested)
    label = components(links)
    named = shared.join(label.select(F.col("node").alias("set1"), "root"), "set1", "left").select("key", "set1", F.coalesce("root", "set1").alias("root"))
    open_ = write_out(spanning(named), "dup-open")
    discard(links)
    checked = [tested]
    for last in (False, True):
        fresh = across(open_, shapes, t) if last else allowed(through_pivot(open_), shapes, t)
        for before in checked:
            fresh = fresh.join(before, ["a", "b"], "left_anti")
        fresh = write_out(fresh, "dup-pairs")
        checked.append(fresh)
        links = check(fresh)
        root = label.select(F.col("node").alias("set1"), "root")
        ends = [links.join(root.toDF(end, f"root_{end}"), end, "left").select("a", "b", F.coalesce(f"root_{end}", end).alias(end + end)) for end in "ab"]
        step = components(ends[0].join(ends[1], ["a", "b"]).select(F.col("aa").alias("a"), F.col("bb").alias("b")).where("a != b"))
        grown = renamed(label, step).select("node", "root").union(step.join(label, "node", "left_anti").select("node", "root"))
        before, label = label, write_out(grown, "dup-label")
        if not last:
            closed, open_ = open_, write_out(spanning(renamed(open_, step)), "dup-open")
            discard(closed)
        discard(before, step, links)
    root = label.select(F.col("node").alias("set1"), "root")
    lows = full.groupBy("set1").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "body")).alias("low"))
    named = lows.join(root, "set1", "left").select("set1", "low", F.coalesce("root", "set1").alias("root"))
    final = named.join(named.groupBy("root").agg(F.min("low").alias("leader")), "root").select("set1", "leader")
    alone = F.col("n") == 0
    out = each.join(final, "set1", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("leader.id")).alias("component_id"),
        "body",
        F.when(~alone, F.struct("leader.id", "leader.body")).alias("leader"),
    )
    out = write_out(out, "dup-result")
    discard(each, shared, chosen, texts, open_, label, *checked)
    return out


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, k=4, similarity=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near duplicates one row stays, that with the smallest id and text hash.

    Five-word shingles, similarity 0.8.  Rows are told apart by id and text; of rows equal in both one stays.  A null id
    sorts last; a text without words stays.
    """
    found = near_duplicates(docs, k=5, similarity=0.8).where("leader IS NOT NULL")
    mine = F.struct("id", "body").eqNullSafe(F.col("leader"))
    fate = found.groupBy("id", "body").agg(F.count("*").alias("rows"), F.first(mine).alias("leads")).where("rows > 1 OR NOT leads")
    keys = [temporary(docs, name) for name in ("fate_id", "fate_body", "fate_leads")]
    fate = fate.select(*(F.col(c).alias(k) for c, k in zip(("id", "body", "leads"), keys)))
    same = F.col("doc_id").eqNullSafe(F.col(keys[0])) & (F.xxhash64("text") == F.col(keys[1]))
    judged = docs.join(fate, same, "left")
    rest = judged.where(F.col(keys[2]).isNull()).select(docs.columns)
    return rest.union(judged.where(keys[2]).dropDuplicates(keys[:2]).select(docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
