"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped when an earlier line of the corpus, in the order (id, place in the text), is
equal to it or within one edit of it; an edit replaces, inserts or deletes one word.  Words are parted
by white space of any kind and length, which counts for nothing else.  A line without words is never
dropped; lines under near_words words only when equal.

1. Equal lines meet by a 128-bit hash of their words; the grouped minimum names the first.
2. One edit leaves either the first half or the rest untouched, so only distinct lines that share
   a half with another distinct line can have a near one; the others emit nothing further.
3. The remaining lines emit their whole deletion neighbourhood: the line without word i, for every
   i, as a hashed key.  The hash is an exclusive or of position-dependent word hashes, so running
   aggregates give all variants of a line in linear time.  Equal variants at the same place differ
   in that word alone: one grouped minimum finds the earliest of all of them.  A variant that equals
   a whole line differs by one insertion: each variant joins that one line.
4. Every (line, earliest partner) is verified word by word, and the later one is dropped.

No step pairs up the members of a group, and every hot key is pre-aggregated before its shuffle.

Nulls and odd inputs: a null text has no lines and stays null; a null id sorts first; rows that
repeat both id and text are dropped or kept alike, as neither precedes the other; empty tables give
empty results; a line of any length is compared whole; other columns pass through unchanged, but one
named like a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, temporary, write_out

NEAR_WORDS = 10


def lines_of(text_col: str) -> Column:
    """The lines of a text, as words with one space between."""
    text = F.col(text_col)
    odd = text.contains("  ")
    for c in "\t\v\f\r":
        odd = odd | text.contains(c)
    return F.transform(F.split(F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text), "\n"), lambda line: F.trim(line))


def words_of_line(line: Column) -> Column:
    return F.split(line, " ")


def half_keys(words: Column, n: Column) -> Column:
    """For the pair lengths n and n+1: the key of the first half and of the rest."""
    keys = []
    for longer in (n, n + 1):
        half = F.floor(longer / 2).cast("int")
        rest = (longer - half).cast("int")
        keys += [F.xxhash64(F.slice(words, F.lit(1), half), longer, F.lit("head")), F.xxhash64(F.slice(words, n - rest + 1, rest), longer, F.lit("tail"))]
    return F.array(*keys)


def numbered_lines(docs: DataFrame, id_col: str, text_col: str, near_words: int) -> DataFrame:
    """(id, row, pos, n, h1, h2, halves) of every line with a word; id and row name the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(lines_of(text_col)).alias("pos", "line"))
    words = F.col("words")
    n = F.size(words)
    named = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")  # two seeds, so 128 bits
    halves = F.when(n >= near_words, half_keys(words, n)).alias("halves")
    split = rows.where(F.col("line") != "").select("id", "row", "pos", "line", words_of_line(F.col("line")).alias("words"))
    return split.select("id", "row", "pos", n.alias("n"), *named, halves)


def same_but_one(x: Column, y: Column) -> Column:
    """True when at most one word is replaced, inserted or deleted between the arrays."""
    least = F.least(F.size(x), F.size(y))

    def common(a, b):
        at = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(at == 0, least).otherwise(F.least(at - 1, least))

    return common(x, y) + common(F.reverse(x), F.reverse(y)) >= F.greatest(F.size(x), F.size(y)) - 1


def near_dropped(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the distinct lines that come after a line within one edit."""
    halves = distinct.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a != z").select("half")
    able = halves.join(shared, "half").select("h1").distinct()
    able = distinct.join(able, "h1").select("h1", "h2", "first")
    at_text = able.groupBy(F.col("first.id").alias("at_id"), F.col("first.row").alias("at_row"))
    places = write_out(at_text.agg(F.collect_set(F.struct("first.pos", "first", "h1", "h2")).alias("places")), "line-places")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), lines_of(text_col).alias("lines"))
    same = F.col("id").eqNullSafe(F.col("at_id")) & (F.col("row") == F.col("at_row"))
    texts = own.join(places, same).select("lines", F.explode("places").alias("p"))
    able = write_out(
        texts.select("p.first", "p.h1", "p.h2", words_of_line(F.element_at("lines", F.col("p.pos") + 1)).alias("words")).dropDuplicates(["h1", "h2"]),
        "line-able",
    )
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = able.select("h1", "h2", "first", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    here, moved = F.xxhash64("w", "i"), F.xxhash64("w", F.col("i") - 1)
    word = word.select("h1", "h2", "first", "n", "i", here.alias("here"), moved.alias("moved"))
    running = word.withColumns(
        {"head": F.bit_xor("here").over(before), "past": F.bit_xor("moved").over(before), "all": F.bit_xor("here").over(line), "rest": F.bit_xor("moved").over(line)}
    )
    cut = running.select("h1", "h2", "first", "n", "i", "all", F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("rest")).bitwiseXOR(F.col("past")).alias("variant"))
    cut = write_out(cut, "line-variants")
    me = F.struct("first", "h1", "h2")
    earliest = cut.groupBy("variant", "i", "n").agg(F.min(me).alias("partner"))
    replaced = cut.join(earliest, ["variant", "i", "n"]).where(F.col("partner.first") < F.col("first")).select("h1", "h2", F.col("partner.h1").alias("g1"), F.col("partner.h2").alias("g2"))
    replaced = write_out(replaced, "line-replaced")
    whole = cut.where("i = 0").select(F.col("all").alias("variant"), (F.col("n") + 1).alias("n"), me.alias("short"))
    both = cut.select("variant", "n", me.alias("long")).join(whole, ["variant", "n"])
    later, sooner = F.greatest("long", "short"), F.least("long", "short")
    inserted = both.where(F.col("long.first") != F.col("short.first")).select(later["h1"].alias("h1"), later["h2"].alias("h2"), sooner["h1"].alias("g1"), sooner["h2"].alias("g2"))
    pairs = write_out(replaced.union(inserted).distinct(), "line-pairs")
    discard(cut, replaced, places)
    mine = able.select("h1", "h2", "words")
    theirs = able.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("other"))
    judged = pairs.join(mine, ["h1", "h2"]).join(theirs, ["g1", "g2"]).where(same_but_one(F.col("words"), F.col("other")))
    near = write_out(judged.select("h1", "h2").distinct(), "line-near")
    discard(pairs, able)
    return near


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """All columns of docs with the kept text, and _n_lines, _n_dropped."""
    lines = write_out(numbered_lines(docs, id_col, text_col, near_words), "lines")
    at = F.struct("id", "row", "pos")
    firsts = lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    distinct = write_out(firsts, "line-first")
    near = near_dropped(docs, distinct.where(F.col("halves").isNotNull()), id_col, text_col)
    named = distinct.select("h1", "h2", F.struct("first.id", "first.pos").alias("first"), "copies")
    touched = named.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near OR copies > 1")
    met = lines.select("h1", "h2", "id", "row", "pos").join(touched, ["h1", "h2"])
    dropped = met.where(F.coalesce("near", F.lit(False)) | (F.struct("id", "pos") > F.col("first"))).select("id", "row", "pos")
    row_id, row, gone = (temporary(docs, name) for name in ("row_id", "row_hash", "row_gone"))
    by_row = dropped.groupBy(F.col("id").alias(row_id), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone))
    by_row = write_out(by_row, "line-dropped")
    discard(lines, distinct, near)
    parts = F.split(text_col, "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)), "\n")
    joined = docs.join(by_row, docs[id_col].eqNullSafe(F.col(row_id)) & (F.xxhash64(text_col) == F.col(row)), "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    found = {"_n_lines": F.coalesce(F.size(parts), F.lit(0)), "_n_dropped": F.coalesce(F.size(gone), F.lit(0))}
    own = [text if c == text_col else F.col(c) for c in docs.columns if c.lower() not in found]
    return joined.select(*own, *(c.alias(name) for name, c in found.items()))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    counts = F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped")
    return line_dedup(docs).select("doc_id", *counts, digest)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep the other lines; a text that loses lines and has no word left goes.

    Null and wordless texts stay as they are; all columns pass through; an empty table stays empty.
    """
    plain = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    found = line_dedup(plain).where((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


ORACLE_SQL = rf"""
WITH l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l1 AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS s FROM l0),
l AS (SELECT doc_id, pos, line, s, string_split(s, ' ') AS w, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS n FROM l1),
f AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min((doc_id, pos)) AS first FROM l WHERE n > 0 GROUP BY s),
c AS (SELECT s, n, first, i, array_to_string(w[1:i - 1], ' ') || ' ' || array_to_string(w[i + 1:], ' ') AS v, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS u
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= {NEAR_WORDS})),
e AS (SELECT v, i, n, min(first) AS first FROM c GROUP BY ALL),
near AS (SELECT c.s FROM c JOIN e ON c.v = e.v AND c.i = e.i AND c.n = e.n WHERE e.first < c.first
  UNION SELECT CASE WHEN c.first > f.first THEN c.s ELSE f.s END FROM c JOIN f ON c.u = f.s AND f.n = c.n - 1 AND f.n >= {NEAR_WORDS}),
o AS (SELECT l.doc_id, l.pos, l.line, (l.n > 0 AND (near.s IS NOT NULL OR (l.doc_id, l.pos) > f.first)) AS gone
      FROM l LEFT JOIN f ON l.s = f.s LEFT JOIN near ON near.s = l.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone IS TRUE) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM o GROUP BY doc_id"""
