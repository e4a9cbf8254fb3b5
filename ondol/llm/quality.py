"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts are taken over whole texts with built-in functions only.  Repeated three-word windows are
found by sorting (window hash, position) inside the row, so a text costs n log n.  Each rule of
the table compares a ratio of counts with a bound; a text is kept when the base test and every
rule pass.

Nulls and odd inputs: a null or blank text has no words, no lines and fails the base test;
repeated rows and ids are judged row by row; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and a in that have it for not on with as was is are by this from or an at "
    "le la les de des du un une et en est que qui dans pour pas ce il elle au sur par plus "
    "der die das und ist ein eine nicht von zu mit den im für auf dem sich des als auch es "
    "el los las y del se por con para su no lo como más o al una ción"
).split()
# (name, numerator, denominator, least, most): a ratio outside its bounds fails; None leaves a side open.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    ("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.3),
    ("letter_word_share", "n_letter_words", "n_words", 0.7, None),
)


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, inside one projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur at least twice in the array."""

    def covered(s):
        same = lambda i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, i)["h"] == F.get(s, j)["h"])
        hits = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return let(
            F.array_sort(F.transform(hits, lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, b: a + b),
        )

    windows = let(
        words,
        lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))),
    )
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, covered))


def counts(text: Column) -> dict[str, Column]:
    """The counted columns of a text; words come from the column _words, lines from _lines."""
    words, lines = F.col("_words"), F.col("_lines")
    return {
        "n_words": F.size(words),
        "word_chars": F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Judge every text: the counts, base_failed, kept, and failed_rules (names in table order)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    measured = rows.select("doc_id", *(c.cast("long").alias(k) for k, c in counts(F.col("text")).items()))
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    tests = []
    for name, top, bottom, least, most in thresholds:
        fails = F.lit(False)
        if least is not None:
            fails = fails | (F.col(top) < least * F.col(bottom))
        if most is not None:
            fails = fails | (F.col(top) > most * F.col(bottom))
        tests.append(F.when(fails, F.lit(name)))
    failed = F.array_compact(F.array(*tests))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"),
        "n_lines", "n_stop_words", "n_letter_words", F.concat_ws(",", failed).alias("failed_rules"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for name, top, bottom, least, most in THRESHOLDS:
        sides = ([f"{top} < {least} * {bottom}"] if least is not None else []) + ([f"{top} > {most} * {bottom}"] if most is not None else [])
        tests.append(f"CASE WHEN {' OR '.join(sides)} THEN '{name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
q AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(3) t(o) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(replace(array_to_string(w, ''), chr(0), '.'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(q.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
      FROM s LEFT JOIN q USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        concat_ws(',', {', '.join(tests)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND failed_rules = '') AS kept, n_lines, n_stop_words, n_letter_words, failed_rules FROM b"""


ORACLE_SQL = _sql()
