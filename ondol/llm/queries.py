"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, language, line_dedup, lm_score, near_dup, quality, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_ngram_jaccard": near_dup.op2_ngram_jaccard,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL = {
    "op2_ngram_jaccard": near_dup.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
