"""A training-data pipeline over `documents`: each stage applies one operator to what its predecessor kept.

Every stage is written as Parquet and read again, so a lost executor repeats one stage at most; a stage's
table is deleted once the next one is written.

Line dedup comes before the near-duplicate stage, so of near copies it takes the lines they share: what reaches
that stage are the changed lines of a copy, and the texts whose copies differ inside every line.

Nulls and odd inputs: a null or wordless text stays in every stage and is encoded as no tokens; a null id stays;
of rows equal in id and text one stays, if the text has words; rows that share an id alone are separate texts; an
empty table gives no rows; columns beyond those named are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ondol.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from ondol.llm.common import discard, write_out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token counts and digests of the texts that are left."""
    return bpe.token_digests(bpe.bpe_encode(docs, bpe.vocabulary_path()))


STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard", near_dup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", encode),
]

ORACLE_SQL = None  # a fitted classifier is not SQL; tests hold the stages and their order against planted rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = []
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*done)
        done = [docs]
    return docs
