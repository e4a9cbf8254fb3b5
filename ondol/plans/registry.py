"""All plans of the package by name: a callable for Spark and the same plan as SQL for DuckDB."""

from __future__ import annotations

import re

from ..functions.dialect import Duck, Spark
from . import catalogue, estimates, evaluation, ingest, measures, quotes, reports, retrieval, scalars, vectors
from .stored import discard, store

STORED = {name: plan(Spark) for name, plan in (estimates.STORED | retrieval.STORED).items()}


def named(spark, sf_dir: str, text: str) -> dict:
    return {t: table(spark, sf_dir, t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))}


def table(spark, sf_dir: str, name: str):
    """A table of the inputs, or one of STORED, which is written first; stored tables that only it reads are deleted again."""
    if best := re.fullmatch(r"hits_(\d+)(_other)?", name):
        return vectors.hits(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), retrieval.EVERY, int(best[1]), bool(best[2]))
    if name not in STORED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    read = named(spark, sf_dir, STORED[name])
    made = store(spark.sql(STORED[name], **read), name)
    for t in STORED.keys() & read.keys():
        discard(read[t])
    return made


def query(plan):
    text = plan(Spark)

    def run(spark, sf_dir: str):
        return spark.sql(text, **named(spark, sf_dir, text))

    return run


PLANS = (*catalogue.PLANS, *ingest.PLANS, *measures.PLANS, *reports.PLANS, *retrieval.PLANS, *quotes.PLANS, *estimates.PLANS, *scalars.PLANS, *evaluation.PLANS)
QUERIES = {plan.__name__: query(plan) for plan in PLANS}
ORACLE_SQL = {plan.__name__: plan(Duck).replace("regexp_like(", "regexp_matches(") for plan in PLANS}
