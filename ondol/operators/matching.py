"""Ordered one-to-one matching of what was planted in a record with what a review found there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_findings(planted: DataFrame, clean: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Findings beyond the clean run's, as bags: of k equal ones on the clean side, the first k are taken away."""
    n_clean = clean.groupBy(keys).agg(F.count("*").alias("_clean"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    left = planted.withColumn("_i", F.row_number().over(Window.partitionBy(keys).orderBy(order)))
    right = n_clean.select(F.struct(*keys).alias("_r"), "_clean")
    return left.join(right, on, "left").where(F.col("_i") > F.coalesce("_clean", F.lit(0))).select(planted.columns)


def greedy_match(defects: DataFrame, findings: DataFrame, matches: Column, record: str = "record", place: str = "pos") -> DataFrame:
    """For each record, defects in order take the first finding they match that none before took.

    matches: a condition over the aliases d and f.  Result: record, pos of the defect, found (place of
    its finding, or null).  Only candidate places travel to the Python step, and one record's report is
    one group; a defect without candidates never does.  Null records match nothing.  Where a defect or
    a finding repeats, each is matched on its own.
    """
    pairs = defects.alias("d").join(findings.alias("f"), (F.col(f"d.{record}") == F.col(f"f.{record}")) & matches)
    pairs = pairs.select(F.col(f"d.{record}").alias("record"), F.col(f"d.{place}").alias("pos"), F.col(f"f.{place}").alias("found"))

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for pos, some in group.sort_values(["pos", "found"]).groupby("pos", sort=True):
            free = next((x for x in some["found"] if x not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((group["record"].iloc[0], pos, free))
        return pd.DataFrame(out, columns=["record", "pos", "found"])

    given = pairs.groupBy("record").applyInPandas(assign, pairs.schema)
    return defects.select(F.col(record).alias("record"), F.col(place).alias("pos")).join(given, ["record", "pos"], "left")


def match_summary(matched: DataFrame, findings: DataFrame) -> DataFrame:
    """Defects, those found, and the share of findings that met a defect (null without findings)."""
    n = findings.agg(F.count("*").alias("n_findings"))
    m = matched.agg(F.count("*").alias("n_defects"), F.count("found").alias("n_found"))
    return m.crossJoin(n).withColumn("precision", F.when(F.col("n_findings") > 0, F.col("n_found") / F.col("n_findings")))
