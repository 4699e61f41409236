"""Ranks inside groups of any size: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import materialize

CELLS = 4096


def ranked(df: DataFrame, group: str, cell: Column, order: list, name: str = "position") -> DataFrame:
    """df with the rank (from 1) in its group. cell: a number that never falls along the order, so
    that a rank is the rows of the cells before plus the rank inside the cell. df is written once,
    as both steps read it; the windows run over a group's cells and over the rows of one cell."""
    df = materialize(df.withColumn("_cell", cell))
    counts = df.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("_group"), F.col("_cell").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order))
    rows = df.withColumn("_inner", inner)
    joined = rows.join(starts, rows[group].eqNullSafe(starts["_group"]) & (rows["_cell"] == starts["_at"]))
    return joined.select(*[rows[c] for c in df.columns if c != "_cell"], (F.col("_inner") + F.col("_before")).alias(name))


def by_score(df: DataFrame, group: str, tie: str, up: bool = False, score: str = "score", name: str = "position") -> DataFrame:
    """Ranks by score, the highest first (up: the lowest), then by the tie-break."""
    s = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    cell = F.floor((s if up else 1 - s) * CELLS).cast("int")
    return ranked(df, group, cell, [F.col(score) if up else F.desc(score), F.col(tie)], name)
