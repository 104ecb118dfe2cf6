"""Reasons instead of silent nulls: a row that can't be worked on says why, and can be set apart or made an error.

An operator gives ``refused``, null where all is well.  ``apart`` parts the rows, ``strict`` raises the first reason it meets when rows are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(*cases: tuple[Column, str | Column]) -> Column:
    """The reason of the first case that holds; one that is null doesn't hold."""
    reasons = [F.when(F.coalesce(case, F.lit(False)), reason) for case, reason in cases]
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def apart(rows: DataFrame, refused: str = "refused") -> tuple[DataFrame, DataFrame]:
    """(rows that were worked on, without the reason; rows that were not, with it)."""
    return rows.where(F.col(refused).isNull()).drop(refused), rows.where(F.col(refused).isNotNull())


def strict(rows: DataFrame, key: str, refused: str = "refused") -> DataFrame:
    """``rows`` without the reason column; reading a refused one is an error that names its ``key`` and reason."""
    said = F.concat(F.lit("refused "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.col(refused))
    return rows.where(F.when(F.col(refused).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(refused)


def collected(key: str, **stages: DataFrame) -> DataFrame:
    """(key, stage, refused, n): how many rows each stage refused of each key, and why."""
    parts = [rows.where(F.col("refused").isNotNull()).select(key, F.lit(stage).alias("stage"), "refused") for stage, rows in stages.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key, "stage", "refused").agg(F.count("*").alias("n"))
