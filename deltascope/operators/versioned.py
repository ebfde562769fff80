"""Versioned rows: keep the newest of each identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.model import FORBIDDEN


def latest_version(df: DataFrame, keys: list[str], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The whole newest row of each key; order is descending and should be total.

    by: some of the keys, by which rows are dealt to tasks, so that what follows by these alone needs no second exchange or sort.
    """
    if by is not None:
        df = df.repartition(*by)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def latest_columns(df: DataFrame, key: str, version: str, columns: list[str], skip_nulls: bool = False) -> DataFrame:
    """One row per key with each column's newest value; skip_nulls takes the newest that is not null.

    The column that holds traces is refused, and a column named twice is taken once.
    """
    if FORBIDDEN in columns:
        raise ValueError(f"{FORBIDDEN} is too heavy to read")
    picks = []
    for c in dict.fromkeys(columns):
        if c not in (key, version):
            picks.append((F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(version))) if skip_nulls else F.max_by(c, version)).alias(c))
    return df.groupBy(key).agg(F.max(version).alias(version), *picks)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, n_distinct and n_duplicates of a key; 0 duplicates after deduplication."""
    one = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    return one.withColumn("n_duplicates", F.col("n") - F.col("n_distinct"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per configuration: newest time, and the commit and manifest of that time."""
    return latest_columns(runs, "analysis_config_hash", "updated_at", ["producer_git_commit", "manifest_json"])
