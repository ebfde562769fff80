"""Exact distinct counts that roll up: values get dense ids once, days keep bitmaps of ids, and longer spans combine bitmaps instead of reading rows again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.sources.tables import held

_ROW = (1 << 33) - 1  # of an id of monotonically_increasing_id, the row in its partition


def _each(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """which, value (as text) of the columns, one row each; nulls go."""
    return rows.select(*more, F.inline(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).cast("string").alias("value")) for c in columns]))).filter("value is not null")


def dictionary(rows: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """which, value, id: every value that the columns hold, with ids from 0 on without gaps, for all columns together; a stored table.

    known, an earlier dictionary, keeps its ids, and new values follow. Ids come from places in partitions and the partitions'
    sizes, of which the driver gets one each; no task numbers all values.
    """
    new = _each(rows, columns).distinct()
    start = 0
    if known is not None:
        new = new.join(known, ["which", "value"], "left_anti")
        start = known.count()
    placed = held(new.withColumn("_place", F.monotonically_increasing_id()), "dictionary-values")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    firsts, at = [], start
    for r in sizes:
        firsts += [F.lit(r["part"]), F.lit(at).cast("bigint")]
        at += r["n"]
    first = F.try_element_at(F.create_map(*firsts), part) if firsts else F.lit(0).cast("bigint")
    out = placed.select("which", "value", (first + F.col("_place").bitwiseAND(F.lit(_ROW))).alias("id"))
    return held(out if known is None else known.unionByName(out), "dictionary")


def bitmaps(rows: DataFrame, columns: list[str], ids: DataFrame, by: list[str]) -> DataFrame:
    """by, which, bucket, bitmap: the ids of a group's values, 32,768 to a bitmap, of which only those with a value are there."""
    each = _each(rows, columns, *by).distinct()
    met = each.join(ids, ["which", "value"]).select(*by, "which", F.expr("bitmap_bucket_number(id)").alias("bucket"), F.expr("bitmap_bit_position(id)").alias("bit"))
    return met.groupBy(*by, "which", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def rolled_up(maps: DataFrame, by: list[str]) -> DataFrame:
    """The bitmaps of coarser groups (by: columns that maps has)."""
    return maps.groupBy(*by, "which", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def counted(maps: DataFrame, by: list[str]) -> DataFrame:
    """by, which, n: how many distinct values each group has."""
    return maps.groupBy(*by, "which").agg(F.sum(F.expr("bitmap_count(bitmap)")).alias("n"))


def breadth_over(maps: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """level, all columns that levels name (null where a level lacks them), which, n: counts at every level from one table of bitmaps."""
    every = list(dict.fromkeys(c for by in levels.values() for c in by))
    parts = []
    for level, by in levels.items():
        n = counted(rolled_up(maps, by), by)
        parts.append(n.select(F.lit(level).alias("level"), *[(F.col(c) if c in by else F.lit(None)).cast(maps.schema[c].dataType).alias(c) for c in every], "which", "n"))
    return reduce(DataFrame.unionByName, parts)
