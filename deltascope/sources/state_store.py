"""Stored states by schedule and bucket of blocks: one partition a bucket, overwritten alone."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.operators.states import Spec, merged, merged_counts, partial, partial_counts
from deltascope.sources.tables import BUCKET

PLACE = ["schedule_name", "block_bucket"]


def bucketed(rows: DataFrame, width: int = BUCKET) -> DataFrame:
    """rows with their block_bucket, if they have none."""
    return rows if "block_bucket" in rows.columns else rows.withColumn("block_bucket", F.floor(F.col("block_number") / width))


def refresh(rows: DataFrame, spec: Spec, folder: str, buckets: Iterable[int], schedule: str, by: list[str] | None = None) -> None:
    """Make the states of one schedule's buckets anew from rows (with block_bucket); those of all other buckets and schedules stay as they are.

    Of a table partitioned by bucket, only the asked ones are read. A bucket without rows gets the empty state, so
    nothing of what it had before remains. by: further keys (a day, say) within a bucket.
    """
    spark, by, asked = rows.sparkSession, by or [], sorted({int(b) for b in buckets})
    if not asked:
        return
    own = rows.filter(F.col("block_bucket").isin(asked)).withColumn("schedule_name", F.lit(schedule)).withColumn("block_bucket", F.col("block_bucket").cast("bigint"))
    marks = spark.createDataFrame([(b,) for b in asked], "block_bucket bigint").withColumn("schedule_name", F.lit(schedule))  # a row a bucket
    states = partial(own, spec, [*PLACE, *by])
    empty = marks.select(*PLACE, F.lit(0).cast("bigint").alias("n_rows"))
    _put(states.unionByName(empty.join(states.select(*PLACE).distinct(), PLACE, "left_anti"), allowMissingColumns=True), f"{folder}/states")
    if spec.counted:
        nothing = marks.select(*PLACE, F.lit("").alias("which"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n"))
        _put(partial_counts(own, spec, [*PLACE, *by]).unionByName(nothing, allowMissingColumns=True), f"{folder}/counts")


def _put(df: DataFrame, path: str) -> None:
    df.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def read_states(spark: SparkSession, folder: str, schedule: str | None = None, what: str = "states") -> DataFrame:
    df = spark.read.parquet(f"{folder}/{what}").withColumn("block_bucket", F.col("block_bucket").cast("bigint")).withColumn("schedule_name", F.col("schedule_name").cast("string"))
    return df if schedule is None else df.filter(F.col("schedule_name") == schedule)


def over_range(rows: DataFrame, spec: Spec, folder: str, schedule: str, blocks: tuple[int, int], by: list[str] | None = None, width: int = BUCKET) -> tuple[DataFrame, DataFrame | None]:
    """States of by and value counts over blocks lo to hi, both included: buckets that lie in the range whole come from the store, and only those at its ends are read."""
    (lo, hi), by = blocks, by or []
    first, last = -(-lo // width), (hi + 1) // width - 1  # whole buckets
    whole = lambda df: df.filter(F.col("block_bucket").between(first, last))
    ends = [b for b in {lo // width, hi // width} if not first <= b <= last]
    rest = rows.filter(F.col("block_bucket").isin(ends) & F.col("block_number").between(lo, hi))
    kept = whole(read_states(rows.sparkSession, folder, schedule)).filter("n_rows > 0")
    states = kept.select(*by, *spec.figures).unionByName(partial(rest, spec, by) if by else partial(rest, spec, []).select(*spec.figures))
    counts = None
    if spec.counted:
        kept = whole(read_states(rows.sparkSession, folder, schedule, "counts")).select(*by, "which", "value", "n")
        counts = merged_counts(kept.unionByName(partial_counts(rest, spec, by)), by)
    return merged(states, spec, by), counts


def stale(ledger: DataFrame, kept: DataFrame | None) -> list[int]:
    """Buckets of a source's ledger (block_bucket, rows, checksum) that a kept one lacks or has otherwise; those that the source has no more are among them."""
    if kept is None:
        return sorted(r[0] for r in ledger.select("block_bucket").collect())
    old = kept.select("block_bucket", *[F.col(c).alias(f"old_{c}") for c in ("rows", "checksum")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("rows", "checksum")])
    return sorted(r[0] for r in ledger.join(old, "block_bucket", "full_outer").filter(~same).select("block_bucket").collect())  # a row a bucket
