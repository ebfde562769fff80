"""Staging that is held against a ledger: a read that comes back short is repaired bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.sources.tables import BUCKET

#: How often a bucket is read before staging gives up.
ATTEMPTS = 4
#: Blocks that are dealt together.
SLICE = 10_000
LEDGER = "block_bucket bigint, rows bigint, checksum decimal(38,0)"


class ShortRead(ValueError):
    """Buckets that are still short after all attempts."""


class SurplusRows(ValueError):
    """Buckets with more rows than the ledger has; reading again can't mend that."""


def row_hash(rows: DataFrame) -> Column:
    """A hash of the whole row, nulls and all columns in order."""
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c != "block_bucket"])


def ledger(rows: DataFrame, of: Column | None = None) -> DataFrame:
    """block_bucket, rows and checksum (the sum of a hash of every row, so of any order) of rows with block_bucket; of: a hash other than row_hash, of 64 bits.

    The halves of the hashes are summed as whole numbers, which costs half of what decimals do, and put together once a bucket.
    """
    value = (row_hash(rows) if of is None else of).cast("bigint")
    halves = F.sum(F.shiftright(value, 32)).alias("high"), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    sums = rows.groupBy(F.col("block_bucket").cast("bigint").alias("block_bucket")).agg(F.count("*").alias("rows"), *halves)
    checksum = F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")
    return sums.select("block_bucket", "rows", checksum.cast("decimal(38,0)").alias("checksum"))


def expected_rows(coverage: DataFrame, width: int = BUCKET) -> DataFrame:
    """The ledger that block coverage promises: retained transactions by bucket, of unknown checksum."""
    bucket = F.floor(F.col("block_number") / width).cast("bigint")
    return coverage.groupBy(bucket.alias("block_bucket")).agg(F.coalesce(F.sum("retained_drill_in_count"), F.lit(0)).cast("bigint").alias("rows")).filter("rows > 0").withColumn("checksum", F.lit(None).cast("decimal(38,0)"))


def stage_checked(read: Callable[[list[int]], DataFrame], expected: DataFrame, path: str, of: Callable[[DataFrame], Column] = row_hash, only: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage read(buckets) by bucket until what is stored is what the ledger expects; returns the staged rows and the ledger kept beside them.

    read gives the rows of the buckets asked for, with block_number and block_bucket. What was written is read back from the
    files and counted: buckets that are short, or whose checksum differs from a known one, are read and written again, up to
    ATTEMPTS times, and no other; a bucket with too many rows raises at once. The kept ledger has rows, checksum and
    attempts of each bucket. only: buckets to stage (all of the ledger's without it); others stay as they are on disk.
    Lists of buckets go through the driver, rows never.
    """
    spark = expected.sparkSession
    wanted = {r["block_bucket"]: (r["rows"], r["checksum"]) for r in expected.collect() if only is None or r["block_bucket"] in set(only)}
    gone = [] if only is None else [b for b in only if b not in wanted]
    todo, tried, found = sorted(wanted), {}, {}
    for attempt in range(1, ATTEMPTS + 1):
        if attempt > 1 and not todo:
            break
        rows = read(todo)
        schema = rows.schema
        # dealt by slices, not by ranges, whose bounds a second reading would have to find; a slice too large for one task is split
        dealt = rows.withColumn("_slice", F.floor(F.col("block_number") / SLICE)).hint("rebalance", "block_bucket", "_slice").drop("_slice")
        write = dealt.sortWithinPartitions("block_bucket", "block_number").write.partitionBy("block_bucket")
        if attempt == 1 and only is None:
            write.mode("overwrite").parquet(path)
        else:
            write.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for b in gone if attempt == 1 else []:
            _drop(spark, f"{path}/block_bucket={b}")
        back = spark.read.schema(rows.schema).parquet(path).filter(F.col("block_bucket").isin(todo))
        got = {r["block_bucket"]: (r["rows"], r["checksum"]) for r in ledger(back, of(back)).collect()}
        for b in todo:
            tried[b], found[b] = attempt, got.get(b, (0, None))
        over = [b for b in todo if found[b][0] > wanted[b][0]]
        if over:
            raise SurplusRows(f"bucket {over[0]} has {found[over[0]][0]} rows, the ledger {wanted[over[0]][0]}; {len(over)} such buckets")
        todo = [b for b in todo if found[b][0] < wanted[b][0] or (wanted[b][1] is not None and found[b][1] != wanted[b][1])]
        for b in todo:
            print(f"bucket {b}: {found[b][0]} of {wanted[b][0]} rows at attempt {attempt}")
    if todo:
        raise ShortRead(f"bucket {todo[0]} has {found[todo[0]][0]} of {wanted[todo[0]][0]} rows after {ATTEMPTS} attempts; {len(todo)} such buckets")
    kept = spark.createDataFrame([(b, *found[b], tried[b]) for b in sorted(wanted)], f"{LEDGER}, attempts int")
    if only is not None and (old := kept_ledger(spark, path)) is not None:
        kept = spark.createDataFrame([*old.filter(~F.col("block_bucket").isin([*wanted, *gone])).collect(), *kept.collect()], kept.schema)
    keep_ledger(kept, path)
    return spark.read.schema(schema).parquet(path), spark.read.schema(kept.schema).parquet(f"{path}-ledger")


def keep_ledger(rows: DataFrame, path: str) -> None:
    """Write a ledger beside a staged table; it has a row a bucket."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}-ledger")


def kept_ledger(spark, path: str) -> DataFrame | None:
    """The ledger beside a staged table; None where nothing is staged."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-ledger/_SUCCESS")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{path}-ledger") if there else None


def _drop(spark, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
