"""Reading versioned fact tables and writing staged ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions.scalars import address, to_flag, to_long, to_reservoir
from deltascope.model import DIVERGENCE, DIVERGENCE_COLUMNS, FORBIDDEN
from deltascope.operators.versioned import latest_version

#: Blocks of one directory of a staged table; a range reads only its own.
BUCKET = 50_000


def pinned(df: DataFrame, config: str, schedule: str | None = None, blocks: tuple[int, int] | None = None, chain: int = 1) -> DataFrame:
    """One chain, configuration and schedule, and blocks from lo to hi, both included."""
    out = df.filter((F.col("chain_id") == chain) & (F.col("analysis_config_hash") == config))
    if schedule is not None:
        out = out.filter(F.col("schedule_name") == schedule)
    if blocks is not None:
        lo, hi = blocks
        out = out.filter(F.col("block_number").between(lo, hi))
        if "block_bucket" in df.columns:
            out = out.filter(F.col("block_bucket").between(lo // BUCKET, hi // BUCKET))
    return out


def read_divergence(df: DataFrame) -> DataFrame:
    """The newest version of every replayed transaction, its kept columns alone, coerced to their types."""
    if FORBIDDEN in df.columns:
        df = df.drop(FORBIDDEN)
    rows = latest_version(df.select("row_id", "updated_at", *DIVERGENCE_COLUMNS), ["row_id"], [F.desc("updated_at"), F.desc(F.xxhash64(*DIVERGENCE_COLUMNS))])
    out = []
    for name, kind in (c.split() for c in DIVERGENCE.split(", ")):
        c = F.col(name)
        if name in ("runtime_state_gas_spillover", "schedule_initial_reservoir"):
            c = to_reservoir(c)
        elif name in ("recipient", "oog_contract", "divergence_contract", "tx_hash"):
            c = address(c.cast("string"))
        elif dict(df.dtypes)[name] == "string" and kind == "boolean":
            c = to_flag(c)
        elif dict(df.dtypes)[name] == "string" and kind in ("bigint", "int", "smallint"):
            c = to_long(c)
        out.append(c.cast(kind).alias(name))
    return rows.select(*out)


def stage(df: DataFrame, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Write a staged table by block bucket, replacing what was there (or only these buckets), and read it back.

    Rows are ranged by block first, so a bucket gets files from few tasks and a file's row groups hold few blocks.
    """
    df = df.withColumn("block_bucket", F.floor(F.col("block_number") / BUCKET)).repartitionByRange("block_number").sortWithinPartitions("block_number")
    write = df.write.mode("overwrite").partitionBy("block_bucket")
    if buckets is not None:
        write = write.option("partitionOverwriteMode", "dynamic")
        _drop_buckets(df.sparkSession, path, buckets)
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop_buckets(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Delete buckets that are about to be written anew, which may have no rows any more."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in buckets:
        fs.delete(of(f"{path}/block_bucket={b}"), True)


_own_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master alone, one that goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        made = tempfile.mkdtemp(prefix="deltascope-scratch-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_folders[context.applicationId] = f"file://{made}"
    return _own_folders[context.applicationId]


#: Paths of held tables that scratch() is to delete, innermost last.
_to_delete: list[list[str]] = []


def held(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a plan read: written once to the scratch folder and read back.

    The files stay until the end of a scratch() around the call, or until the folder's owner deletes them.
    """
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _to_delete:
        _to_delete[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables held inside go at the end: what was computed from them must have been written by then."""
    _to_delete.append([])
    try:
        yield
    finally:
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _to_delete.pop():
            of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of(path), True)


def latest_coverage(df: DataFrame) -> DataFrame:
    """The newest row of each identity; of equal versions, by a hash of all columns."""
    return latest_version(df, ["row_id"], [F.desc("updated_at"), F.desc(F.xxhash64(*df.columns))])


#: Addresses up to which a lookup is a list of values that Parquet's Bloom filters answer (Spark's threshold for such lists).
FEW = 10


def stage_recipients(transactions: DataFrame, path: str, row_group_bytes: int | None = None) -> DataFrame:
    """block_number and addr (recipients in small letters, none null) of transactions, by block bucket and with a Bloom filter on addr in every row group."""
    rows = transactions.filter("to_address is not null").select("block_number", F.lower("to_address").alias("addr"))
    rows = rows.withColumn("block_bucket", F.floor(F.col("block_number") / BUCKET)).repartitionByRange("block_number").sortWithinPartitions("block_number")
    write = rows.write.mode("overwrite").partitionBy("block_bucket").option("parquet.bloom.filter.enabled#addr", "true")
    if row_group_bytes is not None:
        write = write.option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.expected.ndv#addr", max(1, row_group_bytes // 16))
    write.parquet(path)
    return transactions.sparkSession.read.schema(rows.schema).parquet(path)


def denominators(transactions: DataFrame, addresses: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """addr, total_tx of the addresses asked for (a bounded set), from every transaction of a range.

    transactions are raw (to_address) or staged by stage_recipients; of a staged table, a lookup of up to FEW addresses reads the row groups alone that can hold one.
    """
    asked = addresses.select(F.lower("addr").alias("addr")).distinct()
    rows = transactions.filter(F.col("block_number").between(*blocks))
    if "addr" not in transactions.columns:
        rows = rows.filter("to_address is not null").select(F.lower("to_address").alias("addr"))
    else:
        lo, hi = (b // BUCKET for b in blocks)
        rows = rows.filter(F.col("block_bucket").between(lo, hi))
        few = [r["addr"] for r in asked.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return rows.filter(F.col("addr").isin(few)).groupBy("addr").agg(F.count("*").alias("total_tx"))
    return rows.join(F.broadcast(asked), "addr", "left_semi").groupBy("addr").agg(F.count("*").alias("total_tx"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
