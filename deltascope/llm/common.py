"""Shared pieces: durable intermediate tables, joins that survive hot keys, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table of a few narrow columns is broadcast (about 20 MB in the JVM, so that the broadcasts of one plan fit together).
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch on its way to Python.
ARROW_BYTES = 2 << 20
#: A key is hot when it holds more than one row in so many; there are at most that many hot keys.
HOT_SHARE = 1000


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "65536k", "64m", "64MB")


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, unless their PYTHONPATH has it, and keep Arrow batches of texts small.

    Batches of ARROW_BYTES hold memory down on both sides. This sets spark.sql.execution.arrow.maxBytesPerBatch of the
    whole session, where the session has it unset or at its default; any other bound is kept.
    """
    if spark.conf.get(_BATCH, None) in (None, *_BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    known = any(Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if not known and not any("deltascope-code" in p for p in context._python_includes):
        to = tempfile.mkdtemp(prefix="deltascope-code-")
        atexit.register(shutil.rmtree, to, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{to}/deltascope-code", "zip", root, "deltascope"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master alone (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="deltascope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of stored tables that scratch() is to delete, innermost last.
_scratch: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The files stay until forget(), the end of a scratch() around the call, or the folder's owner deletes them.
    """
    path = new_path(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by stored(), once no later plan reads it."""
    spark = df.sparkSession
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if path.startswith(shared_dir(spark)):
            _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end: what was computed from them must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when df, a stored table, has at most limit rows."""
    return df.count() <= limit


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """Left join of rows with facts that hold one row per key, safe against hot keys.

    A small facts table is broadcast, after its rows are counted. Beyond that, the
    facts of keys with more than 1/HOT_SHARE of all rows (column ``size`` holds the
    rows of each key, so there are at most HOT_SHARE such keys) are broadcast, and the
    others meet their rows in a shuffle; rows that are already served are spread by a
    hash of the ``spread`` columns. Null keys match nothing. ``facts`` should be stored.
    """
    if small_enough(facts):
        return rows.join(F.broadcast(facts.drop(size)), keys, "left")
    values = [c for c in facts.columns if c not in keys and c != size]
    total = facts.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = facts.filter(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    cold = facts.filter(~is_hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), keys, "left")
    idle = F.col("_hot").isNotNull()
    for k in keys:
        idle = idle | F.col(k).isNull()
    out = out.withColumn("_s", F.when(idle, F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(1_000_000)).cast("int")).otherwise(0))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    out = out.join(cold, [F.col("_s") == F.col("_salt"), *on], "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names]


def carrying(rows: DataFrame, others: str) -> T.StructType:
    """The schema of what an operator makes of rows: their struct carried, whatever its fields are called, and other columns by DDL."""
    return T.StructType([T.StructField("carried", rows.schema["carried"].dataType), *T.StructType.fromDDL(others).fields])


def any_names(*needed: str) -> Callable:
    """For an operator on documents that returns their columns: within it, all but the needed ones have plain names of their own, so that dots, backticks, cases and repeats do no harm."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *more, **named) -> DataFrame:
            names = docs.columns
            plain = [c if c in needed and c not in names[:i] else f"column_{i}" for i, c in enumerate(names)]
            return operator(docs.toDF(*plain), *more, **named).toDF(*names)

        return run

    return wrap


def give_back() -> None:
    """Return memory that this worker has freed to the system, so that it holds little while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow, which gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker runs tasks of this name; the caches of other names are dropped."""
    if name not in _caches:
        for other in _caches.values():
            other.clear()
        _caches.clear()
        _caches[name] = {}
        gc.collect()
    return _caches[name]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
