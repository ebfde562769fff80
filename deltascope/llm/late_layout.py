"""A table in files cut by day, kept up to date when rows arrive late.

A layout keeps the newest version of each key and cuts each day, in order of time and key, into Parquet files of a given number of rows;
the last of a day may have fewer. ``write_layout`` makes one, ``overwrite_days`` takes late rows in: days with a row that comes or
goes are written anew, and the files of all others are not touched.

Days are worked on in slices: fixed stretches of time, with every instant that holds more than one row in HOT_SHARE a slice of its own, and such
slices, as well as rows without a time, cut by key. Stored rows, the ids of outgoing ones and incoming rows meet by (day, slice) and are
merged in one sorted pass over each slice. Counts by slice, summed up within a day, give each slice's first row number in its day, and
with it every row's file. So no task gets more than a slice, and only a file's own rows meet in one task, which writes them as they come.

The driver gets a list of the days that change, BANDS limits of keys and up to HOT_SHARE instants; none grows with the rows.

Edge cases: rows without a time are day -1, in order of their keys; rows without a key are versions of one row; a version that is null is older
than all others; of equal versions within a batch, a hash of the row decides, and a later batch's row takes the place of an earlier one;
repeated rows are one; no rows give no files; a day that loses all rows loses its folder; columns may have any names, the
partition columns' names give way. The exchange of folders is atomic for a day, not over all days: after a driver is lost there, the days not yet
exchanged lie whole in the folder beside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from deltascope.llm.common import HOT_SHARE, frugal, new_path, quoted, stored

DAY = 86_400_000_000
#: Seconds of a slice, and the bands of keys that a single instant is cut into.
SLICE_SECONDS, BANDS = 900, 64


def micros(column: Column, ntz: bool) -> Column:
    """Microseconds since 1970, whatever the session's zone; times without a zone are UTC."""
    if not ntz:
        return F.unix_micros(column)
    since = (column - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")


@dataclass(frozen=True)
class Layout:
    """Where a layout lies, its columns, which of them are key (a whole number), time (a timestamp, with or without a zone) and version, and the rows of a file."""

    folder: str
    schema: StructType
    key: str
    time: str
    version: str
    file_rows: int
    slice_seconds: int = SLICE_SECONDS

    @property
    def parts(self) -> tuple[str, str]:
        """Names of the partition columns, which are no columns of the table."""
        taken = {c.lower() for c in self.schema.names}
        free = lambda c: free(c + "_") if c in taken else c
        return free("day"), free("file_no")

    def at(self, row: Column) -> Column:
        return micros(row.getField(self.time), isinstance(self.schema[self.time].dataType, TimestampNTZType))

    def day(self, at: Column) -> Column:
        return F.coalesce(F.floor(at / DAY), F.lit(-1)).cast("long")

    def stored_rows(self, spark: SparkSession, folder: str | None = None) -> DataFrame:
        """The rows of the files as they are, with day and file_no, and Spark's _metadata."""
        day, file_no = self.parts
        schema = StructType([*self.schema.fields]).add(day, "long").add(file_no, "long")
        return spark.read.schema(schema).parquet(folder or self.folder)


def newest(rows: DataFrame, layout: Layout) -> DataFrame:
    """row: the newest version of each key; versions are combined before the shuffle, so a key may have any number."""
    columns = quoted(layout.schema.names)
    own = rows.select(F.struct(*columns).alias("row"))
    rank = F.struct(F.col("row").getField(layout.version).alias("v"), F.xxhash64("row").alias("h"))
    return own.groupBy(F.col("row").getField(layout.key).alias("key")).agg(F.max_by("row", rank).alias("row")).select("row")


def sliced(rows: DataFrame, layout: Layout, like: DataFrame) -> DataFrame:
    """rows (at, key and others) with day, slice (where it begins) and band; like: stored rows with at and key that say which instants are hot."""
    width = layout.slice_seconds * 1_000_000
    grid = (F.floor(F.col("at") / width) * width).cast("long")
    marks = F.lit([(i + 1) / BANDS for i in range(BANDS - 1)])
    total, limits = like.agg(F.count("*"), F.percentile_approx("key", marks, 10_000)).first()
    full = like.filter("at is not null").groupBy(grid.alias("grid")).agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > total)
    instants = like.join(F.broadcast(full.select("grid")), grid == F.col("grid"), "left_semi").groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > total)
    hot = sorted(r["at"] for r in instants.collect())  # fewer than HOT_SHARE
    edges = F.lit(sorted({e for h in hot for e in (h, h + 1)})).cast("array<long>")
    begin = F.greatest(grid, F.array_max(F.filter(edges, lambda e: e <= F.col("at"))))
    of_one_instant = F.col("at").isNull() | F.col("at").isin(hot)
    band = F.when(of_one_instant, F.size(F.filter(F.lit(sorted(set(limits or []))).cast("array<long>"), lambda e: e <= F.col("key")))).otherwise(0)
    return rows.select("*", layout.day(F.col("at")).alias("day"), begin.alias("slice"), F.coalesce(band, F.lit(-1)).alias("band"))


_SLICE = ["day", "slice", "band"]


def _written(ranked: DataFrame, layout: Layout, folder: str) -> None:
    """Rows with day, slice, band and rank (from 1, in the slice) to files; a slice's first row number is the sum of the counts before it in its day."""
    ranked = stored(ranked, "ranked")
    counts = ranked.groupBy(*_SLICE).agg(F.count("*").alias("n"))
    before = Window.partitionBy("day").orderBy("slice", "band").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(c).alias(f"_{c}") for c in _SLICE], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SLICE])
    day, file_no = layout.parts
    place = F.col("first") + F.col("rank") - 1
    rows = ranked.join(firsts, same).select("row", "_day", F.floor(place / layout.file_rows).cast("long").alias("_file"), place.alias("_place"))
    rows = rows.repartition("_day", "_file").sortWithinPartitions("_day", "_file", "_place")
    out = [F.col("row").getField(c).alias(c) for c in layout.schema.names]
    rows.select(*out, F.col("_day").alias(day), F.col("_file").alias(file_no)).write.option("maxRecordsPerFile", 0).partitionBy(day, file_no).parquet(folder)


def _keyed(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.select("row", layout.at(F.col("row")).alias("at"), F.col("row").getField(layout.key).alias("key"))


def write_layout(rows: DataFrame, layout: Layout) -> None:
    """Lay the newest versions of rows out in a new folder."""
    kept = stored(_keyed(newest(rows, layout), layout), "newest")
    order = Window.partitionBy(*_SLICE).orderBy("at", "key")
    _written(sliced(kept, layout, kept).select("row", *_SLICE, F.row_number().over(order).alias("rank")), layout, layout.folder)


def overwrite_days(late: DataFrame, layout: Layout) -> DataFrame:
    """Take late rows into the layout; returns the days that were written anew (day).

    A late row stays if its version is not older than the stored one of its key.
    """
    spark = late.sparkSession
    columns = quoted(layout.schema.names)
    stored_rows = layout.stored_rows(spark)
    day, _ = layout.parts
    keyed = stored_rows.select(F.struct(*columns).alias("row"), F.col(day).alias("day"))
    old = keyed.select(layout.at(F.col("row")).alias("old_at"), F.col("row").getField(layout.key).alias("old_key"), F.col("row").getField(layout.version).alias("old_version"), F.lit(True).alias("there"))
    new = _keyed(newest(late, layout), layout)
    version = F.col("row").getField(layout.version)
    met = new.join(old, F.col("key").eqNullSafe(F.col("old_key")), "left")
    wins = F.col("there").isNull() | F.col("old_version").isNull() | (version >= F.col("old_version"))
    incoming = stored(met.filter(wins).select("row", "at", "key", "there", "old_at"), "incoming")
    outgoing = incoming.filter("there").select(F.lit(None).cast(incoming.schema["row"].dataType).alias("row"), F.col("old_at").alias("at"), "key")
    days = stored(incoming.select(layout.day(F.col("at")).alias("day")).union(outgoing.select(layout.day(F.col("at")))).distinct(), "days")
    changed = sorted(r["day"] for r in days.collect())  # a row a day
    if not changed:
        return days
    rest = keyed.filter(F.col("day").isin(changed)).select("row", layout.at(F.col("row")).alias("at"), F.col("row").getField(layout.key).alias("key"))
    tagged = [rows.select("row", "at", "key", F.lit(tag).alias("tag")) for tag, rows in enumerate((outgoing, rest, incoming))]
    meet = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    like = rest.select("at", "key").unionByName(incoming.select("at", "key"))
    order = Window.partitionBy(*_SLICE).orderBy("at", "key", "tag")
    merged = sliced(meet, layout, like).select("row", "at", "key", "tag", *_SLICE, F.lag("tag").over(order).alias("ahead"))
    merged = merged.filter("tag <> 0 and not (tag = 1 and ahead <=> 0)")  # an id that goes stands right before its row
    ranked = merged.select("row", *_SLICE, F.row_number().over(Window.partitionBy(*_SLICE).orderBy("at", "key")).alias("rank"))
    beside = new_path(spark, "rewritten-days")
    _written(ranked, layout, beside)
    _exchange(spark, layout, beside, changed)
    return days


def _exchange(spark: SparkSession, layout: Layout, beside: str, changed: list[int]) -> None:
    """Put the folders of changed days in place of the layout's; a day without one there is left with none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(layout.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in changed:
        name = f"{layout.parts[0]}={d}"
        new, now = path(f"{beside}/{name}"), path(f"{layout.folder}/{name}")
        fs.delete(now, True)
        if fs.exists(new) and not fs.rename(new, now):
            raise OSError(f"{new} could not be moved")
    fs.delete(path(beside), True)


def described(rows: DataFrame) -> DataFrame:
    """Per file, of rows(path, day, file_no, place, id, cents, crc): day, file_no, path, n_rows, cents, rows_crc and ids_sha256, of the comma-joined ids in order of place; each file streams through a task."""
    names = ["day", "file_no", "path", "n_rows", "cents", "rows_crc", "ids_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, sums = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [now[1], now[2], now[0], *sums, digest.hexdigest()]))], schema=schema)

        schema = pa.schema([(n, pa.string() if n in ("path", "ids_sha256") else pa.int64()) for n in names])
        for batch in batches:
            paths = batch.column("path").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                head = tuple(part.column(c)[0].as_py() for c in ("path", "day", "file_no"))
                joined = ",".join(part.column("id").to_pylist()).encode()
                if now != head:
                    if now is not None:
                        yield done()
                    now, digest, sums = head, hashlib.sha256(joined), [0, 0, 0]
                else:
                    digest.update(b"," + joined)
                sums = [x + int(y) for x, y in zip(sums, (b - a, part.column("cents").to_numpy().sum(), part.column("crc").to_numpy().sum()))]
        if now is not None:
            yield done()

    own = rows.repartition("path").sortWithinPartitions("path", "place")
    return own.mapInArrow(frugal(run), "day long, file_no long, path string, n_rows long, cents long, rows_crc long, ids_sha256 string")
