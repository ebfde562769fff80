"""JSON documents: rounding at the edge, files of a schedule, one shard per contract."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from deltascope.sources import document_sink


def plain(value, places: int | None = None, keep_nulls: bool = True):
    """Rows, arrays and decimals as JSON values; floats are rounded half-even as Python does; keep_nulls=False leaves null fields out."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        out = {k: plain(v, places, keep_nulls) for k, v in value.items()}
        return out if keep_nulls else {k: v for k, v in out.items() if v is not None}
    if isinstance(value, list | tuple):
        return [plain(v, places, keep_nulls) for v in value]
    if isinstance(value, Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and places is not None:
        return round(value, places)
    return value if isinstance(value, str | int | float | bool | None) else str(value)


def collected(df: DataFrame, places: int | None = 4, keep_nulls: bool = True, limit: int = 10_000) -> list:
    """The rows of a small result as JSON values; a result beyond limit rows is refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one document")
    return [plain(r, places, keep_nulls) for r in rows]


def write_document(document, path: str, indent: int | None = 2) -> None:
    """A small document to a path or URI, by rename."""
    fs, at = pyarrow.fs.FileSystem.from_uri(document_sink.as_uri(path))
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.tmp") as out:
        out.write(json.dumps(document, indent=indent, separators=None if indent else (",", ":"), default=str).encode())
    fs.move(f"{at}.tmp", at)


def write_shards(rows: DataFrame, folder: str) -> None:
    """One file {key}.json per row (key, body) in folder, in place of all that was there. Keys must differ."""
    document_sink.write_folder(document_sink.whole(rows, F.col("key"), F.col("body")), folder)


def finished(rows: DataFrame, column: str, finish: Callable[[dict], dict]) -> DataFrame:
    """rows with the JSON texts of a column read, finished and written again."""
    cloudpickle.register_pickle_by_value(sys.modules[finish.__module__])  # executors need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [json.dumps(finish(json.loads(t)), separators=(",", ":")) for t in batch.column(column).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(new, pa.string()))

    return rows.mapInArrow(run, rows.schema)
