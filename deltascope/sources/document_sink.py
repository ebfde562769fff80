"""A folder of JSON documents as one commit: tasks write files beside the folder, which is exchanged when all are done.

Rows are file, kind (HEAD, ITEM or TAIL), place, tie, body: a file is its rows' bodies in order of kind, place and tie, with commas
between items, so a document of any size is streamed by the one task that has its rows. Nothing but counts reaches the driver. A task
that runs twice writes the same file twice, by rename. When any task fails, the folder stays as it was.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

HEAD, ITEM, TAIL = 0, 1, 2
SCHEMA = "file string, kind int, place bigint, tie string, body string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def as_uri(path: str) -> str:
    return path if ":" in path.split("/", 1)[0] else f"file://{os.path.abspath(path)}"


@dataclass
class Written(WriterCommitMessage):
    files: int


class DocumentSink(DataSource):
    """df.write.format("documents").mode("overwrite").save(folder): folder is a path or URI that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a folder of documents is only written whole: use mode('overwrite')")
        return DocumentWriter(as_uri(self.options["path"]))


class DocumentWriter(DataSourceWriter):
    def __init__(self, uri: str) -> None:
        self.uri, self.beside = uri.rstrip("/"), f"{uri.rstrip('/')}.next-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.beside)
        fs.create_dir(at, recursive=True)
        out, own, name, after, files = None, "", None, False, 0

        def close() -> None:
            out.close()
            fs.move(own, f"{at}/{name}.json")

        for file, kind, _, _, body in rows:
            if file != name:
                if out is not None:
                    close()
                name, after, files = file, False, files + 1
                own = f"{at}/.{name}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own, buffer_size=1 << 20)
            out.write((b"," if after and kind == ITEM else b"") + body.encode())
            after = kind == ITEM
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, new = pyarrow.fs.FileSystem.from_uri(self.beside)
        now = pyarrow.fs.FileSystem.from_uri(self.uri)[1]
        fs.create_dir(new, recursive=True)
        old = f"{new}.old"
        there = fs.get_file_info(now).type != pyarrow.fs.FileType.NotFound
        if there:
            fs.move(now, old)
        fs.move(new, now)
        if there:
            fs.delete_dir(old)

    def abort(self, messages: list) -> None:
        fs, new = pyarrow.fs.FileSystem.from_uri(self.beside)
        if fs.get_file_info(new).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(new)


def whole(rows: DataFrame, file: Column, body: Column) -> DataFrame:
    """A document a row."""
    return rows.select(F.lower(file).alias("file"), F.lit(HEAD).alias("kind"), F.lit(0).cast("bigint").alias("place"), F.lit("").alias("tie"), body.alias("body"))


def items(rows: DataFrame, file: str, place: Column, tie: Column, body: Column) -> DataFrame:
    """The items of one document, in order of place and tie."""
    return rows.select(F.lit(file).alias("file"), F.lit(ITEM).alias("kind"), place.cast("bigint").alias("place"), tie.alias("tie"), body.alias("body"))


def frame(spark: SparkSession, file: str, head: str, tail: str) -> DataFrame:
    """What stands before and after a document's items."""
    return spark.createDataFrame([(file, HEAD, 0, "", head), (file, TAIL, 0, "", tail)], SCHEMA)


def write_folder(rows: DataFrame, folder: str) -> None:
    """Write all documents of rows into folder, in place of what it held."""
    rows.sparkSession.dataSource.register(DocumentSink)
    own = rows.select("file", "kind", "place", "tie", "body").repartition("file").sortWithinPartitions("file", "kind", "place", "tie")
    own.write.format("documents").mode("overwrite").save(folder)
