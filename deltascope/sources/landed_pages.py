"""Pages of a cursor interface as a table: the files that a fetcher has landed, a partition each, or some to a partition where they are many.

A page is a JSON file {"since": cursor, items: [...]}: what came after the cursor (null for the first page), in its order; its own last
cursor is where the next page begins. ``read_pages`` gives a row for each item, and a row with an error for a page that can't be
read; ``faults`` tells from the pages' cursors alone which came twice and where one is missing.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from deltascope.sources import document_sink

#: Partitions up to which each page is its own, and the bytes that pages of one partition have together at most (a page alone may have more).
PARTITIONS, BYTES = 256, 64 << 20
SCHEMA = "page string, since string, last string, n_items int, place int, item string, error string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


class LandedPages(DataSource):
    """spark.read.format("landed_pages").option("items", name).option("cursor", name).load(folder): folder is a path or URI that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = ChoosingReader if self.options.get("push", "false") == "true" else PageReader
        return kind(document_sink.as_uri(self.options["path"]), self.options.get("items", "items"), self.options.get("cursor", "time"))


class PageReader(DataSourceReader):
    def __init__(self, uri: str, items: str, cursor: str) -> None:
        self.uri, self.items, self.cursor, self.only = uri, items, cursor, None

    def partitions(self) -> list[InputPartition]:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.uri)
        found = fs.get_file_info(pyarrow.fs.FileSelector(at))
        pages = sorted((f.base_name, f.size or 0) for f in found if f.is_file and f.extension == "json" and not f.base_name.startswith("."))
        pages = [p for p in pages if self.only is None or p[0].removesuffix(".json") in self.only]
        most, groups, held = -(-len(pages) // PARTITIONS), [[]], 0
        for name, size in pages:
            if groups[-1] and (len(groups[-1]) == most or held + size > BYTES):
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in partition.value:
            yield from self.page(file)

    def page(self, file: str) -> list[tuple]:
        name = file.removesuffix(".json")
        fs, at = pyarrow.fs.FileSystem.from_uri(self.uri)
        text = lambda x: None if x is None else str(x)
        try:
            with fs.open_input_stream(f"{at}/{file}") as f:
                page = json.loads(f.read().decode())
            rows = page[self.items]
            since, last = text(page["since"]), text(rows[-1][self.cursor]) if rows else None
            out = [(name, since, last, len(rows), i, json.dumps(r), None) for i, r in enumerate(rows)]
        except (ValueError, KeyError, TypeError, AttributeError) as e:  # what a page that is broken off or of another shape gives
            return [(name, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        return out or [(name, since, None, 0, None, None, None)]


class ChoosingReader(PageReader):
    """A reader for sessions that push filters to Python sources (Spark refuses it in others)."""

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on the page's name choose files; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("page",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f


def read_pages(spark: SparkSession, folder: str, items: str, cursor: str) -> DataFrame:
    """page, since, last, n_items, place, item (JSON text), error of all pages in a folder; an empty page is a row without an item."""
    spark.dataSource.register(LandedPages)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("landed_pages").option("push", push).option("items", items).option("cursor", cursor).load(folder)


def pages_of(rows: DataFrame) -> DataFrame:
    """page, since, last, n_items, error, digest (of all items in order): one row a page."""
    text = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]), "\n"), 256)
    return rows.groupBy("page").agg(F.first("since").alias("since"), F.first("last").alias("last"), F.first("n_items").alias("n_items"), F.first("error").alias("error"), text.alias("digest"))


def faults(pages: DataFrame) -> DataFrame:
    """page, fault, at: pages that are broken, doubled (as an earlier one by name, with the same cursor) or preceded by a gap (no page ends at their cursor).

    pages: pages_of, stored. A gap after a broken page is the broken page's.
    """
    broken = pages.filter("error is not null").select("page", F.lit("broken").alias("fault"), F.col("error").alias("at"))
    good = pages.filter("error is null")
    order = Window.partitionBy("since").orderBy("page")
    twice = good.withColumn("n", F.row_number().over(order)).filter("n > 1").select("page", F.lit("doubled").alias("fault"), F.col("since").alias("at"))
    ends = good.filter("last is not null").select(F.col("last").alias("since")).distinct()
    gaps = good.filter("since is not null").join(ends, "since", "left_anti").select("page", F.lit("missing before").alias("fault"), F.col("since").alias("at"))
    return broken.unionByName(twice).unionByName(gaps)


def items_of(rows: DataFrame, kind: str) -> DataFrame:
    """The items of all readable pages, read by a DDL type, those of a doubled page once: page, place and the item's fields."""
    good = rows.filter("item is not null")
    first = good.groupBy("since").agg(F.min("page").alias("page"))
    own = good.join(first.select(F.col("since").alias("_since"), F.col("page").alias("_page")), F.col("since").eqNullSafe(F.col("_since")) & (F.col("page") == F.col("_page")), "left_semi")
    return own.select("page", "place", F.from_json("item", kind).alias("x")).select("page", "place", "x.*")
