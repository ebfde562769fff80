"""Label tables as Parquet with an evolving schema, and registries as trees of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.model import LABEL
from deltascope.operators.labels import records


def write_labels(labels: DataFrame, path: str) -> None:
    """All columns in their order; an empty table is written, too."""
    labels.select(*LABEL.names).write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Columns that an older file lacks are null, further ones are left out, order and types are the schema's."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    out = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LABEL.fields]
    return df.select(*out).withColumn("is_mev_bot", F.coalesce("is_mev_bot", F.lit(False))).select(*LABEL.names)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All of the label tables that exist, one after another."""
    out = spark.createDataFrame([], LABEL)
    for p in paths:
        if exists(spark, p):
            out = out.unionByName(read_labels(spark, p))
    return out


def _registry(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """address (the file's name) and doc (null for broken JSON) of every file in the folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)).alias("address"), F.from_json("value", schema).alias("doc"))
    return files.filter("doc is not null")


def _text(*names: str):
    return F.coalesce(*[F.when(F.trim(f"doc.{n}") != "", F.trim(f"doc.{n}")) for n in names])


def registry_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of known projects; files without a project or a name are skipped."""
    df = _registry(spark, folder, "project string, name string").withColumn("who", _text("project", "name")).filter("who is not null")
    return records(df, "ethlists", "medium", address=F.col("address"), label=F.col("who"), category=F.lit("unknown"), owner_project=F.col("who"))


def registry_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens by name, else symbol; files with neither are skipped."""
    df = _registry(spark, folder, "name string, symbol string, type string").withColumn("who", _text("name", "symbol")).filter("who is not null")
    return records(df, "ethlists", "medium", address=F.col("address"), label=F.col("who"), category=F.lit("token"), erc_type=_text("type"))
