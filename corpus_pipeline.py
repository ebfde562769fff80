"""A training corpus from documents: five stages, each reading what the one before kept.

Every stage takes empty tables (and returns none of any row), repeated rows and ids, texts of any length, nulls in
every column, and further columns of any name, which all but the last carry along. What it does with each is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import language_id, mixing, ngram_join, secrets, sp_codec
from deltascope.llm.common import any_names, new_path, prepare, scratch

#: A document whose n-grams are known to this share in no language has no known language.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; the others stay as they are.

    Null texts and texts without a letter have none. The languages are learned from the rows that name one; with no such row all go.
    """
    prepare(spark)
    return language_id.keep_identified(docs, language_id.fit(docs, F.lit(True)), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with similarity 0.8 or more, the smallest doc_id stays.

    Copies of that row go, too; other texts under its id are judged by themselves. Null texts, texts without words and rows without an id stay.
    """
    prepare(spark)
    return ngram_join.keep_one(docs, width=5, threshold=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and n_chars follows. Rows without one, null texts among them, stay as they are."""
    prepare(spark)
    return _redacted(docs)


@any_names("text", "n_chars")
def _redacted(docs: DataFrame) -> DataFrame:
    found = secrets.find_secrets(docs, docs.columns)
    clean, hit = secrets.redacted(F.col("carried")["text"], F.col("spans")), F.size("spans") > 0
    found = found.select("carried", clean.alias("clean"), hit.alias("hit"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried")["n_chars"])
    return found.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those that it takes no copy of go.

    Null is a source of its own. Of a document without words, the mix takes the whole copies of its source alone.
    """
    prepare(spark)
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix; null and empty texts have none. The last stage: it returns ids and figures, and carries no other column."""
    prepare(spark)
    return sp_codec.encode_documents(docs).select("doc_id", "ids", "n_pieces", "ids_sha256", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Models and random draws can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
