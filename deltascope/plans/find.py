"""What a user of a published schedule types into its search box: an address or a part of a name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.operators import search
from deltascope.sources.label_files import exists

ADDRESS = re.compile(r"0x[0-9a-f]{40}")


def write_lookup(index: DataFrame, accounts: DataFrame, folder: str) -> None:
    """The tables that find() reads: the name index, and the collapsed accounts sorted by address."""
    search.write_index(index, folder)
    accounts.repartitionByRange("account").sortWithinPartitions("account").write.mode("overwrite").parquet(f"{folder}/accounts")


def find(spark: SparkSession, schedule: str, text: str, most: int = 20) -> tuple[str, DataFrame]:
    """kind and rows: of an address, its shard's file (shard: value, the JSON text) or its collapsed account (collapsed), else none; of a name,
    the entries that have it in label or owner (one or many, at most `most` rows, by footprint), else none.

    schedule: the folder that a run wrote. An address opens one file, or the row groups of accounts that can hold it; a name opens its postings.
    """
    wanted = text.strip().lower()
    if ADDRESS.fullmatch(wanted):
        shard = f"{schedule}/affected/{wanted}.json"
        if exists(spark, shard):
            return "shard", spark.read.text(shard, wholetext=True)
        account = spark.read.parquet(f"{schedule}/_search/accounts").filter(F.col("account") == wanted)
        return ("none" if account.isEmpty() else "collapsed"), account
    found = search.search(spark, f"{schedule}/_search", [text], most)
    return found.first()["kind"], found.select(F.explode("hits").alias("hit")).select("hit.*").drop("place")
