"""Labels from all sources: each is normalised to a table of its own in the cache folder, then all are merged."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.operators import bytecode, labels as L
from deltascope.sources import label_files, landed_pages
from deltascope.sources.optional import optional
from deltascope.sources.tables import held

#: Tags of attestations that the labels use.
TAGS = ["contract_name", "usage_category", "owner_project", "is_proxy", "is_factory_contract", "is_safe_contract", "is_paymaster", "is_bundler", "erc_type"]
ATTESTATION = "recipient string, revoked boolean, time string, tags map<string,string>"
#: Tables of the cache folder, by source, and the merged one.
CACHES = ("oli", "dune", "ethlists", "mev", "heuristic")
MERGED = "contract_labels.parquet"


def readers(spark: SparkSession, landed: str) -> dict[str, Callable[[], DataFrame]]:
    """For each source, how its landed rows in a folder become label records."""
    table = lambda n: spark.read.parquet(f"{landed}/{n}.parquet")

    def attestations() -> DataFrame:
        """The landed table or, where there is none, landed pages; their faults are said."""
        if label_files.exists(spark, f"{landed}/attestations.parquet"):
            return table("attestations")
        rows = held(landed_pages.read_pages(spark, f"{landed}/attestations", "attestations", "time"), "pages")
        for f in landed_pages.faults(held(landed_pages.pages_of(rows), "page-ends")).orderBy("page").limit(20).collect():
            print(f"attestations, page {f['page']}: {f['fault']} {f['at']}")
        return landed_pages.items_of(rows, ATTESTATION)

    def structural() -> DataFrame:
        return bytecode.classify(bytecode.structural_inputs(table("addresses"), table("storage_reads"), table("storage_diffs"), table("contract_codes")))

    def registries() -> DataFrame:
        return label_files.registry_contracts(spark, f"{landed}/registry/contracts").unionByName(label_files.registry_tokens(spark, f"{landed}/registry/tokens"))

    return {
        "oli": lambda: L.attested_labels(L.collapse_attestations(attestations(), TAGS)),
        "dune": lambda: L.curated_labels(table("curated")),
        "ethlists": registries,
        "mev": lambda: L.mev_labels(table("mev")),
        "heuristic": structural,
    }


def normalise(spark: SparkSession, landed: str, cache: str, sources: tuple[str, ...] = CACHES) -> None:
    """Write the cache table of each source that has landed; one that hasn't keeps the table it had."""
    for name in sources:
        optional(f"labels from {name}", lambda: label_files.write_labels(readers(spark, landed)[name](), f"{cache}/{name}.parquet"))  # noqa: B023


def merged(spark: SparkSession, cache: str) -> DataFrame:
    """The cache tables that exist and the names given by hand, one record per address; a record outside the enumerations raises."""
    known = label_files.read_sources(spark, [f"{cache}/{n}.parquet" for n in CACHES]).unionByName(L.manual_labels(spark))
    wrong = L.invalid(known).limit(5).collect()
    if wrong:
        raise ValueError(f"records outside the enumerations: {[r.asDict() for r in wrong]}")
    return L.merge_labels(known)


def build(spark: SparkSession, landed: str | None, cache: str) -> DataFrame:
    """Normalise what has landed (if a folder is given), merge, write the merged table and read it back."""
    if landed:
        normalise(spark, landed, cache)
    label_files.write_labels(merged(spark, cache), f"{cache}/{MERGED}")
    return label_files.read_labels(spark, f"{cache}/{MERGED}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build the merged label table.")
    p.add_argument("cache"), p.add_argument("--landed", help="folder with landed rows of the sources")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(build(spark, a.landed, a.cache).count(), "labels")


if __name__ == "__main__":
    main()
