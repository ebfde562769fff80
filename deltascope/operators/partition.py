"""The six-way partition of all transactions, per block and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.functions import predicates as P

PARTS = ("g1", "g2", "g3", "g4", "g5", "af")


def block_groups(divergence: DataFrame, key: str = "block_number") -> DataFrame:
    """Per block: drill-in members of g2, g3, g4 and af, rescues, rows and rows beyond distinct row ids."""
    names = {"g2_drillin": P.G2_DRILLIN, "g3": P.G3, "g4": P.G4, "af": P.AF, "rescues": P.RESCUE}
    return divergence.groupBy(key).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in names.items()], F.count("*").alias("n_rows"))


def assemble(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """Coverage left-joined with the drill-in counts: every block closes, g1 + g2 + g3 + g4 + af + g5 = tx_count."""
    return closed(with_groups(coverage, groups.select("block_number", "g2_drillin", "g3", "g4", "af", "rescues")))


def with_groups(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """Coverage left-joined with block_groups, 0 where a block has no rows."""
    names = [c for c in groups.columns if c != "block_number"]
    return coverage.join(groups, "block_number", "left").fillna(0, names)


def closed(j: DataFrame) -> DataFrame:
    """The parts of coverage that with_groups has joined."""
    j = j.withColumn("g1", F.col("tx_count_unchanged")).withColumn("g2", F.col("tx_count_gas_only") + F.col("g2_drillin"))
    rest = F.col("tx_count") - F.col("g1") - F.col("g2") - F.col("g3") - F.col("g4") - F.col("af")
    return j.withColumn("g5", rest.cast("bigint")).withColumn("day", F.to_date("block_timestamp"))


def overview(blocks: DataFrame, by: str = "day") -> DataFrame:
    """Series in time: first and last block, transactions, the parts, rescues and truncated blocks."""
    return blocks.groupBy(by).agg(
        F.min("block_number").alias("block_start"), F.max("block_number").alias("block_end"), F.sum("tx_count").alias("tx_count"),
        *[F.sum(p).alias(p) for p in PARTS], F.sum("rescues").alias("rescues"), F.count_if("drill_ins_truncated").alias("truncated_blocks"),
    ).orderBy(by)


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tx_count", *PARTS, "rescues")])


def meta(blocks: DataFrame) -> DataFrame:
    """Block range (count is the span), day range, totals and the share of truncated blocks."""
    share = F.try_divide(F.count_if("drill_ins_truncated").cast("double"), F.count("*").cast("double"))
    return blocks.agg(
        F.min("block_number").alias("block_start"), F.max("block_number").alias("block_end"), (F.max("block_number") - F.min("block_number") + 1).alias("block_count"),
        F.min("day").alias("day_start"), F.max("day").alias("day_end"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tx_count", *PARTS, "rescues")], share.alias("truncated_share"),
    )


def composition(series: DataFrame, by: str = "day") -> DataFrame:
    """Each part in percent of the bucket's transactions, 0 where there are none."""
    return series.select(by, *[F.coalesce(F.try_divide(100.0 * F.col(p), F.col("tx_count").cast("double")), F.lit(0.0)).alias(f"{p}_pct") for p in PARTS]).orderBy(by)


def violations(blocks: DataFrame) -> DataFrame:
    """Blocks that break an invariant of the partition; empty for sound inputs."""
    stored = F.col("tx_count_unchanged") + F.col("tx_count_gas_only") + F.col("tx_count_stored") != F.col("tx_count")
    kept = F.col("g2_drillin") + F.col("g3") + F.col("g4") + F.col("af") != F.col("retained_drill_in_count")
    return blocks.withColumn("broken", F.concat_ws(",", F.when(stored, "I1"), F.when(kept, "I2"), F.when(F.col("g5") < 0, "I3"))).filter("broken <> ''")


#: The mixes that partition a block summary's transactions.
SUMMARY_VIEWS = {
    "state_driver": ("no_state", "runtime_state"),
    "tx_shape": ("creation", "simple_transfer", "contract_call"),
    "tx_type": ("type_legacy", "type_access_list", "type_dynamic_fee", "type_blob", "type_set_code", "type_other"),
}


def summary_violations(summary: DataFrame) -> DataFrame:
    """Gas-only summaries with a mix (named in broken) that doesn't add up to tx_count; mixes that are null throughout aren't looked at."""
    def off(parts):
        there = F.coalesce(*[F.col(f"tx_count_{p}") for p in parts]).isNotNull()
        return there & (sum((F.coalesce(F.col(f"tx_count_{p}"), F.lit(0)) for p in parts), F.lit(0)) != F.col("tx_count"))

    own = summary.filter("class = 'gas_only'")
    return own.withColumn("broken", F.concat_ws(",", *[F.when(off(ps), v) for v, ps in SUMMARY_VIEWS.items()])).filter("broken <> ''")


def multiplier_leaks(divergence: DataFrame) -> DataFrame:
    """Rows in which success and a multiplier of at most 1 disagree."""
    low = F.coalesce(F.col("min_multiplier_to_succeed") <= 1, F.lit(False))
    return divergence.filter(F.col("schedule_success") != low)


def require_single_rows(coverage: DataFrame) -> None:
    """Raise if a block has more than one coverage row."""
    twice = coverage.groupBy("block_number").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"block {twice[0][0]} has {twice[0][1]} coverage rows")


def require_retained(blocks: DataFrame, divergence: DataFrame) -> None:
    """Raise unless the staged rows are as many as the blocks retained."""
    want, got = blocks.agg(F.coalesce(F.sum("retained_drill_in_count"), F.lit(0))).first()[0], divergence.count()
    if want != got:
        raise ValueError(f"{got} rows are staged, the blocks retained {want}")


def aggregate_mixes(summary: DataFrame) -> DataFrame:
    """The gas-only cohort in one scan: view, key, count. Partitions sum to tx_count; overlay members overlap them."""
    views = SUMMARY_VIEWS | {"overlay": ("authorization", "creation")}
    keys = sorted({k for v in views.values() for k in v})
    one = summary.filter("class = 'gas_only'").agg(F.coalesce(F.sum("tx_count"), F.lit(0)).alias("all"), *[F.coalesce(F.sum(f"tx_count_{k}"), F.lit(0)).alias(k) for k in keys])
    rows = [F.struct(F.lit("total").alias("view"), F.lit("tx_count").alias("key"), F.col("all").alias("count"))]
    rows += [F.struct(F.lit(v).alias("view"), F.lit(k.removeprefix("type_")).alias("key"), F.col(k).alias("count")) for v, ks in views.items() for k in ks]
    return one.select(F.inline(F.array(*rows)))


