"""Which configuration a run reads: coverage by configuration, ranking, common range."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("analysis_config_hash", "schedule_name")


def coverage_by_config(coverage: DataFrame) -> DataFrame:
    """Per configuration and schedule: distinct blocks, range and newest time."""
    one = coverage.groupBy(*KEYS, "block_number").agg(F.max("updated_at").alias("at"))
    return one.groupBy(*KEYS).agg(F.count("*").alias("blocks"), F.min("block_number").alias("min_block"), F.max("block_number").alias("max_block"), F.max("at").alias("updated_at"))


def ranked_configs(by_config: DataFrame, schedules: list[str]) -> DataFrame:
    """Configurations that cover all schedules, by blocks, then recency (no time is oldest), then name."""
    full = by_config.filter(F.col("schedule_name").isin(*schedules)).groupBy("analysis_config_hash").agg(F.size(F.collect_set("schedule_name")).alias("n"), F.sum("blocks").alias("blocks"), F.max("updated_at").alias("updated_at"))
    return full.filter(F.col("n") == len(set(schedules))).drop("n").orderBy(F.desc("blocks"), F.desc_nulls_last("updated_at"), "analysis_config_hash")


def best_per_schedule(by_config: DataFrame) -> DataFrame:
    """The fallback: each schedule's own best configuration."""
    order = Window.partitionBy("schedule_name").orderBy(F.desc("blocks"), F.desc_nulls_last("updated_at"), "analysis_config_hash")
    return by_config.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def common_range(by_config: DataFrame) -> DataFrame:
    """The blocks that all rows share; lo > hi says that there are none."""
    return by_config.agg(F.max("min_block").alias("lo"), F.min("max_block").alias("hi"))


def manifest_fields(runs: DataFrame, fields: dict[str, tuple[str, str]], column: str = "manifest_json") -> DataFrame:
    """runs with manifest, its JSON as a VARIANT (null where it is none), manifest_kind, the type it has there, and named fields of it.

    fields: path and type by name. Manifests need not agree: a field that one lacks, or has as what can't be read as the type, is null there.
    """
    read = runs.withColumn("manifest", F.try_parse_json(column))
    picked = {n: F.try_variant_get("manifest", path, kind) for n, (path, kind) in fields.items()}
    return read.withColumns({"manifest_kind": F.schema_of_variant("manifest")} | picked)


@dataclass(frozen=True)
class Resolution:
    configs: dict[str, str]
    shared: bool
    lo: int | None
    hi: int | None
    #: How the configurations were chosen: override, shared or best_per_schedule.
    chosen: str = field(default="override", compare=False)


def resolve(by_config: DataFrame, schedules: list[str], override: str | None = None) -> Resolution:
    """The configuration of each schedule: the override, else one that covers all, else each schedule's best."""
    chosen = "override"
    if override:
        configs = dict.fromkeys(schedules, override)
    elif first := ranked_configs(by_config, schedules).first():
        chosen = "shared"
        configs = dict.fromkeys(schedules, first["analysis_config_hash"])
    else:
        chosen = "best_per_schedule"
        configs = {r["schedule_name"]: r["analysis_config_hash"] for r in best_per_schedule(by_config).collect() if r["schedule_name"] in schedules}
    if missing := [s for s in schedules if s not in configs]:
        raise ValueError(f"no configuration covers {', '.join(missing)}")
    hit = F.lit(False)
    for s, c in configs.items():
        hit = hit | ((F.col("schedule_name") == s) & (F.col("analysis_config_hash") == c))
    lo, hi = common_range(by_config.filter(hit)).first()
    return Resolution(configs, len(set(configs.values())) == 1, lo, hi, chosen)


def window(resolution: Resolution, start: int | None = None, end: int | None = None, default: int = 2000) -> tuple[int, int]:
    """The block window of a run, inside the common range; without limits, the first default blocks."""
    if resolution.lo is None or resolution.lo > resolution.hi:
        raise ValueError("the schedules have no blocks in common")
    lo = resolution.lo if start is None else max(start, resolution.lo)
    hi = min(lo + default - 1 if end is None else end, resolution.hi)
    if lo > hi:
        raise ValueError(f"blocks {start} to {end} lie outside {resolution.lo} to {resolution.hi}")
    return lo, hi
