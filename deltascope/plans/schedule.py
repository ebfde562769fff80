"""One schedule's run: stage the inputs once, then every published document."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions import predicates as P
from deltascope.model import GROUPS
from deltascope.operators import bytecode, clusters, config, forensics, hist, labels as L, mixes, partition, shards, states, versioned
from deltascope.plans.find import write_lookup
from deltascope.sources import document_sink as sink, staging, state_store, tables
from deltascope.sources.documents import collected, finished, write_document
from deltascope.sources.label_files import read_labels
from deltascope.sources.optional import optional


def stage_blocks(coverage: DataFrame, divergence: DataFrame, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Per-block partition, written once, or for some buckets anew; a block with two coverage rows or lost transactions raises."""
    partition.require_single_rows(coverage)
    bucket = F.floor(F.col("block_number") / tables.BUCKET)
    some = (lambda df: df) if buckets is None else (lambda df: df.filter(bucket.isin(buckets)))
    blocks = tables.stage(partition.assemble(some(coverage), partition.block_groups(some(divergence))), path, buckets)
    partition.require_retained(some(blocks), some(divergence))
    for name, broken in (("blocks that break the partition", partition.violations(some(blocks))), ("rows whose success and multiplier disagree", partition.multiplier_leaks(some(divergence)))):
        n = broken.count()
        if n:
            print(f"{n} {name}")
    return blocks


def stage_run(spark: SparkSession, table, staged: str, schedule: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replayed transactions, and the states of blocks (by day) and of gas-only summaries, staged by bucket under a folder.

    Only buckets whose coverage or summary rows are not those of the last run into the folder are read; they are held against the
    coverage's counts, read again if short, and overwritten alone, as are their states. Ledgers of what was read are
    written last, so a run that broke off reads its buckets again.
    """
    coverage = tables.held(tables.latest_coverage(table("gas_analysis_block_coverage")), "coverage")
    partition.require_single_rows(coverage)
    ledgers = {"coverage": tables.held(staging.ledger(state_store.bucketed(coverage)), "ledger")}
    before = staging.kept_ledger(spark, f"{staged}/coverage")
    buckets = state_store.stale(ledgers["coverage"], before)
    whole = before is None
    source = tables.read_divergence(table("gas_analysis_divergence"))

    def read(asked: list[int]) -> DataFrame:
        ends = (min(asked) * tables.BUCKET, (max(asked) + 1) * tables.BUCKET - 1) if asked else (0, -1)
        return state_store.bucketed(source.filter(F.col("block_number").between(*ends))).filter(F.col("block_bucket").isin(asked))

    rows, _ = staging.stage_checked(read, staging.expected_rows(coverage), f"{staged}/divergence", only=None if whole else buckets)
    blocks = stage_blocks(coverage, rows, f"{staged}/blocks", None if whole else buckets)
    state_store.refresh(blocks, states.BLOCKS, f"{staged}/block-states", buckets, schedule, by=["day"])
    summary = state_store.bucketed(tables.latest_coverage(table("gas_analysis_block_summary")))
    ledgers["summary"] = tables.held(staging.ledger(summary), "ledger")
    of_summary = state_store.stale(ledgers["summary"], staging.kept_ledger(spark, f"{staged}/summary"))
    check_summary(summary.filter(F.col("block_bucket").isin(of_summary)))
    state_store.refresh(summary.filter("class = 'gas_only'"), states.SUMMARY, f"{staged}/summary-states", of_summary, schedule)
    for name, ledger in ledgers.items():
        staging.keep_ledger(ledger, f"{staged}/{name}")
    read_states = lambda n: state_store.read_states(spark, f"{staged}/{n}-states", schedule)
    return rows.drop("block_bucket"), read_states("block"), read_states("summary").withColumn("class", F.lit("gas_only"))


def check_summary(summary: DataFrame) -> None:
    """Say how many block summaries have mixes that don't add up."""
    n = partition.summary_violations(summary).count()
    if n:
        print(f"{n} block summaries whose mixes differ from their transactions")


def group_documents(divergence: DataFrame, summary: DataFrame, state_flavour: bool) -> dict[str, dict]:
    """The documents of categories, gas histograms, failure sites and examples, as JSON values."""
    g2 = forensics.g2_categories(divergence) | {"aggregate": partition.aggregate_mixes(summary)}
    several = lambda d: {k: collected(v) for k, v in d.items()}
    gas = {"2": {"gas_bins": collected(hist.gas_histogram(summary.filter("class = 'gas_only'"), "gas_delta_log2_hist", divergence.filter(P.G2_DRILLIN))), "figures": collected(forensics.gas_view(divergence, summary))}}
    pct = summary.filter("class = 'gas_only'").agg(hist.sum_arrays_fixed(hist.resize(F.col("gas_delta_pct_hist"), len(P.PERCENT_EDGES)), len(P.PERCENT_EDGES)).alias("h"))
    gas["2"]["pct_bins"] = collected(pct.select(F.posexplode("h").alias("bin", "count")))
    gas["2"]["pct_cohort"] = "gas_only"
    gas["2"]["pct_covered_count"] = sum(b["count"] for b in gas["2"]["pct_bins"])
    for key, pred in (("3", P.G3), ("4", P.G4)):
        view = gas[key] = several(forensics.signed_view(divergence.filter(pred)))
        view["pct_cohort"] = "drillin"
        view["pct_covered_count"] = sum(b["count"] for b in view["pct_bins"])
        view["pct_excluded_count"] = view["figures"][0]["count"] - view["pct_covered_count"]
    categories = {"g2": several(g2), "g3": several(forensics.g3_categories(divergence, state_flavour)), "g4": several(forensics.g4_categories(divergence, state_flavour))}
    return {"gas_hist": {"groups": gas}, "group_categories": categories, "examples": {"rows": collected(forensics.examples(divergence))}}


def structural_probes(divergence: DataFrame, structure: tuple[DataFrame, DataFrame, DataFrame] | None) -> DataFrame | None:
    """Label records of the contracts on the leaderboard from their code and slots (reads, diffs, codes); None without these."""
    if structure is None:
        return None
    asked = mixes.mix(divergence.filter(f"({P.G4}) AND {P.OOG}"), F.col("oog_contract"), mixes.BOARD).select(F.col("key").alias("address"))
    return bytecode.classify(bytecode.structural_inputs(asked, *structure))


def failure_documents(divergence: DataFrame, names: DataFrame, denominators: DataFrame | None, probes: DataFrame | None = None) -> dict[str, dict]:
    out = {}
    for name, oog in (("oog_forensics", True), ("nonoog_forensics", False)):
        parts = forensics.failure_site(divergence, oog, names, denominators, probes)
        links = parts.pop("flow").collect()  # at most 11 x 11
        doc = {k: collected(v, 6, keep_nulls=k != "contract_leaderboard") for k, v in parts.items()}
        doc["call_depth_uncovered"] = doc["total"][0]["n"] - sum(b["count"] for b in doc["call_depth_hist"])
        out[name] = doc | {"sankey": mixes.flow_document(links, "halt" if oog else "revert")}
    rows = forensics.contract_failures(divergence)
    few = F.broadcast(rows.select("recipient"))
    for column in ("divergence_contract", "oog_contract"):
        mix = forensics.counterparts(divergence.join(few, "recipient", "left_semi"), column).withColumnRenamed("mix", f"{column}_mix")
        rows = rows.join(mix, "recipient", "left")
    out["contract_failures"] = {"contracts": collected(rows.orderBy(F.desc("g4_tx_count"), "recipient"))}
    return out


def shard_tables(divergence: DataFrame, names: DataFrame, denominators: DataFrame | None, selectors: DataFrame | None, probes: DataFrame | None = None) -> dict[str, DataFrame]:
    """index, shards (one nested row per contract, as published) and deploy (contract); empty g4 gives empty tables."""
    g4 = divergence.filter(P.G4)
    deploy = tables.held(clusters.deploy_accounts(g4, clusters.searchable(names)), "deploy")
    own = tables.held(clusters.roles(g4).join(deploy, "contract", "left_anti").select("contract", *clusters.ROLED), "roled")
    counts = tables.held(clusters.role_counts(own), "role-counts")
    found = tables.held(clusters.failure_clusters(own), "clusters")
    rates = None if denominators is None else clusters.failure_rates(counts, denominators)
    nested = shards.shards(found, counts, clusters.context_figures(own, divergence), tables.held(clusters.top_values(clusters.value_counts(own)), "top-values"), names, selectors, rates, probes)
    return {"index": clusters.index(counts, names, deploy), "shards": nested, "deploy": deploy}


def affected_tables(divergence: DataFrame, names: DataFrame, denominators: DataFrame | None, selectors: DataFrame | None, probes: DataFrame | None = None) -> dict[str, DataFrame]:
    """shard_tables and the parts of the collapsed document."""
    parts = shard_tables(divergence, names, denominators, selectors, probes)
    g4, deploy = divergence.filter(P.G4), parts["deploy"]
    collapsed = clusters.deploy_summary(g4, deploy)
    entries = collapsed["top_entry_contracts"].withColumnRenamed("key", "contract")
    collapsed["top_entry_contracts"] = shards.named(entries, "contract", shards.records(names), "label", "category").orderBy(F.desc("count"), "contract")
    return {**parts, **{f"deploy_{k}": v for k, v in collapsed.items()}}


EXPLAINER = "New contract accounts, without a name and entered by no transaction, that run out of gas in their own construction. Their shards would be alike, so they stand together here."
NOTE = "Contracts that a name search can find, by footprint. Every other affected contract has its shard or its place among the collapsed accounts."


def write_affected(parts: dict[str, DataFrame], folder: str, head: dict | None = None) -> int:
    """One shard per contract, index.json and deploy_oog.json, in one commit and in place of what the folder held; returns the number of shards.

    head: what both documents begin with (schedule, range, total).
    """
    text = lambda x: json.dumps(x, separators=(",", ":"), default=str)
    whole = lambda df, *left_out: F.to_json(F.struct(*[c for c in df.columns if c not in left_out]), {"ignoreNullFields": "false"})
    nested, index, accounts, head = parts["shards"], parts["index"], parts["deploy_accounts"], head or {}
    written = tables.held(finished(nested.select("address", whole(nested).alias("body")), "body", shards.document), "shard-texts")
    n, collapsed = written.count(), parts["deploy"].count()
    figures = parts["deploy_figures"].first()
    shown = {"halt_opcode_split": ("key", "count"), "initcode_families": ("key", "count"), "top_entry_contracts": ("contract", "label", "category", "count"), "revert_reasons": ("key", "count")}
    aggregate = {k: collected(parts[f"deploy_{k}"].select(*columns)) for k, columns in shown.items()}
    aggregate |= {"gas_delta": {k: figures[f"gas_{k}"] for k in ("p50", "p90", "min", "max")}, "drivers": shards.known(figures["drivers"] and figures["drivers"].asDict(recursive=True))}
    first = head | {"affected_count": n + collapsed, "deploy_oog": {"count": collapsed, "file": "deploy_oog.json"}, "note": NOTE}
    second = {"class": "deploy_oog"} | head | {"count": collapsed, "explainer": EXPLAINER, "aggregate": aggregate}
    quoted = F.concat(F.lit('"'), F.col("account"), F.lit('":'))  # addresses need no escapes
    rows = [
        sink.whole(written, F.col("address"), F.col("body")),
        sink.frame(nested.sparkSession, "index", text(first)[:-1] + ',"contracts":[', "]}"),
        sink.items(index, "index", -F.col("footprint"), F.col("address"), F.to_json(F.struct(*[c for c in index.columns if c != "footprint"]))),
        sink.frame(nested.sparkSession, "deploy_oog", text(second)[:-1] + ',"accounts":{', "}}"),
        sink.items(accounts, "deploy_oog", F.lit(0), F.col("account"), F.concat(quoted, whole(accounts, "account"))),
    ]
    sink.write_folder(reduce(DataFrame.unionByName, rows), folder)
    return n


CHAIN = 1
TRUNCATED = "Truncated blocks keep no drill-in rows beyond the producer's limit, so the Unknown group is larger there: read it as a gap in coverage."


def run_manifest(spark: SparkSession, warehouse: str, configuration: str) -> dict | None:
    """commit and manifest (any JSON value) of the newest run of a configuration; None without one."""
    runs = tables.read_table(spark, warehouse, "gas_analysis_run").filter((F.col("chain_id") == CHAIN) & (F.col("analysis_config_hash") == configuration))
    newest = config.manifest_fields(versioned.latest_runs(runs), {}).select("producer_git_commit", "updated_at", F.to_json("manifest").alias("manifest")).first()
    return None if newest is None else {"producer_git_commit": newest[0], "updated_at": str(newest[1]), "run": json.loads(newest[2]) if newest[2] else None}


def meta_document(row: dict, schedule: str, schedules: list[str], configuration: str, chosen: str, manifest: dict | None) -> dict:
    """The run's metadata as published, from states.meta's row."""
    n, truncated = row["n_blocks"], row["truncated_blocks"]
    return {
        "schedule": schedule, "schedules_available": schedules, "analysis_config_hash": configuration, "chain_id": CHAIN, "generated_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "block_range": {"start": row["block_start"], "end": row["block_end"], "count": row["block_count"]},
        "date_range": {"start": row["day_start"], "end": row["day_end"]},
        "totals": {k: row[k] for k in ("tx_count", *partition.PARTS, "rescues")},
        "group_labels": GROUPS,
        "truncation": {"drill_ins_truncated_blocks": truncated, "total_blocks": n, "truncated_share": row["truncated_share"] or 0.0, "note": TRUNCATED},
        "manifest": {"schedule_name": schedule, "config_selected_by": chosen} | (manifest or {}),
    }


def run_schedule(spark: SparkSession, warehouse: str, out: str, schedule: str, configuration: str, blocks: tuple[int, int], label_path: str | None = None, state_flavour: bool = True, selector_path: str | None = None, schedules: list[str] | None = None, chosen: str = "override") -> None:
    """Read one schedule's tables from the warehouse folder, write its documents under out/schedule.

    Optional sources are evaluated before they are used, so a broken one costs its own figures alone: transactions (denominators of rates),
    selector_path (signatures), storage_reads, storage_diffs and contract_codes (structural tags), and the run table (manifest).
    """
    table = lambda n: tables.pinned(tables.read_table(spark, warehouse, n), configuration, schedule, blocks)
    plain_table = lambda n: tables.read_table(spark, warehouse, n)
    divergence, block_states, summary = stage_run(spark, table, f"{out}/_staged/{schedule}", schedule)
    names = read_labels(spark, label_path) if label_path else L.manual_labels(spark)
    counts = clusters.role_counts(clusters.roles(divergence.filter(P.G4)))
    asked = lambda: clusters.probe_set(counts, clusters.searchable(names)).select(F.col("contract").alias("addr"))
    denominators = optional("denominators", lambda: tables.held(tables.denominators(plain_table("canonical_execution_transaction"), tables.held(asked(), "asked"), blocks), "denominators"))
    selectors = optional("selectors", lambda: tables.held(L.selector_cache(spark.read.parquet(selector_path), "first_seen"), "selectors")) if selector_path else None
    inputs = ("storage_reads", "storage_diffs", "contract_codes")
    probes = optional("structural tags", lambda: tables.held(structural_probes(divergence, tuple(plain_table(n) for n in inputs)), "probes"))
    manifest = optional("manifest", lambda: run_manifest(spark, warehouse, configuration))
    meta = meta_document(collected(states.meta(block_states))[0], schedule, schedules or [schedule], configuration, chosen, manifest)
    documents = {"meta": meta, "overview": {"series": collected(states.overview(block_states), limit=100_000)}}
    documents |= group_documents(divergence, summary, state_flavour) | failure_documents(divergence, names, denominators, probes)
    for name, doc in documents.items():
        write_document({"schedule": schedule} | doc, f"{out}/{schedule}/{name}.json")
    head = {"schedule": schedule, "block_range": {"start": blocks[0], "end": blocks[1]}, "g4_total": meta["totals"]["g4"]}
    parts = affected_tables(divergence, names, denominators, selectors, probes)
    write_affected(parts, f"{out}/{schedule}/affected", head)
    write_lookup(parts["index"], parts["deploy_accounts"], f"{out}/{schedule}/_search")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Compare schedules over a window of blocks and write their documents.")
    p.add_argument("warehouse"), p.add_argument("out"), p.add_argument("--schedules", nargs="+", required=True)
    p.add_argument("--config"), p.add_argument("--start", type=int), p.add_argument("--end", type=int), p.add_argument("--full", action="store_true"), p.add_argument("--labels"), p.add_argument("--selectors")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = config.resolve(config.coverage_by_config(tables.read_table(spark, a.warehouse, "gas_analysis_block_coverage")), a.schedules, a.config)
    blocks = config.window(found, a.start, found.hi if a.full and a.end is None else a.end)
    for s in a.schedules:
        with tables.scratch(spark):
            run_schedule(spark, a.warehouse, a.out, s, found.configs[s], blocks, a.labels, selector_path=a.selectors, schedules=a.schedules, chosen=found.chosen)


if __name__ == "__main__":
    main()
