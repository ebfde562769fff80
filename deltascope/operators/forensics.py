"""Published views of the groups: categories, failure sites, failing contracts, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as P
from deltascope.functions.scalars import after_prefix
from deltascope.operators import hist
from deltascope.operators.mixes import flow, leaderboard, mix, mix_fixed, mix_none, mix_per_key, rate_leaderboards, rich_leaderboard, top_and_others

ERROR_PREFIX = "Error(string):"


def _counts(df: DataFrame, **predicates: str) -> DataFrame:
    """key, count of each predicate, in order, from one scan."""
    one = df.agg(*[F.count_if(F.expr(p)).alias(k) for k, p in predicates.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("count")) for k in predicates])))


def change_types(divergence: DataFrame) -> DataFrame:
    """Overlapping flags of the g2 drill-in members; trace_only has none of the three."""
    return _counts(divergence.filter(P.G2_DRILLIN), all="true", gas_changed="gas_delta <> 0", event_logs_changed="event_logs_changed", output_changed="output_changed", logs_bloom_changed="logs_bloom_changed", trace_only=P.TRACE_ONLY)


def fixability(divergence: DataFrame) -> DataFrame:
    return _counts(divergence.filter(P.G4), not_gas_fixable="replay_halt_oog = false", still_oog_at_ceiling="replay_halt_oog = true", unknown="replay_halt_oog IS NULL")


def break_reasons(divergence: DataFrame) -> DataFrame:
    """Not a partition: rows whose gas signal is null fall in no bucket."""
    return _counts(divergence.filter(P.G4), oog=P.OOG, non_oog_revert=P.NON_OOG, other=f"NOT {P.OOG} AND status_changed = false")


def status_flips(divergence: DataFrame) -> DataFrame:
    """Within g4 only success_to_fail can occur; the other two keep the published shape."""
    return _counts(divergence.filter(P.G4), success_to_fail="baseline_success AND NOT schedule_success", fail_to_fail="NOT baseline_success AND NOT schedule_success", fail_to_success="NOT baseline_success AND schedule_success")


def reservoir(rows: DataFrame, initial: bool) -> DataFrame:
    """Exhausted true/false, average spillover and, if asked for, average initial reservoir: whole numbers, halves to the even one; averages of nothing are 0."""
    mean = lambda c: F.coalesce(F.rint(F.avg(c)).cast("bigint"), F.lit(0))
    cols = [F.count_if("reservoir_exhausted").alias("exhausted_true"), F.count_if(~F.col("reservoir_exhausted")).alias("exhausted_false"), mean("runtime_state_gas_spillover").alias("avg_spillover")]
    return rows.agg(*cols, *([mean("schedule_initial_reservoir").alias("avg_initial")] if initial else []))


def g2_categories(divergence: DataFrame) -> dict[str, DataFrame]:
    own = divergence.filter(P.G2_DRILLIN)
    return {"change_type_mix": change_types(divergence), "state_driver_mix_drillin": mix_none(own, F.col("state_gas_category"))}


def g3_categories(divergence: DataFrame, state_flavour: bool) -> dict[str, DataFrame]:
    own = divergence.filter(P.G3)
    out = {
        "multiplier_histogram": hist.multiplier_histogram(own),
        "state_gas_category": mix(own, F.col("state_gas_category")),
        "tx_shape_mix": mix_fixed(own, P.tx_shape(), P.TX_SHAPES),
        "tx_type_mix": mix_fixed(own, P.tx_type(), P.TX_TYPES),
        "is_create": _counts(own, true="is_create", false="NOT is_create"),
        "oog_pattern": mix(own, F.col("oog_pattern")),
    }
    return out | ({"reservoir": reservoir(own, False)} if state_flavour else {})


def g4_categories(divergence: DataFrame, state_flavour: bool) -> dict[str, DataFrame]:
    own = divergence.filter(P.G4)
    out = {
        "fixability": fixability(divergence),
        "break_reason": break_reasons(divergence),
        "oog_bottleneck_kind": mix(own, F.col("oog_bottleneck_kind")),
        "status_flip": status_flips(divergence),
        "state_gas_category": mix(own, F.col("state_gas_category")),
        "tx_shape_mix": mix_fixed(own, P.tx_shape(), P.TX_SHAPES),
        "tx_type_mix": mix_fixed(own, P.tx_type(), P.TX_TYPES),
    }
    return out | ({"reservoir": reservoir(own, True)} if state_flavour else {})


def percent_of_sums(part: Column, whole: Column) -> Column:
    """Aggregate: 100 times the ratio of the sums; null where there is nothing to divide by."""
    return F.try_divide(100.0 * F.sum(part), F.sum(whole).cast("double"))


def gas_view(divergence: DataFrame, summary: DataFrame) -> DataFrame:
    """The g2 gas figures over both cohorts: sum, min, max, count, and gas-weighted percent of the gas-only cohort."""
    go = summary.filter("class = 'gas_only'").agg(
        percent_of_sums(F.col("gas_delta_sum"), F.col("baseline_gas_used_sum")).alias("pct"),
        F.coalesce(F.sum("tx_count"), F.lit(0)).alias("go_n"), F.coalesce(F.sum("gas_delta_sum"), F.lit(0)).alias("go_sum"), F.min("gas_delta_min").alias("go_min"),
        F.max("gas_delta_max").alias("go_max"), F.coalesce(F.sum("baseline_gas_used_sum"), F.lit(0)).alias("base"),
    )
    dr = divergence.filter(f"({P.G2_DRILLIN}) AND gas_delta <> 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("gas_delta"), F.lit(0)).alias("s"), F.min("gas_delta").alias("mn"), F.max("gas_delta").alias("mx"))
    both = go.withColumn("one", F.lit(1)).join(F.broadcast(dr.withColumn("one", F.lit(1))), "one")
    return both.select(
        (F.col("go_n") + F.col("n")).alias("count"), (F.col("go_sum") + F.col("s")).alias("sum_gas_delta"), F.coalesce(F.least("go_min", "mn"), F.lit(0)).alias("min_gas_delta"), F.coalesce(F.greatest("go_max", "mx"), F.lit(0)).alias("max_gas_delta"),
        F.col("go_sum").alias("sum_gas_delta_gas_only"), F.col("base").alias("baseline_gas_used_sum"), F.col("pct").alias("gas_delta_pct_of_baseline"),
    )


def signed_view(rows: DataFrame) -> dict[str, DataFrame]:
    """Histogram, percentiles, figures and percent bins of g3 or g4 rows."""
    bins = hist.signed_histogram(rows)
    figures = rows.agg(F.count("*").alias("count"), *[F.coalesce(f("gas_delta"), F.lit(0)).alias(f"{n}_gas_delta") for f, n in ((F.sum, "sum"), (F.min, "min"), (F.max, "max"))])
    pct = hist.percent_histogram(rows, P.percent(F.col("gas_delta"), F.col("baseline_gas_used")))
    return {"bins": bins, "percentiles": hist.histogram_percentiles(bins), "figures": figures, "pct_bins": pct}


def revert_errors(rows: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent messages of string reverts, the rest as Others."""
    message = after_prefix(F.col("revert_decoded"), ERROR_PREFIX)
    counts = rows.select(message.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("count"))
    return top_and_others(counts, top).select("key", "count", "rank")


def breadth(rows: DataFrame, *columns: str) -> DataFrame:
    """Exact distinct counts of several columns, one column at a time by partial aggregates."""
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))).filter("value is not null").distinct()
    counts = each.groupBy("column").agg(F.count("*").alias("n"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).alias(c) for c in columns])


def failure_site(divergence: DataFrame, oog: bool, labels: DataFrame, totals: DataFrame | None, probes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything published on where g4 rows ran out of gas (oog) or reverted without; with whole label records, the leaderboard shows all of them."""
    rows = divergence.filter(f"({P.G4}) AND {P.OOG if oog else P.NON_OOG}")
    site, depth = ("oog_contract", "oog_call_depth") if oog else ("divergence_contract", "divergence_call_depth")
    out = {
        "total": rows.agg(F.count("*").alias("n")),
        "breadth": breadth(rows, "recipient", site),
        "opcode": mix(rows, F.col("oog_opcode" if oog else "divergence_opcode")),
        "call_depth_hist": hist.depth_histogram(rows, depth),
        "call_depth_percentiles": hist.percentiles(rows, depth),
        "recipient_leaderboards": rate_leaderboards(rows, "recipient", totals),
        "flow": flow(rows, "recipient", site),
    }
    if oog:
        return out | {"oog_pattern": mix(rows, F.col("oog_pattern")), "gas_remaining_hist": hist.magnitude_histogram(rows, "oog_gas_remaining"), "contract_leaderboard": rich_leaderboard(rows, "oog_contract", labels, probes) if "source" in labels.columns else leaderboard(rows, "oog_contract", labels)}
    return out | {"failure_reason": mix(rows, F.col("failure_reason")), "revert_error_mix": revert_errors(rows)}


def contract_failures(divergence: DataFrame, top: int = 40) -> DataFrame:
    """The recipients with most g4 rows: counts, gas, multipliers, spans, ratios and the running share of all g4 rows."""
    g4 = F.expr(P.G4)
    rows = divergence.filter("recipient is not null")
    own = rows.groupBy("recipient").agg(
        F.count_if(g4).alias("g4_tx_count"), F.count_if(F.expr(P.G3)).alias("g3_tx_count"), F.count_if(F.expr(P.G2_DRILLIN)).alias("g2_drillin_tx_count"), F.count_if(F.expr(P.STATUS_FLIP)).alias("status_flips"),
        F.avg("gas_delta").alias("avg_gas_delta"), F.sum("gas_delta").alias("sum_gas_delta"), F.min("block_number").alias("block_span_start"), F.max("block_number").alias("block_span_end"),
    ).filter("g4_tx_count > 0")
    best = own.orderBy(F.desc("g4_tx_count"), "recipient").limit(top)
    total = divergence.agg(F.count_if(g4).alias("total"))
    running = F.sum("g4_tx_count").over(Window.orderBy(F.desc("g4_tx_count"), "recipient").rowsBetween(Window.unboundedPreceding, 0))  # over top rows
    best = best.withColumn("running", running)
    # percentiles and distinct blocks are computed for the top recipients alone
    few = rows.join(F.broadcast(best.select("recipient")), "recipient", "left_semi")
    p = few.groupBy("recipient").agg(F.percentile("min_multiplier_to_succeed", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"))
    blocks = few.filter(g4).select("recipient", "block_number").distinct().groupBy("recipient").agg(F.count("*").alias("distinct_blocks_with_g4"))
    out = best.join(F.broadcast(p), "recipient", "left").join(F.broadcast(blocks), "recipient", "left").withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    cohort = F.col("g4_tx_count") + F.col("g3_tx_count") + F.col("g2_drillin_tx_count")
    return out.select(
        "recipient", "g4_tx_count", "g3_tx_count", "g2_drillin_tx_count", "status_flips", "avg_gas_delta", "sum_gas_delta", "block_span_start", "block_span_end", "distinct_blocks_with_g4",
        *[F.col("p")[i].alias(f"mm_p{n}") for i, n in enumerate((50, 90, 99))], (F.col("g4_tx_count") / F.col("distinct_blocks_with_g4")).alias("avg_g4_per_block"),
        (F.col("g4_tx_count") / cohort).alias("g4_vs_other_ratio"), F.try_divide(F.col("running").cast("double"), F.col("total").cast("double")).alias("cumulative_share"),
    ).orderBy(F.desc("g4_tx_count"), "recipient")


def pareto(failures: DataFrame) -> DataFrame:
    """rank, share in percent of the running share of contract_failures."""
    rank = F.row_number().over(Window.orderBy(F.desc("g4_tx_count"), "recipient"))  # over the top recipients
    return failures.select(rank.alias("rank"), (100.0 * F.col("cumulative_share")).alias("share"))


def counterparts(divergence: DataFrame, column: str, top: int = 3) -> DataFrame:
    """Each recipient's most frequent sites among its g4 rows, for all recipients at once."""
    return mix_per_key(divergence.filter(P.G4), "recipient", column, top)


def examples(divergence: DataFrame, top: int = 20) -> DataFrame:
    """The g4 and the g3 rows whose gas changed most."""
    cols = ["grp", "block_number", "tx_hash", "gas_delta", "recipient", "min_multiplier_to_succeed"]

    def best(name: str, predicate: str) -> DataFrame:
        return divergence.filter(predicate).withColumn("grp", F.lit(name)).select(*cols).orderBy(F.desc(F.abs("gas_delta")), "block_number", "tx_hash").limit(top)

    return best("g4", P.G4).unionByName(best("g3", P.G3))


def sortable(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Sorted by the column as a number where it is one, else as text; numbers come before texts, nulls last."""
    n = F.col(column).cast("string").try_cast("double")
    text = F.lower(F.col(column).cast("string"))
    return df.orderBy(n.isNull(), F.desc(n) if descending else F.asc(n), F.desc_nulls_last(text) if descending else F.asc_nulls_last(text))
