"""Every operator as a query over the driver's tables, with the same question in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions import opcodes, predicates as P, scalars as S
from deltascope.operators import breadth as distinct, bytecode, clusters, config, forensics, hist, labels as L, mixes, partition, search, states, versioned
from deltascope.model import DIVERGENCE_COLUMNS
from deltascope.plans.facts import COLUMNS, FACTS_SQL, LABELS_SQL, TOTALS_SQL, VERSION, as_facts, dated_items, facts, labels, latest_items, totals
from deltascope.plans.label_build import TAGS, build
from deltascope.plans.schedule import shard_tables
from deltascope.sources import document_sink as sink, landed_pages as pages, staging, state_store
from deltascope.sources.documents import write_shards
from deltascope.sources.label_files import read_labels, registry_contracts, registry_tokens, write_labels
from deltascope.sources.tables import denominators as source_denominators, held, pinned, read_divergence, read_table, scratch_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, *ctes: str, base: bool = True):
    """Register a query under its function's name; base puts the facts in front of the SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        head = ", ".join([*([FACTS_SQL] if base else []), *ctes])
        ORACLE[f.__name__] = f"{head if base or not ctes else 'WITH ' + head} {sql}"
        return f

    return add


def mix_sql(column: str, where: str = "TRUE", limit: str = "") -> str:
    return f"SELECT {column} AS key, count(*) AS count FROM facts WHERE ({where}) AND ({column}) IS NOT NULL GROUP BY 1 ORDER BY count DESC, key {limit}"


def _text(c: str):
    return F.col(c).cast("string").alias(c)


# Partition ------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(month AS STRING) AS month, count(*) AS tx_count, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2_drillin, count(*) FILTER (WHERE {P.G3}) AS g3, count(*) FILTER (WHERE {P.G4}) AS g4,
    count(*) FILTER (WHERE {P.AF}) AS af, count(*) FILTER (WHERE {P.RESCUE}) AS rescues FROM facts GROUP BY month""")
def partition_overview(spark, sf_dir):
    """Newest versions, classified and counted by month."""
    out = partition.block_groups(facts(spark, sf_dir), "month")
    return out.select(F.col("month").cast("string").alias("month"), F.col("n_rows").alias("tx_count"), "g2_drillin", "g3", "g4", "af", "rescues").orderBy("month")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM li")
def dedup_latest(spark, sf_dir):
    return latest_items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


@query("SELECT l_orderkey, max(l_shipdate) AS l_shipdate, arg_max_null(l_quantity, (l_shipdate, l_quantity)) AS l_quantity FROM lineitem GROUP BY l_orderkey", base=False)
def dedup_columns(spark, sf_dir):
    """Column by column, where the version is total."""
    rows = read_table(spark, sf_dir, "lineitem").withColumn("v", F.struct("l_shipdate", "l_quantity"))
    return versioned.latest_columns(rows, "l_orderkey", "v", ["l_quantity"]).select("l_orderkey", "v.l_shipdate", "l_quantity")


@query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem", base=False)
def dedup_guard(spark, sf_dir):
    return versioned.duplicate_count(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _blocks(spark, sf_dir) -> DataFrame:
    """Orders as blocks of 20 transactions: up to 7 replayed one by one, the rest in two aggregate classes; truncated ones stored 2 more and dropped them."""
    cov = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS block_number", "o_orderdate AS block_timestamp", "o_orderkey % 10 AS tx_count_gas_only", "o_custkey % 10 = 0 AS drill_ins_truncated")
    groups = partition.block_groups(facts(spark, sf_dir)).withColumnRenamed("n_rows", "stored")
    cov = partition.with_groups(cov, groups).withColumn("tx_count_unchanged", 20 - F.col("stored") - F.col("tx_count_gas_only"))
    cov = cov.withColumns({"tx_count": F.when(F.col("drill_ins_truncated"), 22).otherwise(20).cast("bigint"), "retained_drill_in_count": F.col("stored")}).withColumn("tx_count_stored", F.col("stored") + F.col("tx_count") - 20)
    return partition.closed(cov)


BLOCKS_SQL = f"""d AS (SELECT block_number, count(*) AS n, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2d, count(*) FILTER (WHERE {P.G3}) AS g3, count(*) FILTER (WHERE {P.G4}) AS g4,
    count(*) FILTER (WHERE {P.AF}) AS af, count(*) FILTER (WHERE {P.RESCUE}) AS rescues FROM facts GROUP BY block_number),
b AS (SELECT o_orderkey AS block_number, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 10 = 0 THEN 22 ELSE 20 END AS tx_count, o_custkey % 10 = 0 AS truncated,
    20 - coalesce(n, 0) - o_orderkey % 10 AS g1, o_orderkey % 10 + coalesce(g2d, 0) AS g2, coalesce(g3, 0) AS g3, coalesce(g4, 0) AS g4, coalesce(af, 0) AS af, coalesce(rescues, 0) AS rescues
    FROM orders LEFT JOIN d ON block_number = o_orderkey),
blocks AS (SELECT *, tx_count - g1 - g2 - g3 - g4 - af AS g5 FROM b)"""


@query("SELECT block_number, CAST(day AS STRING) AS day, CAST(g1 AS BIGINT) AS g1, CAST(g2 AS BIGINT) AS g2, g3, g4, CAST(g5 AS BIGINT) AS g5, af, rescues FROM blocks", BLOCKS_SQL)
def block_partition(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_number", _text("day"), "g1", "g2", "g3", "g4", "g5", "af", "rescues")


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tx_count", "g1", "g2", "g3", "g4", "g5", "af", "rescues"))


@query(f"SELECT CAST(day AS STRING) AS day, min(block_number) AS block_start, max(block_number) AS block_end, {_SUMS}, count(*) FILTER (WHERE truncated) AS truncated_blocks FROM blocks GROUP BY day", BLOCKS_SQL)
def overview_series(spark, sf_dir):
    return partition.overview(_blocks(spark, sf_dir)).withColumn("day", _text("day"))


@query(f"SELECT {_SUMS} FROM blocks", BLOCKS_SQL)
def coverage_totals(spark, sf_dir):
    return partition.totals(_blocks(spark, sf_dir))


@query(f"SELECT min(block_number) AS block_start, max(block_number) AS block_end, max(block_number) - min(block_number) + 1 AS block_count, CAST(min(day) AS STRING) AS day_start, CAST(max(day) AS STRING) AS day_end, {_SUMS}, CAST(count(*) FILTER (WHERE truncated) AS DOUBLE) / count(*) AS truncated_share FROM blocks", BLOCKS_SQL)
def run_meta(spark, sf_dir):
    return partition.meta(_blocks(spark, sf_dir)).withColumns({"day_start": _text("day_start"), "day_end": _text("day_end")})


@query("SELECT CAST(day AS STRING) AS day, " + ", ".join(f"100.0::DOUBLE * sum({p}) / sum(tx_count) AS {p}_pct" for p in partition.PARTS) + " FROM blocks GROUP BY day", BLOCKS_SQL)
def composition_percent(spark, sf_dir):
    return partition.composition(partition.overview(_blocks(spark, sf_dir))).withColumn("day", _text("day"))


@query("""SELECT block_number, concat_ws(',', CASE WHEN i1 THEN 'I1' END, CASE WHEN i2 THEN 'I2' END, CASE WHEN i3 THEN 'I3' END) AS broken FROM (
    SELECT block_number, 20 - coalesce(n, 0) - o_orderkey % 10 + o_orderkey % 10 + coalesce(n, 0) + extra + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END <> 20 + extra AS i1,
        coalesce(g2d + g3 + g4 + af, 0) <> coalesce(n, 0) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS i2,
        20 + extra - (20 - coalesce(n, 0) - o_orderkey % 10) - (o_orderkey % 10 + coalesce(g2d, 0)) - coalesce(g3, 0) - coalesce(g4, 0) - coalesce(af, 0) - CASE WHEN o_orderkey % 13 = 0 THEN 3 ELSE 0 END < 0 AS i3
    FROM (SELECT *, o_orderkey AS block_number, CASE WHEN o_custkey % 10 = 0 THEN 2 ELSE 0 END AS extra FROM orders) LEFT JOIN d USING (block_number)) WHERE i1 OR i2 OR i3""", BLOCKS_SQL)
def partition_violations(spark, sf_dir):
    """All blocks, some of them spoilt: stored and retained counts too high by one, unknown ones too low by three."""
    every = lambda c, n, d: (F.col(c) + F.when(F.col("block_number") % n == 0, d).otherwise(0)).alias(c)
    blocks = _blocks(spark, sf_dir)
    spoilt = {"tx_count_stored": every("tx_count_stored", 7, 1), "retained_drill_in_count": every("retained_drill_in_count", 11, 1), "g5": every("g5", 13, -3)}
    return partition.violations(blocks.withColumns(spoilt)).select("block_number", "broken")


@query("SELECT count(*) AS n FROM facts WHERE schedule_success <> coalesce(min_multiplier_to_succeed <= 1, FALSE)")
def multiplier_leaks(spark, sf_dir):
    return partition.multiplier_leaks(facts(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("""SELECT grp, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(baseline_success, FALSE) THEN 'af' WHEN schedule_success THEN 'g2' WHEN min_multiplier_to_succeed > 1 THEN 'g3' ELSE 'g4' END AS grp FROM facts) GROUP BY grp""")
def drill_in_groups(spark, sf_dir):
    grp = P.drill_in_group(F.col("schedule_success"), F.col("min_multiplier_to_succeed"), F.col("baseline_success"))
    return facts(spark, sf_dir).groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))


# Configurations -------------------------------------------------------------------------------------------

_CONFIG_SQL = "c AS (SELECT c_mktsegment AS analysis_config_hash, o_orderpriority AS schedule_name, o_orderkey AS block_number, o_orderdate AS updated_at FROM orders JOIN customer ON c_custkey = o_custkey), k AS (SELECT analysis_config_hash, schedule_name, count(DISTINCT block_number) AS blocks, min(block_number) AS min_block, max(block_number) AS max_block, max(updated_at) AS updated_at FROM c GROUP BY 1, 2)"
_FOCUS = ["1-URGENT", "2-HIGH"]


def _configs(spark, sf_dir) -> DataFrame:
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("analysis_config_hash"), F.col("o_orderpriority").alias("schedule_name"), F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("updated_at"))
    return config.coverage_by_config(rows)


@query("SELECT * FROM k", _CONFIG_SQL, base=False)
def config_coverage(spark, sf_dir):
    return _configs(spark, sf_dir)


@query(f"SELECT analysis_config_hash, CAST(sum(blocks) AS BIGINT) AS blocks, max(updated_at) AS updated_at FROM k WHERE schedule_name IN {tuple(_FOCUS)} GROUP BY 1 HAVING count(DISTINCT schedule_name) = 2", _CONFIG_SQL, base=False)
def config_resolution(spark, sf_dir):
    return config.ranked_configs(_configs(spark, sf_dir), _FOCUS)


@query("SELECT analysis_config_hash, schedule_name, blocks, min_block, max_block, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY schedule_name ORDER BY blocks DESC, updated_at DESC NULLS LAST, analysis_config_hash) AS r FROM k) WHERE r = 1", _CONFIG_SQL, base=False)
def config_fallback(spark, sf_dir):
    return config.best_per_schedule(_configs(spark, sf_dir)).select("analysis_config_hash", "schedule_name", "blocks", "min_block", "max_block", "updated_at")


@query("SELECT max(min_block) AS lo, min(max_block) AS hi FROM k", _CONFIG_SQL, base=False)
def common_range(spark, sf_dir):
    return config.common_range(_configs(spark, sf_dir))


@query("SELECT c_mktsegment AS analysis_config_hash, max(o_orderdate) AS updated_at, max_by(o_clerk, o_orderdate) AS producer_git_commit FROM x GROUP BY 1", "x AS (SELECT c_mktsegment, o_orderdate, max(o_orderstatus || o_orderkey) AS o_clerk FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)", base=False)
def latest_runs(spark, sf_dir):
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("analysis_config_hash"), F.col("o_orderdate").alias("updated_at")).agg(F.max(F.expr("o_orderstatus || o_orderkey")).alias("producer_git_commit"))
    return versioned.latest_runs(rows.withColumn("manifest_json", F.lit("{}"))).drop("manifest_json")


# Mixes and aggregates -------------------------------------------------------------------------------------


@query(mix_sql("state_gas_category", P.G3))
def mix_count(spark, sf_dir):
    return mixes.mix(facts(spark, sf_dir).filter(P.G3), F.col("state_gas_category"))


@query(mix_sql("coalesce(state_gas_category, 'none')", P.G2_DRILLIN))
def mix_none(spark, sf_dir):
    return mixes.mix_none(facts(spark, sf_dir).filter(P.G2_DRILLIN), F.col("state_gas_category"))


_SHAPE = "CASE WHEN is_create THEN 'creation' WHEN has_authorization = 1 THEN 'authorization' WHEN coalesce(input_zero_bytes, 0) = 0 AND coalesce(input_nonzero_bytes, 0) = 0 AND recipient IS NOT NULL THEN 'simple_transfer' ELSE 'contract_call' END"
_TYPE = "CASE tx_type WHEN 0 THEN 'legacy' WHEN 1 THEN 'access_list' WHEN 2 THEN 'dynamic_fee' WHEN 3 THEN 'blob' WHEN 4 THEN 'set_code' ELSE 'unknown' END"


def _fixed_sql(case: str, order: tuple[str, ...], where: str) -> str:
    return f"SELECT key, coalesce(n, 0) AS count FROM (SELECT unnest({list(order)}) AS key) LEFT JOIN (SELECT {case} AS k, count(*) AS n FROM facts WHERE {where} GROUP BY 1) ON k = key"


@query(_fixed_sql(_SHAPE, P.TX_SHAPES, P.G4))
def mix_zero_filled(spark, sf_dir):
    return mixes.mix_fixed(facts(spark, sf_dir).filter(P.G4), P.tx_shape(), P.TX_SHAPES)


@query(_fixed_sql(_TYPE, P.TX_TYPES, P.G3))
def mix_tx_types(spark, sf_dir):
    return mixes.mix_fixed(facts(spark, sf_dir).filter(P.G3), P.tx_type(), P.TX_TYPES)


def _counts_sql(where: str, **preds: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS count FROM facts WHERE ({where}) AND ({p})" for k, p in preds.items())


@query(_counts_sql(P.G2_DRILLIN, all="TRUE", gas_changed="gas_delta <> 0", event_logs_changed="event_logs_changed", output_changed="output_changed", logs_bloom_changed="logs_bloom_changed", trace_only=P.TRACE_ONLY))
def overlap_flags(spark, sf_dir):
    return forensics.change_types(facts(spark, sf_dir))


@query(_counts_sql(P.G4, not_gas_fixable="replay_halt_oog = FALSE", still_oog_at_ceiling="replay_halt_oog", unknown="replay_halt_oog IS NULL"))
def fixability(spark, sf_dir):
    return forensics.fixability(facts(spark, sf_dir))


@query(_counts_sql(P.G4, oog=P.OOG, non_oog_revert=P.NON_OOG, other=f"NOT {P.OOG} AND status_changed = FALSE"))
def break_reasons(spark, sf_dir):
    return forensics.break_reasons(facts(spark, sf_dir))


@query(_counts_sql(P.G4, success_to_fail="baseline_success AND NOT schedule_success", fail_to_fail="NOT baseline_success AND NOT schedule_success", fail_to_success="NOT baseline_success AND schedule_success"))
def status_flips(spark, sf_dir):
    return forensics.status_flips(facts(spark, sf_dir))


@query(f"SELECT count(*) FILTER (WHERE reservoir_exhausted) AS exhausted_true, count(*) FILTER (WHERE NOT reservoir_exhausted) AS exhausted_false, CAST(coalesce(round_even(avg(runtime_state_gas_spillover), 0), 0) AS BIGINT) AS avg_spillover, CAST(coalesce(round_even(avg(schedule_initial_reservoir), 0), 0) AS BIGINT) AS avg_initial FROM facts WHERE {P.G4}")
def reservoir(spark, sf_dir):
    return forensics.reservoir(facts(spark, sf_dir).filter(P.G4), True)


@query("SELECT quantile_cont(oog_call_depth, 0.5) AS p50, quantile_cont(oog_call_depth, 0.9) AS p90, quantile_cont(oog_call_depth, 0.99) AS p99, max(oog_call_depth) AS max FROM g4 WHERE oog_call_depth IS NOT NULL")
def percentiles(spark, sf_dir):
    return hist.percentiles(facts(spark, sf_dir).filter(P.G4), "oog_call_depth")


@query("SELECT event_type, 100.0::DOUBLE * sum(round(value)) / nullif(sum(event_id), 0) AS pct FROM events GROUP BY 1", base=False)
def ratio_of_sums(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(forensics.percent_of_sums(F.round("value"), F.col("event_id")).alias("pct"))


@query("SELECT count(DISTINCT recipient) AS recipient, count(DISTINCT oog_contract) AS oog_contract, count(DISTINCT divergence_contract) AS divergence_contract FROM g4")
def distinct_breadth(spark, sf_dir):
    return forensics.breadth(facts(spark, sf_dir).filter(P.G4), "recipient", "oog_contract", "divergence_contract")


@query(f"SELECT recipient AS contract, count(*) FILTER (WHERE {P.G3}) AS g3_tx_count, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2_drillin_tx_count, count(*) FILTER (WHERE {P.AF}) AS af_tx_count, count(*) FILTER (WHERE {P.STATUS_FLIP}) AS status_flips FROM facts WHERE recipient IS NOT NULL GROUP BY 1")
def recipient_counts(spark, sf_dir):
    return clusters.recipient_counts(facts(spark, sf_dir))


_SUMMARY_KEYS = ("no_state", "runtime_state", "creation", "simple_transfer", "contract_call", "type_legacy", "type_access_list", "type_dynamic_fee", "type_blob", "type_set_code", "type_other", "authorization")


@query("SELECT 'total' AS view, 'tx_count' AS key, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem WHERE l_linestatus = 'O' UNION ALL " + " UNION ALL ".join(
    f"SELECT '{v}', '{k.removeprefix('type_')}', CAST(sum(l_partkey % {_SUMMARY_KEYS.index(k) + 2}) AS BIGINT) FROM lineitem WHERE l_linestatus = 'O'"
    for v, ks in (("state_driver", _SUMMARY_KEYS[:2]), ("tx_shape", _SUMMARY_KEYS[2:5]), ("tx_type", _SUMMARY_KEYS[5:11]), ("overlay", ("authorization", "creation"))) for k in ks), base=False)
def aggregate_mixes(spark, sf_dir):
    """A block summary with made-up counts: thirteen sums in one scan."""
    rows = read_table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_linestatus = 'O' THEN 'gas_only' ELSE 'unchanged' END AS class", "CAST(l_quantity AS BIGINT) AS tx_count", *[f"l_partkey % {i + 2} AS tx_count_{k}" for i, k in enumerate(_SUMMARY_KEYS)])
    return partition.aggregate_mixes(rows)


# Histograms -----------------------------------------------------------------------------------------------

_LOG2 = "CAST(CASE WHEN gas_delta = 0 THEN 0 ELSE least(floor(log2(abs(gas_delta))) + 1, 11) END AS INTEGER)"


@query(f"""SELECT CAST(b AS INTEGER) AS bin, CAST(2 ** (b - 1) AS BIGINT) AS lo, CASE WHEN b < 11 THEN CAST(2 ** b - 1 AS BIGINT) END AS hi, CAST(a AS BIGINT) AS aggregate, coalesce(d, 0) AS drill_in, CAST(a AS BIGINT) + coalesce(d, 0) AS count
    FROM (SELECT b, (SELECT sum(floor(abs(embedding[b + 1]::DOUBLE) * 100)) FROM embeddings) AS a FROM range(1, 12) t(b)) LEFT JOIN (SELECT {_LOG2} AS bin, count(*) AS d FROM facts WHERE ({P.G2_DRILLIN}) AND gas_delta <> 0 GROUP BY 1) ON bin = b""")
def hist_gas(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("bigint")).alias("h"))
    return hist.gas_histogram(e, "h", facts(spark, sf_dir).filter(P.G2_DRILLIN)).select("bin", "lo", "hi", "aggregate", "drill_in", "count")


@query(f"SELECT CASE WHEN gas_delta < 0 THEN -1 ELSE 1 END AS sign, CAST(CASE WHEN abs(gas_delta) < 1 THEN 0 ELSE floor(log2(abs(gas_delta))) END AS INTEGER) AS bin_log2, count(*) AS count FROM facts WHERE {P.G3} GROUP BY 1, 2")
def hist_signed_log2(spark, sf_dir):
    return hist.signed_histogram(facts(spark, sf_dir).filter(P.G3))


def _pct_sql() -> str:
    edges = list(P.PERCENT_EDGES)
    values = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(zip(edges, [*edges[1:], "NULL"])))
    return f"SELECT i AS bin, lo, hi, (SELECT count(*) FROM x WHERE v >= lo AND (hi IS NULL OR v < hi)) AS count FROM (VALUES {values}) e(i, lo, hi)"


@query(_pct_sql(), f"x AS (SELECT 100.0::DOUBLE * gas_delta / baseline_gas_used AS v FROM facts WHERE ({P.G4}) AND baseline_gas_used > 0)")
def hist_pct(spark, sf_dir):
    return hist.percent_histogram(facts(spark, sf_dir).filter(P.G4), P.percent(F.col("gas_delta"), F.col("baseline_gas_used")))


@query(_pct_sql(), "x AS (SELECT value * 4 - 150 AS v FROM events)", base=False)
def hist_pct_tails(spark, sf_dir):
    return hist.percent_histogram(read_table(spark, sf_dir, "events"), F.col("value") * 4 - 150)


@query("SELECT CASE WHEN d > 8 THEN '9+' ELSE CAST(d AS STRING) END AS depth, (SELECT count(*) FROM g4 WHERE least(oog_call_depth, 9) = d AND oog_call_depth IS NOT NULL) AS count FROM range(1, 10) t(d)")
def hist_depth(spark, sf_dir):
    return hist.depth_histogram(facts(spark, sf_dir).filter(P.G4), "oog_call_depth")


@query(" UNION ALL ".join(f"SELECT '{n}' AS bucket, count(*) AS count FROM g4 WHERE oog_gas_remaining >= {lo}" + (f" AND oog_gas_remaining < {hi}" if hi else "") for n, lo, hi in hist.MAGNITUDES))
def hist_magnitude(spark, sf_dir):
    return hist.magnitude_histogram(facts(spark, sf_dir).filter(P.G4), "oog_gas_remaining")


@query(" UNION ALL ".join(f"SELECT {n} AS multiplier, count(*) AS count FROM facts WHERE ({P.G3}) AND min_multiplier_to_succeed > {lo}" + (f" AND min_multiplier_to_succeed <= {hi}" if hi else "") for lo, hi, n in hist.MULTIPLIERS))
def hist_multiplier(spark, sf_dir):
    return hist.multiplier_histogram(facts(spark, sf_dir).filter(P.G3))


@query("SELECT " + ", ".join(f"coalesce(CAST(floor(1.5 * 2 ** min(b) FILTER (WHERE u >= {p} * t)) AS BIGINT), 0) AS p{round(100 * p)}" for p in (0.5, 0.9, 0.99)) + " FROM (SELECT b, sum(n) OVER (ORDER BY b) AS u, sum(n) OVER () AS t FROM (SELECT CASE WHEN abs(gas_delta) < 1 THEN 0 ELSE floor(log2(abs(gas_delta))) END AS b, count(*) AS n FROM g4 WHERE gas_delta IS NOT NULL GROUP BY 1))")
def hist_percentiles(spark, sf_dir):
    return hist.histogram_percentiles(hist.signed_histogram(facts(spark, sf_dir).filter(P.G4)))


@query("SELECT label, string_agg(s, ',' ORDER BY i) AS h FROM (SELECT label, i, CAST(sum(floor(abs(embedding[i]::DOUBLE) * 100)) AS BIGINT) AS s FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY label", base=False)
def array_sum(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("bigint")).alias("h"))
    return hist.sum_arrays(e, "h", ["label"]).withColumn("h", F.array_join("h", ","))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0,0,0,0' WHEN 1 THEN user_id || ',' || event_id || ',0,0' ELSE '1,2,3,4' END AS a FROM events", base=False)
def array_resize(spark, sf_dir):
    a = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(array() AS array<bigint>) WHEN 1 THEN array(user_id, event_id) ELSE CAST(array(1, 2, 3, 4, 5) AS array<bigint>) END")
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(hist.resize(a, 4), ",").alias("a"))


# Leaderboards and flows -----------------------------------------------------------------------------------


@query("SELECT t.addr, t.count, coalesce(label, t.addr) AS label, CASE WHEN category <> 'unknown' THEN category END AS category FROM (SELECT oog_contract AS addr, count(*) AS count FROM g4 WHERE oog_contract IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) t LEFT JOIN names ON address = t.addr", LABELS_SQL)
def leaderboard(spark, sf_dir):
    return mixes.leaderboard(facts(spark, sf_dir).filter(P.G4), "oog_contract", labels(spark, sf_dir))


_POOL = "pool AS (SELECT recipient AS addr, count(*) AS count FROM g4 WHERE recipient IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200), rated AS (SELECT pool.addr, pool.count, total_tx, CAST(pool.count AS DOUBLE) / total_tx AS rate FROM pool LEFT JOIN totals ON totals.addr = pool.addr)"


@query("(SELECT 'count' AS board, * FROM rated ORDER BY count DESC, addr LIMIT 12) UNION ALL (SELECT 'rate' AS board, * FROM rated WHERE total_tx >= 100 ORDER BY rate DESC, count DESC, addr LIMIT 12)", TOTALS_SQL, _POOL)
def leaderboard_rate(spark, sf_dir):
    return mixes.rate_leaderboards(facts(spark, sf_dir).filter(P.G4), "recipient", totals(spark, sf_dir))


@query("SELECT CASE WHEN r <= 5 THEN key ELSE 'Others' END AS key, CAST(sum(n) AS BIGINT) AS count, CAST(min(least(r, 6)) AS INTEGER) AS rank FROM m GROUP BY 1", "m AS (SELECT trim(substr(revert_decoded, 15)) AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS r FROM g4 WHERE revert_decoded LIKE 'Error(string):%' GROUP BY 1)")
def topn_others(spark, sf_dir):
    return forensics.revert_errors(facts(spark, sf_dir).filter(P.G4))


@query("SELECT CASE WHEN e IN (SELECT e FROM rows GROUP BY 1 ORDER BY count(*) DESC, e LIMIT 10) THEN e ELSE '__other__' END AS e, CASE WHEN t IN (SELECT t FROM rows GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 10) THEN t ELSE '__other__' END AS t, count(*) AS n FROM rows GROUP BY ALL", "rows AS (SELECT recipient AS e, divergence_contract AS t FROM g4 WHERE recipient IS NOT NULL AND divergence_contract IS NOT NULL)")
def flow_sankey(spark, sf_dir):
    return mixes.flow(facts(spark, sf_dir).filter(P.G4), "recipient", "divergence_contract")


_FAILURES = ["recipient", "block_number", "baseline_success", "schedule_success", "min_multiplier_to_succeed", "status_changed", "gas_delta"]
_FAIL = f"""agg AS (SELECT recipient, count(*) FILTER (WHERE {P.G4}) AS g4_tx_count, count(*) FILTER (WHERE {P.G3}) AS g3_tx_count, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2_drillin_tx_count, count(*) FILTER (WHERE {P.STATUS_FLIP}) AS status_flips,
    avg(gas_delta) AS avg_gas_delta, CAST(sum(gas_delta) AS BIGINT) AS sum_gas_delta, min(block_number) AS block_span_start, max(block_number) AS block_span_end, count(DISTINCT CASE WHEN {P.G4} THEN block_number END) AS distinct_blocks_with_g4,
    quantile_cont(min_multiplier_to_succeed, 0.5) AS mm_p50, quantile_cont(min_multiplier_to_succeed, 0.9) AS mm_p90, quantile_cont(min_multiplier_to_succeed, 0.99) AS mm_p99
    FROM facts WHERE recipient IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE {P.G4}) > 0 ORDER BY g4_tx_count DESC, recipient LIMIT 40)"""


@query("SELECT *, CAST(g4_tx_count AS DOUBLE) / distinct_blocks_with_g4 AS avg_g4_per_block, CAST(g4_tx_count AS DOUBLE) / (g4_tx_count + g3_tx_count + g2_drillin_tx_count) AS g4_vs_other_ratio, CAST(sum(g4_tx_count) OVER (ORDER BY g4_tx_count DESC, recipient ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT count(*) FROM g4) AS cumulative_share FROM agg", _FAIL)
def top_recipients_cumshare(spark, sf_dir):
    return forensics.contract_failures(held(facts(spark, sf_dir).select(*_FAILURES), "facts"))


@query("SELECT CAST(row_number() OVER (ORDER BY g4_tx_count DESC, recipient) AS INTEGER) AS rank, 100.0::DOUBLE * (CAST(sum(g4_tx_count) OVER (ORDER BY g4_tx_count DESC, recipient ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT count(*) FROM g4)) AS share FROM agg", _FAIL)
def pareto_curve(spark, sf_dir):
    return forensics.pareto(forensics.contract_failures(held(facts(spark, sf_dir).select(*_FAILURES), "facts")))


_EX = "block_number, tx_hash, gas_delta, recipient, min_multiplier_to_succeed FROM facts"


@query(f"(SELECT 'g4' AS grp, {_EX} WHERE {P.G4} ORDER BY abs(gas_delta) DESC, block_number, tx_hash LIMIT 20) UNION ALL (SELECT 'g3' AS grp, {_EX} WHERE {P.G3} ORDER BY abs(gas_delta) DESC, block_number, tx_hash LIMIT 20)")
def examples_topk(spark, sf_dir):
    return forensics.examples(facts(spark, sf_dir))


@query("SELECT key, coalesce(g3, 0) AS g3_count, coalesce(g3 / (SELECT sum(g3) FROM w), 0.0) AS g3_share, coalesce(g4, 0) AS g4_count, coalesce(g4 / (SELECT sum(g4) FROM w), 0.0) AS g4_share FROM w", f"w AS (SELECT state_gas_category AS key, nullif(count(*) FILTER (WHERE {P.G3}), 0) AS g3, nullif(count(*) FILTER (WHERE {P.G4}), 0) AS g4 FROM facts WHERE state_gas_category IS NOT NULL AND (({P.G3}) OR ({P.G4})) GROUP BY 1)")
def mix_aligned(spark, sf_dir):
    f = facts(spark, sf_dir)
    both = [mixes.mix(f.filter(p), F.col("state_gas_category")).withColumn("series", F.lit(n)) for n, p in (("g3", P.G3), ("g4", P.G4))]
    return mixes.aligned(both[0].unionByName(both[1]), ["g3", "g4"])


@query("SELECT recipient AS key, string_agg(c || '=' || n, ',' ORDER BY r) AS mix FROM (SELECT recipient, divergence_contract AS c, count(*) AS n, row_number() OVER (PARTITION BY recipient ORDER BY count(*) DESC, divergence_contract) AS r FROM g4 WHERE recipient IS NOT NULL AND divergence_contract IS NOT NULL GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1")
def counterpart_mix(spark, sf_dir):
    out = forensics.counterparts(facts(spark, sf_dir), "divergence_contract")
    pairs = F.transform("mix", lambda m: F.concat_ws("=", m["contract"], m["count"]))
    return out.select(F.col("recipient").alias("key"), F.array_join(pairs, ",").alias("mix"))


@query("SELECT * FROM t ORDER BY n DESC, k", "t AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)", base=False)
def sorted_table(spark, sf_dir):
    t = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    return forensics.sortable(t, "n")


# Clusters -------------------------------------------------------------------------------------------------

ROLES_SQL = """r0 AS (SELECT *, recipient AS contract, 'entry' AS role FROM g4 WHERE recipient IS NOT NULL UNION ALL SELECT *, oog_contract, 'oog_site' FROM g4 WHERE oog_contract IS NOT NULL
    UNION ALL SELECT *, divergence_contract, 'revert_site' FROM g4 WHERE divergence_contract IS NOT NULL),
r1 AS (SELECT *, CASE WHEN role = 'oog_site' OR (role = 'entry' AND oog_contract IS NOT NULL) THEN 'oog' ELSE 'non_oog' END AS kind FROM r0),
roled AS (SELECT contract, role, kind, block_number, tx_hash, gas_delta, recipient, oog_contract, divergence_contract, entry_selector, state_gas_category, cold_account_access_count, sload_cold_count, sstore_cold_count, access_list_address_count, access_list_storage_key_count, oog_gas_remaining, reservoir_exhausted, runtime_state_gas_spillover, surcharge_at_oog,
    coalesce(tier1_failing_selector, entry_selector) AS failing_selector, CASE WHEN kind = 'oog' THEN oog_contract ELSE divergence_contract END AS where_contract, CASE WHEN kind = 'oog' THEN oog_opcode ELSE divergence_opcode END AS opcode,
    CASE WHEN kind = 'oog' THEN oog_pattern ELSE failure_reason END AS pattern_or_reason, CASE WHEN kind = 'oog' THEN oog_bottleneck_kind END AS oog_bottleneck_kind, CASE WHEN kind = 'oog' THEN oog_call_depth ELSE divergence_call_depth END AS call_depth,
    CASE WHEN kind = 'non_oog' THEN revert_decoded END AS revert_decoded FROM r1)"""
_KEYS = ", ".join(clusters.KEY)
# nulls sort first in Spark's ascending order
_ORDER = ", ".join(f"{k} ASC NULLS FIRST" for k in clusters.KEY)


#: Columns of the facts that the analysis of contracts reads.
_CONTEXT = [c for c in COLUMNS if c not in ("event_logs_changed", "output_changed", "logs_bloom_changed", "is_create", "tx_type", "has_authorization", "input_zero_bytes", "input_nonzero_bytes", "baseline_gas_used", "schedule_initial_reservoir", "replay_halt_oog")]


_COUNTED = ("recipient", "block_number", "baseline_success", "schedule_success", "min_multiplier_to_succeed", "status_changed")

#: Columns of the facts that tell g4, and of the items that the wider counts are worked out from.
_JUDGED = ("baseline_success", "schedule_success", "min_multiplier_to_succeed")
_WIDER = ("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")


def _contract_facts(spark, sf_dir) -> DataFrame:
    """The facts that contracts' figures read; the newest items are written once (outside g4, only the columns of the wider counts), and facts worked out as they are read."""
    items = dated_items(spark, sf_dir).withColumns({f"_{c}": F.expr(COLUMNS[c]) for c in _JUDGED})
    g4 = F.expr(reduce(lambda text, c: text.replace(c, f"_{c}"), _JUDGED, P.G4))
    slim = items.withColumns({c: F.when(g4, F.col(c)) for c in items.columns if c not in _WIDER}).drop(*[f"_{c}" for c in _JUDGED])
    return as_facts(held(slim, "items")).select(*_COUNTED, *[c for c in _CONTEXT if c not in _COUNTED])


def _q(column: str, p: float) -> str:
    return f"CAST(round_even(round(quantile_cont({column}, {p}), 6), 0) AS BIGINT)"


_ACCESS = "coalesce(access_list_address_count, 0) + coalesce(access_list_storage_key_count, 0)"
#: The causes of a group as columns; nulls stand where a cause has no values.
_DRIVERS = ", ".join(f"{_q(c, p)} AS {n}_p{round(100 * p)}" for n, c in clusters.PAIRS.items() for p in (0.5, 0.9)) + f""",
    CASE WHEN count(access_list_address_count) + count(access_list_storage_key_count) > 0 THEN {_q(_ACCESS, 0.5)} END AS access_p50, CASE WHEN count(access_list_address_count) + count(access_list_storage_key_count) > 0 THEN {_q(_ACCESS, 0.9)} END AS access_p90,
    {_q('surcharge_at_oog', 0.5)} AS surcharge_p50, CAST(sum(surcharge_at_oog) AS BIGINT) AS surcharge_sum, CASE WHEN count(reservoir_exhausted) > 0 THEN CAST(count(*) FILTER (WHERE reservoir_exhausted) AS DOUBLE) / count(*) END AS exhausted,
    CASE WHEN count(runtime_state_gas_spillover) > 0 THEN CAST(count(*) FILTER (WHERE runtime_state_gas_spillover > 0) AS DOUBLE) / count(*) END AS spilled"""


def _flat_drivers() -> list:
    """The drivers struct as the same columns."""
    d = lambda path, name: F.col(f"drivers.{path}").alias(name)
    out = [d(f"{n}.p{p}", f"{n}_p{p}") for n in clusters.PAIRS for p in (50, 90)] + [d(f"access_list_entries.p{p}", f"access_p{p}") for p in (50, 90)]
    return out + [d("surcharge_at_oog.p50", "surcharge_p50"), d("surcharge_at_oog.sum", "surcharge_sum"), d("reservoir_exhausted_share", "exhausted"), d("spillover_share", "spilled")]


_STATES = "array_to_string(list_transform(list_sort(list_transform(map_entries(histogram(CASE WHEN state_gas_category <> '' THEN state_gas_category END)), lambda e: {'m': -CAST(e.value AS BIGINT), 'k': e.key})), lambda e: e.k || '=' || CAST(-e.m AS VARCHAR)), ',')"
CLUSTERS_SQL = f"""cl AS (SELECT contract, {_KEYS}, count(*) AS count, min(block_number) AS b, avg(gas_delta) AS gas_avg, {_q('gas_delta', 0.5)} AS gas_p50, {_q('gas_delta', 0.9)} AS gas_p90, {_DRIVERS},
    array_to_string(list(tx_hash ORDER BY block_number, tx_hash)[1:2], ',') AS examples, first(entry_selector ORDER BY block_number, tx_hash) AS entry_selector, {_STATES} AS states FROM roled GROUP BY contract, {_KEYS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY count DESC, {_ORDER}) AS place, count(*) OVER (PARTITION BY contract) AS distinct_clusters, CAST(sum(count) OVER (PARTITION BY contract) AS BIGINT) AS contract_total, CAST(sum(count) OVER (PARTITION BY contract, role) AS BIGINT) AS role_total FROM cl),
shown AS (SELECT * FROM ranked WHERE place <= 8)"""


def _roles(spark, sf_dir) -> DataFrame:
    """The rows of every role, written once for the branches that read them."""
    return held(clusters.roles(facts(spark, sf_dir).filter(P.G4)).select("contract", *clusters.ROLED), "roled")


def _mix_text(c: str, name: str):
    """An array of (name, count) as text; none is empty."""
    return F.coalesce(F.array_join(F.transform(c, lambda m: F.concat_ws("=", m[name], m["count"])), ","), F.lit(""))


@query(f"SELECT contract, {_KEYS}, block_number, tx_hash FROM roled", ROLES_SQL)
def role_unpivot(spark, sf_dir):
    return _roles(spark, sf_dir).select("contract", *clusters.KEY, "block_number", "tx_hash")


@query(f"SELECT contract, {_KEYS}, count, distinct_clusters, CAST(count AS DOUBLE) / role_total AS share_of_role, CAST(count AS DOUBLE) / contract_total AS share_of_contract, gas_avg, gas_p50, gas_p90, entry_selector, examples, coalesce(states, '') AS states FROM shown", ROLES_SQL, CLUSTERS_SQL)
def failure_clusters(spark, sf_dir):
    out = clusters.failure_clusters(_roles(spark, sf_dir), causes=False)
    return out.select("contract", *clusters.KEY, "count", "distinct_clusters", "share_of_role", "share_of_contract", "gas_avg", "gas_p50", "gas_p90", "entry_selector", F.array_join(F.transform("examples", lambda e: e["tx_hash"]), ",").alias("examples"), _mix_text("state_gas_category", "key").alias("states"))


_DRIVER_NAMES = ", ".join([*[f"{n}_p{p}" for n in clusters.PAIRS for p in (50, 90)], "access_p50", "access_p90", "surcharge_p50", "surcharge_sum", "exhausted", "spilled"])


@query(f"SELECT contract, {_KEYS}, {_DRIVER_NAMES} FROM shown", ROLES_SQL, CLUSTERS_SQL)
def cluster_drivers(spark, sf_dir):
    return clusters.failure_clusters(_roles(spark, sf_dir)).select("contract", *clusters.KEY, *_flat_drivers())


@query("SELECT contract, max(distinct_clusters) AS distinct_cluster_count, CAST(sum(count) AS DOUBLE) / max(contract_total) AS clusters_shown_share FROM shown GROUP BY 1", ROLES_SQL, CLUSTERS_SQL)
def cluster_summary(spark, sf_dir):
    return clusters.cluster_summary(clusters.failure_clusters(_roles(spark, sf_dir), causes=False))


@query(f"""SELECT contract, {', '.join(k for k in clusters.KEY if k != 'role')}, first(count ORDER BY role = 'entry', count DESC, role) AS count, first(role ORDER BY role = 'entry', count DESC, role) AS from_role, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM shown GROUP BY ALL""", ROLES_SQL, CLUSTERS_SQL)
def self_role_merge(spark, sf_dir):
    return clusters.merge_self_roles(clusters.failure_clusters(_roles(spark, sf_dir), causes=False)).drop("share_of_contract").withColumn("roles", F.array_join("roles", ","))


def _mix_sql(name: str, column: str, rows: str) -> str:
    return f"{name} AS (SELECT contract, string_agg(v || '=' || n, ',' ORDER BY r) AS mix FROM (SELECT contract, {column} AS v, count(*) AS n, row_number() OVER (PARTITION BY contract ORDER BY count(*) DESC, {column}) AS r FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE r <= {clusters.BREAKDOWN} GROUP BY 1)"


_SITES = "sites AS (SELECT DISTINCT contract, recipient, block_number, tx_hash FROM roled WHERE role <> 'entry'), entries AS (SELECT * FROM roled WHERE role = 'entry')"
_MIX_SQL = [_mix_sql(n, c, "sites" if n == "entry_contracts" else "entries") for n, c in clusters.MIXES.items()]


@query(f"""SELECT b.*, coalesce(w.g3, 0) AS g3_tx_count, coalesce(w.g2, 0) AS g2_drillin_tx_count, coalesce(w.af, 0) AS af_tx_count, coalesce(w.flips, 0) AS status_flips, {', '.join(f"coalesce({n}.mix, '') AS {n}" for n in clusters.MIXES)} FROM (
    SELECT contract, avg(gas_delta) FILTER (WHERE role = 'entry') AS gas_avg, CAST(coalesce(sum(gas_delta) FILTER (WHERE role = 'entry'), 0) AS BIGINT) AS gas_sum,
    {_q("CASE WHEN role = 'entry' THEN gas_delta END", 0.5)} AS gas_p50, {_q("CASE WHEN role = 'entry' THEN gas_delta END", 0.9)} AS gas_p90,
    coalesce(min(block_number) FILTER (WHERE role = 'entry'), min(block_number)) AS block_span_start, coalesce(max(block_number) FILTER (WHERE role = 'entry'), max(block_number)) AS block_span_end,
    CASE WHEN count(*) FILTER (WHERE role = 'entry') > 0 THEN count(DISTINCT block_number) FILTER (WHERE role = 'entry') ELSE count(DISTINCT block_number) END AS distinct_blocks FROM roled GROUP BY contract) b
    LEFT JOIN (SELECT recipient, count(*) FILTER (WHERE {P.G3}) AS g3, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2, count(*) FILTER (WHERE {P.AF}) AS af, count(*) FILTER (WHERE {P.STATUS_FLIP}) AS flips FROM facts GROUP BY 1) w ON w.recipient = b.contract
    {' '.join(f'LEFT JOIN {n} ON {n}.contract = b.contract' for n in clusters.MIXES)}""", ROLES_SQL, _SITES, *_MIX_SQL)
def contract_context(spark, sf_dir):
    f = _contract_facts(spark, sf_dir)
    out = clusters.context(clusters.roles(f.filter(P.G4)).select("contract", *clusters.ROLED), f)
    return out.select(*[c for c in out.columns if c not in clusters.MIXES], *[_mix_text(n, "contract").alias(n) for n in clusters.MIXES])


_COUNTS = "counts AS (SELECT contract, count(*) FILTER (WHERE role = 'entry') AS entry, count(*) FILTER (WHERE role = 'oog_site') AS halts, count(*) FILTER (WHERE role = 'revert_site') AS reverts, count(*) AS footprint FROM roled GROUP BY 1)"
_NAMED = "named AS (SELECT * FROM names WHERE (label <> '' AND label <> address) OR coalesce(owner_project, '') <> '')"
_DEPLOY = "deploy AS (SELECT oog_contract AS contract FROM g4 WHERE oog_contract IS NOT NULL AND oog_contract NOT IN (SELECT address FROM named) AND oog_contract NOT IN (SELECT recipient FROM g4 WHERE recipient IS NOT NULL) GROUP BY 1 HAVING bool_and(coalesce(regexp_matches(coalesce(tier1_failing_selector, entry_selector), '^0x6[01]'), FALSE)))"


def _named(spark, sf_dir) -> DataFrame:
    return clusters.searchable(labels(spark, sf_dir))


@query("SELECT contract FROM deploy", LABELS_SQL, _NAMED, _DEPLOY)
def deploy_accounts(spark, sf_dir):
    return clusters.deploy_accounts(facts(spark, sf_dir).filter(P.G4), _named(spark, sf_dir))


def _deployed(spark, sf_dir) -> dict[str, DataFrame]:
    g4 = held(facts(spark, sf_dir).filter(P.G4).select(*_CONTEXT), "g4")
    return clusters.deploy_summary(g4, held(clusters.deploy_accounts(g4, _named(spark, sf_dir)), "deploy"))


@query("SELECT lower(oog_contract) AS account, first(tx_hash ORDER BY block_number, tx_hash) AS tx, first(block_number ORDER BY block_number, tx_hash) AS block, first(gas_delta ORDER BY block_number, tx_hash) AS gas_delta, first({'o': oog_opcode} ORDER BY block_number, tx_hash).o AS opcode, first({'s': coalesce(tier1_failing_selector, entry_selector)} ORDER BY block_number, tx_hash).s AS selector, first({'r': lower(recipient)} ORDER BY block_number, tx_hash).r AS entry FROM g4 WHERE oog_contract IN (SELECT contract FROM deploy) GROUP BY 1", LABELS_SQL, _NAMED, _DEPLOY)
def deploy_collapse(spark, sf_dir):
    return _deployed(spark, sf_dir)["accounts"]


_DEPLOYED = "g4 WHERE oog_contract IN (SELECT contract FROM deploy)"


@query(" UNION ALL ".join([
    f"SELECT 'opcode' AS view, oog_opcode AS key, count(*) AS count FROM {_DEPLOYED} AND oog_opcode IS NOT NULL GROUP BY 2",
    f"SELECT 'family', substr(coalesce(tier1_failing_selector, entry_selector), 1, 6) AS key, count(*) FROM {_DEPLOYED} AND coalesce(tier1_failing_selector, entry_selector) IS NOT NULL GROUP BY 2",
    f"(SELECT 'entry', lower(recipient) AS key, count(*) AS n FROM {_DEPLOYED} AND recipient IS NOT NULL GROUP BY 2 ORDER BY n DESC, key LIMIT 8)",
    "(SELECT 'revert', revert_decoded AS key, count(*) AS n FROM g4 WHERE divergence_contract IN (SELECT contract FROM deploy) AND revert_decoded IS NOT NULL GROUP BY 2 ORDER BY n DESC, key LIMIT 8)"]), LABELS_SQL, _NAMED, _DEPLOY)
def deploy_mixes(spark, sf_dir):
    parts = _deployed(spark, sf_dir)
    views = {"opcode": "halt_opcode_split", "family": "initcode_families", "entry": "top_entry_contracts", "revert": "revert_reasons"}
    out = [parts[p].select(F.lit(v).alias("view"), "key", "count") for v, p in views.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"SELECT count(DISTINCT oog_contract) AS count, {_q('gas_delta', 0.5)} AS gas_p50, {_q('gas_delta', 0.9)} AS gas_p90, min(gas_delta) AS gas_min, max(gas_delta) AS gas_max, {_DRIVERS} FROM {_DEPLOYED}", LABELS_SQL, _NAMED, _DEPLOY)
def deploy_figures(spark, sf_dir):
    return _deployed(spark, sf_dir)["figures"].select("count", "gas_p50", "gas_p90", "gas_min", "gas_max", *_flat_drivers())


@query("SELECT n.address, label, owner_project, CASE WHEN category <> 'unknown' THEN category END AS category, nullif(entry, 0) AS entry_g4_tx_count, nullif(halts, 0) AS halt_count, nullif(reverts, 0) AS revert_count, footprint FROM counts JOIN named n ON n.address = contract WHERE contract NOT IN (SELECT contract FROM deploy)", LABELS_SQL, _NAMED, _DEPLOY, ROLES_SQL, _COUNTS)
def affected_index(spark, sf_dir):
    g4 = facts(spark, sf_dir).filter(P.G4)
    return clusters.index(clusters.role_counts(clusters.roles(g4)), labels(spark, sf_dir), clusters.deploy_accounts(g4, _named(spark, sf_dir)))


@query("SELECT contract FROM (SELECT * FROM counts ORDER BY footprint DESC, contract LIMIT 1000) UNION SELECT contract FROM counts WHERE contract IN (SELECT address FROM named)", LABELS_SQL, _NAMED, ROLES_SQL, _COUNTS)
def probe_set(spark, sf_dir):
    return clusters.probe_set(clusters.role_counts(_roles(spark, sf_dir)), _named(spark, sf_dir))


@query("SELECT contract, total_tx, CAST(halts AS DOUBLE) / total_tx AS halt_rate, CAST(reverts AS DOUBLE) / total_tx AS revert_rate FROM counts JOIN totals ON addr = contract", ROLES_SQL, _COUNTS, TOTALS_SQL)
def failure_rates(spark, sf_dir):
    return clusters.failure_rates(clusters.role_counts(_roles(spark, sf_dir)), totals(spark, sf_dir))


@query("SELECT address, label, owner_project FROM named WHERE contains(lower(label), 'supplier#00000001') OR contains(lower(coalesce(owner_project, '')), 'supplier#00000001')", LABELS_SQL, _NAMED)
def name_search(spark, sf_dir):
    rows = labels(spark, sf_dir).join(_named(spark, sf_dir), "address", "left_semi").withColumn("footprint", F.lit(1))
    none = spark.createDataFrame([], "contract string"), spark.createDataFrame([], "account string")
    return clusters.lookup(rows, *none, " Supplier#00000001 ", most=10_000)[1].select("address", "label", "owner_project")


@query("SELECT DISTINCT c AS contract FROM (SELECT recipient AS c FROM g4 UNION SELECT oog_contract FROM g4 UNION SELECT divergence_contract FROM g4) WHERE c IS NOT NULL AND c NOT IN (SELECT contract FROM deploy)", LABELS_SQL, _NAMED, _DEPLOY)
def affected_contracts(spark, sf_dir):
    g4 = facts(spark, sf_dir).filter(P.G4)
    return clusters.shards_for(clusters.affected(g4), clusters.deploy_accounts(g4, _named(spark, sf_dir)))


# Scalars --------------------------------------------------------------------------------------------------

_RAW = "CASE event_id % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'nan' WHEN 2 THEN '1e3' WHEN 3 THEN '9223372036854775808' WHEN 4 THEN '-5' WHEN 5 THEN '' WHEN 6 THEN CAST(event_id AS STRING) ELSE 'false' END"


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN TRUE WHEN 7 THEN FALSE END AS flag, CASE event_id % 8 WHEN 2 THEN 1000 WHEN 4 THEN -5 WHEN 6 THEN event_id END AS n, CASE event_id % 8 WHEN 2 THEN 1000 WHEN 6 THEN event_id END AS reservoir FROM events""", base=False)
def null_coercion(spark, sf_dir):
    raw = F.expr(_RAW)
    return read_table(spark, sf_dir, "events").select("event_id", S.to_flag(raw).alias("flag"), S.to_long(raw).alias("n"), S.to_reservoir(raw).alias("reservoir"))


@query("SELECT event_id, event_id || ',' || user_id || ',3' AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def json_array_parse(spark, sf_dir):
    text = F.concat(F.lit("["), F.concat_ws(",", "event_id", "user_id", F.lit(3)), F.lit("]"))
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(S.parse_array(text), ",").alias("a"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT p_partkey, b AS opcode_byte, b * 2 AS count, b + p_size AS gas_baseline, b - p_size AS gas_schedule, CASE b WHEN 84 THEN 'SLOAD' WHEN 96 THEN 'PUSH1' WHEN 127 THEN 'PUSH32' WHEN 12 THEN 'UNKNOWN_0x0c' END AS opcode FROM part, (VALUES (84), (96), (127), (12)) t(b)", base=False)
def parallel_arrays(spark, sf_dir):
    b = "array(84, 96, 127, 12)"
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey", f"{b} AS opcode", f"transform({b}, x -> x * 2) AS opcode_count", f"transform({b}, x -> x + p_size) AS opcode_gas_baseline", f"transform({b}, x -> x - p_size) AS opcode_gas_schedule")
    return opcodes.explode_opcodes(rows, ["p_partkey"])


@query("SELECT substr(entry_selector, 1, 6) AS family, regexp_matches(entry_selector, '^0x6[01]') AS init, count(*) AS n FROM facts GROUP BY 1, 2")
def regex_family(spark, sf_dir):
    return facts(spark, sf_dir).groupBy(S.family(F.col("entry_selector")).alias("family"), P.is_initcode(F.col("entry_selector")).alias("init")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey % 7 AS c, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'swapTokens(uint256)' WHEN s_suppkey % 5 = 2 THEN 'a(uint256)' ELSE 'a(uint256)' END AS signature FROM supplier", base=False)
def selector_decode(spark, sf_dir):
    """Three signatures collide on one selector; a dex takes the one that names a swap."""
    cache = spark.createDataFrame([("0x38ED1739", "zz_join_everything(bytes)", None, 1), ("38ed1739", " swapTokens(uint256) ", "4byte", 2), ("0x38ed1739", "a(uint256)", "", 3), ("bad", "b()", "", 4), ("0x38ed1739", "a(uint256)", "x", 5)], "selector string, text_signature string, source string, o int")
    s = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey % 7 AS c", "CASE WHEN s_suppkey % 5 = 0 THEN '0x00000000' ELSE '0x38ed1739' END AS selector", "CASE s_suppkey % 5 WHEN 1 THEN 'swap_dex' WHEN 2 THEN 'oracle' WHEN 3 THEN NULL ELSE 'token' || s_suppkey END AS category")
    got = L.decode_selectors(s, L.selector_cache(cache, "o"))
    return s.join(got, s["selector"].eqNullSafe(got["selector"]) & s["category"].eqNullSafe(got["category"])).select("s_suppkey", "c", "signature")


@query("""SELECT doc_id, CASE WHEN n LIKE '%entrypoint%' THEN 'ERC-4337 EntryPoint' WHEN n LIKE '%uniswap%' THEN 'Uniswap' WHEN n LIKE '%safe%' OR n LIKE '%gnosis%' THEN 'Safe' WHEN n LIKE '%proxy%' AND k IS NOT NULL THEN 'Proxy (' || k || ')' WHEN k = 'proxy' THEN 'Proxy' ELSE a END AS label
    FROM (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'MyEntryPointSafe' WHEN 1 THEN 'GnosisThing' WHEN 2 THEN 'AdminProxy' ELSE lang END) AS n, CASE WHEN doc_id % 3 = 0 THEN 'proxy' END AS k, 'd' || CAST(doc_id AS STRING) AS a FROM documents)""", base=False)
def keyword_ladder(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 5 WHEN 0 THEN 'MyEntryPointSafe' WHEN 1 THEN 'GnosisThing' WHEN 2 THEN 'AdminProxy' ELSE lang END AS n", "CASE WHEN doc_id % 3 = 0 THEN 'proxy' END AS k", "'d' || CAST(doc_id AS STRING) AS a")
    return d.select("doc_id", S.label_from_name(F.col("n"), F.col("k"), F.col("a")).alias("label"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'swap_dex' WHEN 1 THEN 'nft' WHEN 2 THEN 'unknown' WHEN 3 THEN 'other' ELSE 'defi_complex' END AS attested, CASE p_size % 5 WHEN 0 THEN 'swap_dex' WHEN 1 THEN 'other' WHEN 2 THEN 'unknown' WHEN 3 THEN 'other' ELSE 'defi_complex' END AS curated, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) END AS owner FROM part", base=False)
def category_fold(spark, sf_dir):
    c = F.expr("CASE p_size % 5 WHEN 0 THEN ' DEX' WHEN 1 THEN 'nft_fi' WHEN 2 THEN '' WHEN 3 THEN 'thing' ELSE 'lending' END")
    name = F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand || ' : Router: 2' ELSE p_brand END")
    return read_table(spark, sf_dir, "part").select("p_partkey", L.fold(c, L.ATTESTED).alias("attested"), L.fold(c, L.CURATED).alias("curated"), S.owner_of(name).alias("owner"))


_ADDRESS = "CASE WHEN event_id % 4 = 0 THEN 'a' || event_id ELSE '0x' || lpad(CAST(event_id AS STRING), 40, '7') END"


@query(f"""SELECT event_id, CAST(value AS DOUBLE) / nullif(event_id % 4, 0) AS ratio, format('{{:,}}', event_id) AS n, format('{{:,.1f}}%', 100.0::DOUBLE * (event_id % 4096 / 64.0::DOUBLE)) AS pct,
    CASE WHEN event_id % 4 = 0 THEN {_ADDRESS} ELSE substr({_ADDRESS}, 1, 6) || '…' || right({_ADDRESS}, 4) END AS short, upper(event_type[1]) || lower(event_type[2:]) || ' Of ' || user_id AS words FROM events""", base=False)
def format_helpers(spark, sf_dir):
    address = F.expr(_ADDRESS)
    return read_table(spark, sf_dir, "events").select(
        "event_id", S.safe_ratio(F.col("value"), F.col("event_id") % 4).alias("ratio"), S.format_count(F.col("event_id")).alias("n"), S.format_percent(F.col("event_id") % 4096 / 64.0).alias("pct"),
        S.short_address(address).alias("short"), S.humanize(F.concat_ws("__of_", F.upper("event_type"), "user_id")).alias("words"),
    )


# Labels and code ------------------------------------------------------------------------------------------


def _sources(spark, sf_dir) -> DataFrame:
    """Three sources and an overlay over customers, who repeat under the address c mod 700."""
    c = read_table(spark, sf_dir, "customer").withColumn("a", F.expr("'c' || CAST(c_custkey % 700 AS STRING)"))
    manual = L.records(c.filter("c_custkey % 5 = 0"), "manual", "high", address=F.col("a"), label=F.expr("'m' || c_custkey"), category=F.lit("unknown"))
    oli = L.records(c.filter("c_custkey % 3 = 0"), "oli", "high", address=F.col("a"), label=F.lit(""), category=F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'token' ELSE 'unknown' END"), owner_project=F.expr("lower(c_mktsegment)"))
    dune = L.records(c.filter("c_custkey % 2 = 0"), "dune", "high", address=F.col("a"), label=F.expr("'d' || c_custkey"), category=F.lit("nft"), is_proxy=F.expr("CASE WHEN c_custkey % 4 = 0 THEN true END"))
    mev = L.records(c.filter("c_custkey % 7 = 0"), "mev", "medium", address=F.col("a"), label=F.lit("MEV bot (arb)"), category=F.lit("mev_bot"), is_mev_bot=F.lit(True), mev_role=F.lit("arb"))
    return manual.unionByName(oli).unionByName(dune).unionByName(mev)


_MERGE = """s AS (SELECT 'c' || CAST(c_custkey % 700 AS STRING) AS address, c_custkey, c_nationkey, c_mktsegment FROM customer),
src AS (SELECT address, 0 AS r, 'm' || c_custkey AS label, 'unknown' AS category, NULL AS owner, NULL AS proxy, 'manual' AS source FROM s WHERE c_custkey % 5 = 0
    UNION ALL SELECT address, 1, '', CASE WHEN c_nationkey % 2 = 0 THEN 'token' ELSE 'unknown' END, lower(c_mktsegment), NULL, 'oli' FROM s WHERE c_custkey % 3 = 0
    UNION ALL SELECT address, 2, 'd' || c_custkey, 'nft', NULL, CASE WHEN c_custkey % 4 = 0 THEN TRUE END, 'dune' FROM s WHERE c_custkey % 2 = 0),
own AS (SELECT address, min(label) FILTER (WHERE r = 0) AS m, min(label) FILTER (WHERE r = 2) AS d, count(*) FILTER (WHERE r = 1) AS o,
    coalesce(min(category) FILTER (WHERE r = 1 AND category <> 'unknown'), min(category) FILTER (WHERE r = 2)) AS category, bool_or(proxy) AS proxy FROM src GROUP BY 1),
mev AS (SELECT DISTINCT address FROM s WHERE c_custkey % 7 = 0)"""


@query("SELECT coalesce(own.address, mev.address) AS address, CASE WHEN own.address IS NULL THEN 'MEV bot (arb)' ELSE coalesce(m, d, own.address) END AS label, coalesce(category, CASE WHEN mev.address IS NOT NULL THEN 'mev_bot' ELSE 'unknown' END) AS category, CASE WHEN own.address IS NULL THEN 'mev' WHEN m IS NOT NULL THEN 'manual' WHEN d IS NOT NULL THEN 'dune' ELSE 'oli' END AS source, mev.address IS NOT NULL AS is_mev_bot, proxy AS is_proxy FROM own FULL JOIN mev ON mev.address = own.address", _MERGE, base=False)
def label_merge(spark, sf_dir):
    return L.merge_labels(_sources(spark, sf_dir)).select("address", "label", "category", "source", "is_mev_bot", "is_proxy")


@query("SELECT coalesce(own.address, mev.address) AS address, own.address IS NULL AS alone FROM own FULL JOIN mev ON mev.address = own.address WHERE mev.address IS NOT NULL", _MERGE, base=False)
def label_overlay(spark, sf_dir):
    return L.merge_labels(_sources(spark, sf_dir)).filter("is_mev_bot").select("address", (F.col("source") == "mev").alias("alone"))


@query("SELECT lower('D' || CAST(doc_id // 4 AS STRING)) AS address, arg_max(source, (doc_id % 3 <> 0, lpad(CAST(doc_id AS STRING), 12, '0'))) AS contract_name, arg_max(lang, (doc_id % 3 <> 0, lpad(CAST(doc_id AS STRING), 12, '0'))) FILTER (WHERE lang <> 'en') AS usage_category FROM documents GROUP BY 1", base=False)
def attestation_collapse(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").selectExpr("'D' || CAST(doc_id DIV 4 AS STRING) AS recipient", "doc_id % 3 = 0 AS revoked", "lpad(CAST(doc_id AS STRING), 12, '0') AS time", "map('contract_name', source, 'usage_category', CASE WHEN lang <> 'en' THEN lang ELSE '' END) AS tags")
    return L.collapse_attestations(d, ["contract_name", "usage_category"])


@query("SELECT lower(c_name) AS address, 'MEV bot (' || CASE c_nationkey % 4 WHEN 0 THEN 'arb' ELSE 'sandwich' END || ')' AS label, CASE c_nationkey % 4 WHEN 0 THEN 'arb' ELSE 'sandwich' END AS mev_role FROM customer WHERE c_nationkey % 4 < 2", base=False)
def mev_normalise(spark, sf_dir):
    raw = read_table(spark, sf_dir, "customer").selectExpr("CASE c_nationkey % 4 WHEN 0 THEN ' ARB' WHEN 1 THEN 'frontrun' WHEN 2 THEN 'sandwich' ELSE 'swap' END AS mev_type", "c_name AS address_from")
    return L.mev_labels(raw).select("address", "label", "mev_role")


@query("SELECT 's' || s_suppkey AS address, CASE WHEN s_suppkey % 3 = 0 THEN 'Uniswap' WHEN s_suppkey % 3 = 1 THEN s_name ELSE 's' || s_suppkey END AS label FROM supplier", base=False)
def label_resolve(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    cache = s.filter("s_suppkey % 3 = 1").selectExpr("'s' || s_suppkey AS address", "s_name AS label")
    asked = s.selectExpr("'s' || s_suppkey AS address", "CASE WHEN s_suppkey % 3 = 0 THEN 'UniswapPool' END AS compiled_name")
    return L.resolve_labels(asked, cache, spark)


def _code(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex("text")).alias("code"))


_PUSH = "(?:" + "|".join([f"{0x5F + n:02x}[0-9a-f]{{{2 * n}}}" for n in range(1, 33)]) + "|[67][0-9a-f].*|..)"


@query(f"SELECT doc_id, len(t) AS n, list_contains(t, '65') AS has_push6, t[1] AS first FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '{_PUSH}'), lambda x: substr(x, 1, 2)) AS t FROM documents)", base=False)
def opcode_tokens(spark, sf_dir):
    """Instructions of every whole text; null and empty texts have none."""
    rows = _code(spark, sf_dir).withColumn("t", opcodes.instructions(F.col("code")))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_contains("t", "65").alias("has_push6"), F.get("t", F.lit(0)).alias("first"))


_CODE = "CASE doc_id % 6 WHEN 0 THEN '0x363d3d373d3d3d363d73' || repeat('ab', 20) || '5af43d82803e903d91602b57fd5bf3' WHEN 1 THEN '60f4' WHEN 2 THEN '60001f931c1c' WHEN 3 THEN '00f5' WHEN 4 THEN 'a9059cbb70a0823118160ddd' ELSE '' END"


@query("""SELECT doc_id, doc_id % 6 = 0 OR doc_id % 7 = 0 AS is_proxy, doc_id % 6 = 3 AS is_factory, CASE WHEN doc_id % 6 = 4 THEN 'erc20' END AS erc_type,
    CASE WHEN doc_id % 6 = 0 THEN 'minimal_proxy_immutable' WHEN doc_id % 6 = 2 THEN 'diamond' WHEN doc_id % 7 = 0 THEN 'eip1967_transparent' ELSE 'none' END AS mechanism,
    CASE WHEN doc_id % 6 <> 0 AND doc_id % 7 = 0 THEN '0x' || lpad(lower(to_hex(doc_id + 1)), 40, '0') END AS admin FROM documents""", base=False)
def proxy_classify(spark, sf_dir):
    slot = bytecode.SLOTS["admin"]
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), "doc_id").alias("address"), F.expr(_CODE).alias("code"), F.expr(f"CASE WHEN doc_id % 7 = 0 THEN map('0x{slot}', '0x' || hex(doc_id + 1)) ELSE map('{slot}', '0x000') END").alias("storage"), F.create_map().cast("map<string,boolean>").alias("answers"))
    up = bytecode.upgradability(F.col("code"), F.col("storage"), F.col("answers"))
    return rows.select("doc_id", bytecode.is_proxy(F.col("code"), F.col("storage")).alias("is_proxy"), bytecode.is_factory(F.col("code")).alias("is_factory"), bytecode.erc_type(F.col("code"), F.col("answers")).alias("erc_type"), up["mechanism"].alias("mechanism"), up["admin"].alias("admin"))


@query("SELECT address, slot, arg_max(value, (block_number, value)) AS value FROM (SELECT lower('S' || l_suppkey) AS address, l_linenumber AS slot, l_partkey AS value, l_orderkey AS block_number FROM lineitem UNION ALL SELECT lower('S' || l_suppkey), l_linenumber, l_partkey + 1, l_orderkey FROM lineitem WHERE l_partkey % 2 = 0) GROUP BY 1, 2", base=False)
def latest_slot(spark, sf_dir):
    reads = read_table(spark, sf_dir, "lineitem").selectExpr("'S' || l_suppkey AS address", "l_linenumber AS slot", "l_partkey AS value", "l_orderkey AS block_number")
    return bytecode.latest_slots(reads, reads.filter("value % 2 = 0").withColumn("value", F.col("value") + 1))


@query("""SELECT doc_id, 'x' || doc_id AS address, CASE WHEN erc IS NOT NULL THEN 'ERC-' || substr(erc, 4) || ' token' WHEN proxy THEN 'Proxy contract' WHEN factory THEN 'Factory contract' ELSE 'x' || doc_id END AS label,
    CASE WHEN erc IS NOT NULL THEN 'token' ELSE 'unknown' END AS category, 'heuristic' AS source, 'low' AS confidence, FALSE AS is_mev_bot, proxy AS is_proxy, factory AS is_factory, erc AS erc_type, mechanism NOT IN ('none', 'minimal_proxy_immutable') AS is_upgradable, mechanism AS upgrade_mechanism,
    CASE WHEN doc_id % 7 = 0 AND mechanism IN ('diamond', 'eip1967_transparent') THEN '0x' || lpad(lower(to_hex(doc_id + 1)), 40, '0') END AS upgrade_admin
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'erc721' WHEN doc_id % 6 = 4 THEN 'erc20' END AS erc, doc_id % 6 = 0 OR doc_id % 7 = 0 AS proxy, doc_id % 6 = 3 AS factory,
        CASE WHEN doc_id % 6 = 0 THEN 'minimal_proxy_immutable' WHEN doc_id % 6 = 2 OR doc_id % 13 = 0 THEN 'diamond' WHEN doc_id % 7 = 0 THEN 'eip1967_transparent' ELSE 'none' END AS mechanism FROM documents)""", base=False)
def classify_contract(spark, sf_dir):
    """Whole records from code, slots and interface answers."""
    slot = bytecode.SLOTS["admin"]
    answers = f"CASE WHEN doc_id % 11 = 0 THEN map('0x{bytecode.ERC721}', true) WHEN doc_id % 13 = 0 THEN map('{bytecode.LOUPE}', true) ELSE map('0x{bytecode.ERC721}', false) END"
    loupe = f"CASE WHEN doc_id % 13 = 0 THEN map('0x{bytecode.LOUPE}', true) ELSE CAST(map() AS map<string,boolean>) END"
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), "doc_id").alias("address"), F.expr(_CODE).alias("code"), F.expr(f"CASE WHEN doc_id % 7 = 0 THEN map('0x{slot}', '0x' || hex(doc_id + 1)) ELSE map('{slot}', '0x000') END").alias("storage"), F.expr(f"CASE WHEN doc_id % 143 = 0 THEN map_concat(map('0x{bytecode.ERC721}', true), {loupe}) ELSE {answers} END").alias("answers"))
    columns = ["address", "label", "category", "source", "confidence", "is_mev_bot", "is_proxy", "is_factory", "erc_type", "is_upgradable", "upgrade_mechanism", "upgrade_admin"]
    return bytecode.classify(rows).select(F.substring("address", 2, 30).cast("bigint").alias("doc_id"), *columns)


@query("""SELECT 'c' || c_custkey AS address, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN 'token' ELSE 'nft' END AS category, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS owner_project, 'oli' AS source, 'high' AS confidence, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AS is_mev_bot,
    CASE WHEN c_custkey % 2 = 1 THEN TRUE END AS is_proxy, CASE WHEN c_custkey % 2 = 1 THEN 'uups' END AS upgrade_mechanism FROM customer""", base=False)
def schema_evolution(spark, sf_dir):
    """A label table whose older files lack columns and whose newer ones have one too many, in another order."""
    path = f"{scratch_folder(spark)}/labels-{uuid.uuid4().hex}"
    c = read_table(spark, sf_dir, "customer")
    head = ["'c' || c_custkey AS address", "c_name AS label"]
    c.filter("c_custkey % 2 = 0").selectExpr(*head, "'token' AS category", "'oli' AS source", "'high' AS confidence").write.parquet(path)
    c.filter("c_custkey % 2 = 1").selectExpr("'uups' AS upgrade_mechanism", *head, "1 AS not_ours", "'nft' AS category", "c_mktsegment AS owner_project", "'oli' AS source", "'high' AS confidence", "c_custkey % 3 = 0 AS is_mev_bot", "true AS is_proxy").write.mode("append").parquet(path)
    return read_labels(spark, path).select("address", "label", "category", "owner_project", "source", "confidence", "is_mev_bot", "is_proxy", "upgrade_mechanism")


_TAGS = {
    "label": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END", "category": "CASE WHEN s_nationkey % 5 = 0 THEN 'unknown' ELSE 'token' END", "owner_project": "CASE WHEN s_suppkey % 4 = 0 THEN 'owner' || CAST(s_nationkey AS STRING) ELSE '' END",
    "source": "CASE WHEN s_suppkey % 2 = 0 THEN 'oli' ELSE 'unknown' END", "confidence": "'high'", "is_mev_bot": "s_suppkey % 6 = 0", "mev_role": "'arb'", "is_proxy": "CASE WHEN s_suppkey % 5 = 0 THEN TRUE END", "is_factory": "CAST(NULL AS BOOLEAN)", "is_safe": "FALSE",
    "erc_type": "CASE WHEN s_suppkey % 7 = 0 THEN 'erc20' END", "is_upgradable": "CASE WHEN s_suppkey % 3 = 0 THEN TRUE END", "upgrade_mechanism": "CASE WHEN s_suppkey % 3 = 0 THEN 'uups' ELSE 'none' END", "upgrade_admin": "CASE WHEN s_suppkey % 3 = 0 THEN 'adm' || CAST(s_suppkey AS STRING) END",
}
_PROBES = {
    "is_proxy": "FALSE", "is_factory": "TRUE", "is_safe": "CAST(NULL AS BOOLEAN)", "erc_type": "CASE WHEN s_suppkey % 8 = 0 THEN 'erc721' ELSE '' END", "is_upgradable": "s_suppkey % 8 = 0",
    "upgrade_mechanism": "CASE WHEN s_suppkey % 8 = 0 THEN 'beacon' WHEN s_suppkey % 12 = 0 THEN 'minimal_proxy_immutable' ELSE 'none' END", "upgrade_admin": "CASE WHEN s_suppkey % 8 = 0 THEN 'p' || CAST(s_suppkey AS STRING) END",
}


@query("""SELECT t.addr, coalesce(nullif(r.label, ''), t.addr) AS label, nullif(r.category, 'unknown') AS category, nullif(r.owner_project, '') AS owner_project, nullif(r.source, 'unknown') AS source, CASE WHEN r.source <> 'unknown' THEN r.confidence END AS confidence,
    nullif(r.is_mev_bot, FALSE) AS is_mev_bot, CASE WHEN r.is_mev_bot THEN r.mev_role END AS mev_role, nullif(coalesce(p.is_proxy, FALSE) OR coalesce(r.is_proxy, FALSE), FALSE) AS is_proxy, nullif(coalesce(p.is_factory, FALSE), FALSE) AS is_factory, CAST(NULL AS BOOLEAN) AS is_safe,
    coalesce(nullif(p.erc_type, ''), r.erc_type) AS erc_type, nullif(CASE WHEN p.upgrade_mechanism <> 'none' THEN p.is_upgradable ELSE r.is_upgradable END, FALSE) AS is_upgradable, nullif(CASE WHEN p.upgrade_mechanism <> 'none' THEN p.upgrade_mechanism ELSE r.upgrade_mechanism END, 'none') AS upgrade_mechanism,
    CASE WHEN p.upgrade_mechanism <> 'none' THEN p.upgrade_admin ELSE r.upgrade_admin END AS upgrade_admin, t.count
    FROM (SELECT oog_contract AS addr, count(*) AS count FROM g4 WHERE oog_contract IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) t LEFT JOIN rec r ON r.address = t.addr LEFT JOIN probes p ON p.address = t.addr""",
    *[f"{name} AS (SELECT 's' || CAST(s_suppkey AS STRING) AS address, {', '.join(f'{e} AS {n}' for n, e in tags.items())} FROM supplier{where})" for name, tags, where in (("rec", _TAGS, ""), ("probes", _PROBES, " WHERE s_suppkey % 4 = 0"))])
def rich_leaderboard(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").withColumn("address", F.expr("'s' || CAST(s_suppkey AS STRING)"))
    table = lambda rows, tags: rows.selectExpr("address", *[f"{e} AS {n}" for n, e in tags.items()])
    return mixes.rich_leaderboard(facts(spark, sf_dir).filter(P.G4), "oog_contract", table(s, _TAGS), table(s.filter("s_suppkey % 4 = 0"), _PROBES))


_HAND = ", ".join(f"('{a}', '{n}')" for a, n in L.MANUAL.items())


@query(f"""SELECT coalesce(own.address, mev.address) AS address, CASE WHEN own.address IS NULL THEN 'MEV bot (arb)' ELSE coalesce(d, own.address) END AS label, coalesce(category, CASE WHEN mev.address IS NOT NULL THEN 'mev_bot' ELSE 'unknown' END) AS category,
    CASE WHEN own.address IS NULL THEN 'mev' WHEN d IS NOT NULL THEN 'dune' ELSE 'oli' END AS source, mev.address IS NOT NULL AS is_mev_bot, proxy AS is_proxy FROM own FULL JOIN mev ON mev.address = own.address
    UNION ALL SELECT a, n, CASE WHEN n LIKE '% precompile' THEN 'precompile' ELSE 'unknown' END, 'manual', FALSE, NULL FROM (VALUES {_HAND}) h(a, n)""", _MERGE.replace("WHERE c_custkey % 5 = 0", "WHERE FALSE"), base=False)
def label_build(spark, sf_dir):
    """The cache tables of three sources (two have none), merged with the names given by hand, written and read back."""
    cache = f"{scratch_folder(spark)}/cache-{uuid.uuid4().hex}"
    rows = _sources(spark, sf_dir)
    for source in ("oli", "dune", "mev"):
        write_labels(rows.filter(F.col("source") == source), f"{cache}/{source}.parquet")
    return build(spark, None, cache).select("address", "label", "category", "source", "is_mev_bot", "is_proxy")


# The run's own reading ------------------------------------------------------------------------------------


def _raw_divergence(spark, sf_dir) -> DataFrame:
    """Line items as stored rows of several versions: flags as text, addresses in capitals, a row twice under equal versions."""
    rows = read_table(spark, sf_dir, "lineitem").withColumns({c: F.expr(COLUMNS[c]) for c in DIVERGENCE_COLUMNS if c in COLUMNS})
    text = {c: F.col(c).cast("string") for c in ("baseline_success", "schedule_success", "gas_delta")}
    pin = {"chain_id": F.lit(1), "analysis_config_hash": F.lit("cfg"), "schedule_name": F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd"), "row_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "updated_at": F.struct(*VERSION)}
    missing = {c: F.lit(None) for c in DIVERGENCE_COLUMNS if c not in COLUMNS}
    return rows.withColumns(text | pin | missing | {"recipient": F.upper("recipient")}).select(*pin, *DIVERGENCE_COLUMNS)


@query("SELECT block_number, tx_hash, baseline_success, schedule_success, gas_delta, lower(recipient) AS recipient FROM facts WHERE block_number % 2 = 0 AND block_number BETWEEN 200 AND 52000")
def staged_divergence(spark, sf_dir):
    """Newest versions, coerced, staged by block bucket, and a range of blocks of one schedule read back."""
    rows = read_divergence(pinned(_raw_divergence(spark, sf_dir), "cfg", "even")).select("block_number", "tx_hash", "baseline_success", "schedule_success", "gas_delta", "recipient")
    staged = stage(rows, f"{scratch_folder(spark)}/divergence-{uuid.uuid4().hex}")
    return staged.filter("block_number BETWEEN 200 AND 52000").drop("block_bucket")


@query("SELECT 's' || CAST(l_suppkey AS STRING) AS addr, count(*) AS total_tx FROM lineitem WHERE l_orderkey BETWEEN 100 AND 40000 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1", base=False)
def denominators(spark, sf_dir):
    transactions = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS block_number", "CASE WHEN l_linenumber % 2 = 0 THEN 'S' ELSE 's' END || CAST(l_suppkey AS STRING) AS to_address")
    asked = read_table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").selectExpr("'S' || CAST(s_suppkey AS STRING) AS addr")
    return source_denominators(transactions, asked, (100, 40000))


@query("""SELECT 'a' || s_suppkey AS address, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS label, CASE WHEN s_suppkey % 5 = 0 THEN 'wallet_safe' WHEN s_suppkey % 7 = 0 THEN 'account_abstraction' WHEN s_nationkey % 4 = 0 THEN 'swap_dex' WHEN s_nationkey % 4 = 1 THEN 'other' WHEN s_nationkey % 4 = 2 THEN 'unknown' ELSE 'nft' END AS category,
    'owner' || s_nationkey AS owner_project, 'oli' AS source, 'high' AS confidence, s_suppkey % 2 = 0 AS is_proxy, s_suppkey % 5 = 0 AS is_safe, CASE WHEN s_suppkey % 3 = 0 THEN 'erc721' END AS erc_type FROM supplier""", base=False)
def attested_labels(spark, sf_dir):
    """Attestations of suppliers, an older one below each, collapsed and folded into records."""
    s = read_table(spark, sf_dir, "supplier")
    tags = "map('contract_name', CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, 'usage_category', CASE s_nationkey % 4 WHEN 0 THEN 'Trading' WHEN 1 THEN 'what' WHEN 2 THEN '' ELSE 'nft_marketplace' END, 'owner_project', 'owner' || s_nationkey, 'is_proxy', CAST(s_suppkey % 2 = 0 AS STRING), 'is_safe_contract', CAST(s_suppkey % 5 = 0 AS STRING), 'is_bundler', CAST(s_suppkey % 7 = 0 AS STRING), 'erc_type', CASE WHEN s_suppkey % 3 = 0 THEN '[\"erc721\", \"x\"]' END)"
    newest = s.selectExpr("'A' || s_suppkey AS recipient", "CAST(NULL AS BOOLEAN) AS revoked", "'2' AS time", f"{tags} AS tags")
    older = s.selectExpr("'a' || s_suppkey AS recipient", "s_suppkey % 2 = 0 AS revoked", "'1' AS time", "map('is_proxy', 'wrong', 'owner_project', 'old', 'is_safe_contract', 'false') AS tags")
    return L.attested_labels(L.collapse_attestations(newest.unionByName(older), TAGS)).select("address", "label", "category", "owner_project", "source", "confidence", "is_proxy", "is_safe", "erc_type")


@query("""SELECT 'c' || c_custkey AS address, CASE WHEN c_custkey % 3 = 0 THEN ' C' || c_custkey ELSE c_mktsegment || ': ' || c_custkey END AS label, CASE c_nationkey % 3 WHEN 0 THEN 'swap_dex' WHEN 1 THEN 'infra' ELSE 'other' END AS category, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS owner_project, 'dune' AS source FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0""", base=False)
def curated_labels(spark, sf_dir):
    """One chain, no behavioural categories, categories folded, owners from names."""
    c = read_table(spark, sf_dir, "customer")
    raw = c.selectExpr("' C' || c_custkey AS address", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment || ': ' || c_custkey END AS name", "CASE WHEN c_custkey % 7 = 0 THEN 'Arbitrage' WHEN c_nationkey % 3 = 0 THEN 'Balancer_v2_pool' WHEN c_nationkey % 3 = 1 THEN 'rollup' ELSE 'unheard of' END AS category", "CASE WHEN c_custkey % 4 = 0 THEN 'base' ELSE 'ethereum' END AS blockchain")
    return L.curated_labels(L.curated_query(raw, None, ("arbitrage",))).select("address", "label", "category", "owner_project", "source")


@query("SELECT event_id, event_id % 16 BETWEEN 1 AND 10 AS precompile FROM events", base=False)
def precompile_flags(spark, sf_dir):
    address = F.concat(F.lit("0X"), F.lpad(F.hex(F.col("event_id") % 16), 40, "0"))
    return read_table(spark, sf_dir, "events").select("event_id", S.is_precompile(address).alias("precompile"))


@query(f"""SELECT 's' || s_suppkey AS address, (SELECT arg_max('60' || lpad(to_hex(l_partkey), 6, '0'), (l_orderkey, '60' || lpad(to_hex(l_partkey), 6, '0'))) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 1) AS code,
    (SELECT arg_max('0x' || to_hex(l_partkey), (l_orderkey, '0x' || to_hex(l_partkey))) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 2) AS admin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'nobody', NULL, NULL""", base=False)
def structural_inputs(spark, sf_dir):
    """Newest code and slots of the addresses asked for; what was never seen is empty."""
    items = read_table(spark, sf_dir, "lineitem").withColumn("address", F.expr("'S' || l_suppkey"))
    slots = items.filter("l_linenumber = 2").select("address", F.lit(f"0x{bytecode.SLOTS['admin']}").alias("slot"), F.expr("'0x' || hex(l_partkey)").alias("value"), F.col("l_orderkey").alias("block_number"))
    other = items.filter("l_linenumber = 3").select("address", F.lit("0x01").alias("slot"), F.lit("0xff").alias("value"), F.col("l_orderkey").alias("block_number"))
    codes = items.filter("l_linenumber = 1").select("address", F.expr("'60' || lpad(hex(l_partkey), 6, '0')").alias("code"), F.col("l_orderkey").alias("block_number"))
    asked = read_table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").selectExpr("'S' || s_suppkey AS address").union(spark.createDataFrame([("Nobody",)], "address string"))
    out = bytecode.structural_inputs(asked, slots.filter("block_number % 2 = 0").unionByName(other), slots.filter("block_number % 2 = 1"), codes)
    return out.select("address", "code", F.try_element_at("storage", F.lit(f"0x{bytecode.SLOTS['admin']}")).alias("admin"))


@query(f"""SELECT c.contract, distinct_cluster_count, clusters_shown_share, n_clusters, top_count, nullif(entry, 0) AS entry, CASE WHEN entry > 0 THEN entry_oog END AS entry_oog, nullif(halts, 0) AS oog_site, nullif(reverts, 0) AS revert_site, coalesce(n.label, c.contract) AS label, total_tx,
    CAST(halts AS DOUBLE) / total_tx AS halt_rate, signature FROM (
    SELECT contract, max(distinct_clusters) AS distinct_cluster_count, CAST(sum(count) AS DOUBLE) / max(contract_total) AS clusters_shown_share, count(*) AS n_clusters, max(count) AS top_count,
    coalesce(max(CASE WHEN failing_selector = '0x63' THEN 'pay(uint8)' END), '') AS signature FROM shown GROUP BY 1) c
    JOIN (SELECT *, (SELECT count(*) FROM roled r WHERE r.contract = k.contract AND role = 'entry' AND oog_contract IS NOT NULL) AS entry_oog FROM counts k) k ON k.contract = c.contract
    LEFT JOIN names n ON n.address = c.contract LEFT JOIN totals t ON t.addr = c.contract WHERE c.contract NOT IN (SELECT contract FROM deploy)""", LABELS_SQL, _NAMED, _DEPLOY, TOTALS_SQL, ROLES_SQL, CLUSTERS_SQL, _COUNTS)
def affected_shards(spark, sf_dir):
    """The shards of the run: clusters with signatures, role counts, names, rates."""
    c, roles = F.col("failure_clusters"), lambda path: F.col(f"roles_summary.{path}")
    return _shards(spark, sf_dir).select(
        F.col("address").alias("contract"), "distinct_cluster_count", "clusters_shown_share", F.size(c).cast("bigint").alias("n_clusters"), F.array_max(F.transform(c, lambda x: x["count"])).alias("top_count"),
        roles("entry.g4_tx_count").alias("entry"), roles("entry.g4_oog_count").alias("entry_oog"), roles("oog_site.halt_count").alias("oog_site"), roles("revert_site.revert_count").alias("revert_site"),
        "label", F.col("context.failure_rate.total_tx").alias("total_tx"), F.col("context.failure_rate.halt_rate").alias("halt_rate"), F.array_join(F.array_distinct(F.transform(c, lambda x: x["selector_signature"])), ",").alias("signature"),
    )


def _shards(spark, sf_dir) -> DataFrame:
    whole = {c: F.rpad(c, 10, "0") for c in ("entry_selector", "tier1_failing_selector")}  # of eight digits, as only such are decoded
    f = _contract_facts(spark, sf_dir).withColumns(whole)
    signatures = spark.createDataFrame([("0x63000000", "pay(uint8)", "4byte", 1)], "selector string, text_signature string, source string, first int")
    return shard_tables(f, labels(spark, sf_dir), totals(spark, sf_dir), signatures)["shards"]


@query("""SELECT s.contract, s.role, s.kind, rpad(failing_selector, 10, '0') AS selector, CASE WHEN failing_selector = '0x63' THEN 'pay(uint8)' END AS selector_signature, rpad(entry_selector, 10, '0') AS entry_selector, CASE WHEN entry_selector = '0x63' THEN 'pay(uint8)' END AS entry_signature,
    where_contract, coalesce(w.label, where_contract) AS where_label, CASE WHEN w.category <> 'unknown' THEN w.category END AS where_category, opcode, pattern_or_reason, oog_bottleneck_kind, call_depth, revert_decoded, count, CAST(count AS DOUBLE) / role_total AS share_of_role, CAST(count AS DOUBLE) / contract_total AS share_of_contract, gas_avg, gas_p50, gas_p90, examples
    FROM shown s LEFT JOIN names w ON w.address = where_contract WHERE s.contract NOT IN (SELECT contract FROM deploy)""", LABELS_SQL, _NAMED, _DEPLOY, ROLES_SQL, CLUSTERS_SQL)
def shard_clusters(spark, sf_dir):
    """The clusters of the shards as they are published, a row each."""
    out = _shards(spark, sf_dir).select(F.col("address").alias("contract"), F.explode("failure_clusters").alias("c"))
    names = ["role", "kind", "selector", "selector_signature", "entry_selector", "entry_signature", "where_contract", "where_label", "where_category", "opcode", "pattern_or_reason", "oog_bottleneck_kind", "call_depth", "revert_decoded", "count", "share_of_role", "share_of_contract"]
    return out.select("contract", *[f"c.{n}" for n in names], *[F.col(f"c.gas_delta.{n}").alias(f"gas_{n}") for n in ("avg", "p50", "p90")], F.array_join(F.transform("c.examples", lambda e: e["tx_hash"]), ",").alias("examples"))


_EVERY_MIX = "m AS (" + " UNION ALL ".join(f"SELECT contract, '{n}' AS which, {c} AS v, count(*) AS count, row_number() OVER (PARTITION BY contract ORDER BY count(*) DESC, {c}) AS r FROM {'sites' if n == 'entry_contracts' else 'entries'} WHERE {c} IS NOT NULL AND contract NOT IN (SELECT contract FROM deploy) GROUP BY contract, {c}" for n, c in clusters.MIXES.items()) + ")"


@query(f"""SELECT contract, which, count, CASE WHEN which LIKE '%functions' THEN rpad(v, 10, '0') ELSE v END AS value, CASE WHEN which LIKE '%functions' THEN CASE WHEN v = '0x63' THEN 'pay(uint8)' END ELSE coalesce(n.label, v) END AS name, CASE WHEN which NOT LIKE '%functions' AND n.category <> 'unknown' THEN n.category END AS category
    FROM m LEFT JOIN names n ON n.address = v WHERE r <= {clusters.BREAKDOWN}""", LABELS_SQL, _NAMED, _DEPLOY, ROLES_SQL, _SITES, _EVERY_MIX)
def shard_mixes(spark, sf_dir):
    """The functions and counterparts of the shards, with signatures, names and categories."""
    def rows(n: str):
        fields = ("selector", "signature", None) if n.endswith("functions") else ("contract", "label", "category")
        return F.transform(f"context.{n}", lambda m: F.struct(F.lit(n).alias("which"), m["count"].alias("count"), *[(m[f] if f else F.lit(None).cast("string")).alias(c) for f, c in zip(fields, ("value", "name", "category"))]))

    return _shards(spark, sf_dir).select(F.col("address").alias("contract"), F.inline(F.concat(*[rows(n) for n in clusters.MIXES])))


_SUMMARY = "SELECT o_orderkey AS block_number, CASE WHEN o_custkey % 3 = 0 THEN 'unchanged' ELSE 'gas_only' END AS class, o_orderkey % 10 AS tx_count, o_custkey - 500 AS gas_delta_sum, o_custkey % 50 - 80 AS gas_delta_min, o_custkey % 60 + 900 AS gas_delta_max, o_orderkey AS baseline_gas_used_sum"


@query(f"""SELECT go.n + dr.n AS count, CAST(go.s + dr.s AS BIGINT) AS sum_gas_delta, least(go.mn, dr.mn) AS min_gas_delta, greatest(go.mx, dr.mx) AS max_gas_delta, go.s AS sum_gas_delta_gas_only, base AS baseline_gas_used_sum, 100.0::DOUBLE * go.s / CAST(base AS DOUBLE) AS gas_delta_pct_of_baseline
    FROM (SELECT CAST(sum(tx_count) AS BIGINT) AS n, CAST(sum(gas_delta_sum) AS BIGINT) AS s, min(gas_delta_min) AS mn, max(gas_delta_max) AS mx, CAST(sum(baseline_gas_used_sum) AS BIGINT) AS base FROM s WHERE class = 'gas_only') go,
    (SELECT count(*) AS n, sum(gas_delta) AS s, min(gas_delta) AS mn, max(gas_delta) AS mx FROM facts WHERE ({P.G2_DRILLIN}) AND gas_delta <> 0) dr""", f"s AS ({_SUMMARY} FROM orders)")
def gas_view(spark, sf_dir):
    summary = read_table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _SUMMARY.removeprefix("SELECT ").split(",")])
    return forensics.gas_view(facts(spark, sf_dir), summary)


@query("""SELECT 's' || s_suppkey AS address, CASE WHEN s_suppkey % 5 = 0 THEN 'N' || s_suppkey ELSE 'P' || s_nationkey END AS label, 'unknown' AS category, CASE WHEN s_suppkey % 5 = 0 THEN 'N' || s_suppkey ELSE 'P' || s_nationkey END AS owner_project, 'ethlists' AS source, CAST(NULL AS STRING) AS erc_type FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0
    UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Nm' || s_suppkey ELSE 'T' || s_suppkey END, 'token', NULL, 'ethlists', 'ERC20' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 7 <> 0""", base=False)
def registry_labels(spark, sf_dir):
    """Registry folders of one JSON file per address, written as shards and read back; broken and nameless files are skipped."""
    s = read_table(spark, sf_dir, "supplier").withColumn("key", F.expr("'s' || s_suppkey"))
    folder = f"{scratch_folder(spark)}/registry-{uuid.uuid4().hex}"
    contracts = """CASE WHEN s_suppkey % 3 = 0 THEN '{broken' WHEN s_suppkey % 5 = 0 THEN '{"project": " ", "name": "N' || s_suppkey || '"}' ELSE '{"project": "P' || s_nationkey || '", "name": "x"}' END"""
    tokens = """CASE WHEN s_suppkey % 7 = 0 THEN '{"decimals": 18}' WHEN s_suppkey % 3 = 0 THEN '{"name": "Nm' || s_suppkey || '", "symbol": "S", "type": "ERC20"}' ELSE '{"symbol": "T' || s_suppkey || '", "type": "ERC20"}' END"""
    write_shards(s.filter("s_suppkey % 2 = 0").select("key", F.expr(contracts).alias("body")), f"{folder}/contracts")
    write_shards(s.filter("s_suppkey % 2 = 1").select("key", F.expr(tokens).alias("body")), f"{folder}/tokens")
    both = registry_contracts(spark, f"{folder}/contracts").unionByName(registry_tokens(spark, f"{folder}/tokens"))
    return both.select("address", "label", "category", "owner_project", "source", "erc_type")


def _views(parts: dict[str, DataFrame]) -> DataFrame:
    """Documents of several (key, count) tables as one table of view, key and count."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("view"), F.col(part.columns[0]).cast("string").alias("key"), "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def _views_sql(**parts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{view}' AS view, CAST(x.key AS VARCHAR) AS key, CAST(x.count AS BIGINT) AS count FROM ({sql}) x(key, count)" for view, sql in parts.items())


_FLIPS = {"success_to_fail": "baseline_success AND NOT schedule_success", "fail_to_fail": "NOT baseline_success AND NOT schedule_success", "fail_to_success": "NOT baseline_success AND schedule_success"}


@query(_views_sql(
    fixability=_counts_sql(P.G4, not_gas_fixable="replay_halt_oog = FALSE", still_oog_at_ceiling="replay_halt_oog", unknown="replay_halt_oog IS NULL"), break_reason=_counts_sql(P.G4, oog=P.OOG, non_oog_revert=P.NON_OOG, other=f"NOT {P.OOG} AND status_changed = FALSE"),
    oog_bottleneck_kind=mix_sql("oog_bottleneck_kind", P.G4), status_flip=_counts_sql(P.G4, **_FLIPS), state_gas_category=mix_sql("state_gas_category", P.G4), tx_shape_mix=_fixed_sql(_SHAPE, P.TX_SHAPES, P.G4), tx_type_mix=_fixed_sql(_TYPE, P.TX_TYPES, P.G4)))
def g4_document(spark, sf_dir):
    parts = forensics.g4_categories(held(facts(spark, sf_dir).filter(P.G4), "g4"), True)
    return _views({k: v for k, v in parts.items() if k != "reservoir"})


@query(_views_sql(
    multiplier_histogram=" UNION ALL ".join(f"SELECT {n} AS key, count(*) AS count FROM facts WHERE ({P.G3}) AND min_multiplier_to_succeed > {lo}" + (f" AND min_multiplier_to_succeed <= {hi}" if hi else "") for lo, hi, n in hist.MULTIPLIERS),
    state_gas_category=mix_sql("state_gas_category", P.G3), tx_shape_mix=_fixed_sql(_SHAPE, P.TX_SHAPES, P.G3), tx_type_mix=_fixed_sql(_TYPE, P.TX_TYPES, P.G3), is_create=_counts_sql(P.G3, true="is_create", false="NOT is_create"), oog_pattern=mix_sql("oog_pattern", P.G3)))
def g3_document(spark, sf_dir):
    parts = forensics.g3_categories(held(facts(spark, sf_dir).filter(P.G3), "g3"), True)
    return _views({k: v for k, v in parts.items() if k != "reservoir"})


def _depth_sql(column: str, where: str) -> str:
    return f"SELECT CASE WHEN d > 8 THEN '9+' ELSE CAST(d AS VARCHAR) END AS key, (SELECT count(*) FROM facts WHERE ({where}) AND least({column}, 9) = d AND {column} IS NOT NULL) AS count FROM range(1, 10) t(d)"


def _site_sql(where: str, site: str, depth: str) -> dict[str, str]:
    """The parts of a failure site's document that are more than a mix."""
    pool = f"(SELECT pool.addr, pool.count, total_tx, CAST(pool.count AS DOUBLE) / total_tx AS rate FROM (SELECT recipient AS addr, count(*) AS count FROM facts WHERE ({where}) AND recipient IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200) pool LEFT JOIN totals ON totals.addr = pool.addr)"
    rows = f"(SELECT recipient AS e, {site} AS t FROM facts WHERE ({where}) AND recipient IS NOT NULL AND {site} IS NOT NULL)"
    side = lambda c: f"CASE WHEN {c} IN (SELECT {c} FROM {rows} GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 10) THEN {c} ELSE '__other__' END"
    return {
        "breadth": f"SELECT 'recipient' AS key, count(DISTINCT recipient) AS count FROM facts WHERE {where} UNION ALL SELECT '{site}', count(DISTINCT {site}) FROM facts WHERE {where}",
        "depths": f"SELECT unnest(['p50', 'p90', 'p99', 'max']) AS key, unnest([CAST(round(1000 * x) AS BIGINT) for x in [quantile_cont({depth}, 0.5), quantile_cont({depth}, 0.9), quantile_cont({depth}, 0.99), CAST(max({depth}) AS DOUBLE)]]) AS count FROM facts WHERE ({where}) AND {depth} IS NOT NULL",
        "by_count": f"SELECT addr AS key, count FROM {pool} ORDER BY count DESC, addr LIMIT 12",
        "by_rate": f"SELECT addr AS key, total_tx AS count FROM {pool} WHERE total_tx >= 100 ORDER BY rate DESC, count DESC, addr LIMIT 12",
        "flow": f"SELECT e || '>' || t AS key, count(*) AS count FROM (SELECT {side('e')} AS e, {side('t')} AS t FROM {rows}) GROUP BY 1",
    }


def _site_parts(parts: dict[str, DataFrame], site: str) -> dict[str, DataFrame]:
    """The same of the operator's tables; depths in thousandths."""
    flat = lambda df, *columns, by=1: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.round(by * F.col(c)).cast("bigint").alias("count")) for c in columns])))
    board = lambda n, c: parts["recipient_leaderboards"].filter(F.col("board") == n).select("addr", F.col(c).alias("count"))
    return {
        "breadth": flat(parts["breadth"], "recipient", site), "depths": flat(parts["call_depth_percentiles"], "p50", "p90", "p99", "max", by=1000),
        "by_count": board("count", "count"), "by_rate": board("rate", "total_tx"), "flow": parts["flow"].select(F.concat_ws(">", "e", "t").alias("key"), F.col("n").alias("count")),
    }


_HALTED, _REVERTED = f"({P.G4}) AND {P.OOG}", f"({P.G4}) AND {P.NON_OOG}"


@query(_views_sql(
    total=f"SELECT 'n' AS key, count(*) AS count FROM facts WHERE {_HALTED}", opcode=mix_sql("oog_opcode", _HALTED), call_depth_hist=_depth_sql("oog_call_depth", _HALTED), oog_pattern=mix_sql("oog_pattern", _HALTED),
    gas_remaining_hist=" UNION ALL ".join(f"SELECT '{n}' AS key, count(*) AS count FROM facts WHERE ({_HALTED}) AND oog_gas_remaining >= {lo}" + (f" AND oog_gas_remaining < {hi}" if hi else "") for n, lo, hi in hist.MAGNITUDES),
    board=f"SELECT oog_contract AS key, count(*) AS count FROM facts WHERE ({_HALTED}) AND oog_contract IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {mixes.BOARD}", **_site_sql(_HALTED, "oog_contract", "oog_call_depth")), LABELS_SQL, TOTALS_SQL)
def oog_document(spark, sf_dir):
    parts = forensics.failure_site(held(facts(spark, sf_dir).filter(P.G4), "g4"), True, labels(spark, sf_dir), totals(spark, sf_dir))
    own = {k: parts[k] for k in ("opcode", "call_depth_hist", "oog_pattern", "gas_remaining_hist")}
    return _views({"total": parts["total"].select(F.lit("n").alias("key"), F.col("n").alias("count"))} | own | {"board": parts["contract_leaderboard"].select("addr", "count")} | _site_parts(parts, "oog_contract"))


@query(_views_sql(
    total=f"SELECT 'n' AS key, count(*) AS count FROM facts WHERE {_REVERTED}", opcode=mix_sql("divergence_opcode", _REVERTED), call_depth_hist=_depth_sql("divergence_call_depth", _REVERTED), failure_reason=mix_sql("failure_reason", _REVERTED),
    revert_error_mix="SELECT CASE WHEN r <= 5 THEN key ELSE 'Others' END AS key, sum(n) AS count FROM m GROUP BY 1", **_site_sql(_REVERTED, "divergence_contract", "divergence_call_depth")), TOTALS_SQL,
    f"m AS (SELECT trim(substr(revert_decoded, 15)) AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS r FROM facts WHERE ({_REVERTED}) AND revert_decoded LIKE 'Error(string):%' GROUP BY 1)")
def revert_document(spark, sf_dir):
    parts = forensics.failure_site(held(facts(spark, sf_dir).filter(P.G4), "g4"), False, labels(spark, sf_dir), totals(spark, sf_dir))
    own = {k: parts[k] for k in ("opcode", "call_depth_hist", "failure_reason", "revert_error_mix")}
    return _views({"total": parts["total"].select(F.lit("n").alias("key"), F.col("n").alias("count"))} | own | _site_parts(parts, "divergence_contract"))


# States and staging -----------------------------------------------------------------------------------------

_WIDTH = 10_000  # blocks of a bucket here
_INNER = "block_number BETWEEN 1500 AND (SELECT max(o_orderkey) - 700 FROM orders)"
_STATE_SQL = f"""count(*) AS n_rows, count(*) FILTER (WHERE {P.AF}) AS af, count(*) FILTER (WHERE {P.G2_DRILLIN}) AS g2_drillin, count(*) FILTER (WHERE {P.G3}) AS g3, count(*) FILTER (WHERE {P.G4}) AS g4, count(*) FILTER (WHERE {P.RESCUE}) AS rescues,
    CAST(sum(gas_delta) AS BIGINT) AS gas_sum, CAST(coalesce(sum(baseline_gas_used), 0) AS BIGINT) AS baseline_gas, min(gas_delta) AS gas_min, max(gas_delta) AS gas_max, """ + " || ',' || ".join(f"count(*) FILTER (WHERE {_LOG2} = {b})" for b in range(P.LOG2_BINS)) + " AS gas_hist"
_GROUP_SQL = f"CASE WHEN {P.AF} THEN 'af' WHEN {P.G2_DRILLIN} THEN 'g2' WHEN {P.G3} THEN 'g3' WHEN {P.G4} THEN 'g4' END"


def _bucket_store(spark, sf_dir, by: list[str]) -> tuple[DataFrame, str, tuple[int, int]]:
    """Facts by bucket, a store whose buckets were filled in three goes (one of them twice), and the inner range."""
    rows = state_store.bucketed(held(facts(spark, sf_dir), "facts"), _WIDTH)
    folder = f"{scratch_folder(spark)}/states-{uuid.uuid4().hex}"
    buckets = sorted(r[0] for r in rows.select("block_bucket").distinct().collect())
    for some in (buckets[::2], buckets[1::2], buckets[:3]):
        state_store.refresh(rows, states.DIVERGENCE, folder, some, "s", by)
    last = read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return rows, folder, (1500, last - 700)


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, CAST(month AS STRING) AS month, {_STATE_SQL} FROM facts WHERE {where} GROUP BY month" for part, where in (("all", "TRUE"), ("inner", _INNER))))
def bucket_states(spark, sf_dir):
    """States of all blocks and of a range that cuts buckets, merged from the store by month."""
    rows, folder, inner = _bucket_store(spark, sf_dir, ["month"])
    out = []
    for part, blocks in (("all", (0, inner[1] + 2 * _WIDTH)), ("inner", inner)):
        found, _ = state_store.over_range(rows, states.DIVERGENCE, folder, "s", blocks, ["month"], _WIDTH)
        out.append(found.select(F.lit(part).alias("part"), _text("month"), *[c for c in states.DIVERGENCE.figures if c != "gas_hist"], F.array_join("gas_hist", ",").alias("gas_hist")))
    return out[0].unionByName(out[1])


_COUNTED_SQL = {"group": _GROUP_SQL, "state_gas_category": f"{_GROUP_SQL} || ':' || coalesce(state_gas_category, 'none')", "tx_type": f"{_GROUP_SQL} || ':' || tx_type", "halt_opcode": f"CASE WHEN {P.G4} THEN oog_opcode END"}


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, '{which}' AS which, {e} AS value, count(*) AS n FROM facts WHERE {where} AND ({e}) IS NOT NULL GROUP BY 3" for part, where in (("all", "TRUE"), ("inner", _INNER)) for which, e in _COUNTED_SQL.items()))
def bucket_value_counts(spark, sf_dir):
    """The mixes of all blocks and of a range, merged from the store's value counts."""
    rows, folder, inner = _bucket_store(spark, sf_dir, [])
    out = [state_store.over_range(rows, states.DIVERGENCE, folder, "s", blocks, width=_WIDTH)[1].withColumn("part", F.lit(part)) for part, blocks in (("all", (0, inner[1] + 2 * _WIDTH)), ("inner", inner))]
    return out[0].unionByName(out[1])


@query(f"""SELECT block_number // {_WIDTH} AS block_bucket, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(block_number || '|' || tx_hash || '|' || gas_delta), 1, 8) AS BIGINT)) AS BIGINT) AS checksum,
    CAST(CASE WHEN count(*) FILTER (WHERE block_number % 5 = 0) = 0 OR block_number // {_WIDTH} % 3 <> 0 THEN 1 WHEN block_number // {_WIDTH} % 2 <> 0 THEN 2 ELSE 3 END AS INTEGER) AS attempts FROM facts GROUP BY 1, block_number // {_WIDTH} % 3, block_number // {_WIDTH} % 2""")
def stage_ledger(spark, sf_dir):
    """Staging through a reader that loses a fifth of the blocks of every third bucket once and of every sixth twice; the ledger that is kept."""
    rows = state_store.bucketed(as_facts(held(dated_items(spark, sf_dir), "items")), _WIDTH)
    of = lambda df: F.conv(F.substring(F.md5(F.concat_ws("|", "block_number", "tx_hash", "gas_delta").cast("binary")), 1, 8), 16, 10).cast("bigint")
    attempts = []

    def read(buckets: list[int]) -> DataFrame:
        attempts.append(1)
        short = F.col("block_bucket") % (3 if len(attempts) == 1 else 6) == 0
        lost = short & (F.col("block_number") % 5 == 0) & F.lit(len(attempts) < 3)
        return rows.filter(F.col("block_bucket").isin(buckets) & ~lost)

    expected = held(staging.ledger(rows, of(rows)), "expected")
    _, kept = staging.stage_checked(read, expected, f"{scratch_folder(spark)}/checked-{uuid.uuid4().hex}", of)
    return kept.withColumn("checksum", F.col("checksum").cast("bigint"))


@query("SELECT 'nation-' || c_nationkey AS file, c_nationkey AS nation, c_custkey AS id, c_acctbal AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, CAST(c_custkey AS STRING)) AS place FROM customer UNION ALL SELECT 'index', n, NULL, NULL, n FROM (SELECT count(*) AS n FROM customer)", base=False)
def document_folder(spark, sf_dir):
    """A document for each nation, its customers by balance, and an index, written as one commit over an older folder and read back."""
    folder = f"{scratch_folder(spark)}/documents-{uuid.uuid4().hex}"
    c = read_table(spark, sf_dir, "customer").withColumn("file", F.concat(F.lit("nation-"), "c_nationkey"))
    nations = c.select("file", "c_nationkey").distinct()
    ends = [nations.select("file", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("place"), F.lit("").alias("tie"), body.alias("body")) for kind, body in ((sink.HEAD, F.concat(F.lit('{"nation":'), "c_nationkey", F.lit(',"customers":['))), (sink.TAIL, F.lit("]}")))]
    one = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    rows = c.select("file", F.lit(sink.ITEM).alias("kind"), F.round(-100 * F.col("c_acctbal")).cast("bigint").alias("place"), F.col("c_custkey").cast("string").alias("tie"), one.alias("body"))
    index = c.agg(F.to_json(F.struct(F.count("*").alias("nation"))).alias("body"))
    sink.write_folder(sink.whole(nations, F.concat(F.lit("old-"), "file"), F.lit("{}")), folder)
    sink.write_folder(rows.unionByName(ends[0]).unionByName(ends[1]).unionByName(sink.whole(index, F.lit("index"), F.col("body"))), folder)
    back = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json", 1).alias("file"), F.from_json("value", "nation bigint, customers array<struct<id:bigint,balance:double>>").alias("d"))
    each = back.select("file", "d.nation", F.posexplode_outer("d.customers").alias("pos", "x"))
    return each.select("file", "nation", "x.id", "x.balance", F.coalesce(F.col("pos") + 1, F.col("nation")).cast("bigint").alias("place"))


_SITES_SQL = {"recipient": "recipient", "oog_contract": "oog_contract", "divergence_contract": "divergence_contract"}


def _breadth_sql(level: str, day: str, month: str, group: str) -> str:
    return " UNION ALL ".join(f"SELECT '{level}' AS level, {month} AS month, {day} AS day, '{w}' AS which, count(DISTINCT {c}) AS n FROM f WHERE {c} IS NOT NULL {group}" for w, c in _SITES_SQL.items())


@query("SELECT * FROM (" + " UNION ALL ".join((_breadth_sql("day", "day", "month", "GROUP BY 2, 3"), _breadth_sql("month", "NULL", "month", "GROUP BY 2"), _breadth_sql("all", "NULL", "NULL", ""))) + ") WHERE n > 0",
    "f AS (SELECT g4.recipient, g4.oog_contract, g4.divergence_contract, CAST(month AS STRING) AS month, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM g4 JOIN orders ON o_orderkey = block_number)")
def breadth_by_day(spark, sf_dir):
    """Distinct contracts of days, months and all time: rows are read for the days, the rest comes from bitmaps. The dictionary grows in two goes."""
    days = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.to_date("o_orderdate").cast("string").alias("day"))
    columns = list(_SITES_SQL)
    f = held(facts(spark, sf_dir).filter(P.G4).select("block_number", *columns, _text("month")).join(days, "block_number"), "sites")
    ids = distinct.dictionary(f.filter("block_number % 2 = 0"), columns)
    ids = distinct.dictionary(f, columns, ids)
    maps = held(distinct.bitmaps(f, columns, ids, ["month", "day"]), "bitmaps")
    return distinct.breadth_over(maps, {"day": ["month", "day"], "month": ["month"], "all": []})


# Search and manifests ---------------------------------------------------------------------------------------

_ENTRIES_SQL = "entries AS (SELECT 's' || s_suppkey AS address, lower(s_name) || ' ' || lower(CASE WHEN s_nationkey % 3 = 0 THEN 'Owner ' || s_nationkey ELSE '' END) AS text, s_suppkey % 7 AS footprint FROM supplier)"
_SHORT = ["S", " 1", "zz", "r 2", "owner", "OWNER 3", "", "  ", "#000", "no such name", "er#"]


@query(f"""SELECT query, CASE WHEN needle = '' THEN 0 ELSE n END AS n_hits, CASE WHEN needle = '' OR n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS kind, CASE WHEN needle <> '' AND n > 0 THEN hits END AS hits FROM (
    SELECT query, any_value(needle) AS needle, count(address) AS n, array_to_string(list(address ORDER BY footprint DESC, address) FILTER (WHERE address IS NOT NULL)[1:20], ',') AS hits
    FROM q LEFT JOIN entries ON contains(text, needle) GROUP BY query)""", _ENTRIES_SQL, "q AS (SELECT query, lower(trim(query)) AS needle FROM (SELECT s_name AS query FROM supplier UNION SELECT substr(s_name, 12) FROM supplier UNION SELECT unnest(" + repr(_SHORT) + ")))", base=False)  # fmt: skip
def name_search_index(spark, sf_dir):
    """Every supplier's name, its number and short texts, looked up in a stored index of names and owners."""
    s = read_table(spark, sf_dir, "supplier")
    owner = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("Owner "), "s_nationkey"))
    names = s.select(F.concat(F.lit("s"), "s_suppkey").alias("address"), F.col("s_name").alias("label"), owner.alias("owner_project"), (F.col("s_suppkey") % 7).alias("footprint"))
    folder = f"{scratch_folder(spark)}/names-{uuid.uuid4().hex}"
    search.write_index(names, folder)
    asked = s.select(F.col("s_name").alias("query")).union(s.select(F.col("s_name").substr(12, 99))).union(spark.createDataFrame([(q,) for q in _SHORT], "query string"))
    out = search.search(spark, folder, asked)
    return out.withColumn("hits", F.array_join(F.transform("hits", lambda h: h["address"]), ","))


_MANIFEST_SQL = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || event_id || '"}' WHEN 2 THEN '{"n": {"k": [' || event_id || ', 7]}, "k": true}' WHEN 3 THEN 'not json' ELSE '[' || event_id || ']' END"""


@query(f"""SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 1 THEN event_id WHEN 2 THEN 1 END AS k, CASE event_id % 5 WHEN 2 THEN event_id END AS deep, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN 'ARRAY' ELSE 'OBJECT' END AS kind
    FROM (SELECT user_id, max(event_id) AS event_id, max_by(props, event_id) AS props FROM events GROUP BY 1)""", base=False)  # fmt: skip
def run_manifest(spark, sf_dir):
    """The newest manifest of each user as a VARIANT, and fields that not all of them have, or have as another type."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_MANIFEST_SQL).alias("manifest_json"))
    newest = versioned.latest_columns(rows, "user_id", "event_id", ["manifest_json"])
    out = config.manifest_fields(newest, {"k": ("$.k", "bigint"), "deep": ("$.n.k[0]", "bigint")})
    return out.select("user_id", "event_id", "k", "deep", F.regexp_extract("manifest_kind", "^[A-Z]+", 0).alias("kind"))


_PAGE = 1000  # events of a landed page


@query(f"""SELECT 'item' AS kind, event_id // {_PAGE} AS page, event_id, user_id, value FROM events WHERE event_id // {_PAGE} NOT IN (2, 4)
    UNION ALL SELECT kind, page, NULL, NULL, NULL FROM (VALUES ('doubled', 1), ('missing before', 3), ('broken', 4), ('missing before', 5)) f(kind, page), (SELECT max(event_id) // {_PAGE} AS last FROM events) WHERE page <= last OR (kind = 'doubled' AND last >= 1)""", base=False)  # fmt: skip
def landed_pages(spark, sf_dir):
    """Events landed as pages of a cursor interface, of which the second came twice, the third not at all and the fifth broken; read back, with what is wrong."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value").withColumn("page", F.floor(F.col("event_id") / _PAGE)).filter("page <> 2")
    file = lambda c: F.concat(F.lit("page-"), F.lpad(F.col(c).cast("string"), 9, "0"))
    one = F.to_json(F.struct("event_id", "user_id", "value"))
    rows = e.select(file("page").alias("file"), "page", F.lit(sink.ITEM).alias("kind"), F.col("event_id").alias("place"), F.lit("").alias("tie"), one.alias("body"))
    each = e.select("page").distinct()
    since = F.when(F.col("page") > 0, F.concat(F.lit('"'), F.col("page") * _PAGE - 1, F.lit('"'))).otherwise("null")
    ends = [each.select(file("page").alias("file"), "page", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("place"), F.lit("").alias("tie"), body.alias("body")) for kind, body in ((sink.HEAD, F.concat(F.lit('{"since":'), since, F.lit(',"events":['))), (sink.TAIL, F.when(F.col("page") == 4, "").otherwise("]}")))]
    whole = rows.unionByName(ends[0]).unionByName(ends[1])
    whole = whole.unionByName(whole.filter("page = 1").withColumn("file", F.concat(F.col("file"), F.lit("-again"))))
    folder = f"{scratch_folder(spark)}/pages-{uuid.uuid4().hex}"
    sink.write_folder(whole, folder)
    back = held(pages.read_pages(spark, folder, "events", "event_id"), "pages")
    number = F.regexp_extract("page", r"page-(\d+)", 1).cast("bigint")
    found = pages.faults(held(pages.pages_of(back), "page-ends")).select(F.col("fault").alias("kind"), number.alias("page"), *[F.lit(None).cast(k).alias(c) for c, k in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))])
    items = pages.items_of(back, "event_id bigint, user_id bigint, value double")
    return items.select(F.lit("item").alias("kind"), number.alias("page"), "event_id", "user_id", "value").unionByName(found)
