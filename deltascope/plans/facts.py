"""The analysis's input tables, played by the driver's tables: columns are SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.operators.versioned import latest_version
from deltascope.sources.tables import read_table

VERSION = "l_shipdate l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_returnflag l_linestatus".split()
_DELTA = "CAST(round(l_extendedprice * (l_tax - l_discount)) AS BIGINT)"
_PICK = "CASE WHEN {cond} THEN CASE {n} {cases} END END"


def _choice(cond: str, n: str, values: list[str]) -> str:
    return _PICK.format(cond=cond, n=n, cases=" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v))


_OOG, _REV = f"{_DELTA} < 0", f"{_DELTA} >= 0"
#: One replayed transaction per newest line item.
COLUMNS = {
    "block_number": "l_orderkey",
    "tx_hash": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "baseline_success": "l_returnflag <> 'R'",
    "schedule_success": "l_linestatus = 'O'",
    "min_multiplier_to_succeed": "CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 WHEN l_discount >= 0.05 THEN 1 + l_quantity / 6 END",
    "gas_delta": _DELTA,
    "baseline_gas_used": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(round(l_extendedprice) AS BIGINT) END",
    "status_changed": "(l_returnflag <> 'R') <> (l_linestatus = 'O')",
    "event_logs_changed": "l_linenumber % 2 = 0",
    "output_changed": "l_partkey % 3 = 0",
    "logs_bloom_changed": "l_partkey % 5 = 0",
    "recipient": "CASE WHEN l_suppkey % 17 <> 0 THEN 's' || CAST(l_suppkey AS STRING) END",
    "is_create": "l_suppkey % 17 = 0",
    "tx_type": "l_linenumber - 1",
    "has_authorization": "CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END",
    "input_zero_bytes": "l_partkey % 4",
    "input_nonzero_bytes": "l_suppkey % 3",
    "oog_pattern": _choice(_OOG, "l_partkey % 5", ["storage_heavy", "call_chain", "loop", "memory_expansion"]),
    "oog_call_depth": f"CASE WHEN {_OOG} AND l_partkey % 5 <> 4 THEN l_linenumber + l_suppkey % 5 END",
    "oog_bottleneck_kind": _choice(_OOG, "l_partkey % 4", ["FractionalGas", "FixedGas", "Stipend2300"]),
    "oog_contract": f"CASE WHEN {_OOG} THEN CASE WHEN l_partkey % 2 = 0 THEN 's' || CAST(l_partkey % 100 AS STRING) ELSE 'p' || CAST(l_partkey AS STRING) END END",
    "oog_opcode": _choice(_OOG, "l_partkey % 3", ["SLOAD", "SSTORE", "CALL"]),
    "oog_gas_remaining": f"CASE WHEN {_OOG} THEN (l_partkey * 379) % 2000003 - l_partkey % 3 END",
    "replay_halt_oog": "CASE l_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END",
    "surcharge_at_oog": f"CASE WHEN {_OOG} THEN l_partkey % 1000 END",
    "divergence_contract": f"CASE WHEN {_REV} THEN 's' || CAST(l_partkey % 100 AS STRING) END",
    "divergence_opcode": _choice(_REV, "l_partkey % 2", ["REVERT", "INVALID"]),
    "divergence_call_depth": f"CASE WHEN {_REV} THEN l_linenumber + l_suppkey % 5 END",
    "failure_reason": _choice(_REV, "l_partkey % 3", ["Revert", "InvalidJump", "StackUnderflow"]),
    "revert_decoded": f"CASE WHEN {_REV} AND l_partkey % 2 = 0 THEN 'Error(string): message ' || CAST(l_partkey % 9 AS STRING) END",
    "entry_selector": "'0x6' || CAST(l_partkey % 10 AS STRING)",
    "tier1_failing_selector": "CASE WHEN l_partkey % 4 <> 0 THEN '0x6' || CAST((l_partkey + 1) % 10 AS STRING) END",
    "state_gas_category": _choice("TRUE", "l_partkey % 6", ["access_list", "authorization", "contract_creation", "transfer_new_account"]),
    "reservoir_exhausted": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 3 = 0 END",
    "runtime_state_gas_spillover": "CASE WHEN l_partkey % 13 <> 0 THEN l_partkey % 4 END",
    "schedule_initial_reservoir": "l_partkey * 10",
    "cold_account_access_count": "CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 23 END",
    "sload_cold_count": "l_partkey % 7",
    "sstore_cold_count": "CASE WHEN l_linenumber > 3 THEN l_partkey % 5 END",
    "access_list_address_count": "CASE WHEN l_linenumber = 1 THEN l_partkey % 3 END",
    "access_list_storage_key_count": "CASE WHEN l_linenumber = 2 THEN l_partkey % 4 END",
}

_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in VERSION)}) AS rn FROM lineitem) WHERE rn = 1"
#: The same facts for DuckDB, to put in front of a query.
FACTS_SQL = f"""WITH li AS ({_LATEST}),
facts AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())}, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM li JOIN orders ON o_orderkey = l_orderkey),
g4 AS (SELECT * FROM facts WHERE baseline_success AND NOT schedule_success AND min_multiplier_to_succeed IS NULL)"""


def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in VERSION], by=["l_orderkey"])


def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest line items with the month of their order: a quarter of the columns of facts, so what is held as these is written and read in less time."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    rows = latest_items(spark, sf_dir).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", *[c for c in VERSION if c != "l_shipdate"], "month")


def as_facts(items: DataFrame) -> DataFrame:
    """Dated items as replayed transactions."""
    return items.selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()], "month")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest line items as replayed transactions, with the month of their order."""
    return as_facts(dated_items(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of suppliers, in the label schema's leading columns."""
    s = read_table(spark, sf_dir, "supplier")
    return s.selectExpr("'s' || CAST(s_suppkey AS STRING) AS address", "CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey AS STRING) ELSE s_name END AS label", "CASE WHEN s_nationkey % 5 = 0 THEN 'unknown' ELSE 'token' END AS category", "CASE WHEN s_suppkey % 4 = 0 THEN 'owner' || CAST(s_nationkey AS STRING) END AS owner_project")


LABELS_SQL = "names AS (SELECT 's' || CAST(s_suppkey AS STRING) AS address, CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey AS STRING) ELSE s_name END AS label, CASE WHEN s_nationkey % 5 = 0 THEN 'unknown' ELSE 'token' END AS category, CASE WHEN s_suppkey % 4 = 0 THEN 'owner' || CAST(s_nationkey AS STRING) END AS owner_project FROM supplier)"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy(F.expr("'s' || CAST(l_suppkey AS STRING)").alias("addr")).agg(F.count("*").alias("total_tx"))


TOTALS_SQL = "totals AS (SELECT 's' || CAST(l_suppkey AS STRING) AS addr, count(*) AS total_tx FROM lineitem GROUP BY 1)"
