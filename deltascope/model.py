"""Table shapes, enumerations and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

GROUPS = {"g1": "No change", "g2": "Succeeds with changes", "g3": "Fixable", "g4": "Potentially broken", "af": "Already failing", "g5": "Unknown"}

# The taxonomies that labels are checked against.
CATEGORIES = ("precompile", "stablecoin", "token", "swap_dex", "defi_complex", "bridge", "account_abstraction", "wallet_safe", "mev_bot", "nft", "oracle", "infra", "cex", "other", "unknown")
UPGRADE_MECHANISMS = ("none", "eip1967_transparent", "uups", "beacon", "diamond", "minimal_proxy_immutable")
SOURCES = ("manual", "oli", "dune", "ethlists", "mev", "heuristic", "unknown")
CONFIDENCES = ("high", "medium", "low")
#: Sources that own the taxonomy, by precedence; mev is an overlay.
PRECEDENCE = ("manual", "oli", "dune", "ethlists", "heuristic", "unknown")

LABEL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("address", "label", "category", "owner_project", "source", "confidence")]
    + [T.StructField("is_mev_bot", T.BooleanType()), T.StructField("mev_role", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("is_proxy", "is_factory", "is_safe")]
    + [T.StructField("erc_type", T.StringType()), T.StructField("is_upgradable", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("upgrade_mechanism", "upgrade_admin")]
)

COVERAGE = "block_number bigint, block_timestamp timestamp, tx_count bigint, tx_count_unchanged bigint, tx_count_gas_only bigint, tx_count_stored bigint, retained_drill_in_count bigint, drill_ins_truncated boolean"

# Columns of one replayed transaction that the analysis keeps, with their types, grouped by what they tell:
# the transaction and its outcome, its shape, where it ran out of gas, where it diverged, selectors, state gas, access counts.
DIVERGENCE = (
    "block_number bigint, tx_hash string, baseline_success boolean, schedule_success boolean, "
    "min_multiplier_to_succeed double, gas_delta bigint, baseline_gas_used bigint, status_changed boolean, "
    "event_logs_changed boolean, output_changed boolean, logs_bloom_changed boolean, recipient string, "
    "is_create boolean, tx_type smallint, has_authorization smallint, input_zero_bytes bigint, "
    "input_nonzero_bytes bigint, oog_pattern string, oog_call_depth int, oog_bottleneck_kind string, "
    "oog_bottleneck_depth int, oog_contract string, oog_opcode string, oog_gas_remaining bigint, "
    "replay_halt_oog boolean, surcharge_at_oog bigint, divergence_contract string, divergence_opcode string, "
    "divergence_call_depth int, failure_reason string, revert_decoded string, entry_selector string, "
    "tier1_failing_selector string, failure_selector_path string, state_gas_category string, "
    "reservoir_exhausted boolean, runtime_state_gas_spillover bigint, schedule_initial_reservoir bigint, "
    "cold_account_access_count bigint, sload_cold_count bigint, sstore_cold_count bigint, "
    "access_list_address_count bigint, access_list_storage_key_count bigint"
)
DIVERGENCE_COLUMNS = [c.split()[0] for c in DIVERGENCE.split(", ")]
#: The heavy column that no analysis may read.
FORBIDDEN = "trace_payload"
