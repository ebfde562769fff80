"""Predicates and classifications of a replayed transaction, written once (SQL text or Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The partition's predicates, as defined by the data's contract. Three-valued on purpose.
AF = "baseline_success = false"
G2_DRILLIN = "baseline_success = true AND schedule_success = true"
G3 = "baseline_success = true AND schedule_success = false AND min_multiplier_to_succeed > 1"
G4 = "baseline_success = true AND schedule_success = false AND min_multiplier_to_succeed IS NULL"
G4_NOT_GAS_FIXABLE = f"({G4}) AND replay_halt_oog = false"
G4_STILL_OOG = f"({G4}) AND replay_halt_oog = true"
RESCUE = "baseline_success = false AND schedule_success = true"
OUTER_LIMIT_ONLY = "outer_limit_only_failure = 1"
OOG = "(oog_pattern IS NOT NULL OR oog_call_depth IS NOT NULL OR replay_halt_oog = true)"
NON_OOG = f"NOT {OOG} AND status_changed = true"
STATUS_FLIP = "baseline_success AND NOT schedule_success"
TRACE_ONLY = "NOT event_logs_changed AND NOT output_changed AND NOT logs_bloom_changed"

TX_SHAPES = ("creation", "authorization", "simple_transfer", "contract_call")
TX_TYPES = ("legacy", "access_list", "dynamic_fee", "blob", "set_code", "unknown")
PERCENT_EDGES = (-100, -50, -25, -10, -1, 0, 1, 10, 25, 50, 100, 200, 500)
LOG2_BINS = 12
INITCODE = "^0x6[01]"
FAILING_SELECTOR = "coalesce(tier1_failing_selector, entry_selector)"


def drill_in_group(schedule_success: Column, multiplier: Column, baseline_success: Column) -> Column:
    """af, g2, g3 or g4 of one row; a failing row without a multiplier above 1 is g4, and a null baseline is af."""
    failing = F.when(multiplier > 1, "g3").otherwise("g4")
    return F.when(F.coalesce(baseline_success, F.lit(False)), F.when(schedule_success, "g2").otherwise(failing)).otherwise("af")


def is_initcode(selector: Column) -> Column:
    return F.coalesce(selector.rlike(INITCODE), F.lit(False))


def tx_shape() -> Column:
    bare = (F.coalesce(F.col("input_zero_bytes"), F.lit(0)) == 0) & (F.coalesce(F.col("input_nonzero_bytes"), F.lit(0)) == 0)
    return F.when(F.col("is_create"), "creation").when(F.col("has_authorization") == 1, "authorization").when(bare & F.col("recipient").isNotNull(), "simple_transfer").otherwise("contract_call")


def tx_type() -> Column:
    out = F.lit("unknown")
    for i, name in reversed(list(enumerate(TX_TYPES[:5]))):
        out = F.when(F.col("tx_type") == i, name).otherwise(out)
    return out


def log2_bin(x: Column) -> Column:
    """0 for 0, else one more than the binary magnitude, at most 11; null for null."""
    return F.when(x == 0, 0).when(x.isNotNull(), F.least(F.floor(F.log2(F.abs(x))) + 1, F.lit(LOG2_BINS - 1))).cast("int")


def signed_bin(x: Column) -> tuple[Column, Column]:
    """Sign (0 counts as +1) and binary magnitude."""
    return F.when(x < 0, -1).otherwise(1), F.when(F.abs(x) < 1, 0).otherwise(F.floor(F.log2(F.abs(x)))).cast("int")


def percent_bin(x: Column) -> Column:
    """Index of the bin of PERCENT_EDGES, closed on the left; null below the first edge and for null."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(PERCENT_EDGES):
        out = F.when(x >= float(edge), i).otherwise(out)
    return out


def percent(delta: Column, base: Column) -> Column:
    """100 delta / base, null where base is null or not positive."""
    return F.when(base > 0, F.lit(100.0) * delta / base)
