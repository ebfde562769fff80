"""Partial states of figures by bucket of blocks. States merge, so a range is put together from stored ones and new blocks cost their own scan alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.functions import predicates as P
from deltascope.operators import partition
from deltascope.operators.hist import resize, sum_arrays_fixed


@dataclass(frozen=True)
class Spec:
    """What a state holds, each as SQL over the rows: sums of whole numbers (null adds nothing), extremes, arrays summed element by element
    (with their length; shorter ones are padded) and counted values (null is not counted)."""

    sums: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    most: dict[str, str] = field(default_factory=dict)
    arrays: dict[str, tuple[str, int]] = field(default_factory=dict)
    counted: dict[str, str] = field(default_factory=dict)

    @property
    def figures(self) -> list[str]:
        return ["n_rows", *self.sums, *self.least, *self.most, *self.arrays]


def partial(rows: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """keys and the figures of each group of rows."""
    total = lambda e: F.coalesce(F.sum(F.expr(e).cast("bigint")), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[total(e).alias(n) for n, e in spec.sums.items()], *[F.min(F.expr(e)).alias(n) for n, e in spec.least.items()],
        *[F.max(F.expr(e)).alias(n) for n, e in spec.most.items()], *[sum_arrays_fixed(resize(F.expr(e), k), k).alias(n) for n, (e, k) in spec.arrays.items()],
    )


def partial_counts(rows: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """keys, which, value (as text), n: how often each counted value occurs in each group; one unpivot and one count for all."""
    each = F.array(*[F.struct(F.lit(w).alias("which"), F.expr(e).cast("string").alias("value")) for w, e in spec.counted.items()])
    return rows.select(*keys, F.inline(each)).filter("value is not null").groupBy(*keys, "which", "value").agg(F.count("*").alias("n"))


def merged(states: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """The state of each group of states, as if made from all their rows at once; without keys and states, zeros and nulls."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return states.groupBy(*keys).agg(
        total("n_rows"), *[total(n) for n in spec.sums], *[F.min(n).alias(n) for n in spec.least], *[F.max(n).alias(n) for n in spec.most], *[sum_arrays_fixed(F.col(n), k).alias(n) for n, (_, k) in spec.arrays.items()]
    )


def merged_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.filter("n > 0").groupBy(*keys, "which", "value").agg(F.sum("n").alias("n"))


#: Of the staged blocks: what the run's metadata, the coverage totals and the series in time are made of.
BLOCKS = Spec(
    sums={c: c for c in ("tx_count", *partition.PARTS, "rescues")} | {"truncated_blocks": "CAST(drill_ins_truncated AS INT)"},
    least={"block_start": "block_number", "day_start": "day"}, most={"block_end": "block_number", "day_end": "day"},
)

#: Of gas-only block summaries: the mixes of the aggregate cohort, its gas figures and its two histograms.
SUMMARY = Spec(
    sums={"tx_count": "tx_count"} | {f"tx_count_{k}": f"tx_count_{k}" for ks in (*partition.SUMMARY_VIEWS.values(), ("authorization",)) for k in ks} | {"gas_delta_sum": "gas_delta_sum", "baseline_gas_used_sum": "baseline_gas_used_sum"},
    least={"gas_delta_min": "gas_delta_min"}, most={"gas_delta_max": "gas_delta_max"},
    arrays={"gas_delta_log2_hist": ("gas_delta_log2_hist", P.LOG2_BINS), "gas_delta_pct_hist": ("gas_delta_pct_hist", len(P.PERCENT_EDGES))},
)

_GROUP = f"CASE WHEN {P.AF} THEN 'af' WHEN {P.G2_DRILLIN} THEN 'g2' WHEN {P.G3} THEN 'g3' WHEN {P.G4} THEN 'g4' END"
#: Of replayed transactions: group sizes, gas, its binary histogram, and the mixes by group.
DIVERGENCE = Spec(
    sums={n: f"CASE WHEN {p} THEN 1 ELSE 0 END" for n, p in (("af", P.AF), ("g2_drillin", P.G2_DRILLIN), ("g3", P.G3), ("g4", P.G4), ("rescues", P.RESCUE))} | {"gas_sum": "gas_delta", "baseline_gas": "baseline_gas_used"},
    least={"gas_min": "gas_delta"}, most={"gas_max": "gas_delta"},
    arrays={"gas_hist": (f"CASE WHEN gas_delta IS NULL THEN array() ELSE transform(sequence(0, {P.LOG2_BINS - 1}), i -> CASE WHEN i = CASE WHEN gas_delta = 0 THEN 0 ELSE least(floor(log2(abs(gas_delta))) + 1, {P.LOG2_BINS - 1}) END THEN 1L ELSE 0L END) END", P.LOG2_BINS)},
    counted={"group": _GROUP, "state_gas_category": f"{_GROUP} || ':' || coalesce(state_gas_category, 'none')", "tx_type": f"{_GROUP} || ':' || tx_type", "halt_opcode": f"CASE WHEN {P.G4} THEN oog_opcode END"},
)


def meta(states: DataFrame) -> DataFrame:
    """partition.meta from states of BLOCKS, with n_blocks and truncated_blocks beside it."""
    one = merged(states, BLOCKS, [])
    share = F.try_divide(F.col("truncated_blocks").cast("double"), F.col("n_rows").cast("double"))
    return one.select("block_start", "block_end", (F.col("block_end") - F.col("block_start") + 1).alias("block_count"), "day_start", "day_end", "tx_count", *partition.PARTS, "rescues", share.alias("truncated_share"), F.col("n_rows").alias("n_blocks"), "truncated_blocks")


def overview(states: DataFrame, by: str = "day") -> DataFrame:
    """partition.overview from states of BLOCKS that are kept by day (or another key)."""
    return merged(states.filter("n_rows > 0"), BLOCKS, [by]).select(by, "block_start", "block_end", "tx_count", *partition.PARTS, "rescues", "truncated_blocks").orderBy(by)
