"""Affected contracts in the form in which they are published: one nested row each, names and signatures resolved, figures not yet rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.model import LABEL
from deltascope.operators import clusters
from deltascope.operators import labels as L
from deltascope.sources.tables import held

#: Label fields that a fresh probe of the chain sets over the record's own.
PROBED = ("is_proxy", "is_factory", "is_safe", "erc_type")


def records(names: DataFrame) -> DataFrame:
    """Label records with all fields of the schema, those that names lacks null, and the published defaults: a blank label is the address, unknown category and source are null, low confidence."""
    fields = {f.name: (F.col(f.name) if f.name in names.columns else F.lit(None)).cast(f.dataType) for f in LABEL.fields}
    out = fields | {
        "label": F.coalesce(F.nullif(fields["label"], F.lit("")), fields["address"]),
        "category": F.nullif(fields["category"], F.lit("unknown")),
        "source": F.nullif(fields["source"], F.lit("unknown")),
        "confidence": F.coalesce(fields["confidence"], F.lit("low")),
        "is_mev_bot": F.coalesce(fields["is_mev_bot"], F.lit(False)),
        "upgrade_mechanism": F.nullif(fields["upgrade_mechanism"], F.lit("none")),
    }
    blank = ("owner_project", "mev_role", "upgrade_admin")
    return names.select(*[(F.nullif(c, F.lit("")) if n in blank else c).alias(n) for n, c in out.items()])


def named(rows: DataFrame, column: str, names: DataFrame, label: str, category: str) -> DataFrame:
    """rows with the label and category of the address in column; an address without a record is its own label, null has neither."""
    own = names.select(F.col("address").alias("_address"), F.col("label").alias("_label"), F.col("category").alias("_category"))
    met = rows.join(own, F.col(column) == F.col("_address"), "left")
    return met.withColumns({label: F.coalesce("_label", column), category: F.col("_category")}).drop("_address", "_label", "_category")


def headers(contracts: DataFrame, names: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """The identity of each contract: its label record or the defaults; probes (records read from the chain) win for what they know."""
    own = [f for f in LABEL.names if f != "address"]
    met = contracts.select("contract").join(names.withColumnRenamed("address", "contract"), "contract", "left")
    defaults = {"label": F.coalesce("label", "contract"), "confidence": F.coalesce("confidence", F.lit("low")), "is_mev_bot": F.coalesce("is_mev_bot", F.lit(False))}
    met = met.withColumns(defaults)
    if probes is None:
        return met.select("contract", *own)
    fresh = records(probes).select(F.col("address").alias("contract"), F.struct(*PROBED, "is_upgradable", "upgrade_mechanism", "upgrade_admin").alias("p"))
    met = met.join(fresh, "contract", "left")
    taken = {c: F.coalesce(F.when(F.col(f"p.{c}").cast("string") != "false", F.col(f"p.{c}")), F.col(c)) for c in PROBED}
    upgrade = F.col("p.upgrade_mechanism").isNotNull()
    taken |= {c: F.when(upgrade, F.col(f"p.{c}")).otherwise(F.col(c)) for c in ("is_upgradable", "upgrade_mechanism", "upgrade_admin")}
    return met.withColumns(taken).select("contract", *own)


def role_summary() -> Column:
    """Of role counts: a struct by role, null where the contract has not that role."""
    entry = F.struct(F.col("entry").alias("g4_tx_count"), F.col("entry_oog").alias("g4_oog_count"), (F.col("entry") - F.col("entry_oog")).alias("g4_nonoog_count"))
    return F.struct(
        F.when(F.col("entry") > 0, entry).alias("entry"), F.when(F.col("halts") > 0, F.struct(F.col("halts").alias("halt_count"))).alias("oog_site"),
        F.when(F.col("reverts") > 0, F.struct(F.col("reverts").alias("revert_count"))).alias("revert_site"),
    ).alias("roles_summary")


class Decoder:
    """Signatures of selectors by category, worked out once for all that are asked for; without a cache, none is known."""

    def __init__(self, asked: DataFrame, selectors: DataFrame | None) -> None:
        self.known = None if selectors is None else held(L.decode_selectors(asked.select("selector", "category"), selectors), "signatures")  # its size is known, so that a small one is sent to the rows

    def add(self, rows: DataFrame, selector: str, name: str) -> DataFrame:
        """rows (with category) and the signature of the selector column."""
        if self.known is None:
            return rows.withColumn(name, F.lit(None).cast("string"))
        own = self.known.select(F.col("selector").alias("_selector"), F.col("category").alias("_category"), F.col("signature").alias(name))
        return rows.join(own, (F.col(selector) == F.col("_selector")) & F.col("category").eqNullSafe(F.col("_category")), "left").drop("_selector", "_category")


def _packed(rows: DataFrame, name: str, *fields: Column | str) -> DataFrame:
    """contract and the rows as an array of structs in order of place; at most a few rows a contract."""
    packed = F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("x"))))
    return rows.groupBy("contract").agg(F.transform(packed, lambda r: r["x"]).alias(name))


def shards(found: DataFrame, counts: DataFrame, figures: DataFrame, top: DataFrame, names: DataFrame, selectors: DataFrame | None = None, rates: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """One row per contract with the published keys.

    found: failure clusters; counts: role counts; figures and top: clusters.context_figures and top_values; names: label records;
    rates: clusters.failure_rates. Shares, rates and averages are raw doubles, rounded where documents are written.
    """
    names = records(names)
    kind = names.select(F.col("address").alias("contract"), "category")
    found, top = (rows.join(kind, "contract", "left") for rows in (found, top))
    functions = F.col("which").isin("entry_functions", "failing_functions")
    asked = found.select(F.explode(F.array("failing_selector", "entry_selector")).alias("selector"), "category")
    asked = asked.unionByName(top.filter(functions).select(F.col("value").alias("selector"), "category")).filter("selector is not null").distinct()
    decoder = Decoder(asked, selectors)
    shown = decoder.add(decoder.add(found, "failing_selector", "selector_signature"), "entry_selector", "entry_signature").drop("category")
    shown = named(shown, "where_contract", names, "where_label", "where_category")
    shown = _packed(
        shown, "failure_clusters", "role", "kind", F.col("failing_selector").alias("selector"), "selector_signature", "entry_selector", "entry_signature", "where_contract", "where_label", "where_category",
        "opcode", "pattern_or_reason", "oog_bottleneck_kind", "call_depth", "revert_decoded", "count", "share_of_role", "share_of_contract",
        F.struct(F.col("gas_avg").alias("avg"), F.col("gas_p50").alias("p50"), F.col("gas_p90").alias("p90")).alias("gas_delta"), "drivers", "state_gas_category",
        F.transform("examples", lambda e: F.struct(e["tx_hash"].alias("tx_hash"), e["block_number"].alias("block_number"), e["gas_delta"].alias("gas_delta"))).alias("examples"),
    )
    top = named(decoder.add(top, "value", "signature").withColumnRenamed("category", "_own"), "value", names, "label", "category")
    of_function = F.struct(F.col("value").alias("selector"), "signature", "count")
    of_contract = F.struct(F.col("value").alias("contract"), "label", "category", "count")
    mixes = top.groupBy("contract").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == n, F.struct("place", x.alias("x"))))), lambda r: r["x"]).alias(n)
        for n in clusters.MIXES for x in (of_function if n.endswith("functions") else of_contract,)
    ])
    context = figures.join(mixes, "contract", "left")
    if rates is None:
        rates = counts.select("contract", F.lit(None).cast("bigint").alias("total_tx"), *[F.lit(None).cast("double").alias(c) for c in ("halt_rate", "revert_rate")])
    context = context.join(rates, "contract", "left")
    rate = F.when(F.col("total_tx").isNotNull(), F.struct("total_tx", "halt_rate", "revert_rate"))
    empty = {n: F.coalesce(F.col(n), F.array().cast(mixes.schema[n].dataType)).alias(n) for n in clusters.MIXES}
    context = context.select("contract", F.struct(
        "g3_tx_count", "g2_drillin_tx_count", "af_tx_count", "status_flips",
        F.struct(F.col("gas_avg").alias("avg"), F.col("gas_sum").alias("sum"), F.col("gas_p50").alias("p50"), F.col("gas_p90").alias("p90")).alias("gas_delta"),
        "block_span_start", "block_span_end", "distinct_blocks", rate.alias("failure_rate"), *empty.values(),
    ).alias("context"))
    out = headers(counts, names, probes).join(counts.select("contract", role_summary()), "contract").join(clusters.cluster_summary(found), "contract").join(shown, "contract").join(context, "contract")
    header = [c for c in LABEL.names if c != "address"]
    return out.select(F.col("contract").alias("address"), *header, "roles_summary", "distinct_cluster_count", "clusters_shown_share", "failure_clusters", "context")


def _rounded(value, places: int = 4):
    return None if value is None else round(value, places)


def known(fields: dict | None, places: int = 4) -> dict:
    """The fields that are not null, doubles rounded half-even as Python does."""
    return {k: round(v, places) if isinstance(v, float) else v for k, v in (fields or {}).items() if v is not None}


def document(shard: dict) -> dict:
    """A shard's JSON value in its published form: figures rounded, causes and roles that it has not left out."""
    whole = lambda x: 0 if x is None else int(round(x))
    out = dict(shard)
    out["roles_summary"] = known(shard["roles_summary"])
    out["clusters_shown_share"] = _rounded(shard["clusters_shown_share"])
    out["failure_clusters"] = [
        c | {"share_of_role": _rounded(c["share_of_role"]), "share_of_contract": _rounded(c["share_of_contract"]), "gas_delta": c["gas_delta"] | {"avg": whole(c["gas_delta"]["avg"])}, "drivers": known(c["drivers"]), "state_gas_category": c["state_gas_category"] or []}
        for c in shard["failure_clusters"]
    ]
    context = dict(shard["context"])
    context["gas_delta"] = context["gas_delta"] | {"avg": whole(context["gas_delta"]["avg"])}
    context["failure_rate"] = context["failure_rate"] and known(context["failure_rate"], 6)
    return out | {"context": context}
