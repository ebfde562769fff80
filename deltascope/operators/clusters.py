"""Failure clusters of affected contracts, for all contracts in one set-based plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.functions import predicates as P
from deltascope.functions.scalars import family
from deltascope.operators import hist
from deltascope.operators.mixes import mix, topk_per_key
from deltascope.sources.tables import held

CLUSTERS, EXAMPLES, BREAKDOWN, PROBES = 8, 2, 8, 1000
#: Rows of a cluster up to which one aggregate holds them all; larger ones are counted by value.
SMALL = 10_000
KEY = ["role", "kind", "failing_selector", "where_contract", "opcode", "pattern_or_reason", "oog_bottleneck_kind", "call_depth", "revert_decoded"]

#: Columns of the rows of roles() that the analysis of contracts reads.
ROLED = [
    *KEY, "block_number", "tx_hash", "gas_delta", "recipient", "oog_contract", "divergence_contract", "entry_selector", "state_gas_category", "cold_account_access_count", "sload_cold_count", "sstore_cold_count",
    "access_list_address_count", "access_list_storage_key_count", "surcharge_at_oog", "oog_gas_remaining", "reservoir_exhausted", "runtime_state_gas_spillover",
]


def roles(g4: DataFrame) -> DataFrame:
    """Up to three rows per transaction, one for each role that names a contract, with role, kind and the kind's own columns."""
    parts = F.array(F.struct(F.lit("entry").alias("role"), F.col("recipient").alias("contract")), F.struct(F.lit("oog_site").alias("role"), F.col("oog_contract").alias("contract")), F.struct(F.lit("revert_site").alias("role"), F.col("divergence_contract").alias("contract")))
    r = g4.select("*", F.inline(parts)).filter("contract is not null")
    oog = F.when(F.col("role") == "entry", F.col("oog_contract").isNotNull()).otherwise(F.col("role") == "oog_site")
    either = lambda a, b: F.when(F.col("kind") == "oog", F.col(a)).otherwise(F.col(b))
    r = r.withColumn("kind", F.when(oog, "oog").otherwise("non_oog"))
    return r.withColumns({
        "failing_selector": F.expr(P.FAILING_SELECTOR),
        "where_contract": either("oog_contract", "divergence_contract"),
        "opcode": either("oog_opcode", "divergence_opcode"),
        "pattern_or_reason": either("oog_pattern", "failure_reason"),
        "call_depth": either("oog_call_depth", "divergence_call_depth"),
        "oog_bottleneck_kind": F.when(F.col("kind") == "oog", F.col("oog_bottleneck_kind")),
        "revert_decoded": F.when(F.col("kind") == "non_oog", F.col("revert_decoded")),
    })


def _whole(q: Column) -> Column:
    """Rounded to a whole number, halves to the even one; the first rounding takes away the noise of interpolation."""
    return F.rint(F.round(q, 6)).cast("bigint")


#: Causes whose median and 90th percentile are published, and their columns.
PAIRS = {"cold_account": "cold_account_access_count", "sload": "sload_cold_count", "sstore": "sstore_cold_count", "gas_remaining_at_oog": "oog_gas_remaining"}


def figures(rows: DataFrame, keys: list[str], *more: Column, causes: bool = True, small: bool = False) -> DataFrame:
    """keys, gas figures, more aggregates and, unless causes is false, drivers of each group.

    drivers is a struct of the causes; a cause whose columns are all null is null (and so left out of JSON).
    small: no group has more than a few thousand rows, so its percentiles are aggregates beside the others.
    """
    at = lambda name, i: _whole(F.col(f"q_{name}")[i])
    gas = [at("gas", 0).alias("gas_p50"), at("gas", 1).alias("gas_p90")]
    plain = [F.avg("gas_delta").alias("gas_avg"), F.min("gas_delta").alias("gas_min"), F.max("gas_delta").alias("gas_max"), *more]

    def aggregated(asked: dict[str, Column], *own: Column) -> DataFrame:
        if small:
            points = F.array(F.lit(0.5), F.lit(0.9))
            return rows.groupBy(*keys).agg(*own, *[F.percentile(v.cast("double"), points).alias(f"q_{n}") for n, v in asked.items()])
        return rows.groupBy(*keys).agg(*own).join(hist.quantiles(rows, keys, asked, (0.5, 0.9)), keys, "left")

    if not causes:
        own = aggregated({"gas": F.col("gas_delta")}, *plain)
        return own.select(*[c for c in own.columns if c != "q_gas"], *gas)
    access = F.coalesce("access_list_address_count", F.lit(0)) + F.coalesce("access_list_storage_key_count", F.lit(0))
    asked = {"gas": F.col("gas_delta"), "access": access, "surcharge": F.col("surcharge_at_oog")} | {n: F.col(c) for n, c in PAIRS.items()}
    n = F.count("*").cast("double")
    share = lambda column, flag: F.when(F.count(column) > 0, F.count_if(flag) / n)
    both = aggregated(
        asked, (F.count("access_list_address_count") + F.count("access_list_storage_key_count")).alias("_listed"), F.sum("surcharge_at_oog").alias("_surcharge"),
        share("reservoir_exhausted", F.col("reservoir_exhausted")).alias("_exhausted"), share("runtime_state_gas_spillover", F.col("runtime_state_gas_spillover") > 0).alias("_spilled"), *plain,
    )
    pair = lambda name: F.struct(at(name, 0).alias("p50"), at(name, 1).alias("p90"))
    drivers = F.struct(
        *[F.when(F.col(f"q_{n}").isNotNull(), pair(n)).alias(n) for n in ("cold_account", "sload", "sstore")],
        F.when(F.col("_listed") > 0, pair("access")).alias("access_list_entries"),
        F.when(F.col("q_surcharge").isNotNull(), F.struct(at("surcharge", 0).alias("p50"), F.col("_surcharge").alias("sum"))).alias("surcharge_at_oog"),
        F.when(F.col("q_gas_remaining_at_oog").isNotNull(), pair("gas_remaining_at_oog")).alias("gas_remaining_at_oog"),
        F.col("_exhausted").alias("reservoir_exhausted_share"),
        F.col("_spilled").alias("spillover_share"),
    )
    named = [c for c in both.columns if not c.startswith(("_", "q_"))]
    return both.select(*named, *gas, drivers.alias("drivers"))


def failure_clusters(roled: DataFrame, keep: int = CLUSTERS, causes: bool = True) -> DataFrame:
    """contract, key columns, count, shares, gas figures, drivers (unless causes is false), state categories and examples of each contract's largest clusters.

    Totals are sums, not windows, and each task keeps its own largest clusters of a contract before they meet, so a contract's
    clusters are never in one task, however many it has. Examples come from a bounded aggregate (the smallest (block, transaction)
    pairs), and percentiles are computed for kept clusters alone, after counts have chosen them.
    """
    counts = roled.groupBy("contract", *KEY).agg(F.count("*").alias("count"))
    by_role = counts.groupBy("contract", "role").agg(F.sum("count").alias("total"), F.count("*").alias("clusters"))  # at most three of a contract
    each = F.map_from_entries(F.collect_list(F.struct("role", "total"))).alias("by_role")
    totals = by_role.groupBy("contract").agg(F.sum("total").alias("contract_total"), F.sum("clusters").alias("distinct_clusters"), each)
    top = topk_per_key(counts, ["contract"], keep, [F.desc("count"), *[F.col(k) for k in KEY]])
    ranked = top.join(totals, "contract").withColumn("role_total", F.col("by_role")[F.col("role")]).drop("by_role")
    # one 128-bit name per key, null-safe, so that the rows meet their clusters in a plain equi-join
    nulls = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in KEY])
    name = F.struct(*[F.xxhash64(F.lit(seed), nulls, *KEY).alias(f"h{seed}") for seed in (1, 2)])
    ranked = held(ranked.withColumn("cluster", name), "ranked")  # read for the rows, again for the published counts
    rows = roled.withColumn("cluster", name)
    small, large = (ranked.filter(f"count {sign} {SMALL}").select("contract", "cluster") for sign in ("<=", ">"))
    detail = _small_details(rows.join(small, ["contract", "cluster"]), causes)
    # of large clusters there are at most a SMALLth of the rows
    detail = detail.unionByName(_large_details(rows.join(F.broadcast(large), ["contract", "cluster"]), causes))
    out = ranked.join(detail, ["contract", "cluster"])
    share = lambda d: F.col("count") / F.col(d)
    return out.withColumns({"share_of_role": share("role_total"), "share_of_contract": share("contract_total")}).drop("cluster")


_FIRST = ("block_number", "tx_hash")
_EXAMPLE = (*_FIRST, "gas_delta")


def _small_details(rows: DataFrame, causes: bool) -> DataFrame:
    """contract, cluster, entry_selector, gas figures, drivers, examples and state_gas_category of clusters of at most SMALL rows: one aggregate, dealt as the join that chose the rows."""
    state = F.col("state_gas_category")
    more = [F.min_by("entry_selector", F.struct(*_FIRST)).alias("entry_selector"), F.slice(F.array_sort(F.collect_list(F.struct(*_EXAMPLE))), 1, EXAMPLES).alias("examples"), F.sort_array(F.collect_list(F.when(state != "", state))).alias("states")]
    out = figures(rows, ["contract", "cluster"], *more, causes=causes, small=True).drop("gas_min", "gas_max")
    return out.withColumn("state_gas_category", _sorted_mix(F.col("states"))).drop("states")


def _large_details(rows: DataFrame, causes: bool) -> DataFrame:
    """The same of clusters of any size: rows are counted by value before they meet, and examples and categories are bounded aggregates."""
    keys = ["contract", "cluster"]
    detail = figures(rows, keys, F.min_by("entry_selector", F.struct(*_FIRST)).alias("entry_selector"), causes=causes).drop("gas_min", "gas_max")
    firsts = topk_per_key(rows.select(*keys, *_EXAMPLE), keys, EXAMPLES, [F.col(c) for c in _FIRST])
    shown = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_EXAMPLE))).alias("examples"))
    states = mix_pairs(rows, keys, "state_gas_category").withColumnRenamed("mix", "state_gas_category")
    return detail.join(shown, keys).join(states, keys, "left")


def _sorted_mix(values: Column) -> Column:
    """Of a sorted array, what mix_pairs gives of its rows: (key, count) by count, then key; null where it is empty."""
    keys = F.array_distinct(values)
    starts = F.transform(keys, lambda k: F.array_position(values, k))
    ends = F.concat(F.slice(starts, 2, F.size(values) + 1), F.array(F.size(values).cast("bigint") + 1))
    each = F.zip_with(keys, F.zip_with(starts, ends, lambda a, b: b - a), lambda k, n: F.struct((-n).alias("m"), k.alias("key"), n.alias("count")))
    return F.when(F.size(values) > 0, F.transform(F.array_sort(each), lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))))


def mix_pairs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mix: counts of the values that are neither null nor empty, by count, as an array of (key, count)."""
    counts = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    sort = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("key"), F.col("n").alias("count"))))
    return counts.groupBy(*keys).agg(F.transform(sort, lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))).alias("mix"))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """contract, distinct_cluster_count, clusters_shown_share."""
    return clusters.groupBy("contract").agg(F.max("distinct_clusters").alias("distinct_cluster_count"), (F.sum("count") / F.max("contract_total")).alias("clusters_shown_share"))


def role_counts(roled: DataFrame) -> DataFrame:
    """contract, entry, halts, reverts, entry_oog (entry rows that ran out of gas) and their sum, the footprint."""
    of = lambda r: F.count_if(F.col("role") == r)
    out = roled.groupBy("contract").agg(of("entry").alias("entry"), of("oog_site").alias("halts"), of("revert_site").alias("reverts"), F.count_if((F.col("role") == "entry") & F.col("oog_contract").isNotNull()).alias("entry_oog"))
    return out.withColumn("footprint", F.col("entry") + F.col("halts") + F.col("reverts"))


def recipient_counts(divergence: DataFrame) -> DataFrame:
    """Over all rows of each recipient: g3, g2 drill-ins, af and status flips, in one scan."""
    return divergence.filter("recipient is not null").groupBy(F.col("recipient").alias("contract")).agg(
        F.count_if(F.expr(P.G3)).alias("g3_tx_count"), F.count_if(F.expr(P.G2_DRILLIN)).alias("g2_drillin_tx_count"), F.count_if(F.expr(P.AF)).alias("af_tx_count"), F.count_if(F.expr(P.STATUS_FLIP)).alias("status_flips")
    )


#: Values whose most frequent ones a contract's context shows, by the name of the mix; the last is of its site rows, the others of its entry rows.
MIXES = {"entry_functions": "entry_selector", "failing_functions": "failing_selector", "halt_contracts": "oog_contract", "revert_contracts": "divergence_contract", "entry_contracts": "recipient"}


def value_counts(roled: DataFrame) -> DataFrame:
    """contract, which, value, count: functions and counterparts of each contract, from one unpivot and one count."""
    entry = F.col("role") == "entry"
    second = (F.col("role") == "revert_site") & F.col("oog_contract").eqNullSafe(F.col("contract"))  # a row that is both sites counts once
    part = lambda which, value, when: F.struct(F.lit(which).alias("which"), F.when(when, F.col(value).cast("string")).alias("value"))
    each = [part(n, c, entry if n != "entry_contracts" else ~entry & ~second) for n, c in MIXES.items()]
    return roled.select("contract", F.inline(F.array(*each))).filter("value is not null").groupBy("contract", "which", "value").agg(F.count("*").alias("count"))


def top_values(counts: DataFrame) -> DataFrame:
    """contract, which, value, count, place: the most frequent values of each mix."""
    return topk_per_key(counts, ["contract", "which"], BREAKDOWN, [F.desc("count"), F.col("value")])


def context_figures(roled: DataFrame, divergence: DataFrame) -> DataFrame:
    """Per contract: the wider counts, gas of its entry rows, and block span and distinct blocks (of entry rows, else of site rows).

    Rows are summed by contract and block first, which gives the distinct blocks beside all other figures and keeps a contract's rows from meeting in one task.
    """
    entry = F.col("role") == "entry"
    own = F.when(entry, F.col("gas_delta"))
    by_block = roled.groupBy("contract", "block_number").agg(F.count_if(entry).alias("entries"), F.count(own).alias("n"), F.sum(own).alias("gas"))
    entered = F.max("entries") > 0
    side = lambda f: F.coalesce(f(F.when(F.col("entries") > 0, F.col("block_number"))), f("block_number"))
    base = by_block.groupBy("contract").agg(
        F.try_divide(F.sum("gas").cast("double"), F.sum("n").cast("double")).alias("gas_avg"), F.coalesce(F.sum("gas"), F.lit(0)).alias("gas_sum"),
        side(F.min).alias("block_span_start"), side(F.max).alias("block_span_end"),
        F.when(entered, F.count(F.when(F.col("entries") > 0, F.col("block_number")))).otherwise(F.count("block_number")).alias("distinct_blocks"),
    )
    gas = hist.quantiles(roled.filter(entry), ["contract"], {"gas": F.col("gas_delta")}, (0.5, 0.9))
    gas = gas.select("contract", _whole(F.col("q_gas")[0]).alias("gas_p50"), _whole(F.col("q_gas")[1]).alias("gas_p90"))
    return base.join(gas, "contract", "left").join(recipient_counts(divergence), "contract", "left").fillna(0, ["g3_tx_count", "g2_drillin_tx_count", "af_tx_count", "status_flips"])


def context(roled: DataFrame, divergence: DataFrame) -> DataFrame:
    """context_figures with the mixes as arrays of (contract, count), null where there is none."""
    counts = value_counts(roled)

    def shown(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("which") == name, F.struct("place", F.col("value").alias("contract"), "count"))))  # at most BREAKDOWN of each
        return F.when(F.size(rows) > 0, F.transform(rows, lambda r: F.struct(r["contract"].alias("contract"), r["count"].alias("count")))).alias(name)

    mixes = top_values(counts).groupBy("contract").agg(*[shown(n) for n in MIXES])
    return context_figures(roled, divergence).join(mixes, "contract", "left")


def searchable(labels: DataFrame) -> DataFrame:
    """address of the labels that a name search can find: a label other than the address, or an owner."""
    named = ((F.col("label") != "") & (F.col("label") != F.col("address"))) | (F.coalesce("owner_project", F.lit("")) != "")
    return labels.filter(named).select("address")


def affected(g4: DataFrame) -> DataFrame:
    """contract: the distinct addresses of all roles."""
    return g4.select(F.explode(F.array("recipient", "oog_contract", "divergence_contract")).alias("contract")).filter("contract is not null").distinct()


def deploy_accounts(g4: DataFrame, names: DataFrame) -> DataFrame:
    """contract: accounts without a name that no transaction enters and whose every out-of-gas row is init code."""
    init = P.is_initcode(F.expr(P.FAILING_SELECTOR))
    sites = g4.filter("oog_contract is not null").groupBy(F.col("oog_contract").alias("contract")).agg(F.bool_and(init).alias("all_init")).filter("all_init")
    entered = g4.select(F.col("recipient").alias("contract")).distinct()
    return sites.select("contract").join(entered, "contract", "left_anti").join(names.select(F.col("address").alias("contract")), "contract", "left_anti")


def shards_for(contracts: DataFrame, deploy: DataFrame) -> DataFrame:
    """The affected contracts that get a shard of their own."""
    return contracts.join(deploy, "contract", "left_anti")


def probe_set(counts: DataFrame, names: DataFrame, top: int = PROBES) -> DataFrame:
    """Contracts that the bounded second sources are asked about: the largest footprints and all that have a name."""
    best = counts.orderBy(F.desc("footprint"), "contract").limit(top).select("contract")
    return best.union(counts.join(names.select(F.col("address").alias("contract")), "contract", "left_semi").select("contract")).distinct()


def deploy_summary(g4: DataFrame, deploy: DataFrame) -> dict[str, DataFrame]:
    """The collapsed accounts together: splits, families, entries, reverts, gas, drivers and the first row of each account."""
    rows = g4.join(deploy.withColumnRenamed("contract", "oog_contract"), "oog_contract", "left_semi")
    reverts = g4.join(deploy.withColumnRenamed("contract", "divergence_contract"), "divergence_contract", "left_semi")
    selector = F.expr(P.FAILING_SELECTOR)
    first = F.min_by(F.struct(F.col("tx_hash").alias("tx"), F.col("block_number").alias("block"), "gas_delta", F.col("oog_opcode").alias("opcode"), selector.alias("selector"), F.lower("recipient").alias("entry")), F.struct("block_number", "tx_hash"))
    return {
        "halt_opcode_split": mix(rows, F.col("oog_opcode")),
        "initcode_families": mix(rows, family(selector)),
        "top_entry_contracts": mix(rows, F.lower("recipient"), BREAKDOWN),
        "revert_reasons": mix(reverts, F.col("revert_decoded"), BREAKDOWN),
        "figures": deploy.agg(F.count("*").alias("count")).withColumn("every", F.lit(1)).join(figures(rows.withColumn("every", F.lit(1)), ["every"]).drop("gas_avg"), "every", "left").drop("every"),
        "accounts": rows.groupBy(F.lower("oog_contract").alias("account")).agg(first.alias("first")).select("account", "first.*"),
    }


def index(counts: DataFrame, labels: DataFrame, deploy: DataFrame) -> DataFrame:
    """Searchable contracts by footprint; counts of 0 are null, so that JSON leaves them out."""
    own = counts.join(deploy, "contract", "left_anti").join(searchable(labels), F.col("contract") == F.col("address"), "left_semi")
    rows = own.join(labels.select("address", "label", "owner_project", "category"), F.col("contract") == F.col("address"))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.select(
        F.col("contract").alias("address"), "label", F.nullif("owner_project", F.lit("")).alias("owner_project"), F.when(F.col("category") != "unknown", F.col("category")).alias("category"),
        some("entry").alias("entry_g4_tx_count"), some("halts").alias("halt_count"), some("reverts").alias("revert_count"), "footprint",
    ).orderBy(F.desc("footprint"), "address")


def failure_rates(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """contract, total_tx, halt_rate, revert_rate (0 for none); only contracts with a denominator."""
    rate = lambda c: F.col(c) / F.col("total_tx")
    return counts.join(totals.select(F.col("addr").alias("contract"), "total_tx"), "contract").filter("total_tx > 0").select("contract", "total_tx", rate("halts").alias("halt_rate"), rate("reverts").alias("revert_rate"))


def merge_self_roles(clusters: DataFrame) -> DataFrame:
    """Clusters of a contract that differ in role alone become one: the site's figures where there is a site, and all roles."""
    rest = [k for k in KEY if k != "role"]
    site_first = F.when(F.col("role") == "entry", 1).otherwise(0)
    picked = F.min_by(F.struct("count", "share_of_contract", "role"), F.struct(site_first, -F.col("count"), "role"))
    return clusters.groupBy("contract", *rest).agg(picked.alias("p"), F.array_sort(F.collect_set("role")).alias("roles")).select("contract", *rest, "p.count", "p.share_of_contract", F.col("p.role").alias("from_role"), "roles")


def lookup(index_rows: DataFrame, shards: DataFrame, accounts: DataFrame, query: str, most: int = 20) -> tuple[str, DataFrame]:
    """kind and rows for a typed query: an address reads its shard, then the collapsed accounts; a name is searched as a part of label or owner."""
    q = query.strip().lower()
    if len(q) == 42 and q.startswith("0x") and all(c in "0123456789abcdef" for c in q[2:]):
        for kind, rows, column in (("shard", shards, "contract"), ("collapsed", accounts, "account")):
            hit = rows.filter(F.col(column) == q)
            if hit.limit(1).count():
                return kind, hit
        return "none", shards.filter(F.lit(False))
    hit = index_rows.filter(F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower(F.coalesce("owner_project", F.lit(""))), F.lit(q))) if q else index_rows.filter(F.lit(False))
    hit = hit.orderBy(F.desc("footprint"), "address")
    n = hit.limit(2).count()
    return ("none", "one", "many")[n], hit.limit(most)
