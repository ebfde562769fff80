"""The analysis on rows of its own shapes, against values worked out by hand."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltascope.functions import opcodes, predicates as P, scalars as S
from deltascope.model import DIVERGENCE, DIVERGENCE_COLUMNS, LABEL
from deltascope.operators import bytecode, clusters, config, forensics, hist, labels as L, mixes, partition, versioned
from deltascope.plans import label_build, schedule
from deltascope.sources import documents, label_files, tables


def divergence(spark, *rows):
    """Rows from dicts; what is not given is null."""
    return spark.createDataFrame([tuple(r.get(c) for c in DIVERGENCE_COLUMNS) for r in rows], DIVERGENCE)


G4 = {"baseline_success": True, "schedule_success": False}


def one(df, column="x"):
    return [r[column] for r in df.collect()]


def test_dedup_keeps_the_newest_whole_row(spark):
    rows = [("a", 2, 3.5, "p"), ("a", 1, 9.0, "q"), ("b", 1, 1.0, "r"), ("b", 3, None, "s"), ("b", 2, 8.0, "t"), ("c", 1, 0.5, "u")]
    df = spark.createDataFrame(rows, "row_id string, updated_at int, m double, s string")
    got = {r["row_id"]: (r["m"], r["s"]) for r in versioned.latest_version(df, ["row_id"], [F.desc("updated_at")]).collect()}
    assert got == {"a": (3.5, "p"), "b": (None, "s"), "c": (0.5, "u")}
    assert {r["row_id"]: r["m"] for r in versioned.latest_columns(df, "row_id", "updated_at", ["m", "m"], skip_nulls=True).collect()} == {"a": 3.5, "b": 8.0, "c": 0.5}
    assert versioned.duplicate_count(df, ["row_id"]).first().asDict() == {"n": 6, "n_distinct": 3, "n_duplicates": 3}
    with pytest.raises(ValueError):
        versioned.latest_columns(df, "row_id", "updated_at", ["trace_payload"])


def test_group_boundaries(spark):
    values = [0.5, 1.0, 1.0001, 2.0, 9.9979, 10.0, 100.0, None]
    rows = [(b, s, m) for b in (True, False, None) for s in (True, False) for m in values]
    df = spark.createDataFrame(rows, "b boolean, s boolean, m double")
    for r in df.select("*", P.drill_in_group(F.col("s"), F.col("m"), F.col("b")).alias("g")).collect():
        want = "af" if not r["b"] else "g2" if r["s"] else "g3" if r["m"] is not None and r["m"] > 1 else "g4"
        assert r["g"] == want
    sql = df.toDF("baseline_success", "schedule_success", "min_multiplier_to_succeed")
    assert sql.filter(P.G3).count() == 5 and sql.filter(P.G4).count() == 1 and sql.filter(P.AF).count() == 16 and sql.filter(P.RESCUE).count() == 8
    assert partition.multiplier_leaks(sql).count() == 3 * 8


def test_partition_closes(spark):
    cov = [(549, 549, 256, 166, 127, 127, False), (1000, 200, 50, 70, 80, 4, True)]
    cov = spark.createDataFrame([(b, None, t, u, g, s, k, x) for b, t, u, g, s, k, x in cov], "block_number long, block_timestamp timestamp, tx_count long, tx_count_unchanged long, tx_count_gas_only long, tx_count_stored long, retained_drill_in_count long, drill_ins_truncated boolean")
    kinds = [({"baseline_success": True, "schedule_success": True}, 122), ({**G4, "min_multiplier_to_succeed": 2.0}, 3), (G4, 2), ({"baseline_success": False, "schedule_success": True}, 0)]
    rows = [{"block_number": 549, **k} for k, n in kinds for _ in range(n)] + [{"block_number": 1000, **G4}] * 4
    blocks = partition.assemble(cov, partition.block_groups(divergence(spark, *rows)))
    got = {r["block_number"]: (r["g1"], r["g2"], r["g3"], r["g4"], r["af"], r["g5"]) for r in blocks.collect()}
    assert got == {549: (256, 288, 3, 2, 0, 0), 1000: (50, 70, 0, 4, 0, 76)}
    assert partition.violations(blocks).count() == 0
    assert partition.totals(blocks).first()["tx_count"] == 749 and partition.meta(blocks).first()["block_count"] == 452
    with pytest.raises(ValueError):
        partition.require_single_rows(cov.union(cov))
    with pytest.raises(ValueError):
        partition.require_retained(blocks, divergence(spark))


def test_config_resolution(spark):
    rows = [("c1", "s1", 1), ("c1", "s1", 2), ("c1", "s2", 2), ("c2", "s1", 1), ("c2", "s1", 2), ("c2", "s1", 3), ("c2", "s1", 4)]
    df = spark.createDataFrame(rows, "analysis_config_hash string, schedule_name string, block_number long").withColumn("updated_at", F.lit(None).cast("timestamp"))
    by = config.coverage_by_config(df)
    assert config.resolve(by, ["s1", "s2"]) == config.Resolution({"s1": "c1", "s2": "c1"}, True, 2, 2)
    assert config.resolve(by, ["s1"]).configs == {"s1": "c2"} and config.resolve(by, ["s1"], "c1").configs == {"s1": "c1"}
    apart = config.coverage_by_config(df.filter("not (analysis_config_hash = 'c1' and schedule_name = 's1')"))
    assert config.resolve(apart, ["s1", "s2"]).configs == {"s1": "c2", "s2": "c1"}
    with pytest.raises(ValueError):
        config.resolve(by, ["s3"])
    assert config.window(config.Resolution({}, True, 10, 5000)) == (10, 2009) and config.window(config.Resolution({}, True, 10, 50), 5, 60) == (10, 50)


def test_bins(spark):
    xs = [0, 1, -1, 2, 3, 4, 1023, 1024, -5000, None]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert one(df.select(P.log2_bin(F.col("x")).alias("x"))) == [0, 1, 1, 2, 2, 3, 10, 11, 11, None]
    sign, bin_ = P.signed_bin(F.col("x"))
    assert [tuple(r) for r in df.limit(5).select(sign, bin_).collect()] == [(1, 0), (1, 0), (-1, 0), (1, 1), (1, 1)]
    edges = spark.createDataFrame([(float(e),) for e in (*P.PERCENT_EDGES, -101, 9e9)], "x double")
    assert one(edges.select(P.percent_bin(F.col("x")).alias("x"))) == [*range(13), None, 12]
    pct = spark.createDataFrame([(5, 10), (5, 0), (5, None), (-10, 10)], "d long, b long").select(P.percent(F.col("d"), F.col("b")).alias("x"))
    assert one(pct) == [50.0, None, None, -100.0]


def test_histograms(spark):
    df = spark.createDataFrame([(d, g) for d, g in ((0, 0), (1, 1), (8, 999), (9, 1000), (18, 10**6), (None, -1), (2, None))], "oog_call_depth int, oog_gas_remaining long")
    assert {r["depth"]: r["count"] for r in hist.depth_histogram(df, "oog_call_depth").collect()} == {"1": 1, "2": 1, "8": 1, "9+": 2, **{str(i): 0 for i in range(3, 8)}}
    assert [r["count"] for r in hist.magnitude_histogram(df, "oog_gas_remaining").collect()] == [1, 2, 1, 0, 0, 1]
    m = divergence(spark, *[{"min_multiplier_to_succeed": x} for x in (1.0001, 2.0, 4.0, 4.1, 8.0, 9.9, 100.0)])
    assert [r["count"] for r in hist.multiplier_histogram(m).collect()] == [2, 1, 1, 1, 2]
    a = spark.createDataFrame([(1, []), (1, list(range(12))), (2, list(range(14))), (2, [1] * 13)], "k int, h array<long>")
    assert [len(r["h"]) for r in a.select(hist.resize(F.col("h"), 13).alias("h")).collect()] == [13] * 4
    assert {r["k"]: list(r["h"]) for r in hist.sum_arrays(a, "h", ["k"]).collect()} == {1: list(range(12)), 2: [i + 1 for i in range(13)] + [13]}
    assert list(a.agg(hist.sum_arrays_fixed(F.col("h"), 3).alias("h")).first()["h"]) == [1, 3, 5]
    bins = spark.createDataFrame([(0, 50), (3, 40), (5, 10)], "bin_log2 int, count long")
    assert tuple(hist.histogram_percentiles(bins).first()) == (1, 12, 48)
    assert tuple(hist.histogram_percentiles(bins.filter("count < 0")).first()) == (0, 0, 0)
    p = hist.percentiles(spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double"), "x").first()
    assert (p["p50"], p["p90"], p["max"]) == (3.0, 4.6, 5.0)


def test_coercions(spark):
    raw = [" True ", "f", "nan", "None", "\\n", "", "1e3", "12.0", "9223372036854775807", "9223372036854775808", "18446744073709551615", "-4", "x", None]
    df = spark.createDataFrame([(r,) for r in raw], "c string").select(S.to_flag(F.col("c")).alias("f"), S.to_long(F.col("c")).alias("n"), S.to_reservoir(F.col("c")).alias("r")).collect()
    assert [r["f"] for r in df] == [True, False] + [None] * 12
    assert [r["n"] for r in df] == [None] * 6 + [1000, 12, 2**63 - 1, None, None, -4, None, None]
    assert [r["r"] for r in df] == [None] * 6 + [1000, 12, 2**63 - 1, None, None, None, None, None]
    t = spark.createDataFrame([("Error(string): STF ", "0xABCDEF01", "Uniswap_v2: Router: 2", "[1,2]"), ("Panic", "abc", " : x", "bad")], "a string, s string, o string, j string")
    got = t.select(S.after_prefix(F.col("a"), "Error(string):").alias("a"), S.canonical_selector(F.col("s")).alias("s"), S.owner_of(F.col("o")).alias("o"), S.parse_array(F.col("j")).alias("j")).collect()
    assert [tuple(r) for r in got] == [("STF", "0xabcdef01", "uniswap_v2", [1, 2]), (None, None, None, None)]
    f = spark.range(1).select(S.format_count(F.lit(12345)).alias("a"), S.format_percent(F.lit(0.125)).alias("b"), S.short_address(F.lit("0x" + "ab" * 20)).alias("c"), S.humanize(F.lit("gas_only")).alias("d"), S.is_precompile(F.lit("0x" + "0" * 39 + "A")).alias("e")).first()
    assert tuple(f) == ("12,345", "12.5%", "0xabab…abab", "Gas Only", True)


def test_null_signals_fall_in_no_bucket(spark):
    df = divergence(spark, G4, {**G4, "replay_halt_oog": True}, {**G4, "replay_halt_oog": False, "status_changed": True}, {**G4, "oog_call_depth": 1, "replay_halt_oog": False})
    assert [r["count"] for r in forensics.break_reasons(df).collect()] == [2, 1, 0]
    assert [r["count"] for r in forensics.fixability(df).collect()] == [2, 1, 1]
    assert [r["count"] for r in forensics.status_flips(df).collect()] == [4, 0, 0]


def test_mixes_and_leaderboards(spark):
    df = divergence(spark, *[{"recipient": a, "oog_pattern": p} for a, p in (("a", "loop"), ("a", None), ("b", "loop"), ("b", "x"), ("c", None), (None, None))])
    assert [tuple(r) for r in mixes.mix(df, F.col("oog_pattern")).collect()] == [("loop", 2), ("x", 1)]
    assert mixes.mix_none(df, F.col("oog_pattern")).first().asDict() == {"key": "none", "count": 3}
    assert [tuple(r) for r in mixes.mix_fixed(df, F.col("oog_pattern"), ("x", "y", "loop")).collect()] == [("x", 1), ("y", 0), ("loop", 2)]
    names = spark.createDataFrame([("a", "Alpha", "unknown"), ("b", "Beta", "token")], "address string, label string, category string")
    assert [tuple(r) for r in mixes.leaderboard(df, "recipient", names, 2).collect()] == [("a", 2, "Alpha", None), ("b", 2, "Beta", "token")]
    totals = spark.createDataFrame([("a", 99), ("b", 100), ("c", 0)], "addr string, total_tx long")
    got = [(r["board"], r["addr"], r["rate"]) for r in mixes.rate_leaderboards(df, "recipient", totals).collect()]
    assert got == [("count", "a", 2 / 99), ("count", "b", 0.02), ("count", "c", None), ("rate", "b", 0.02)]
    assert all(r["rate"] is None and r["board"] == "count" for r in mixes.rate_leaderboards(df, "recipient", None).collect())
    counts = spark.createDataFrame([(f"m{i}", 10 - i) for i in range(7)], "key string, count long")
    assert [tuple(r)[:2] for r in mixes.top_and_others(counts, 5).select("key", "count").collect()][-1] == ("Others", 9)
    assert mixes.top_and_others(counts.limit(5), 5).count() == 5


def test_rich_leaderboard_takes_upgrade_fields_from_one_record(spark):
    df = divergence(spark, {"recipient": "a"}, {"recipient": "a"}, {"recipient": "b"})
    rows = [{"address": "a", "label": "A", "category": "unknown", "source": "dune", "confidence": "high", "is_mev_bot": True, "mev_role": "arb", "is_proxy": True, "is_upgradable": True, "upgrade_mechanism": "uups", "upgrade_admin": "x"}]
    names = spark.createDataFrame([tuple(r.get(c) for c in LABEL.names) for r in rows], LABEL)
    probe = L.records(spark.createDataFrame([("a",)], "a string"), "heuristic", "low", address=F.col("a"), is_factory=F.lit(True), is_proxy=F.lit(False), is_upgradable=F.lit(False), upgrade_mechanism=F.lit("minimal_proxy_immutable"))
    a, b = mixes.rich_leaderboard(df, "recipient", names, probe).collect()
    assert (a["label"], a["is_proxy"], a["is_factory"], a["is_upgradable"], a["upgrade_mechanism"], a["upgrade_admin"], a["category"], a["mev_role"]) == ("A", True, True, None, "minimal_proxy_immutable", None, None, "arb")
    assert json.loads(json.dumps(documents.plain(b, keep_nulls=False))) == {"addr": "b", "label": "b", "count": 1}


def test_flow(spark):
    df = divergence(spark, *[{"recipient": f"r{i % 12}", "oog_contract": f"t{i % 11}"} for i in range(132)], {"recipient": "r0"})
    links = mixes.flow(df, "recipient", "oog_contract").collect()
    assert sum(r["n"] for r in links) == 132 and len({r["e"] for r in links}) == 11
    doc = mixes.flow_document(links, "halt")
    assert doc["nodes"][doc["links"][0]["source"]]["side"] == "entry" and any(n["label"] == "Other halts" and n["addr"] is None for n in doc["nodes"])


def cluster_rows(spark):
    base = {**G4, "recipient": "0xa", "oog_contract": "0xa", "oog_opcode": "SLOAD", "oog_pattern": "loop", "entry_selector": "0x60aa", "gas_delta": 10}
    rows = [{**base, "block_number": b, "tx_hash": f"t{b}", "cold_account_access_count": 0 if b == 1 else None, "reservoir_exhausted": True if b == 1 else None, "state_gas_category": "transfer" if b < 3 else ""} for b in (3, 1, 2)]
    rows += [{**base, "block_number": 9, "tx_hash": "u", "oog_contract": None, "divergence_contract": "0xb", "failure_reason": "Revert", "revert_decoded": f"e{k}"} for k in range(10)]
    rows += [{**base, "recipient": None, "block_number": 5, "tx_hash": "v", "oog_contract": "0xd", "tier1_failing_selector": "0x6080"}, {**base, "recipient": None, "block_number": 6, "tx_hash": "w", "oog_contract": "0xe", "entry_selector": "0x1234"}]
    return divergence(spark, *rows)


def test_clusters(spark):
    df = cluster_rows(spark)
    found = clusters.failure_clusters(clusters.roles(df))
    a = [r for r in found.collect() if r["contract"] == "0xa"]
    first = min(a, key=lambda r: r["place"])
    assert len(a) == 8 and first["count"] == 3 and first["distinct_clusters"] == 12 and first["contract_total"] == 16
    assert [e["tx_hash"] for e in first["examples"]] == ["t1", "t2"] and first["share_of_contract"] == 3 / 16
    assert first["drivers"]["cold_account"].asDict() == {"p50": 0, "p90": 0} and first["drivers"]["sload"] is None and first["drivers"]["reservoir_exhausted_share"] == 1 / 3
    assert [tuple(x) for x in first["state_gas_category"]] == [("transfer", 2)]
    assert {r["role"] for r in a if r["kind"] == "oog"} == {"entry", "oog_site"}
    merged = [r for r in clusters.merge_self_roles(found).collect() if r["contract"] == "0xa" and r["kind"] == "oog"]
    assert len(merged) == 1 and list(merged[0]["roles"]) == ["entry", "oog_site"] and merged[0]["from_role"] == "oog_site"
    ctx = {r["contract"]: r for r in clusters.context(clusters.roles(df), df).collect()}
    assert ctx["0xa"]["distinct_blocks"] == 4 and ctx["0xb"]["block_span_start"] == 9 and ctx["0xa"]["status_flips"] == 13
    assert clusters.failure_clusters(clusters.roles(df.filter("false"))).count() == 0


def test_deploy_rule_index_and_lookup(spark):
    df = cluster_rows(spark)
    names = spark.createDataFrame([("0xa", "Alpha", None, "token"), ("0xb", "0xb", "Beta Labs", "unknown"), ("0xe", "0xe", None, "unknown")], "address string, label string, owner_project string, category string")
    deploy = clusters.deploy_accounts(df, clusters.searchable(names))
    assert one(deploy, "contract") == ["0xd"]
    assert one(clusters.deploy_summary(df, deploy)["accounts"], "tx") == ["v"]
    counts = clusters.role_counts(clusters.roles(df))
    index = clusters.index(counts, names, deploy)
    assert [(r["address"], r["entry_g4_tx_count"], r["revert_count"]) for r in index.collect()] == [("0xa", 13, None), ("0xb", None, 10)]
    shards = counts.withColumn("contract", F.concat(F.lit("0x"), F.lpad(F.substring("contract", 3, 9), 40, "0")))
    accounts = spark.createDataFrame([("0x" + "1" * 40,)], "account string")
    assert [clusters.lookup(index, shards, accounts, q)[0] for q in ("0x" + "0" * 39 + "A", "0x" + "1" * 40, "0x" + "2" * 40, "beta", "a", "")] == ["shard", "collapsed", "none", "one", "many", "none"]


def test_label_merge(spark):
    rows = [
        {"address": "a", "label": "Manual", "category": "unknown", "source": "manual", "confidence": "high"},
        {"address": "a", "label": "Dune", "category": "token", "source": "dune", "confidence": "high", "owner_project": "o", "is_proxy": False},
        {"address": "a", "label": "x", "category": "nft", "source": "heuristic", "confidence": "low", "is_proxy": True, "erc_type": "erc20"},
        {"address": "a", "label": "bot", "category": "mev_bot", "source": "mev", "mev_role": "arb"},
        {"address": "b", "label": "b", "category": "unknown", "source": "oli", "confidence": "high"},
        {"address": "b", "label": "bot", "category": "mev_bot", "source": "mev", "mev_role": "liquidation"},
        {"address": "c", "label": "bot", "category": "mev_bot", "source": "mev", "mev_role": "sandwich"},
    ]
    df = spark.createDataFrame([tuple(r.get(c) for c in LABEL.names) for r in rows], LABEL)
    got = {r["address"]: r for r in L.merge_labels(df).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["label"], a["category"], a["source"], a["owner_project"], a["is_proxy"], a["erc_type"], a["is_mev_bot"], a["mev_role"]) == ("Manual", "token", "manual", "o", False, "erc20", True, "arb")
    assert (b["label"], b["category"], b["source"], c["label"], c["source"], c["confidence"]) == ("b", "mev_bot", "oli", "bot", "mev", "medium")
    assert L.invalid(L.merge_labels(df)).count() == 0 and L.manual_labels(spark).count() == 33
    assert L.manual_labels(spark).filter("category = 'precompile'").count() == 10


def test_attestations_newest_live_value_wins(spark):
    rows = [("A", False, "2024", {"contract_name": "new", "erc_type": '["erc20","x"]'}), ("a", False, "2023", {"contract_name": "old", "usage_category": "dex"}), ("a", True, "2025", {"contract_name": "revoked", "owner_project": "p"}), ("a", False, "2026", {"contract_name": ""})]
    df = spark.createDataFrame(rows, "recipient string, revoked boolean, time string, tags map<string,string>")
    r = L.collapse_attestations(df, ["contract_name", "usage_category", "owner_project", "erc_type"])
    assert r.first().asDict() == {"address": "a", "contract_name": "new", "usage_category": "dex", "owner_project": "p", "erc_type": "erc20"}
    assert L.attested_labels(r).first()["category"] == "swap_dex"


def test_normalisers(spark):
    raw = spark.createDataFrame([("frontrun", " 0xAB "), ("sandwich", "0xV"), ("swap", "0xS"), ("liquid", None), ("ARB", "0xC")], "mev_type string, address_from string")
    assert sorted((r["address"], r["mev_role"]) for r in L.mev_labels(raw).collect()) == [("0xab", "sandwich"), ("0xc", "arb")]
    d = spark.createDataFrame([("0xA", "Circle: USDC", "stablecoin", "ethereum"), ("0xB", " ", "weird", "ethereum"), ("0xD", "n", "Usage", "ethereum"), ("0xE", "n", "dex", "other")], "address string, name string, category string, blockchain string")
    got = {r["address"]: (r["label"], r["category"], r["owner_project"]) for r in L.curated_labels(d).collect()}
    assert got["0xa"] == ("Circle: USDC", "stablecoin", "circle") and got["0xb"] == ("0xB", "other", None)
    assert L.curated_query(d, ["0xa", "0xA", "0xd"], ("usage",)).count() == 1


def test_selectors(spark):
    raw = spark.createDataFrame([("0xA9059CBB", "transfer(address,uint256)", "x", 2), ("a9059cbb", "transfer(address,uint256)", "y", 1), ("a9059cbb", "join_tg_invmru_haha(bool)", "", 3), ("zz", "f()", "", 4), ("a9059cbb", " ", "", 5)], "selector string, text_signature string, source string, o int")
    cache = L.selector_cache(raw, "o")
    assert L.selector_map(cache).first()["signatures"] == ["transfer(address,uint256)", "join_tg_invmru_haha(bool)"]
    asked = spark.createDataFrame([("0xa9059cbb", None), ("0xa9059cbb", "join_x"), ("0xffffffff", "a")], "selector string, category string")
    assert sorted(str(r["signature"]) for r in L.decode_selectors(asked, cache).collect()) == ["None", "join_tg_invmru_haha(bool)", "join_tg_invmru_haha(bool)"]


def walk(code):
    out, i = [], 0
    while i + 2 <= len(code):
        op = code[i : i + 2]
        out.append(op)
        i += 2 + (2 * (int(op, 16) - 0x5F) if "60" <= op <= "7f" else 0)
    return out


def test_bytecode(spark):
    rng = random.Random(1)
    codes = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(0, 200))) for _ in range(500)] + ["60", "7f00", "6", "61ab"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [list(r[0]) for r in df.select(opcodes.instructions(F.col("c"))).collect()] == [walk(c) for c in codes]
    slot = {k: "0x" + v for k, v in bytecode.SLOTS.items()}
    word = "0x" + "0" * 24 + "ab" * 20
    clone = "0x363d3d373d3d3d363d73" + "11" * 20 + "5af43d82803e903d91602b57fd5bf3"
    cases = [
        (clone, {slot["admin"]: word}, {}, "minimal_proxy_immutable", None), ("6000", {}, {"0x48e2b093": True}, "diamond", None), ("001f931c1c", {slot["admin"]: word}, {}, "diamond", "0x" + "ab" * 20),
        (None, {slot["beacon"]: word}, {}, "beacon", None), (None, {slot["admin"][2:]: word}, {}, "eip1967_transparent", "0x" + "ab" * 20), (None, {slot["implementation"]: word}, {}, "uups", None),
        ("3659cfe6", {}, {}, "uups", None), ("00", {slot["admin"]: "0x" + "0" * 64}, {}, "none", None),
    ]
    rows = spark.createDataFrame([(f"0x{i}", c, s, a) for i, (c, s, a, _, _) in enumerate(cases)], "address string, code string, storage map<string,string>, answers map<string,boolean>")
    got = {r["address"]: r for r in bytecode.classify(rows).collect()}
    assert [(got[f"0x{i}"]["upgrade_mechanism"], got[f"0x{i}"]["upgrade_admin"]) for i in range(len(cases))] == [(m, a) for _, _, _, m, a in cases]
    more = spark.createDataFrame([("60f5", {}, {"80ac58cd": True}), ("f5", {}, {"0xd9b67a26": True}), ("a9059cbb70a0823118160ddd", {}, {"0x01ffc9a7": False}), ("f4", {}, {})], "code string, storage map<string,string>, answers map<string,boolean>")
    out = more.select(bytecode.erc_type(F.col("code"), F.col("answers")), bytecode.is_factory(F.col("code")), bytecode.is_proxy(F.col("code"), F.col("storage")), bytecode.is_erc165(F.col("answers"))).collect()
    assert [tuple(r) for r in out] == [("erc721", False, False, True), ("erc1155", True, False, True), ("erc20", False, False, False), (None, False, True, False)]
    reads = spark.createDataFrame([("0xA", slot["admin"], "1", 5), ("0xa", slot["admin"], "2", 7), ("0xz", slot["admin"], "3", 9)], "address string, slot string, value string, block_number long")
    asked = spark.createDataFrame([("0xA",), ("0xq",)], "address string")
    found = {r["address"]: r for r in bytecode.structural_inputs(asked, reads, reads.filter("value = '1'"), spark.createDataFrame([("0xA", "60", 1), ("0xa", "61", 2)], "address string, code string, block_number long")).collect()}
    assert found["0xa"]["storage"] == {slot["admin"]: "2"} and found["0xa"]["code"] == "61" and found["0xq"]["storage"] == {} and found["0xq"]["code"] is None


def test_opcode_arrays(spark):
    df = spark.createDataFrame([(1, "[84,12]", "[5,6]", "[7,8]", "[9,10]")], "b int, opcode string, opcode_count string, opcode_gas_baseline string, opcode_gas_schedule string")
    df = df.select("b", *[S.parse_array(F.col(c)).alias(c) for c in df.columns[1:]])
    assert [tuple(r) for r in opcodes.explode_opcodes(df, ["b"]).collect()] == [(1, 84, 5, 7, 9, "SLOAD"), (1, 12, 6, 8, 10, "UNKNOWN_0x0c")]


def test_label_files(spark, tmp_path):
    old = spark.createDataFrame([("a", "A")], "address string, label string")
    old.write.parquet(f"{tmp_path}/old")
    label_files.write_labels(spark.createDataFrame([], LABEL), f"{tmp_path}/empty")
    got = label_files.read_sources(spark, [f"{tmp_path}/old", f"{tmp_path}/empty", f"{tmp_path}/none"])
    assert got.columns == LABEL.names and [(r["label"], r["is_mev_bot"], r["category"]) for r in got.collect()] == [("A", False, None)]
    for name, text in {"0xAA": '{"project": " P "}', "0xbb": "{bad", "0xcc": '{"x": 1}', "0xdd": '{"name": "", "symbol": "S", "type": "ERC20"}'}.items():
        (tmp_path / "reg").mkdir(exist_ok=True)
        (tmp_path / "reg" / f"{name}.json").write_text(text)
    assert [(r["address"], r["owner_project"]) for r in label_files.registry_contracts(spark, f"{tmp_path}/reg").collect()] == [("0xaa", "P")]
    assert [(r["address"], r["label"], r["erc_type"]) for r in label_files.registry_tokens(spark, f"{tmp_path}/reg").collect()] == [("0xdd", "S", "ERC20")]


def warehouse(spark, path, selector="0x6011", first=100):
    """A small warehouse: two versions of each row, one configuration, one schedule."""
    rng = random.Random(2)
    rows, cov = [], []
    for b in range(first, first + 40):
        kinds = [rng.choice([{"baseline_success": True, "schedule_success": True}, {**G4, "min_multiplier_to_succeed": 3.0}, G4, {"baseline_success": False, "schedule_success": False}]) for _ in range(12)]
        for i, k in enumerate(kinds):
            extra = {"block_number": b, "tx_hash": f"0xT{b}{i}", "recipient": rng.choice(["0xAA", "0xBB", None]), "gas_delta": rng.randint(-50, 50), "baseline_gas_used": 100, "oog_contract": rng.choice(["0xCC", None]), "divergence_contract": rng.choice(["0xDD", None]), "entry_selector": selector, "status_changed": True, "replay_halt_oog": False, "revert_decoded": "Error(string): no", "tx_type": 2, "is_create": False, "oog_call_depth": rng.choice([1, None])}
            rows += [(f"{b}-{i}", v, *[{**k, **extra, "gas_delta": extra["gas_delta"] if v == 2 else 999}.get(c) for c in DIVERGENCE_COLUMNS]) for v in (1, 2)]
        cov.append((f"c{b}", 1, b, 20, 5, 3, 12, 12, False))
    pin = [F.lit(1).alias("chain_id"), F.lit("cfg").alias("analysis_config_hash"), F.lit("s1").alias("schedule_name")]
    spark.createDataFrame(rows, "row_id string, updated_at int, " + DIVERGENCE).select(*pin, "*").write.parquet(f"{path}/gas_analysis_divergence.parquet")
    c = spark.createDataFrame(cov, "row_id string, updated_at int, block_number long, tx_count long, tx_count_unchanged long, tx_count_gas_only long, tx_count_stored long, retained_drill_in_count long, drill_ins_truncated boolean")
    c.select(*pin, "*", F.lit("2026-01-01").cast("timestamp").alias("block_timestamp")).write.parquet(f"{path}/gas_analysis_block_coverage.parquet")
    keys = ["no_state", "runtime_state", "creation", "simple_transfer", "contract_call", "authorization", *[f"type_{t}" for t in ("legacy", "access_list", "dynamic_fee", "blob", "set_code", "other")]]
    s = c.select(*pin, "row_id", "updated_at", "block_number", F.lit("gas_only").alias("class"), F.lit(3).cast("long").alias("tx_count"), *[F.lit(1).cast("long").alias(f"tx_count_{k}") for k in keys], F.lit(30).cast("long").alias("gas_delta_sum"), F.lit(1).cast("long").alias("gas_delta_min"), F.lit(20).cast("long").alias("gas_delta_max"), F.lit(600).cast("long").alias("baseline_gas_used_sum"), F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")).alias("gas_delta_log2_hist"), F.array().cast("array<long>").alias("gas_delta_pct_hist"))
    s.write.parquet(f"{path}/gas_analysis_block_summary.parquet")
    spark.createDataFrame([("cfg", 1, "c1", "{}"), ("cfg", 2, "c2", '{"depth": [1, {"x": null}]}'), ("other", 3, "c3", "{}")], "analysis_config_hash string, updated_at int, producer_git_commit string, manifest_json string").select(F.lit(1).alias("chain_id"), "*").write.parquet(f"{path}/gas_analysis_run.parquet")
    spark.createDataFrame([(b, "0xaA") for b in range(first, first + 40)] * 3, "block_number long, to_address string").write.parquet(f"{path}/canonical_execution_transaction.parquet")


def test_whole_run(spark, tmp_path):
    warehouse(spark, tmp_path / "in")
    out = tmp_path / "out"
    (out / "s1/affected").mkdir(parents=True)
    (out / "s1/affected/0xold.json").write_text("{}")
    held = lambda: {p.name for p in Path(tables.scratch_folder(spark).removeprefix("file:").replace("//", "/")).iterdir()}
    before = held()
    schedule.main([str(tmp_path / "in"), str(out), "--schedules", "s1", "--start", "100", "--end", "139"])
    assert held() == before  # intermediate tables are gone
    read = lambda n: json.loads((out / "s1" / f"{n}.json").read_text())
    whole = read("meta")
    meta = whole["totals"] | {"block_count": whole["block_range"]["count"]}
    assert (whole["schedules_available"], whole["analysis_config_hash"], whole["chain_id"], whole["manifest"]) == (["s1"], "cfg", 1, {"schedule_name": "s1", "config_selected_by": "shared", "producer_git_commit": "c2", "updated_at": "2", "run": {"depth": [1, {"x": None}]}})
    assert whole["date_range"]["start"] == "2026-01-01" and set(whole["group_labels"]) == set(partition.PARTS) and whole["truncation"]["total_blocks"] == 40 and whole["truncation"]["truncated_share"] == 0.0
    assert meta["tx_count"] == 800 and sum(meta[p] for p in partition.PARTS) == 800 and meta["g5"] == 0 and meta["block_count"] == 40
    shape = read("group_categories")["g4"]
    assert sum(x["count"] for x in shape["tx_shape_mix"]) == meta["g4"] and sum(x["count"] for x in shape["fixability"]) == meta["g4"]
    gas = read("gas_hist")["groups"]["2"]
    assert [b["bin"] for b in gas["gas_bins"]] == list(range(1, 12)) and gas["figures"][0]["gas_delta_pct_of_baseline"] == 5.0 and len(gas["pct_bins"]) == 13
    index = read("affected/index")
    shard = read("affected/0xaa")
    assert not (out / "s1/affected/0xold.json").exists() and index["affected_count"] == len(list((out / "s1/affected").glob("0x*.json"))) + index["deploy_oog"]["count"]
    assert shard["context"]["failure_rate"]["total_tx"] == 120 and shard["address"] == "0xaa" and "owner_project" in shard
    failures = read("contract_failures")["contracts"]
    assert failures[-1]["cumulative_share"] <= 1 and len(read("examples")["rows"]) == 40
    assert read("oog_forensics")["sankey"]["links"] and read("nonoog_forensics")["revert_error_mix"][0]["key"] == "no"
    assert gas["pct_cohort"] == "gas_only" and read("gas_hist")["groups"]["4"]["pct_excluded_count"] == 0 and read("oog_forensics")["call_depth_uncovered"] == 0
    assert read("nonoog_forensics")["call_depth_uncovered"] == read("nonoog_forensics")["total"][0]["n"] > 0
    assert all(c["selector_signature"] is None for c in shard["failure_clusters"])
    assert list(read("affected/deploy_oog")["accounts"]) == ["0xcc"]


def test_whole_run_with_optional_sources(spark, tmp_path, capsys):
    warehouse(spark, tmp_path / "in", "0xa9059cbb")
    slot = f"0x{bytecode.SLOTS['admin']}"
    spark.createDataFrame([("0xcc", slot, "0x0", 1)], "address string, slot string, value string, block_number long").write.parquet(f"{tmp_path}/in/storage_reads.parquet")
    spark.createDataFrame([("0xCC", slot, "0x77", 2)], "address string, slot string, value string, block_number long").write.parquet(f"{tmp_path}/in/storage_diffs.parquet")
    spark.createDataFrame([("0xcc", "0x00f5", 1)], "address string, code string, block_number long").write.parquet(f"{tmp_path}/in/contract_codes.parquet")
    spark.createDataFrame([("0xA9059CBB", "transfer(address,uint256)", "4byte", 1), ("0xa9059cbb", "join_tg_invmru_haha(bool,address)", "", 2)], "selector string, text_signature string, source string, first_seen int").write.parquet(f"{tmp_path}/selectors.parquet")
    for f in (tmp_path / "in/canonical_execution_transaction.parquet").glob("*.parquet"):
        f.write_bytes(b"broken")
    schedule.main([str(tmp_path / "in"), str(tmp_path / "out"), "--schedules", "s1", "--start", "100", "--end", "139", "--selectors", f"{tmp_path}/selectors.parquet"])
    read = lambda n: json.loads((tmp_path / "out/s1" / f"{n}.json").read_text())
    board = read("oog_forensics")["contract_leaderboard"]
    assert board[0]["addr"] == "0xcc" and board[0]["is_factory"] and board[0]["upgrade_mechanism"] == "eip1967_transparent" and board[0]["upgrade_admin"].endswith("77")
    assert {c["selector_signature"] for c in read("affected/0xcc")["failure_clusters"]} == {"transfer(address,uint256)"}
    assert "no denominators" in capsys.readouterr().out and read("affected/0xaa")["context"]["failure_rate"] is None


def test_medians_round_halves_to_even(spark):
    rows = divergence(spark, *[{**G4, "block_number": i, "tx_hash": f"t{i}", "recipient": "r", "gas_delta": g, "runtime_state_gas_spillover": g} for i, g in enumerate((2, 3))])
    got = clusters.failure_clusters(clusters.roles(rows)).collect()
    assert [r["gas_p50"] for r in got] == [2] and one(forensics.reservoir(rows, False), "avg_spillover") == [2]
    assert [r["gas_p50"] for r in clusters.context(clusters.roles(rows), rows).collect()] == [2]


def test_quantiles_of_groups(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.randint(-20, 20)]), rng.random()) for k in "abc" for _ in range(rng.randint(1, 60))] + [("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double")
    got = {r["k"]: r for r in hist.quantiles(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, (0.0, 0.5, 0.9, 1.0)).collect()}
    for k in "abcd":
        for name, at in (("x", 1), ("y", 2)):
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert got[k][f"q_{name}"] is None if not values else np.allclose(got[k][f"q_{name}"], np.percentile(values, [0, 50, 90, 100]))


def test_summary_violations(spark):
    names = [p for ps in partition.SUMMARY_VIEWS.values() for p in ps]
    good = {"no_state": 3, "runtime_state": 2, "creation": 5, "type_legacy": 5}
    rows = [(1, "gas_only", 5, *[good.get(n, 0) for n in names]), (2, "gas_only", 5, *[good.get(n, 1) for n in names]), (3, "unchanged", 9, *[0 for _ in names]), (4, "gas_only", 7, *[None for _ in names])]
    df = spark.createDataFrame(rows, "block_number long, class string, tx_count long, " + ", ".join(f"tx_count_{n} long" for n in names))
    assert {r["block_number"]: r["broken"] for r in partition.summary_violations(df).collect()} == {2: "tx_shape,tx_type"}


def test_label_build(spark, tmp_path):
    landed, cache = tmp_path / "landed", tmp_path / "cache"
    spark.createDataFrame([("0xA1", False, "2", {"contract_name": "Pool", "usage_category": "dex", "is_proxy": "true"}), ("0xa1", True, "3", {"contract_name": "Old"})], "recipient string, revoked boolean, time string, tags map<string,string>").write.parquet(f"{landed}/attestations.parquet")
    spark.createDataFrame([("0xa1", "Uni: Pool", "bridge"), ("0xb2", "", "cex")], "address string, name string, category string").write.parquet(f"{landed}/curated.parquet")
    spark.createDataFrame([("frontrun", "0xB2"), ("swap", "0xc3")], "mev_type string, address_from string").write.parquet(f"{landed}/mev.parquet")
    for kind, doc in (("contracts", '{"project": "Who"}'), ("tokens", '{"symbol": "TOK", "type": "ERC20"}')):
        (landed / "registry" / kind).mkdir(parents=True)
        (landed / "registry" / kind / f"0x{kind[0]}.json").write_text(doc)
    got = {r["address"]: r for r in label_build.build(spark, str(landed), str(cache)).collect()}
    assert (got["0xa1"]["label"], got["0xa1"]["category"], got["0xa1"]["source"], got["0xa1"]["is_proxy"]) == ("Pool", "swap_dex", "oli", True)
    assert (got["0xb2"]["category"], got["0xb2"]["is_mev_bot"], got["0xb2"]["mev_role"]) == ("cex", True, "sandwich") and "0xc3" not in got
    assert got["0xc"]["owner_project"] == "Who" and got["0xt"]["category"] == "token" and got["0x" + "0" * 39 + "1"]["category"] == "precompile"
    assert not (cache / "heuristic.parquet").exists()  # has not landed
    label_files.write_labels(L.records(spark.createDataFrame([("x",)], "a string"), "dune", "high", address=F.col("a"), category=F.lit("nonsense")), f"{cache}/dune.parquet")
    with pytest.raises(ValueError, match="enumerations"):
        label_build.merged(spark, str(cache))


def test_pinned_reads_only_its_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "s", b) for b in (10, 60_000, 120_000)], "chain_id int, analysis_config_hash string, schedule_name string, block_number long")
    staged = tables.stage(df, f"{tmp_path}/t")
    got = tables.pinned(staged, "c", "s", (50_000, 99_999))
    assert [r["block_number"] for r in got.collect()] == [60_000]
    assert "PartitionFilters: [isnotnull(block_bucket" in got._jdf.queryExecution().toString()


def test_documents():
    assert documents.plain({"a": 2.675, "b": [None, 0.03125], "c": None}, 2, keep_nulls=False) == {"a": round(2.675, 2), "b": [None, 0.03]}


def test_sorting_numbers_before_texts(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("A",), (None,)], "x string")
    assert one(forensics.sortable(df, "x")) == ["10", "9", "b", "A", None] and one(forensics.sortable(df, "x", False)) == ["9", "10", "A", "b", None]
