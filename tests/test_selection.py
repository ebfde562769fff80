"""Quantiles without a group in one task, distinct counts by bitmaps, the name index, and lookups by Bloom filters."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.operators import breadth, clusters, config, hist, search
from deltascope.plans.find import find, write_lookup
from deltascope.sources import document_sink as sink, tables


def expected(values, p):
    return float(np.quantile(np.array(values, dtype=float), p))


@pytest.mark.parametrize("wide", [0, 7, 50_000])
def test_quantiles_by_aggregate_and_by_bins(spark, monkeypatch, wide):
    monkeypatch.setattr(hist, "WIDE", wide)
    monkeypatch.setattr(hist, "BINS", 16)
    rng = random.Random(4)
    groups = {
        "ints": [rng.randint(-50, 50) for _ in range(200)], "one": [3.0], "same": [7.0] * 30, "zeros": [0.0, 0.0, -1.0, 5.0], "tiny": [rng.random() * 1e-300 for _ in range(40)],
        "huge": [rng.uniform(-1, 1) * 1.7e308 for _ in range(40)], "far": [10.0**k for k in range(-30, 30)] + [-(10.0**k) for k in range(-30, 30)], "close": [1e9 + i * 1e-6 for i in range(60)], None: [float(i) for i in range(20)],
    }
    rows = [(k, float(v), None) for k, vs in groups.items() for v in vs] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    points = (0.5, 0.9, 0.25)
    got = {r["k"]: r for r in hist.quantiles(df, ["k"], {"x": F.col("x"), "y": F.col("y"), "twice": F.col("x") * 1}, points).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name in ("q_x", "q_twice"):
            assert got[k][name] == pytest.approx([expected(vs, p) for p in points], rel=1e-12, abs=1e-12 if k != "tiny" else 0)
        assert got[k]["q_y"] is None


def test_quantiles_of_five_million_values_in_one_group(spark):
    """The group's values never meet in one task: no window or sort is over them, and the largest input of one is a group's bins."""
    df = spark.range(0, 5_000_000, 1, 8).select(F.lit("hot").alias("k"), ((F.col("id") * 7_368_787) % 5_000_011).cast("double").alias("x")).unionByName(spark.createDataFrame([("cold", float(i)) for i in range(10)], "k string, x double"))
    got = {r["k"]: list(r["q_x"]) for r in hist.quantiles(df, ["k"], {"x": F.col("x")}, (0.5, 0.9)).collect()}
    values = np.sort((np.arange(5_000_000) * 7_368_787) % 5_000_011)
    assert got == {"hot": [expected(values, 0.5), expected(values, 0.9)], "cold": [4.5, pytest.approx(8.1)]}


def test_few_values_need_no_window(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS x")
    plan = hist.quantiles(df, ["k"], {"x": F.col("x")}, (0.5,))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_distinct_counts_roll_up_from_bitmaps(spark):
    rng = random.Random(2)
    rows = [(f"2024-{rng.randint(1, 3):02d}", rng.randint(1, 28), rng.choice([None, f"a{rng.randint(0, 60_000)}"]), rng.choice([None, rng.randint(0, 9)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "month string, day int, a string, b long").repartition(5)
    ids = breadth.dictionary(df.filter("day < 9"), ["a", "b"])
    first = {(r["which"], r["value"]): r["id"] for r in ids.collect()}
    ids = breadth.dictionary(df, ["a", "b"], ids)
    known = {(r["which"], r["value"]): r["id"] for r in ids.collect()}
    assert sorted(known.values()) == list(range(len(known))) and all(known[k] == v for k, v in first.items())
    spread = ids.withColumn("id", F.col("id") * 40)  # over several bitmaps
    maps = breadth.bitmaps(df, ["a", "b"], spread, ["month", "day"])
    got = {tuple(r)[:4]: r["n"] for r in breadth.breadth_over(maps, {"day": ["month", "day"], "month": ["month"], "all": []}).collect()}
    want = {}
    for month, day, a, b in rows:
        for which, v in (("a", a), ("b", b)):
            if v is not None:
                for key in (("day", month, day, which), ("month", month, None, which), ("all", None, None, which)):
                    want.setdefault(key, set()).add(v)
    assert got == {k: len(v) for k, v in want.items()}
    assert breadth.dictionary(df.filter("false"), ["a"]).collect() == []


NAMES = [("0xa", "Uniswap V3: Router", "uniswap", 9), ("0xb", "Tether USD", None, 50), ("0xc", "swap", "Curve Fi", 9), ("0xd", None, "SWAPPER", 1), ("0xe", "日本語トークン", "é", 2), ("0xf", "", None, 3)]


def test_index_finds_what_a_plain_search_finds(spark, tmp_path):
    names = spark.createDataFrame(NAMES, "address string, label string, owner_project string, footprint long")
    search.write_index(names, f"{tmp_path}/i")
    queries = ["swap", " SWAP ", "u", "us", "V3: r", "router uniswap", "p curve", "日本", "本語トー", "é", "zzz", "", "  ", "tether usd ", "usd x", ":", " "]
    text = {a: f"{(la or '').lower()} {(o or '').lower()}" for a, la, o, _ in NAMES}
    order = {a: (-f, a) for a, _, _, f in NAMES}
    for given in (queries, spark.createDataFrame([(q,) for q in [*queries, "swap"]], "query string")):
        got = {r["query"]: r for r in search.search(spark, f"{tmp_path}/i", given, most=2).collect()}
        assert set(got) == set(queries)
        for q in queries:
            needle = q.strip(" ").lower()
            hits = sorted((a for a, t in text.items() if needle and needle in t), key=order.get)
            assert (got[q]["n_hits"], got[q]["kind"]) == (len(hits), "none" if not hits else "one" if len(hits) == 1 else "many")
            assert [h["address"] for h in got[q]["hits"] or []] == hits[:2]
    assert search.entry(spark, f"{tmp_path}/i", " 0xA ").first()["label"] == "Uniswap V3: Router" and search.entry(spark, f"{tmp_path}/i", "0xz").count() == 0


def test_a_query_reads_only_its_postings(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"0x{i:06d}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)), None, i) for i in range(5000)]
    search.write_index(spark.createDataFrame(rows, "address string, label string, owner_project string, footprint long"), f"{tmp_path}/i")
    plan = search.search(spark, f"{tmp_path}/i", [rows[7][1]])._jdf.queryExecution().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet [piece#" in x and "address#" in x]
    assert scans and all("PushedFilters: [In(piece, [" in x and re.search(r"PartitionFilters: \[part#\d+ (IN|INSET) ", x) for x in scans)
    assert search.search(spark, f"{tmp_path}/i", [rows[7][1]]).first()["hits"][0]["address"] == rows[7][0]


def test_frequent_pieces_give_no_candidates(spark, tmp_path):
    """Names that share most of their pieces: joins hand on about as many rows as there are hits."""
    rows = [(f"0x{i:06d}", f"Name#{i:09d}", None, i) for i in range(400)]
    names = spark.createDataFrame(rows, "address string, label string, owner_project string, footprint long")
    search.write_index(names, f"{tmp_path}/i")
    asked = names.select(F.col("label").alias("query"))
    out = search.search(spark, f"{tmp_path}/i", asked)
    assert all((r["n_hits"], r["hits"][0]["label"]) == (1, r["query"]) for r in out.collect())
    most, todo = 0, [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("Join"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        todo += [children] if children is not None else [node.children().apply(i) for i in range(node.children().size())]
    assert 400 <= most < 400 * 20  # pieces of these names, asked for by 400 queries


def rows_read(df):
    """Rows that came out of the table scans of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().get("numOutputRows").get().value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_lookups_of_a_few_addresses_read_few_row_groups(spark, tmp_path):
    rng = random.Random(9)
    raw = spark.range(60_000).select(F.col("id").alias("block_number"), F.concat(F.lit("0xA"), F.xxhash64("id").cast("string")).alias("to_address"))
    raw = raw.unionByName(spark.range(50).select(F.col("id").alias("block_number"), F.lit(None).cast("string").alias("to_address")))
    staged = tables.stage_recipients(raw, f"{tmp_path}/t", row_group_bytes=16 << 10)
    wanted = [r["to_address"] for r in raw.filter(F.col("block_number").isin(rng.sample(range(60_000), 9))).filter("to_address is not null").collect()] + ["0xnone"]
    asked = spark.createDataFrame([(a.upper().replace("0X", "0x"),) for a in wanted], "addr string")
    got = tables.denominators(staged, asked, (0, 59_999))
    assert {r["addr"]: r["total_tx"] for r in got.collect()} == {a.lower(): 1 for a in wanted[:-1]}
    assert rows_read(got) < 6_000
    many = raw.filter("to_address is not null").select(F.col("to_address").alias("addr")).limit(40)
    by_staged, by_raw = (sorted(tuple(r) for r in tables.denominators(t, many, (100, 59_000)).collect()) for t in (staged, raw))
    assert by_staged == by_raw


def test_manifests_that_do_not_agree(spark):
    runs = spark.createDataFrame([(1, '{"depth": {"limit": 5}, "tags": ["a"]}'), (2, '{"depth": "none"}'), (3, "[1, 2]"), (4, "broken {"), (5, None), (6, '{"depth": {"limit": "7"}}')], "id int, manifest_json string")
    got = {r["id"]: tuple(r)[1:] for r in config.manifest_fields(runs, {"limit": ("$.depth.limit", "int"), "tag": ("$.tags[0]", "string")}).select("id", "limit", "tag", "manifest_kind").collect()}
    assert got[1][:2] == (5, "a") and got[2][:2] == (None, None) and got[3] == (None, None, "ARRAY<BIGINT>") and got[4] == got[5] == (None, None, None) and got[6][0] == 7


def test_find_opens_a_shard_an_account_or_names(spark, tmp_path):
    a, b, c = (f"0x{x * 40}" for x in "abc")
    sink.write_folder(sink.whole(spark.createDataFrame([(a, '{"address": "x"}')], "k string, t string"), F.col("k"), F.col("t")), f"{tmp_path}/affected")
    names = spark.createDataFrame([*NAMES, (a, "Alpha Swap", None, 4)], "address string, label string, owner_project string, footprint long")
    write_lookup(names, spark.createDataFrame([(b, "t1", 5)], "account string, tx string, block long"), f"{tmp_path}/_search")
    look = lambda text, most=20: find(spark, str(tmp_path), text, most)
    assert look(f" {a.upper().replace('0X', '0x')} ")[0] == "shard" and look(a)[1].first()["value"] == '{"address": "x"}'
    kind, rows = look(b)
    assert kind == "collapsed" and rows.first()["tx"] == "t1" and "PushedFilters: [IsNotNull(account), EqualTo(account" in rows._jdf.queryExecution().toString()
    assert look(c)[0] == "none" and look("nothing of that name")[0] == "none" and look("")[0] == "none" and look("0xabc")[0] == "none"
    kind, rows = look("SWAP", 2)
    assert kind == "many" and [r["address"] for r in rows.collect()] == ["0xa", "0xc"] and look("tether")[0] == "one"


def test_clusters_of_a_contract_with_very_many(spark):
    """Totals are exact, ties go by key, and each task passes on its own largest clusters alone."""
    roled = spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("contract"), F.when(F.col("id") % 2 == 0, "entry").otherwise("revert_site").alias("role"), F.lit("non_oog").alias("kind"),
        F.concat(F.lit("reason"), F.lpad((F.sqrt("id") * 80).cast("int").cast("string"), 6, "0")).alias("revert_decoded"), *[F.lit(None).cast("string").alias(c) for c in ("failing_selector", "where_contract", "opcode", "pattern_or_reason", "oog_bottleneck_kind", "state_gas_category", "entry_selector")],
        F.lit(None).cast("int").alias("call_depth"), F.col("id").alias("block_number"), F.col("id").cast("string").alias("tx_hash"), F.lit(1).cast("bigint").alias("gas_delta"),
    )
    counts = collections.Counter((r["contract"], r["role"], r["revert_decoded"]) for r in roled.collect())
    out = clusters.failure_clusters(roled, causes=False)
    got = collections.defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["place"]):
        got[r["contract"]].append((r["count"], r["role"], r["revert_decoded"], r["contract_total"], r["role_total"], r["distinct_clusters"]))
    for contract in {c for c, _, _ in counts}:
        own = {k: n for k, n in counts.items() if k[0] == contract}
        of_role = lambda role: sum(n for k, n in own.items() if k[1] == role)  # noqa: B023, E731
        best = sorted(own, key=lambda k: (-own[k], k[1], k[2]))[: clusters.CLUSTERS]
        assert got[contract] == [(own[k], k[1], k[2], sum(own.values()), of_role(k[1]), len(own)) for k in best]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[contract#\d+\].*Partial", plan) and "sum(count#" not in "".join(line for line in plan.splitlines() if re.search(r"\bWindow \[", line))
    assert max(len([k for k in counts if k[0] == c]) for c in {k[0] for k in counts}) > 10_000
