"""Driver queries over whole inputs, against values worked out without their SQL."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from deltascope.operators import partition
from deltascope.plans import driver
from deltascope.plans.driver import QUERIES


def walk(code):
    out, i = [], 0
    while i + 2 <= len(code):
        out.append(code[i : i + 2])
        i += 2 + (2 * (int(code[i : i + 2], 16) - 0x5F) if "60" <= code[i : i + 2] <= "7f" else 0)
    return out


def test_opcode_tokens_read_whole_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "a", "é" * 400, " " * 300 + "e123456", " " * 400] + ["".join(rng.choice("abe xyz.é€0") for _ in range(n)) for n in (299, 300, 301, 5000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n"], r["has_push6"], r["first"]) for r in QUERIES["opcode_tokens"](spark, str(tmp_path)).collect()}
    want = [walk((t or "").encode().hex()) for t in texts]
    assert got == {i: (len(w), "65" in w, w[0] if w else None) for i, w in enumerate(want)}
    assert got[4] == (301, True, "20")


def test_format_helpers_format_every_event(spark, tmp_path):
    ids = [0, 1, 7, 899, 900, 999, 1000, 1234567, 9_000_000_001]
    spark.createDataFrame([(i, i / 8, "x", 1) for i in ids], "event_id long, value double, event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["ratio"], r["n"]) for r in QUERIES["format_helpers"](spark, str(tmp_path)).collect()}
    assert got == {i: (i / 8 / (i % 4) if i % 4 else None, f"{i:,}") for i in ids}


@pytest.mark.parametrize("column, broken", [("tx_count_stored", "I1"), ("retained_drill_in_count", "I2"), ("g5", "I3")])
def test_violations_of_truncated_blocks_are_reported(spark, column, broken):
    columns = ["block_number", "tx_count", "tx_count_unchanged", "tx_count_gas_only", "tx_count_stored", "retained_drill_in_count", "g2_drillin", "g3", "g4", "af", "g5"]
    whole = spark.createDataFrame([(1, 22, 10, 5, 7, 5, 2, 1, 1, 1, 2, True), (2, 20, 10, 5, 5, 5, 2, 1, 1, 1, 0, False)], ", ".join(f"{c} long" for c in columns) + ", drill_ins_truncated boolean")
    assert partition.violations(whole).count() == 0
    assert {(r["block_number"], r["broken"]) for r in partition.violations(whole.withColumn(column, F.col(column) - 3)).collect()} == {(1, broken), (2, broken)}


def test_truncated_blocks_store_what_they_dropped(spark, monkeypatch):
    """I1 holds on every block and g5 is stored - retained."""
    day = datetime.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(i, i % 13, day) for i in range(40)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    drilled = spark.createDataFrame([(i, True, True, None) for i in range(30) for _ in range(i % 7)], "block_number long, baseline_success boolean, schedule_success boolean, min_multiplier_to_succeed double")
    monkeypatch.setattr(driver, "read_table", lambda spark, sf_dir, name: orders)
    monkeypatch.setattr(driver, "facts", lambda spark, sf_dir: drilled)
    rows = driver._blocks(spark, "").collect()
    assert len(rows) == 40 and 0 < sum(r["drill_ins_truncated"] for r in rows) < 40
    for r in rows:
        assert r["tx_count_unchanged"] + r["tx_count_gas_only"] + r["tx_count_stored"] == r["tx_count"]
        assert r["tx_count_stored"] - r["retained_drill_in_count"] == r["g5"] == (2 if r["drill_ins_truncated"] else 0)


def test_null_coercion_keeps_every_event(spark, tmp_path):
    spark.range(17).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["flag"], r["n"], r["reservoir"]) for r in QUERIES["null_coercion"](spark, str(tmp_path)).collect()}
    kinds = [(True, None, None), (None, None, None), (None, 1000, 1000), (None, None, None), (None, -5, None), (None, None, None), None, (False, None, None)]
    assert got == {i: kinds[i % 8] or (None, i, i) for i in range(17)}


@pytest.mark.parametrize("name", ["block_partition", "coverage_totals", "partition_violations", "run_meta", "overview_series", "composition_percent"])
def test_blocks_read_and_deal_items_once(spark, name):
    """One scan of the items, dealt by block alone: the window over versions, the join and the counts need no other exchange of them."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "FileScan parquet" in x and "l_shipdate" in x]) == 1
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "l_linenumber" in x.split("ENSURE_REQUIREMENTS")[0]]


def test_clusters_are_counted_and_ranked_once(spark):
    """The wide count by contract and key stands in no plan but that of the ranked clusters, which are held."""
    roled = driver.clusters.roles(driver.facts(spark, "/root/testdata/sf0.001").filter(driver.P.G4)).select("contract", *driver.clusters.ROLED)
    plan = driver.clusters.failure_clusters(roled)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(contract" in plan and not [x for x in plan.splitlines() if "Aggregate [contract" in x and "revert_decoded" in x.split("], [")[0]]


def _scans(df, column):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x and column in x]


def test_rows_meet_their_clusters_once(spark, monkeypatch):
    """Figures, examples and categories of small clusters are one aggregate; large ones, counted by value, give the same."""
    roled = driver._roles(spark, "/root/testdata/sf0.001")
    once = driver.clusters.failure_clusters(roled)
    assert len(_scans(driver.clusters._small_details(roled.withColumn("cluster", F.lit(1)), True), "tx_hash")) == 1
    monkeypatch.setattr(driver.clusters, "SMALL", 1)
    both = driver.clusters.failure_clusters(roled).select(once.columns)
    assert once.schema.simpleString() == both.schema.simpleString()
    assert sorted(map(str, once.collect())) == sorted(map(str, both.collect()))


def test_mixes_of_shards_read_the_shards_once(spark):
    out = QUERIES["shard_mixes"](spark, "/root/testdata/sf0.001")
    assert len(_scans(out, "which")) < len(driver.clusters.MIXES) and {r[0] for r in out.select("which").distinct().collect()} == set(driver.clusters.MIXES)


def test_items_outside_g4_are_written_without_the_columns_of_g4(spark):
    P, own = driver.P, driver._contract_facts(spark, "/root/testdata/sf0.001")
    whole = driver.facts(spark, "/root/testdata/sf0.001").select(own.columns)
    assert own.filter(P.G4).exceptAll(whole.filter(P.G4)).isEmpty() and own.filter(P.G4).count() == whole.filter(P.G4).count()
    rest = own.filter(f"NOT coalesce({P.G4}, false)")
    assert rest.count() > 0 and rest.filter("tx_hash is not null or gas_delta is not null").isEmpty()
    wider = lambda df: driver.clusters.recipient_counts(df)
    assert wider(own).exceptAll(wider(whole)).isEmpty()
