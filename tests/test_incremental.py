"""States by bucket, checked staging, the committing sink, and a run that reads only what changed."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_domain import warehouse

from deltascope.operators import hist, partition, shards, states
from deltascope.plans import schedule
from deltascope.sources import document_sink as sink, staging, state_store, tables

SPEC = states.Spec(sums={"s": "x"}, least={"lo": "x"}, most={"hi": "x"}, arrays={"h": ("h", 3)}, counted={"k": "k", "parity": "x % 2"})
ROWS = "block_number long, x long, h array<long>, k string"


def rows(spark, values, width=10):
    return state_store.bucketed(spark.createDataFrame(values, ROWS), width)


def some(n=100):
    return [(b, None if b % 11 == 0 else (b * 37) % 101 - 50, None if b % 7 == 0 else [b] * (b % 5), None if b % 3 == 0 else f"k{b % 4}") for b in range(n)]


def brute(values):
    xs = [x for _, x, _, _ in values if x is not None]
    h = [sum((a or [])[i] if i < len(a or []) else 0 for _, _, a, _ in values) for i in range(3)]
    counts = {}
    for _, x, _, k in values:
        for which, v in (("k", k), ("parity", None if x is None else str(int(abs(x) % 2 * (1 if x >= 0 else -1))))):
            if v is not None:
                counts[which, v] = counts.get((which, v), 0) + 1
    return (len(values), sum(xs), min(xs, default=None), max(xs, default=None), h), counts


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*.parquet")}


def test_ranges_merge_and_one_bucket_is_rewritten_alone(spark, tmp_path):
    store, values = str(tmp_path / "store"), some()
    df = rows(spark, values)
    state_store.refresh(df, SPEC, store, range(5), "a")
    state_store.refresh(df, SPEC, store, range(5, 10), "a")
    state_store.refresh(df, SPEC, store, range(10), "other")

    def over(lo, hi, frame=df):
        got, counts = state_store.over_range(frame, SPEC, store, "a", (lo, hi), width=10)
        r = got.first()
        return (r["n_rows"], r["s"], r["lo"], r["hi"], list(r["h"])), {(c["which"], c["value"]): c["n"] for c in counts.collect()}

    for lo, hi in ((0, 99), (0, 9), (3, 4), (7, 52), (10, 49), (15, 20), (95, 99), (60, 200)):
        assert over(lo, hi) == brute([v for v in values if lo <= v[0] <= hi])
    left, right = over(0, 49), over(50, 99)
    whole = over(0, 99)
    assert left[0][0] + right[0][0] == whole[0][0] and left[0][1] + right[0][1] == whole[0][1]
    before = files(store)
    changed = [(b, 1000, [1], "new") if 30 <= b < 40 else v for v in values for b in [v[0]]]
    state_store.refresh(rows(spark, changed), SPEC, store, [3], "a")
    after = files(store)
    gone = {p for p in before if p not in after}
    assert gone and all("schedule_name=a" in p and "block_bucket=3/" in p for p in gone | {p for p in after if p not in before})
    assert over(0, 99, rows(spark, changed)) == brute(changed)
    empty = [v for v in changed if not 30 <= v[0] < 40]
    state_store.refresh(rows(spark, empty), SPEC, store, [3], "a")  # a bucket that has lost all rows
    assert over(0, 99, rows(spark, empty)) == brute(empty)


def test_whole_buckets_are_not_read_from_the_rows(spark, tmp_path):
    df = rows(spark, some())
    state_store.refresh(df, SPEC, f"{tmp_path}/s", range(10), "a")
    nothing = df.filter("block_number < 20 or block_number > 79")  # what lies between comes from the store
    got, _ = state_store.over_range(nothing, SPEC, f"{tmp_path}/s", "a", (15, 85), width=10)
    assert got.first()["n_rows"] == 71


def test_meta_and_overview_from_states_equal_those_from_blocks(spark, tmp_path):
    blocks = spark.range(60).selectExpr("id AS block_number", "date_add(date'2026-01-01', cast(id / 25 as int)) AS day", "id + 1 AS tx_count", *[f"id % {i + 2} AS {p}" for i, p in enumerate(partition.PARTS)], "id % 4 AS rescues", "id % 9 = 0 AS drill_ins_truncated")
    state_store.refresh(state_store.bucketed(blocks, 10), states.BLOCKS, f"{tmp_path}/b", range(7), "s", by=["day"])
    kept = state_store.read_states(spark, f"{tmp_path}/b", "s")
    assert [r.asDict() for r in states.meta(kept).drop("n_blocks", "truncated_blocks").collect()] == [r.asDict() for r in partition.meta(blocks).collect()]
    assert [r.asDict() for r in states.overview(kept).collect()] == [r.asDict() for r in partition.overview(blocks).collect()]


def reader(df, losses):
    """A reader that loses what losses says at each attempt, and keeps what it was asked for."""
    asked = []

    def read(buckets):
        asked.append(list(buckets))
        out = df.filter(F.col("block_bucket").isin(buckets))
        return out.filter(~F.expr(losses[len(asked) - 1])) if len(asked) <= len(losses) else out

    return read, asked


def test_short_reads_are_repaired_bucket_by_bucket(spark, tmp_path):
    df = rows(spark, some())
    expected = staging.ledger(df)
    read, asked = reader(df, ["block_number in (14, 15, 77)", "block_number = 77"])
    staged, kept = staging.stage_checked(read, expected, f"{tmp_path}/t")
    assert asked == [list(range(10)), [1, 7], [7]]
    assert sorted(map(repr, staged.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert {r["block_bucket"]: r["attempts"] for r in kept.collect()} == {b: {1: 2, 7: 3}.get(b, 1) for b in range(10)}
    read, asked = reader(df, ["block_number = 14"] * 9)
    with pytest.raises(staging.ShortRead, match="bucket 1 has 9 of 10 rows after 4 attempts"):
        staging.stage_checked(read, expected, f"{tmp_path}/u")
    assert asked[1:] == [[1]] * 3


def test_staging_reads_its_source_once_an_attempt(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).select(F.col("id").alias("block_number"), F.floor(F.col("id") / 100).alias("block_bucket"))
    counted = df.mapInArrow(once, df.schema)
    staged, kept = staging.stage_checked(lambda buckets: counted, staging.ledger(df), f"{tmp_path}/t")
    assert seen.value == 3000 and staged.distinct().count() == 3000 and {r["rows"] for r in kept.collect()} == {100}


def test_checksums_are_exact_sums_of_signed_hashes(spark):
    hashes = [2**63 - 1, -(2**63), -1, 0, None, 2**63 - 1, 2**63 - 5, -(2**32), 2**32 - 1]
    df = spark.createDataFrame([(i % 2, h) for i, h in enumerate(hashes)] + [(7, None)], "block_bucket long, h long")
    got = {r["block_bucket"]: (r["rows"], r["checksum"]) for r in staging.ledger(df, F.col("h")).collect()}
    assert got == {**{b: (len(hashes[b::2]), sum(h or 0 for h in hashes[b::2])) for b in (0, 1)}, 7: (1, None)}


def test_surplus_rows_raise_at_once_and_other_rows_are_read_again(spark, tmp_path):
    df = rows(spark, some())
    read, asked = reader(df.union(df.filter("block_number = 5")), [])
    with pytest.raises(staging.SurplusRows, match="bucket 0 has 11 rows, the ledger 10"):
        staging.stage_checked(read, staging.ledger(df), f"{tmp_path}/t")
    assert len(asked) == 1
    wrong = [df.withColumn("x", F.when(F.col("block_number") == 33, 7).otherwise(F.col("x"))), df]
    tried = []

    def garbled(buckets):
        tried.append(list(buckets))
        return wrong[min(len(tried) - 1, 1)].filter(F.col("block_bucket").isin(buckets))

    staging.stage_checked(garbled, staging.ledger(df), f"{tmp_path}/v")
    assert tried == [list(range(10)), [3]]
    promised = staging.ledger(df).withColumn("checksum", F.lit(None).cast("decimal(38,0)"))  # counts alone
    read, asked = reader(df, [])
    staging.stage_checked(read, promised, f"{tmp_path}/w")
    assert len(asked) == 1


def test_only_some_buckets_are_staged_again(spark, tmp_path):
    df = rows(spark, some())
    staging.stage_checked(reader(df, [])[0], staging.ledger(df), f"{tmp_path}/t")
    before = files(tmp_path / "t")
    new = df.filter("block_bucket <> 8").withColumn("x", F.when(F.col("block_bucket") == 2, 1).otherwise(F.col("x")))
    assert state_store.stale(staging.ledger(new), staging.kept_ledger(spark, f"{tmp_path}/t")) == [2, 8]
    staged, kept = staging.stage_checked(reader(new, [])[0], staging.ledger(new), f"{tmp_path}/t", only=[2, 8])
    after = files(tmp_path / "t")
    assert all("bucket=2/" in p or "bucket=8/" in p for p in before.keys() ^ after.keys()) and not [p for p in after if "bucket=8/" in p]
    assert staged.count() == 90 and sorted(r["block_bucket"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert state_store.stale(staging.ledger(new), staging.kept_ledger(spark, f"{tmp_path}/t")) == []


def test_empty_staging(spark, tmp_path):
    df = rows(spark, [])
    staged, kept = staging.stage_checked(reader(df, [])[0], staging.ledger(df), f"{tmp_path}/t")
    assert staged.count() == 0 and kept.count() == 0


def texts(folder):
    return {p.name: p.read_text() for p in Path(folder).glob("*")}


def test_sink_commits_a_folder_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "docs")
    one = spark.createDataFrame([("A", "{}"), ("b", '{"x":"é"}')], "k string, t string")
    sink.write_folder(sink.whole(one, F.col("k"), F.col("t")), out)
    assert texts(out) == {"a.json": "{}", "b.json": '{"x":"é"}'}
    many = spark.range(1000).selectExpr("id", "cast(id as string) AS tie")
    whole = sink.frame(spark, "list", '{"n":[', "]}").unionByName(sink.items(many, "list", -F.col("id"), F.col("tie"), F.col("tie"))).unionByName(sink.frame(spark, "none", "[", "]"))
    sink.write_folder(whole, out)
    assert json.loads(texts(out)["list.json"])["n"] == list(range(999, -1, -1)) and texts(out)["none.json"] == "[]" and len(texts(out)) == 2
    before = texts(out)
    broken = spark.createDataFrame([("c", "{}"), ("d", None)], "k string, t string")
    with pytest.raises(Exception, match="encode"):
        sink.write_folder(sink.whole(broken, F.col("k"), F.col("t")), out)
    assert texts(out) == before and [p.name for p in tmp_path.iterdir()] == ["docs"]
    sink.write_folder(sink.whole(one.filter("false"), F.col("k"), F.col("t")), out)
    assert texts(out) == {}


def test_second_run_reads_only_what_changed(spark, tmp_path):
    source = tmp_path / "in"
    warehouse(spark, source, first=49_980)  # two buckets
    table = lambda n: tables.pinned(tables.read_table(spark, str(source), n), "cfg", "s1", (49_980, 50_019))

    def run(folder):
        rows, blocks, summary = schedule.stage_run(spark, table, str(tmp_path / folder), "s1")
        return rows.count(), [r.asDict() for r in states.meta(blocks).collect()], [r.asDict() for r in partition.aggregate_mixes(summary).collect()]

    names = ("divergence", "blocks", "block-states", "summary-states")
    contents = lambda: {n: files(tmp_path / "staged" / n) for n in names}
    first, before = run("staged"), contents()
    assert first[1][0]["tx_count"] == 800 and run("staged") == first and contents() == before
    at = source / "gas_analysis_block_coverage.parquet"
    newer = spark.read.parquet(str(at)).filter("block_number = 50010").withColumns({"updated_at": F.lit(2), "tx_count": F.lit(21).cast("long"), "tx_count_unchanged": F.lit(6).cast("long")})
    newer.write.mode("append").parquet(str(at))
    again = run("staged")
    for n, now in contents().items():
        other = now.keys() ^ before[n].keys()
        assert all("block_bucket=1/" in p for p in other) and bool(other) == (n != "summary-states")
    assert again[1][0]["tx_count"] == 801 and again == run("anew")


# Published shards -------------------------------------------------------------------------------------------


def test_written_shards_have_the_published_shape(spark, tmp_path):
    warehouse(spark, tmp_path / "in")
    spark.createDataFrame([("0x60110000", "make()", "4byte", 1)], "selector string, text_signature string, source string, first_seen int").write.parquet(f"{tmp_path}/selectors.parquet")
    schedule.main([str(tmp_path / "in"), str(tmp_path / "out"), "--schedules", "s1", "--start", "100", "--end", "139", "--selectors", f"{tmp_path}/selectors.parquet"])
    folder = tmp_path / "out/s1/affected"
    index, collapsed = (json.loads((folder / f"{n}.json").read_text()) for n in ("index", "deploy_oog"))
    found = {p.stem: json.loads(p.read_text()) for p in folder.glob("0x*.json")}
    assert found and index["affected_count"] == len(found) + index["deploy_oog"]["count"] and index["schedule"] == collapsed["schedule"] == "s1"
    assert index["block_range"] == {"start": 100, "end": 139} and index["g4_total"] == json.loads((tmp_path / "out/s1/meta.json").read_text())["totals"]["g4"]
    header = {"address", "label", "category", "owner_project", "source", "confidence", "is_proxy", "is_factory", "is_safe", "erc_type", "is_upgradable", "upgrade_mechanism", "upgrade_admin", "is_mev_bot", "mev_role"}
    rates = set()
    for name, s in found.items():
        assert s["address"] == name == name.lower() and header <= set(s) and s["label"] == name and s["category"] is None
        assert s["is_mev_bot"] is False and s["confidence"] == "low"
        roles = s["roles_summary"]
        assert roles and set(roles) <= {"entry", "oog_site", "revert_site"} and None not in roles.values()
        if "entry" in roles:
            e = roles["entry"]
            assert set(e) == {"g4_tx_count", "g4_oog_count", "g4_nonoog_count"} and e["g4_oog_count"] + e["g4_nonoog_count"] == e["g4_tx_count"] > 0
        assert "oog_site" not in roles or roles["oog_site"].keys() == {"halt_count"}
        assert "revert_site" not in roles or roles["revert_site"].keys() == {"revert_count"}
        counts = [c["count"] for c in s["failure_clusters"]]
        assert counts and counts == sorted(counts, reverse=True) and len(counts) <= 8 and s["distinct_cluster_count"] >= len(counts) and 0 < s["clusters_shown_share"] <= 1
        for c in s["failure_clusters"]:
            assert c["role"] in roles and c["kind"] in ("oog", "non_oog") and isinstance(c["drivers"], dict) and None not in c["drivers"].values()
            assert {"selector", "selector_signature", "entry_selector", "entry_signature", "where_contract", "where_label", "where_category", "opcode", "pattern_or_reason", "oog_bottleneck_kind", "call_depth", "revert_decoded", "share_of_role", "share_of_contract"} <= set(c)
            assert set(c["gas_delta"]) == {"avg", "p50", "p90"} and all(isinstance(v, int) for v in c["gas_delta"].values())
            assert c["where_label"] == c["where_contract"] and all(c[k] == round(c[k], 4) for k in ("share_of_role", "share_of_contract"))
            assert 1 <= len(c["examples"]) <= 2 and all(set(x) == {"tx_hash", "block_number", "gas_delta"} for x in c["examples"])
        context = s["context"]
        assert set(context) == {"g3_tx_count", "g2_drillin_tx_count", "af_tx_count", "status_flips", "gas_delta", "block_span_start", "block_span_end", "distinct_blocks", "failure_rate", "entry_functions", "failing_functions", "halt_contracts", "revert_contracts", "entry_contracts"}
        assert set(context["gas_delta"]) == {"avg", "sum", "p50", "p90"} and isinstance(context["gas_delta"]["avg"], int)
        assert all(set(f) == {"selector", "signature", "count"} for n in ("entry_functions", "failing_functions") for f in context[n])
        assert all(set(m) == {"contract", "label", "category", "count"} for n in ("halt_contracts", "revert_contracts", "entry_contracts") for m in context[n])
        rates.add(context["failure_rate"] is None)
        assert context["failure_rate"] is None or set(context["failure_rate"]) == {"total_tx", "halt_rate", "revert_rate"}
    assert rates == {True, False}
    assert collapsed["class"] == "deploy_oog" and collapsed["explainer"] and collapsed["count"] == len(collapsed["accounts"]) == index["deploy_oog"]["count"]
    assert set(collapsed["aggregate"]["gas_delta"]) == {"p50", "p90", "min", "max"} and all(set(x) == {"contract", "label", "category", "count"} for x in collapsed["aggregate"]["top_entry_contracts"])
    assert all(set(a) == {"tx", "block", "gas_delta", "opcode", "selector", "entry"} for a in collapsed["accounts"].values()) and not set(collapsed["accounts"]) & set(found)


def test_shares_and_averages_are_rounded_as_python_does():
    """1/32 and 5/32 are ties in binary; 3/20000 is one only in decimal."""
    cluster = {"share_of_role": 1 / 32, "share_of_contract": 5 / 32, "gas_delta": {"avg": 2.5, "p50": 1, "p90": 2}, "drivers": {"sload": {"p50": 1}, "sstore": None, "spillover_share": 3 / 20000}, "state_gas_category": None}
    context = {"gas_delta": {"avg": None}, "failure_rate": {"total_tx": 3, "halt_rate": 1 / 3, "revert_rate": 1 / 128}}
    got = shards.document({"roles_summary": {"entry": {"g4_tx_count": 1}, "oog_site": None}, "clusters_shown_share": 3 / 32, "failure_clusters": [cluster], "context": context})
    c = got["failure_clusters"][0]
    assert (c["share_of_role"], c["share_of_contract"], got["clusters_shown_share"]) == (0.0312, 0.1562, round(3 / 32, 4)) and c["gas_delta"]["avg"] == 2
    assert c["drivers"] == {"sload": {"p50": 1}, "spillover_share": round(3 / 20000, 4)} and got["roles_summary"] == {"entry": {"g4_tx_count": 1}}
    assert got["context"]["gas_delta"]["avg"] == 0 and got["context"]["failure_rate"] == {"total_tx": 3, "halt_rate": 0.333333, "revert_rate": 0.007812}


def test_optional_sources_do_not_hide_errors_of_the_program(spark, tmp_path, capsys):
    def broken():
        raise MemoryError("out of it")

    with pytest.raises(MemoryError):
        schedule.optional("x", broken)
    assert schedule.optional("file", lambda: spark.read.parquet(f"{tmp_path}/none")) is None and "PATH_NOT_FOUND" in capsys.readouterr().out
    (tmp_path / "bad.parquet").write_bytes(b"broken")
    assert schedule.optional("file", lambda: tables.held(spark.read.schema("a int").parquet(f"{tmp_path}/bad.parquet"), "x")) is None and "no file" in capsys.readouterr().out
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        schedule.optional("x", lambda: spark.sql("SELECT 1 / id AS x FROM range(1)").collect())


def test_state_histograms_equal_those_of_rows(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS block_number", "true AS baseline_success", "id % 3 = 0 AS schedule_success", "CAST(NULL AS double) AS min_multiplier_to_succeed", "id * id * 17 - 4000 AS gas_delta", "CAST(NULL AS bigint) AS baseline_gas_used", "'c' AS state_gas_category", "2 AS tx_type", "CAST(NULL AS string) AS oog_opcode")
    state_store.refresh(state_store.bucketed(df, 50), states.DIVERGENCE, f"{tmp_path}/s", range(4), "s")
    got, _ = state_store.over_range(state_store.bucketed(df, 50), states.DIVERGENCE, f"{tmp_path}/s", "s", (10, 180), width=50)
    own = df.filter("block_number between 10 and 180")
    none = spark.createDataFrame([], "h array<bigint>")
    bins = {r["bin"]: r["count"] for r in hist.gas_histogram(none, "h", own).collect()}
    assert got.first()["gas_hist"][1:] == [bins[b] for b in range(1, 12)]
