"""Landed pages of a cursor interface: partitions, pushed filters, broken, doubled and missing pages, and labels made of them."""

import json

import pytest

from deltascope.plans import label_build
from deltascope.sources import landed_pages


def land(folder, pages):
    folder.mkdir(parents=True, exist_ok=True)
    for name, page in pages.items():
        (folder / f"{name}.json").write_text(page if isinstance(page, str) else json.dumps(page))


def page(since, *times):
    return {"since": since, "rows": [{"time": t, "x": f"v{t}"} for t in times]}


PAGES = {"a1": page(None, 1, 2), "a2": page("2", 3, 4), "a2b": page("2", 3, 4), "a4": page("6", 7), "a5": '{"since": "7", "rows": [', "a6": page("9", 10), "a7": page("10"), "a8": {"since": "10"}, "a9": "[]"}


def test_pages_and_faults(spark, tmp_path):
    land(tmp_path / "p", PAGES)
    (tmp_path / "p/.hidden.json").write_text("{}"), (tmp_path / "p/other.txt").write_text("x")
    rows = landed_pages.read_pages(spark, str(tmp_path / "p"), "rows", "time")
    assert rows.rdd.getNumPartitions() == len(PAGES)
    got = sorted((r["page"], r["x"]) for r in landed_pages.items_of(rows, "time int, x string").collect())
    assert got == [("a1", "v1"), ("a1", "v2"), ("a2", "v3"), ("a2", "v4"), ("a4", "v7"), ("a6", "v10")]
    found = sorted((r["page"], r["fault"]) for r in landed_pages.faults(landed_pages.pages_of(rows)).collect())
    assert found == [("a2b", "doubled"), ("a4", "missing before"), ("a5", "broken"), ("a6", "missing before"), ("a8", "broken"), ("a9", "broken")]
    ends = {r["page"]: (r["since"], r["last"], r["n_items"]) for r in landed_pages.pages_of(rows).collect()}
    assert ends["a1"] == (None, "2", 2) and ends["a7"] == ("10", None, 0) and ends["a5"] == (None, None, None)


def test_filters_on_pages_choose_files(spark, tmp_path):
    land(tmp_path / "p", PAGES)
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = landed_pages.read_pages(spark, str(tmp_path / "p"), "rows", "time")
        some = rows.filter("page in ('a1', 'a4') and place = 0")
        assert some.rdd.getNumPartitions() == 2 and sorted(r["page"] for r in some.collect()) == ["a1", "a4"]
        assert rows.filter("page = 'none'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "p").mkdir()
    rows = landed_pages.read_pages(spark, str(tmp_path / "p"), "rows", "time")
    assert rows.count() == 0 and landed_pages.faults(landed_pages.pages_of(rows)).count() == 0
    with pytest.raises(Exception, match="No such file|Cannot list"):
        landed_pages.read_pages(spark, str(tmp_path / "none"), "rows", "time").count()


def test_many_pages_share_partitions(spark, tmp_path, monkeypatch):
    land(tmp_path / "p", PAGES)
    monkeypatch.setattr(landed_pages, "PARTITIONS", 4)
    rows = landed_pages.read_pages(spark, str(tmp_path / "p"), "rows", "time")
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r["page"], r["place"], r["n_items"], r["error"] is None) for r in rows.collect())
    want = [(n, i if k else None, k, True) for n, k in (("a1", 2), ("a2", 2), ("a2b", 2), ("a4", 1), ("a6", 1), ("a7", 0)) for i in range(k or 1)]
    assert got == sorted(want + [(n, None, None, False) for n in ("a5", "a8", "a9")], key=lambda x: x[:2])
    monkeypatch.setattr(landed_pages, "PARTITIONS", 256)
    land(tmp_path / "q", {f"b{i:04d}": page(str(i), i + 1) for i in range(600)})
    reader = landed_pages.PageReader(f"file://{tmp_path}/q", "rows", "time")
    assert [len(p.value) for p in reader.partitions()] == [3] * 200
    monkeypatch.setattr(landed_pages, "BYTES", 1)
    assert [p.value for p in reader.partitions()] == [[f"b{i:04d}.json"] for i in range(600)]


def test_labels_from_pages(spark, tmp_path, capsys):
    one = lambda t, name: {"recipient": "0xA1", "revoked": False, "time": t, "tags": {"contract_name": name, "usage_category": "dex"}}
    land(tmp_path / "landed/attestations", {"p1": {"since": None, "attestations": [one("2024", "Old")]}, "p2": {"since": "2025", "attestations": [one("2026", "New")]}, "p3": "{"})
    got = {r["address"]: r for r in label_build.build(spark, str(tmp_path / "landed"), str(tmp_path / "cache")).collect()}
    assert (got["0xa1"]["label"], got["0xa1"]["category"], got["0xa1"]["source"]) == ("New", "swap_dex", "oli")
    said = capsys.readouterr().out
    assert "page p2: missing before 2025" in said and "page p3: broken" in said and "no labels from dune" in said
