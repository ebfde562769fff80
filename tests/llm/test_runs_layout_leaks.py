"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names, hot instants."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import decontamination, late_layout, periodic_runs, queries
from deltascope.llm.common import new_path, prepare

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, carried string, spans string, `a.b` string, `x``y` int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "c", "s", "ab", 3) for i, t in rows], DOCS)


def brute_runs(words, times=4, least=6):
    """Every stretch for every period, without those whose smallest period is shorter."""
    out = []
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            if words[at] == words[at + q]:
                end = at
                while end + q < len(words) and words[end] == words[end + q]:
                    end += 1
                n = end - at + q
                has = lambda p: all(words[k] == words[k + p] for k in range(at, at + n - p))  # noqa: B023,E731
                if n >= max(least, times * q) and not any(has(p) for p in range(1, q)):
                    out.append((at, n, q))
                at = end
            at += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(5)
    for _ in range(4000):
        words = [rng.choice("abcd"[: rng.choice([1, 2, 3, 4])]) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 4:
                s, p = rng.randrange(len(words)), rng.randint(1, 6)
                for i in range(s, min(len(words), s + p * rng.randint(2, 7))):
                    words[i] = words[s + (i - s) % p]
        given = list(words)
        assert periodic_runs.runs_of(given) == brute_runs(words)
        assert given == words
        assert periodic_runs.runs_of(given, 3, 1) == brute_runs(words, 3, 1)


def test_runs_compare_each_word_a_few_times():
    """Texts that would be quadratic without reuse: one word, short and long periods, a Fibonacci word, copies of a block."""

    class Word(str):
        compared = 0

        def __eq__(self, other):
            Word.compared += 1
            return str.__eq__(self, other)

        __hash__ = None

        def __getitem__(self, k):
            return Word(str.__getitem__(self, k))

    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    rng = random.Random(1)
    block = [str(rng.randrange(100)) for _ in range(500)]
    for words in (["a"] * 20_000, list("ab" * 10_000), [str(i % 1000) for i in range(20_000)], list(b), block * 40):
        Word.compared = 0
        periodic_runs.runs_of([Word(w) for w in words])
        assert Word.compared < 12 * len(words)


def planted(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_runs(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "日本", "z z"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(1000 + i, f"x{i} " * 30 + "\t\n a b a b a b a b\x0b") for i in range(60)] + [(7, None), (None, None), (None, "a " * 9), (8, ""), (9, " \n "), (10, "one"), (7, "b " * 6), (7, "b " * 6)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in map(repr, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted((expected_runs(*r) for r in rows), key=repr) and len(got) == len(rows)


def test_runs_carry_columns_of_any_name_and_take_empty_tables(spark):
    prepare(spark)
    docs = documents(spark, [(1, "w " * 8), (2, None)])
    out = {r["carried"]["doc_id"]: r for r in periodic_runs.find_runs(docs, docs.columns).collect()}
    assert out[1]["carried"]["a.b"] == "ab" and out[1]["carried"]["x`y"] == 3 and out[1]["collapsed"] == "w" and out[1]["n_words"] == 8
    assert out[2]["n_words"] == 0 and out[2]["runs"] == [] and out[2]["collapsed"] == ""
    assert periodic_runs.find_runs(documents(spark, []), ["doc_id"]).collect() == []
    long = periodic_runs.find_runs(documents(spark, [(1, "p q r " * 300_000)]), ["doc_id"]).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 900_000, 3)] and long["collapsed"] == "p q r"


# Late rows ------------------------------------------------------------------------------------------------

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day int, `a.b` string"
EPOCH = dt.datetime(1970, 1, 1)


def day_of(t):
    return -1 if t is None else (t - EPOCH).days


def brute_layout(sales, cut):
    """(day, file_no) -> the file's figures, by plain loops over all rows."""
    rows = list(sales)
    for r in sales:
        if r[0] is not None and r[4] is not None and (h := zlib.crc32(str(r[0]).encode())) % 3 == 0 and day_of(r[4]) % 4 == 0:
            late = None if r[5] is None else r[5] + dt.timedelta(days=1 + h % 97)
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + dt.timedelta(days=h % 2), late, *r[6:]))
    newest = {}
    starting = {}
    for r in rows:
        for into in (newest, starting) if r[5] is not None and r[5] < cut else (newest,):
            if r[0] not in into or (r[5] or dt.datetime.min) > (into[r[0]][5] or dt.datetime.min):
                into[r[0]] = r
    changed = {day_of(r[4]) for k, r in newest.items() if starting.get(k) is not r} | {day_of(starting[k][4]) for k, r in newest.items() if k in starting and starting[k] is not r}
    size, out = 1 + len(sales) // 1100, {}
    for d in {day_of(r[4]) for r in newest.values()}:
        own = sorted((r for r in newest.values() if day_of(r[4]) == d), key=lambda r: (r[4] is not None, r[4] or EPOCH, r[0] is not None, r[0] or 0))
        for f in range(0, len(own), size):
            part = own[f : f + size]
            text = lambda x: "" if x is None else str(x if isinstance(x, int) else (x - EPOCH) // dt.timedelta(microseconds=1))
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
            crc = sum(zlib.crc32(f"{text(r[0])}:{text(r[4])}:{text(r[5])}".encode()) for r in part)
            out[d, f // size] = (len(part), cents, crc, sha(",".join(text(r[0]) for r in part)), d in changed)
    return out


def sales_rows(n, seed=4):
    rng = random.Random(seed)
    start, rows = dt.datetime(2024, 3, 8), []
    for i in range(n):
        sold = start + dt.timedelta(seconds=rng.randrange(16 * 86_400), microseconds=rng.choice([0, 1, 999_999]))
        sold = rng.choice([sold, sold, sold, start, dt.datetime(2024, 3, 10, 2, 30), None if i % 9 == 0 else sold])
        rows.append((i, i % 7, "x", rng.choice([None, 0.005, 12.345, -3.5]), sold, (sold or start) + dt.timedelta(hours=rng.randrange(200)), 1, 5, "q"))
    return rows


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_late_layout_equals_brute_force(spark, tmp_path, zone):
    rows = sales_rows(250)
    rows += [(5000 + i, 1, None, 1.0, dt.datetime(2024, 3, 9), dt.datetime(2024, 3, 21) if i % 2 else dt.datetime(2024, 3, 9), 1, None, None) for i in range(60)]  # one instant
    rows += [(None, 1, "n", 2.0, None, dt.datetime(2024, 3, 9), 1, 1, "z"), (9000, None, None, None, None, None, None, None, None), (9001, 1, "lone", 1.0, dt.datetime(2023, 1, 1), dt.datetime(2024, 3, 1), 1, 1, "z"), (9001, 1, "lone", 1.0, dt.datetime(2023, 6, 1), dt.datetime(2024, 4, 1), 1, 1, "z")]
    rows += rows[:20]
    spark.createDataFrame(rows, SALES).write.parquet(f"{tmp_path}/sales.parquet")
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = queries.op12_late_partition_overwrite(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    found = {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got}
    assert len(found) == len(got) and found == brute_layout(rows, dt.datetime(2024, 3, 20))
    assert {r["columns"] for r in got} == {"sale_id,client_id,status,total,sold_at,arrived_at,priority,day,a.b"}
    root = Path(got[0]["path"].removeprefix("file:")).parents[2]
    assert {str(p) for p in root.rglob("*.parquet")} == {str(Path(r["path"].removeprefix("file:"))) for r in got}


def test_late_layout_leaves_other_files_alone_and_empties_days(spark):
    prepare(spark)
    day = lambda d, h=0: dt.datetime(2024, 3, d, h)
    row = lambda i, sold, arrived: (i, 1, "s", 1.0, sold, arrived, 1, 1, "b")
    frame = lambda rows: spark.createDataFrame(rows, SALES)
    layout = late_layout.Layout(new_path(spark, "layout"), frame([]).schema, "sale_id", "sold_at", "arrived_at", 2)
    late_layout.write_layout(frame([row(i, day(1, i), day(1)) for i in range(5)] + [row(10, day(2), day(2)), row(11, day(3), day(3))]), layout)
    root = Path(layout.folder.removeprefix("file:").replace("//", "/"))
    contents = lambda: {str(p.relative_to(root)): (p.read_bytes(), p.stat().st_mtime_ns) for p in root.rglob("*.parquet")}
    before = contents()
    assert sorted(p.split("/part")[0] for p in before) == ["day_=19783/file_no=0", "day_=19783/file_no=1", "day_=19783/file_no=2", "day_=19784/file_no=0", "day_=19785/file_no=0"]
    changed = late_layout.overwrite_days(frame([row(10, day(3, 5), day(9)), row(2, day(1), dt.datetime(2024, 2, 1))]), layout)
    assert sorted(r["day"] for r in changed.collect()) == [19784, 19785]  # an older version of sale 2 changes nothing
    after = contents()
    assert sorted(p.split("/part")[0] for p in after) == ["day_=19783/file_no=0", "day_=19783/file_no=1", "day_=19783/file_no=2", "day_=19785/file_no=0"]
    assert all(after[p] == before[p] for p in after if "19783" in p)
    assert late_layout.overwrite_days(frame([]), layout).collect() == [] and contents() == after


def test_late_layout_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SALES).write.parquet(f"{tmp_path}/sales.parquet")
    assert queries.op12_late_partition_overwrite(spark, str(tmp_path)).collect() == []


def test_slices_split_hot_instants_in_order(spark):
    """No slice holds much more than its share, and slices by (slice, band) are in the order of (time, key)."""
    layout = late_layout.Layout("x", spark.createDataFrame([], SALES).schema, "sale_id", "sold_at", "arrived_at", 2, 3600)
    at = [None] * 3000 + [5_000_000] * 3000 + [i * 7_000_000 for i in range(3000)]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(at)], "at long, key long")
    got = late_layout.sliced(rows, layout, rows).collect()
    sizes = {}
    for r in got:
        sizes[r["day"], r["slice"], r["band"]] = sizes.get((r["day"], r["slice"], r["band"]), 0) + 1
    assert max(sizes.values()) < 600
    low = lambda x: -(10**18) if x is None else x
    inside = sorted(got, key=lambda r: (r["day"], low(r["slice"]), r["band"], low(r["at"]), r["key"]))
    assert inside == sorted(got, key=lambda r: (r["day"], low(r["at"]), r["key"]))


# Benchmark leaks ------------------------------------------------------------------------------------------


def folded(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(text, items, window):
    words = folded(text)
    hit, found = [False] * len(words), set()
    for item_id, item in items:
        own = folded(item)
        w = min(window, len(own))
        for i in range(len(own) - w + 1) if own else ():
            for p in range(len(words) - w + 1):
                if words[p : p + w] == own[i : i + w]:
                    found.add(item_id)
                    hit[p : p + w] = [True] * w
    return words, hit, found - {None}


def leak_tables(rng, window):
    alphabet = ["a", "B", "c", "é", "日", "7x"][: rng.choice([1, 2, 3, 6])]
    text = lambda n: "".join(rng.choice(alphabet) + rng.choice([" ", "-", "\n", "\x00"]) for _ in range(n))
    return [(i, text(rng.randint(0, window + 6))) for i in range(rng.randint(0, 6))], [text(rng.choice([0, 1, window, 40])) for _ in range(rng.randint(1, 6))]


def test_shards_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        window = rng.choice([3, 4, 10])
        items, docs = leak_tables(rng, window)
        known = decontamination.Items([(str(i), t.encode()) for i, t in items], window)
        shard = decontamination.Shard(known, [known.numbered(d.encode()) for d in docs])
        hit, listed = shard.hits()
        for r, d in enumerate(docs):
            words, want, found = brute_leaks(d, items, window)
            assert hit[shard.starts[r] : shard.starts[r] + shard.sizes[r]].tolist() == want and len(words) == shard.sizes[r]
            assert {int(known.ids[i]) for i in listed[r]} == found
        order = [shard.words[p : p + known.depth].tolist() for p in shard.places]
        assert order == sorted(order)
        texts = [folded(d) for d in docs]
        at = 0
        for _, item in items:
            own = folded(item)
            for i in range(len(own)):
                same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                best = max((same(own[i:], t[p:]) for t in texts for p in range(len(t))), default=0)
                if best >= min(window, len(own)):
                    assert shard.longest[at] == best
                else:
                    assert shard.begin[at] == shard.end[at]
                at += 1


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_leaks_query_equals_brute_force(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 200)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 25])))) for i in range(20)]
    items += [(3, items[4][1]), (None, "lonely item text"), (50, None), (51, "  .. "), (52, "Zed")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(100 + i, f"intro, {rng.choice(items[:20])[1].upper()}! outro {i}") for i in range(40)] + [(7, None), (None, items[0][1]), (8, ""), (9, "zed... ZED"), (9, "lonely, ITEM text"), (9, "lonely, ITEM text")]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for i, t in docs:
        own, hit, found = brute_leaks(t, items, 10)
        want.append((i, len(own), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    got = [tuple(r) for r in queries.op13_benchmark_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    frame, bench = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns and sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(w[0]) for w in want if not w[-1])
    longest = decontamination.longest_matches(frame, bench).collect()
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(folded(t))
    for r in longest:
        own = [folded(t)[r["item_start"] : r["item_start"] + r["length"]] for i, t in items if str(i) == r["item_id"] or r["item_id"] is None]
        assert any(t[r["start"] : r["start"] + r["length"]] in own for t in by_id[r["doc_id"]])


def test_leaks_of_empty_tables_and_long_texts(spark):
    prepare(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = documents(spark, [(1, "x y " * 1_500_000 + "two three four five six seven eight nine ten eleven"), (2, "one two three")])
    got = {r["carried"]["doc_id"]: r for r in decontamination.find_leaks(docs, bench, docs.columns).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(3_000_000, 3_000_010)] and got[1]["items"] == ["1"] and got[1]["carried"]["a.b"] == "ab"
    assert got[2]["spans"] == [] and got[2]["n_words"] == 3
    assert decontamination.find_leaks(documents(spark, []), bench, ["doc_id"]).collect() == []
    none = decontamination.find_leaks(docs, bench.filter("false"), ["doc_id"]).agg(F.sum(F.size("spans"))).first()[0]
    assert none == 0 and decontamination.longest_matches(docs, bench.filter("false")).collect() == []
    assert np.array_equal(decontamination.suffix_array(np.zeros(0, dtype=np.int32), 1, 0, 0), [])
