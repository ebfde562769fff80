"""The ten operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import graph, language_id, mixing, ngram_join, quality, secrets, sp_codec, token_counts, url_filters, vector_join, warc
from deltascope.llm.common import ARROW_BYTES, join_facts, prepare, scratch, stored
from deltascope.llm.graph import connected_components
from deltascope.llm.queries import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, bin int"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def docs(spark, rows):
    """Documents with extra columns whose names the operators use, too."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1.0, 7) for i, t, lang, src in rows], DOCS)


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["the", "on", "er", "té", "日本", "x"]) for _ in range(rng.randint(1, 4)))
    out = [None, "", " \n\t ", "a", "one two three", "\u00a0x\u2003y", "\x1c\x1d z", "😀 😀 token=😀 secret='abc1234567'"]
    out += [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(30)]
    out += ["AKIA" + "A1B2C3D4E5F6G7H8" + " secret=token:abcdefgh token=abc password = \"Zz9+/_.=-\" passwd:12345 " + "0123456789abcdef" * 3, "API_KEY=abcdef apikey: 'q1w2e3r4' AKIAABC " + "f" * 24 + " " + "g" * 30]
    return out


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_base_spans(spark):
    many = " ".join(f"token=a{i:06d}" for i in range(1500))
    rows = [(i, t, None, None) for i, t in enumerate([*texts(), many])] + [(None, "secret=abcdefg", None, None)] * 2
    found = secrets.find_secrets(docs(spark, rows), ["doc_id", "text", "spans"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r["base"]] == base_spans(r["carried"]["text"])
        assert [s for s in r["spans"] if s["kind"] < 3] == r["base"]
    assert secrets.find_secrets(docs(spark, []), ["doc_id"]).collect() == []


def test_secrets_battery_finds_random_keys_and_not_words(spark):
    rng = random.Random(3)
    alphabet = secrets.SYMBOLS["base64"][0]
    keys = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(60)]
    words = ["".join(rng.choice(["tion", "er", "the", "ing", "on", "Re"]) for _ in range(15)) for _ in range(200)] + ["A" * 40, "abababababababababababababababab", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij"]
    rows = [(i, f"x {t} y", None, None) for i, t in enumerate(keys + words)]
    hit = {r["carried"]["doc_id"] for r in secrets.find_secrets(docs(spark, rows), ["doc_id"]).collect() if any(s["kind"] == 3 for s in r["spans"])}
    assert len(hit & set(range(60))) >= 50 and len(hit - set(range(60))) <= 3


def brute_tests(token):
    """Encoding, three times the least p-value of the battery, and the p-value against structured text."""
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    enc, size, excess, changes, _ = next(e for e in secrets.ENCODINGS if e[4] is None or re.search(e[4], token))
    alphabet, also = secrets.SYMBOLS[enc]
    t = token.lower() if enc == "hex" else token.rstrip("=")
    t = t.translate(str.maketrans(*also)) if also else t
    n, k = len(t), size - 1
    if n < 2:
        return enc, 0.0, 1.0
    x = sum(t.count(c) ** 2 for c in set(t)) * size / n - n
    ps = [tail(((max(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))]
    at = [alphabet.find(c) + 1 for c in t]
    bits = "".join("0" if 0 < a <= size // 2 else "1" if a else c for a, c in zip(at, t))
    ones = n - bits.count("0")
    mu = 2 * ones * (n - ones) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    ps.append(2 * tail(abs(len(re.findall("0+|1+", bits)) - mu) / math.sqrt(var)) if var > 0 else 0.0)
    mean = sum(at) / n
    spread = sum((a - mean) ** 2 for a in at)
    lag = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:]))
    ps.append(2 * tail(abs(lag / spread + 1 / n) * math.sqrt(n)) if spread > 0 else 0.0)
    structured = tail((k + (n - 1) * excess - x) / math.sqrt(2 * k + 4 * (n - 1) * excess))
    if changes is not None:
        more = len(re.findall("[0-9]+|[A-Za-z]+", t)) - 1.5 - (n - 1) * changes
        structured = min(1, 2 * min(structured, tail(more / math.sqrt((n - 1) * changes * (1 - changes)))))
    return enc, 3 * min(ps), structured


def planted(rng):
    out = []
    for enc, alphabet in (("hex", "0123456789ABCDEF"), ("base32", secrets.SYMBOLS["base32"][0]), ("base64", secrets.SYMBOLS["base64"][0])):
        out += [(enc, n, "".join(rng.choice(alphabet) for _ in range(n))) for n in (20, 24, 32, 40, 64) for _ in range(100)]
    return out


def structured_runs(rng):
    parts = ["tion", "er", "the", "ing", "on", "re", "con", "able", "ness", "ment", "in", "ly", "pre", "sub"]
    word = lambda lo, hi: "".join(rng.choices(parts, k=rng.randint(lo, hi)))
    out = [word(7, 14) for _ in range(900)] + ["-".join(word(1, 3) for _ in range(6)) for _ in range(300)] + ["".join(word(1, 3).capitalize() for _ in range(6)) for _ in range(300)]
    out += [word(7, 12).upper() for _ in range(200)] + [word(6, 9).upper() + str(rng.randint(1, 9999)) for _ in range(100)]
    out += ["".join(rng.choices("0123456789", k=rng.randint(20, 40))) for _ in range(200)] + [f"2024{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}00000000{rng.randint(0, 9999):04d}ABCD" for _ in range(100)]
    return [t for t in out if len(t) >= 20]


def test_secrets_battery_by_brute_force(spark):
    rng = random.Random(17)
    tokens = [t for _, _, t in planted(rng)[::3]] + structured_runs(rng)[::5] + ["A" * 40, "ab" * 16, "=" * 24, "A=" * 12, "-_" * 11, "0123456789" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    tested = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.tested(F.col("t")).alias("x")).collect()
    by_class = {}
    for r in tested:
        enc, battery, p = brute_tests(r["t"])
        name = f"{enc}/{int(math.log2(len(r['t'])))}"
        at = -math.log(max(p, 1e-300)) * secrets.BINS_PER_UNIT
        assert r["x"]["class"] == name and abs(r["x"]["bin"] + 0.5 - min(at, secrets.MOST_BINS - 0.5)) <= 0.51 + at / 500  # the tail is an approximation
        assert r["x"]["passed"] == (battery >= secrets.BATTERY) or abs(battery - secrets.BATTERY) < 1e-5
        by_class.setdefault(name, []).append((r["x"]["bin"], r["x"]["passed"], r["t"]))
    want = set()
    for rows in by_class.values():
        bins = sorted({b for b, _, _ in rows})
        ok = [b for b in bins if math.exp(-b / secrets.BINS_PER_UNIT) * len(rows) <= secrets.FDR * sum(x >= b for x, _, _ in rows)]
        want |= {t for b, passed, t in rows if ok and passed and b >= ok[0]}
    found = secrets.find_secrets(docs(spark, [(i, t, None, None) for i, t in enumerate(tokens)]), ["text"]).collect()
    assert {r["carried"]["text"] for r in found if any(s["kind"] == 3 for s in r["spans"])} == {t for t in want if not base_spans(t)}


def test_secrets_recall_by_encoding_and_length(spark):
    rng = random.Random(23)
    keys, other = planted(rng), structured_runs(rng)
    rows = [(i, f"x {t} y", None, None) for i, t in enumerate([t for _, _, t in keys] + other)]
    hit = {r["carried"]["doc_id"] for r in secrets.find_secrets(docs(spark, rows), ["doc_id"]).collect() if any(s["kind"] == 3 for s in r["spans"])}
    recall = {}
    for i, (enc, n, _) in enumerate(keys):
        recall[enc, n] = recall.get((enc, n), 0) + (i in hit) / 100
    print(recall, len([i for i in hit if i >= len(keys)]), len(other))
    assert all(recall[enc, n] >= 0.9 for enc in ("hex", "base32", "base64") for n in (32, 40, 64))
    assert len([i for i in hit if i >= len(keys)]) <= 0.05 * len(hit)


def test_secrets_time_is_in_proportion_to_the_text(spark):
    took = []
    for n in (2_000, 20_000):
        text = " ".join(f"token=a{i:06d} {'Qz7' * 7}{i:05d}x" for i in range(n))
        df = docs(spark, [(1, text, None, None)]).repartition(1)
        start = time.time()
        found = secrets.find_secrets(df, ["text"])
        clean = found.select(F.size("base").alias("n"), F.length(secrets.redacted(F.col("carried.text"), F.col("spans"))).alias("left")).collect()[0]
        took.append(time.time() - start)
        assert clean["n"] == n
    assert took[1] < 12 * max(took[0], 1.0)


def test_normal_tail(spark):
    got = spark.createDataFrame([(z / 4,) for z in range(-16, 17)], "z double").select("z", secrets.upper_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(r["z"] / math.sqrt(2)) / 2) < 1e-6 for r in got)


def test_redaction(spark):
    rows = [(i, t, None, None) for i, t in enumerate([*texts(), "é" * 3000 + " token=abcdefg " + "ß" * 3000])]
    found = secrets.find_secrets(docs(spark, rows), ["doc_id", "text"])
    for r in found.select("carried.text", "spans", secrets.redacted(F.col("carried.text"), F.col("spans")).alias("clean")).collect():
        want, last, merged = "", 0, []
        for s in r["spans"]:
            if merged and merged[-1][1] > s["start"]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for a, b in merged:
            want, last = want + r["text"][last:a] + "[SECRET]", b
        assert r["clean"] == (want + r["text"][last:] if merged else r["text"])


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>é</p>" * 30_000
    pages = [(3, "http://a/b", "x" * 100), (1, "http://a\r\n/c", "x" * 100), (2, None, "x" * 100), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "u", big), (8, "u", big), (None, "u", "z" * 200), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    got = {}
    for r in warc.round_trip(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert all(r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest() for r in got[i])
    kinds = {i: {(r["record_type"], r["refers_to"]) for r in rs} for i, rs in got.items()}
    assert kinds[1] == {("response", None)} and kinds[2] == kinds[3] == {("revisit", 1)} and kinds[4] == kinds[5] == {("response", None)}
    assert len(got[8]) == 2 and kinds[8] == {("response", None)} and got[8][0]["n_chunks"] == -(-len(big.encode()) // warc.CHUNK)
    chunks = warc.read_chunks(warc.write_archives(warc.decide(df)), chunk=1000).filter("page_id = 9 or page_id = 8").orderBy("record_id", "chunk_no").collect()
    whole = b"".join(bytes(c["data"]) for c in chunks if c["page_id"] == 9)
    assert whole == pages[-1][2].encode() and all(len(c["data"]) <= 1000 for c in chunks)
    running = hashlib.sha256()
    for c in (c for c in chunks if c["page_id"] == 9):
        running.update(bytes(c["data"]))
        assert c["running_sha256"] == running.hexdigest()
    ids = [c["record_id"] for c in chunks if c["chunk_no"] == 0]
    assert len(ids) == len(set(ids)) == 3
    assert warc.round_trip(df.filter("page_id = -1")).collect() == []
    before = sorted(map(str, warc.decide(df).collect()))
    monkeypatch.setattr(warc, "small_enough", lambda several: False)
    assert before == sorted(map(str, warc.decide(df).collect()))
    few = warc._maybe_copies(spark.range(3000).selectExpr("id AS page_id", "'' AS url", "'' AS html", "sha2(string(id), 256) AS digest", "id AS bytes"), spark.range(500).selectExpr("sha2(string(id), 256) AS digest"))
    assert few.filter("page_id < 500 and not maybe").count() == 0 and few.filter("page_id >= 500 and maybe").count() < 50


def test_token_attribution(spark):
    encoder = token_counts.Encoder(token_counts.load_ranks())
    rows = [(i, t, None, None) for i, t in enumerate([*texts(), "a\n\n\n  b\n", "Hi. You! x? 日本. 語", "<|endoftext|>", "a" * 50_000])]
    for sections, rule in itertools.product(("lines", "sentences"), token_counts.RULES):
        for r in token_counts.attribute_tokens(docs(spark, rows), rule=rule, sections=sections).collect():
            raw = (rows[r["doc_id"]][1] or "").encode()
            ids = encoder.encoding.encode_ordinary(raw.decode())
            starts = list(token_counts.section_starts(raw, sections))
            owner = [sum(b >= s for s in starts) - 1 for b in range(len(raw))] if len(raw) < 5000 else [0] * len(raw)
            want, at, crossing = [0] * len(starts), 0, 0
            for i in ids:
                span = range(at, at + int(encoder.lengths[i]))
                at = span.stop
                own = [owner[b] for b in span]
                crossing += own[0] != own[-1]
                heads = [owner[b] for b in span if raw[b] & 0xC0 != 0x80]
                best = max(range(own[0], own[-1] + 1), key=lambda s: (heads.count(s), -s))
                want[{"first": own[0], "last": own[-1], "most": best}[rule]] += 1
            assert (r["n_tokens"], r["section_tokens"], r["n_crossing"]) == (len(ids), want, crossing)
    assert token_counts.attribute_tokens(docs(spark, [])).collect() == []


def test_tokens_of_long_runs(monkeypatch):
    ranks = token_counts.load_ranks()
    rng = random.Random(4)
    monkeypatch.setattr(token_counts, "LONG_RUN", 2)
    encoder = token_counts.Encoder(ranks)
    for _ in range(3000):
        t = "".join(rng.choice(["  ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "a", "don't", "7", "!", "日"]) for _ in range(rng.randint(0, 12)))
        assert list(encoder.ids(t)) == encoder.encoding.encode_ordinary(t), repr(t)
    monkeypatch.undo()
    encoder = token_counts.Encoder(ranks)
    n = 5_000_000
    for run in (" " * n, "\t" * n, "\n" * n, "a" * n, "x" + " " * n + "y", " \n" * (n // 2)):
        ends = encoder.ends(run)
        assert ends[-1] == len(run) and (np.diff(ends) > 0).all()
        counts, crossing = token_counts.attribute(ends, run.encode(), token_counts.section_starts(run.encode(), "lines"))
        assert counts.sum() == len(ends)


def test_token_fields(spark):
    df = token_counts.fields_as_sections(spark.createDataFrame([(1, "héllo wor", "ld again", None), (2, None, None, None)], "k long, a string, b string, c string"), "k", ["a", "b", "c"])
    got = {r["doc_id"]: r for r in token_counts.attribute_tokens(df).collect()}
    assert got[2]["section_tokens"] == [0, 0, 0] and sum(got[1]["section_tokens"]) == got[1]["n_tokens"] and got[1]["section_tokens"][2] == 0


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("width", "threshold"), [(4, 85), (5, 80)])
def test_ngram_join(spark, width, threshold):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = list(enumerate(texts()))
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 90, 200]))] + passage * (group % 3 == 0)
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), "\t".join(own)))
    rows += [(len(rows) + k, "the the of the") for k in range(3)]
    rng.shuffle(rows)
    sets = shingle_sets(rows, width)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = ngram_join.join(docs(spark, [(i, t, None, None) for i, t in rows]), width, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = ngram_join.keep_one(docs(spark, [(i, t, None, None) for i, t in rows]), width, threshold)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_ngram_join_edges(spark):
    same = [(5, "a b c d e", None, None)] * 3 + [(None, "a b c d e", None, None), (2, "A b c d e", None, None)]
    got = ngram_join.join(docs(spark, same)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (2, 2), (5, 2), (5, 2), (5, 2)]
    assert ngram_join.join(docs(spark, [])).collect() == []
    assert ngram_join.keep_one(docs(spark, same), 4, 85).count() == 2


def test_ngram_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{rng.randrange(80)}" for _ in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(own)))
    sets = shingle_sets(rows, 4)
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = ngram_join.join(docs(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_ngram_many_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, [(2, text, None, None), (3, text + " x", None, None), (4, "other " + text, None, None)])
    many = spark.range(70_000).selectExpr("1L AS doc_id", f"'{text}' AS text", "'x' AS lang", "'x' AS source", "id AS n_chars", "'x' AS spans", "1.0D AS score", "7 AS bin")
    got = ngram_join.join(df.unionByName(many)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 70_000), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    kept = ngram_join.keep_one(df.unionByName(many), 4, 85).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 1


def test_ngram_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, None, None), (1, b, None, None), (2, b + " y", None, None), (1, c, "kept", None), (0, c + " z", None, None), (4, "", None, None), (4, "", None, None), (None, a, None, None), (None, a, None, None)]
    got = ngram_join.join(docs(spark, rows), 5, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 1), (4, 4), (4, 4)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, rows), 5, 80).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (0, c + " z"), (4, ""), (4, ""), (None, a), (None, a)], key=str)


@pytest.mark.parametrize("block", [4, 30])
def test_ngram_unrelated_texts_that_chain(spark, monkeypatch, block):
    """Texts of many sizes around a few passages: one cluster under the first order, of several under all."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(12)
    passages = [[f"p{k}_{i}" for i in range(30)] for k in range(4)]
    rows = []
    for i in range(90):
        own = passages[i % 4] + passages[(i + 1) % 4][:15] + [f"u{i % 30}_{j}" for j in range(i % 11)]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    sets = shingle_sets(rows, 4)
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = ngram_join.join(docs(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = []
    for i in range(220):
        v = centre[i % 6] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.4])
        rows.append((i, int(i % 6 < 3), [float(x) for x in v]))
    rows += [(300, 0, rows[0][2]), (301, 0, rows[0][2]), (302, 0, [2 * x for x in rows[0][2]]), (303, None, rows[0][2]), (304, 0, None), (305, 0, [0.0] * 8), (306, 0, [float("nan")] + [1.0] * 7), (307, 0, [None] + [1.0] * 7), (308, 0, [1.0, 0.0]), (309, 0, []), (310, 0, [1e300] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, class string")
    good = {i: (la, np.array(v)) for i, la, v in rows if la is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (la, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, (la, v) in good.items()}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93]
    want, degree = components([r[0] for r in rows], links), {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = vector_join.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (degree[i], want[i], want[i] == i) for i in want}
    assert vector_join.near_duplicates(df.filter("vec_id < 0")).collect() == []


def test_embeddings_of_null_and_negative_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(5, a), (None, near(a)), (9, b), (None, near(b)), (-1, c), (-1, c), (7, near(c)), (None, [1.0, 1.0, -1.0]), (None, [1.0, 1.0, -1.1])]
    df = spark.createDataFrame([(i, "x", v) for i, v in rows], "vec_id long, label string, embedding array<float>")
    got = sorted((tuple(r) for r in vector_join.near_duplicates(df).collect()), key=str)
    want = [(5, 1, 5, True), (None, 1, 5, False), (9, 1, 9, True), (None, 1, 9, False), (-1, 2, -1, True), (-1, 2, -1, True), (7, 2, -1, False), (None, 1, None, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("few", [0, 100])
def test_embedding_blocks(spark, monkeypatch, few):
    for name, value in (("BLOCK", 16), ("LEAF", 3), ("FEW", few), ("CROWD", 2), ("TILE", 1)):
        monkeypatch.setattr(vector_join, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 6))[rng.integers(0, 5, 150)] + rng.normal(size=(150, 6)) * 0.25
    df = spark.createDataFrame([(i, 1, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.93
    got = vector_join.near_duplicates(df).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(hit[i].sum()) - 1 for i in range(150)}


def brute_viterbi(codec, pieces, s):
    best = [(0.0, ())] + [(-math.inf, ())] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(end - 1, -1, -1):
            if s[start:end] in pieces and best[start][0] + pieces[s[start:end]] > best[end][0]:
                best[end] = (best[start][0] + pieces[s[start:end]], 0)
        if s[end - 1] not in codec.single and best[end - 1][0] + codec.unknown > best[end][0]:
            best[end] = (best[end - 1][0] + codec.unknown, 0)
    return best[-1][0]


def test_pieces(spark):
    pieces = sp_codec.scored_pieces()
    codec = sp_codec.Codec(pieces)
    scores = {p: s for p, s, k in pieces if k == "piece"}
    odd = ["▁", "a▁b", "  two  spaces\n\n x ", "\ttab", "日本語 ünïcödé 😀", "\u0000", "▁▁ ▁", "x" * 3000, " "]
    for t in [t for t in texts() if t] + odd:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if "▁" not in t:
            s = (" " + t).replace(" ", "▁")
            got = sum(scores.get(pieces[i][0], 0.0) for i in ids if pieces[i][2] == "piece")
            spelled = sum(c not in codec.single for c in s)
            assert math.isclose(got + spelled * codec.unknown, brute_viterbi(codec, scores, s), rel_tol=1e-12)
    rows = [(i, t, None, None) for i, t in enumerate([*texts(), *odd])]
    out = sp_codec.encode_documents(docs(spark, rows))
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) == len(codec.encode(rows[r["doc_id"]][1])) for r in out.collect())
    assert {r["doc_id"]: r["text"] for r in sp_codec.decode_documents(out).collect()} == {i: t or "" for i, t, _, _ in rows}
    assert sp_codec.encode_documents(docs(spark, [])).collect() == []


def test_pieces_are_as_few_as_those_of_the_models_own_encoder():
    import pyarrow.parquet as pq
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)
    codec = sp_codec.Codec(sp_codec.scored_pieces())
    corpus = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    readme = (Path(__file__).resolve().parents[2] / "README.md").read_text()
    for part in (corpus, [readme]):
        ours, theirs = sum(len(codec.encode(t)) for t in part), sum(len(own.encode(t)) for t in part)
        assert abs(ours - theirs) <= 0.05 * theirs
    assert not sp_codec.by_merges([("a", -1.5, "piece")]) and sp_codec.by_merges(sp_codec.load_pieces())


def test_urls(spark):
    urls = [None, "", "no host", "http://Example.COM/en/7x", "http://a.example.com/en/9?x", "http://com/en/", "http://xcom/en/", "https://b.example.net/de/8", "http://b.example.net/de/1", "ftp://x.org/es/#f", "http://x.org?y/es/", "http://É.COM:80/en/#a://b", "a://b://c/d"] + ["http://bad.org/es/1"] * 30 + ["http://bad.org/fr/1", "http://new.net/xx"]
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert got[len(urls) - 2]["verdict"] == "block" and got[len(urls) - 1]["verdict"] == "allow" and got[0]["verdict"] == "allow"
    assert url_filters.judge(df.filter("page_id < 0")).collect() == []


def test_reputation_shrinks_through_the_levels(spark):
    rows = [("a.x.com", 1)] * 40 + [("b.x.com", None), ("c.y.com", 0)] + [("d.y.com", 0)] * 40 + [("e.co.uk", None)]
    got = {r["host"]: r["alpha"] / (r["alpha"] + r["beta"]) for r in url_filters.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.com"] > got["b.x.com"] > got["e.co.uk"] > got["c.y.com"] > got["d.y.com"] - 0.05
    hosts = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "x.com": ("x.com", "com"), "com": ("com", "com"), "": ("", ""), "bad.example.com:8080": ("example.com", "com"), "me:pw@www.example.com.": ("example.com", "com"),
        "127.0.0.1": ("127.0.0.1", "ip"), "127.0.0.1:80": ("127.0.0.1", "ip"), "[::1]:8080": ("[::1]", "ip"), "co.uk": ("co.uk", "co.uk"), "a.b.kawasaki.jp": ("a.b.kawasaki.jp", "b.kawasaki.jp"),
        "x.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "c.b.ck": ("c.b.ck", "b.ck"), "1.2.3": ("2.3", "3"), "@": ("", ""), ".": (".", "."),
    }
    domain, suffix = url_filters.tree_of(F.col("h"), url_filters.load_suffixes())
    alike = spark.createDataFrame([(h,) for h in hosts if h != "."], "h string").select("h", domain.alias("d"), suffix.alias("s"))
    assert {r["h"]: (r["d"], r["s"]) for r in alike.collect()} == {h: x for h, x in hosts.items() if h != "."}


def test_reputation_by_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for d in range(30):
        p = rng.random()
        for h in range(rng.randint(1, 4)):
            rows += [(f"h{h}.d{d}.{rng.choice(['com', 'org', 'co.uk'])}", int(rng.random() < p) if rng.random() < 0.8 else None) for _ in range(rng.randint(1, 12))]
    tree = {h: (h, ".".join(h.split(".")[1:]), "co.uk" if h.endswith("co.uk") else h.rpartition(".")[2]) for h, _ in rows}
    seen = [{}, {}, {}]
    for h, bad in rows:
        for level, key in enumerate(tree[h]):
            n = seen[level].setdefault(key, [0, 0])
            n[0] += bad is not None
            n[1] += bad or 0
    n, bad = (sum(x[i] for x in seen[2].values()) for i in (0, 1))
    above = {None: ((bad + 0.5) / (n + 1), n + 1)}
    up = [{t[0]: t[1] for t in tree.values()}, {t[1]: t[2] for t in tree.values()}, {t[2]: None for t in tree.values()}]
    for level in (2, 1, 0):
        groups = [(k, *seen[level][k], above[up[level][k]][0]) for k in seen[level]]
        many = [(b / m, m, q) for _, m, b, q in groups if m >= 2]
        spread, noise, own = (sum(x) / len(many) for x in zip(*[((r - q) ** 2, q * (1 - q) / m, q * (1 - q)) for r, m, q in many]))
        k = min(max(own / max(spread - noise, 1e-9) - 1, url_filters.STRENGTH[0]), url_filters.STRENGTH[1])
        after = {}
        for key, m, b, q in groups:
            sure = min(k, above[up[level][key]][1])
            after[key] = (sure * q + b, sure * (1 - q) + m - b)
        above = {key: (x / (x + y), x + y) for key, (x, y) in after.items()}
    got = {r["host"]: r for r in url_filters.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert set(got) == set(after)
    for h, (x, y) in after.items():
        assert math.isclose(got[h]["alpha"], x, rel_tol=1e-9) and math.isclose(got[h]["beta"], y, rel_tol=1e-9)
        grid = (np.arange(200_000) + 0.5) / 200_000
        density = np.exp((x - 1) * np.log(grid) + (y - 1) * np.log1p(-grid) - max((x - 1) * math.log(max(x - 1, 1e-9) / max(x + y - 2, 1)) if x > 1 and y > 1 else 0, -500))
        assert abs(density[grid < got[h]["bound"]].sum() / density.sum() - url_filters.LOW) < 0.02


def test_beta_quantile():
    for b in (0.3, 1.0, 2.5, 40.0, 3000.0):
        assert np.allclose(url_filters.beta_quantile(0.05, np.array([1.0]), np.array([b])), 1 - 0.95 ** (1 / b), rtol=1e-9)
        assert np.allclose(url_filters.beta_quantile(0.05, np.array([b]), np.array([1.0])), 0.05 ** (1 / b), rtol=1e-9)
    for a, b in ((2, 3), (7, 1), (15, 40), (200, 100)):
        x = 0.37
        want = sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
        assert math.isclose(float(url_filters.beta_cdf(np.array([x]), np.array([a]), np.array([b]))[0]), want, rel_tol=1e-10)


def test_language(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "tion", "her"], "de": ["sch", "ung", "ein", "ä"], "日": ["日本", "語文", "字"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(60)), lang, None))
    rows += [(1000, None, "en", None), (1001, "12 34 !!", "en", None), (1002, "", None, None), (1003, "Ω" * 5000, None, None), (None, rows[0][1], rows[0][2], None)]
    df = docs(spark, rows)
    model = language_id.fit(df, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for i, _, lang, _ in rows[:240]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] in syllables and got[1003]["score"] == 0 and not got[None]["held_out"]
    assert language_id.identify(docs(spark, []), language_id.fit(docs(spark, []), F.lit(True))).collect() == []
    kept = {r["doc_id"] for r in language_id.keep_identified(df, model, 0.2).collect()}
    assert kept == {*range(240), None}


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(["".join(chr(0x4E00 + 4 * i + k) for k in range(4))] * 9), f"l{i:03d}") for i in range(530)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df, F.lit(True))
    assert model.languages == [lang for _, _, lang in rows]
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()} == {i: lang for i, _, lang in rows}


def test_language_of_one_document_each(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", None), (2, "der schnelle braune Fuchs springt über den Hund", "de", None), (3, "le renard brun saute par dessus le chien", "fr", None), (4, "the cat and the fox", "en", None), (5, "ünïq", "x", None)]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, language_id.fit(df, F.lit(True))).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def grams_of(text):
    s = " "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        s += "" if c == " " == s[-1] else c
    return [s[i : i + n] for n in language_id.LENGTHS for i in range(len(s) - n + 1)]


def gram_hash(g):
    whole = (1 << 64) - 1
    h = sum(ord(c) * int(f) for c, f in zip(g, language_id._FACTORS)) + language_id._BY_LENGTH * len(g) & whole
    h ^= h >> 29
    h = h * int(language_id._MIX) & whole
    return h ^ h >> 32


def gram_slots(g, bits):
    return {gram_hash(g) >> (64 - bits * (k + 1)) & (1 << bits) - 1 for k in range(language_id.HASHES)}


@pytest.mark.parametrize("window", [3, 7, 1 << 18])
def test_language_ngrams_over_windows(monkeypatch, window):
    monkeypatch.setattr(language_id, "WINDOW", window)
    for t in [t for t in texts() if t is not None] + ["12ab  cd-3ef", "é" * 50, " x ", "a", "12"]:
        got = sorted(int(h) for part in language_id.ngram_hashes(t) for h in part)
        assert got == sorted(gram_hash(g) for g in grams_of(t))


@pytest.mark.parametrize("languages, table_bytes", [(70, 1 << 20), (5, 1 << 20), (70, 1 << 14)])
def test_language_filters_and_predictions_by_brute_force(spark, monkeypatch, languages, table_bytes):
    """Filters hold every n-gram, counts are those of the slots, and the largest corrected share decides."""
    monkeypatch.setattr(language_id, "TABLE_BYTES", table_bytes)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "and", "der", "und", "les", "ñu", "日本"], k=rng.randint(1, 30))), f"l{i % languages:02d}", None) for i in range(140)]
    df = docs(spark, rows)
    model = language_id.fit(df, F.lit(True))
    assert len(model.words) == -(-languages // 64) and model.languages == sorted({r[2] for r in rows})
    assert sum(t.nbytes for t in model.words) <= table_bytes
    slots = {lang: {x for _, t, la, _ in rows if la == lang for g in grams_of(t) for x in gram_slots(g, model.bits)} for lang in model.languages}
    fp = {lang: (len(slots[lang]) / 2**model.bits) ** language_id.HASHES for lang in model.languages}
    assert list(model.false_positive) == [fp[lang] for lang in model.languages]
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for i, t, _, _ in rows[::7]:
        grams = grams_of(t)
        count = {lang: sum(gram_slots(g, model.bits) <= slots[lang] for g in grams) for lang in model.languages}
        found, total = model.counts(t)
        assert total == len(grams) and list(found) == [count[lang] for lang in model.languages]
        share = {lang: (count[lang] / total - fp[lang]) / (1 - min(fp[lang], 0.999)) for lang in model.languages}
        best = max(model.languages, key=lambda lang: share[lang])
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], min(1, share[best]))


def test_languages_are_learned_alike_at_every_size(spark):
    """An n-gram that one document has is known, however many documents there are; thousands of languages stay small."""
    for n in (400, 500, 501, 600):
        rows = [(i, f"the quick brown fox number {'xyz'[i % 3]}", "en", None) for i in range(n)] + [(n + i, "der schnelle braune fuchs", "de", None) for i in range(n)] + [(5000, "zzqqyy", "en", None)]
        model = language_id.fit(docs(spark, rows), F.lit(True))
        assert model.predict("zzqqyy")[0] == "en" and model.predict("zzqqyy")[1] > 0.99
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id, ' v', id % 97) AS text", "concat('l', id) AS lang")
    model = language_id.fit(many, F.lit(True))
    assert len(model.languages) == 3000 and sum(t.nbytes for t in model.words) <= language_id.TABLE_BYTES


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `x``y` int, column_5 string"


def odd_documents(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "token=abcdef123456"]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=80)) if i % 3 else f"same words here {i // 30} " * 30, "en", rng.choice(["s", "t", None]), 7, f"q{i}", i, "T") for i in range(120)], ODD)


def test_stages_carry_columns_of_any_name(spark):
    prepare(spark)
    df = odd_documents(spark)
    now = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "")
        assert out.columns == df.columns, name
        rows = out.collect()
        assert rows and all(r[5] == f"q{r[6]}" and r[0] == r[6] and r[7] == "T" for r in rows), name
        now = out
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == now.count()


def test_case_is_counted_by_character(spark):
    """Query and SQL agree on letters whose case mapping is odd."""
    words = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60))
    rows = [(k, f"{words} {x}", None, None) for k, x in enumerate(["", "ß" * 400, "ﬁ" * 400, "ŉ" * 400, "ª" * 400, "ǅ" * 400, "ẞ" * 40, "ᾀ" * 400, "ᾈ" * 400, "İ" * 400, "ı" * 400, "ß", "ª0 ª1 " * 300, "ª0 ª1 " * 300 + "ß"])]
    got = {r["doc_id"]: r for r in quality.ledger(docs(spark, rows)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    cur = con.execute(ORACLE["op10_quality_rules"])
    at = [d[0] for d in cur.description].index("fail_bits")
    assert {r[0]: r[at] for r in cur.fetchall()} == {k: r["fail_bits"] for k, r in got.items()}
    assert got[12]["fail_bits"] & 32 and got[13]["fail_bits"] & 32  # one ß changes nothing


def test_mixing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), None, rng.choice(["a", "b", "c", "ä", "Z", None])) for i in range(900)]
    rows += [(2000, None, None, "empty"), (2001, "", None, "empty"), (2002, "x " * 5000, None, "b"), (3, rows[3][1], None, rows[3][3])]
    df = docs(spark, rows)
    got = mixing.pareto_mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(df.repartition(5)).collect()))
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if level * weight[s] > 3 * sizes[s]} | full
        if new == full:
            break
        full = new
    target = {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s], rel_tol=1e-9) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(5, 0.01 * target[s])
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got)
    monkeypatch.setattr(mixing, "BINS", 4)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)
    assert sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(df).collect()))  # the way to the cut changes nothing
    assert mixing.pareto_mix(docs(spark, [])).collect() == []


def test_mixing_takes_with_the_probabilities_it_computes(spark):
    """Sources with the same sizes are draws of the same design; their shares are 15/8, 6/8 and 3/8."""
    sizes = [3, 10, 25, 40, 60, 100, 150, 220, 300, 400, 30, 80, 90, 170, 260] * 6
    rows = [(100 * s + k, " ".join(["w"] * n), None, f"s{s:03d}") for s in range(600) for k, n in enumerate(sizes)]
    got = mixing.pareto_mix(docs(spark, rows)).collect()
    t = np.array([n / (n + mixing.TILT_WORDS) for n in sizes])
    t -= (t * sizes).sum() / sum(sizes)
    for first, rest in ((0, 7 / 8), (1, 6 / 8), (2, 3 / 8)):
        want = rest * (1 + (1 - rest) * t)
        assert math.isclose((want * sizes).sum(), rest * sum(sizes)) and want.min() > 0 and want.max() < 1
        taken = np.zeros(len(sizes))
        for r in got:
            if r["doc_id"] // 100 % 3 == first:
                taken[r["doc_id"] % 100] += r["copies"] - (first == 0)
        assert abs(taken / 200 - want).max() < 0.15 and abs(taken / 200 - want).mean() < 0.045  # the last gap prefers the shortest a little


def test_quality_measures(spark):
    rng = random.Random(6)
    rows = [(i, t, None, None) for i, t in enumerate(texts())]
    rows += [(100 + k, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(30)) + "#*!!", None, None) for k in range(10)]
    got = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(docs(spark, rows)), "v2").collect()}
    for i, t, _, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
        lines = t.split("\n")
        dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:k] for k, x in enumerate(lines))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.ledger(docs(spark, [])).collect() == []


#: A text that fails one rule (and what its name says) and no other of the list.
FAILING = {
    "short": "one two three four five",
    "repeats": " ".join(["red", "blue", "green"] * 20),
    "symbols": " ".join(f"w{i} #" if i % 3 == 0 else f"w{i}" for i in range(60)),
    "dup_lines": "\n".join(["same line"] * 14 + [f"w{i} y{i}" for i in range(4)] + [" ".join(f"z{i}" for i in range(60))]),
    "word_length": " ".join(f"{'x' * 20}{i}" for i in range(60)),
    "shouting": " ".join(f"LOUD{i}" for i in range(60)),
    "bangs": " ".join(f"w{i}!" for i in range(60)),
}


def test_quality_rules_one_by_one(spark):
    clean = " ".join(f"word{i} é" for i in range(40))
    rows = [(k, FAILING[r], None, None) for k, r in enumerate(quality.RULES)] + [(100, clean, None, None)]
    book = quality.ledger(docs(spark, rows))
    failed = {r["doc_id"]: {x for k, x in enumerate(quality.RULES) if r["fail_bits"] >> k & 1} for r in book.collect()}
    assert failed == {k: {r} for k, r in enumerate(quality.RULES)} | {100: set()}
    for policy, rules in quality.POLICIES.items():
        kept = {r["doc_id"] for r in quality.apply_policy(book, policy).filter("kept").collect()}
        assert kept == {k for k, x in failed.items() if not x & (set(rules) | {"short", "repeats"})}
        gone = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality.ablations(book, policy).collect()}
        assert gone == {r: (1, 1) for r in rules}


def test_quality_ablations(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 4), (6, 64)], "doc_id long, fail_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality.ablations(book, "v1").collect()}
    assert got == {"short": (2, 1), "repeats": (1, 0), "symbols": (2, 2), "word_length": (0, 0)}
    assert {r["doc_id"] for r in quality.apply_policy(book, "v1").filter("kept").collect()} == {1, 6}


@pytest.mark.parametrize("one_task", [0, 120, 250_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1200)] + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)


def test_batch_bound_of_the_session(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, left in (("64m", str(ARROW_BYTES)), ("67108864", str(ARROW_BYTES)), ("10m", "10m"), (str(ARROW_BYTES), str(ARROW_BYTES))):
        spark.conf.set(key, given)
        prepare(spark)
        assert spark.conf.get(key) in (left, "10485760", "10485760b")
    spark.conf.set(key, before)


def test_scratch_deletes_what_was_stored_inside(spark):
    kept = stored(spark.range(3), "kept")
    with scratch(spark):
        gone = stored(kept.filter("id > 0"), "gone")
        files = gone.inputFiles()
        assert gone.count() == 2 and all(Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in files)
    assert kept.count() == 3 and not any(Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in files)


def test_join_facts_with_hot_keys(spark, monkeypatch):
    import deltascope.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}") for i in range(60)], "i int, k string")
    facts = stored(rows.filter("k is not null and i <> 2").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("v")), "test-facts")
    got = {r["i"]: r["v"] for r in join_facts(rows, facts, ["k"], "n", ["i"]).collect()}
    assert got == {i: 59 if i % 2 else None if i % 10 == 0 or i == 2 else i for i in range(60)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    parts = {"en": ["the", "ing", "tion", "her"], "de": ["sch", "ung", "ein", "lich"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(80)), lang, f"s{i % 4}"))
    rows += [(500, rows[0][1], "en", "s0"), (501, rows[1][1] + " more", "en", "s1"), (502, "12 34", "en", "s1"), (503, None, None, None), (504, rows[2][1][::-1] + " token=abc123def456 ", "en", "s2")]
    base = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "encoding" or now.columns == base.columns
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].select("doc_id").collect())
    assert not {502, 503} & set(ids("language")) and set(range(120)) <= set(ids("language"))
    assert not {500, 501} & set(ids("near_duplicates")) and len(ids("near_duplicates")) >= 120
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert "abc123def456" not in str([r["text"] for r in clean.values()]) and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert ids("encoding") == ids("mixing") and all(r["round_trip"] for r in seen["encoding"].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids("encoding"))


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, clean string, hit boolean, carried string, spans long, k1 string, drawn double, rank long, size string, node long, label string, _c string, copies double"
    extra = ("c", True, "x", 1, "k", 0.5, 7, "s", 3, "l", "_", 2.0)
    long_text = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, long_text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some plain words here", "en", None, 1), (5, "my secret=abcdefgh here", "en", "b", 23), (5, "my secret=abcdefgh here", "en", "b", 23), (5, "another text under this id", "en", "b", 9)]
    df = spark.createDataFrame([(*r, *extra) for r in rows], names)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, df.filter("doc_id = -1"), "")
        assert empty.count() == 0
        out = stage(spark, df, "")
        assert name == "encoding" or (out.columns == df.columns == empty.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema])
        got = out.collect()
        assert name == "encoding" or all(tuple(r)[5:] == extra for r in got)
        texts = sorted(str(r["text"])[:30] for r in got) if name != "encoding" else []
        if name == "language":
            assert len(got) == 5
        elif name == "near_duplicates":
            assert len(got) == 6 and texts.count("my secret=abcdefgh here") == 1
        elif name == "secrets":
            assert texts.count("my [SECRET] here") == 2 and {r["n_chars"] for r in got if r["doc_id"] == 5} == {16, 9} and {r["n_chars"] for r in got if r["doc_id"] == 1} == {5}
        elif name == "encoding":
            assert len(got) == 7 and all(r["round_trip"] for r in got)
