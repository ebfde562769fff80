"""The operators as queries over the synthetic tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import decontamination, language_id, late_layout, mixing, ngram_join, periodic_runs, quality, secrets, sp_codec, token_counts, url_filters, vector_join, warc
from deltascope.llm.common import new_path, prepare, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("carried.doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), sections="sentences")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), width=4, threshold=85)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sp_codec.encode_documents(_table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_pieces", "n_bytes", "ids_sha256", "round_trip")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    return language_id.identify(docs, language_id.fit(docs, learn))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), "v2")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule fails, and how many it fails alone, from the ledger's bits."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")), "v2")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict of those that a rule fits."""
    judged = url_filters.judge(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def _planted() -> Column:
    """The text; in a tenth of the documents, the words from a place on repeat those that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents"), ["doc_id"], _planted())
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), F.negate(r["start"]).alias("s"), F.negate(r["period"]).alias("p"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("carried.doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("r"), F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    start, length, period = F.negate("r.s"), F.col("r.length"), F.negate("r.p")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Rows that arrive from then on (microseconds since 1970: 2024-03-20) are late.
LATE_FROM = 1_710_892_800_000_000


def op12_late_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "sales")
    utc = lambda c: late_layout.micros(F.col(c), dict(sales.dtypes)[c] == "timestamp_ntz")
    h = F.crc32(F.col("sale_id").cast("string"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    copied = sales.filter((h % 3 == 0) & (F.floor(utc("sold_at") / late_layout.DAY) % 4 == 0))
    copies = copied.withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    rows, early = sales.unionByName(copies), utc("arrived_at") < LATE_FROM
    layout = late_layout.Layout(new_path(spark, "sales-by-day"), sales.schema, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // 1100)
    with scratch(spark):
        late_layout.write_layout(rows.filter(early), layout)
        changed = late_layout.overwrite_days(rows.filter(~F.coalesce(early, F.lit(False))), layout)
        again = [r["day"] for r in changed.collect()]  # a row a day
    day, file_no = layout.parts
    final = layout.stored_rows(spark)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)).cast("long")
    crc = F.crc32(F.concat_ws(":", text(F.col("sale_id")), text(utc("sold_at")), text(utc("arrived_at"))))
    files = final.select(F.col("_metadata.file_path").alias("path"), F.col(day).alias("day"), F.col(file_no).alias("file_no"), F.col("_metadata.row_index").alias("place"), text(F.col("sale_id")).alias("id"), cents.alias("cents"), crc.alias("crc"))
    names = ",".join(c for c in final.columns if c not in layout.parts)
    return late_layout.described(files).withColumns({"columns": F.lit(names), "rewritten": F.col("day").isin(again)})


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("carried.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scans, op2_warc, op3_token_counts, op4_ngram_jaccard_join, op5_embedding_near_dedup, op6_sentencepiece, op7_url_filters, op8_language_id, op9_source_mixing, op10_quality_rules, op11_periodic_runs, op12_late_partition_overwrite, op13_benchmark_decontamination, quality_ablations, url_rules)
}

ORACLE: dict[str, str] = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS bytes, sha256(body) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d WHERE bytes >= {warc.LEAST_REVISIT} GROUP BY digest)
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to,
               CAST(CASE WHEN first IS NOT NULL AND first <> page_id THEN 1 ELSE greatest(1, (bytes + {warc.CHUNK - 1}) // {warc.CHUNK}) END AS BIGINT) AS n_chunks
        FROM d LEFT JOIN f ON d.digest = f.digest AND bytes >= {warc.LEAST_REVISIT}
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * x >= 85 * (p.n + q.n - x)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
    """,
    "op5_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(x, x) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        d AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
        FROM c LEFT JOIN d ON d.vec_id = c.vec_id
    """,
    "op9_source_mixing": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   (CAST('0x' || substr(md5('{mixing.SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '/' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * sum(size)::DOUBLE AS cap, sum(size * (size / (size + {mixing.TILT_WORDS}::DOUBLE))) AS tilted,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM w GROUP BY source
        ), o AS (SELECT *, row_number() OVER q AS k, sum(cap) OVER q - cap AS held, sum(weight) OVER () - (sum(weight) OVER q - weight) AS open, sum(source_size) OVER () AS total FROM s WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), l AS (SELECT arg_min((total - held) / open, k) AS level FROM o WHERE (total - held) / open * weight < cap),
        t AS (SELECT source, source_size, least(coalesce(level, 0) * weight, cap) AS target, tilted / nullif(source_size, 0) AS tilt FROM s, l),
        f AS (SELECT *, least(floor(target / nullif(source_size, 0) + 1e-12), 3) AS whole, greatest(target / nullif(source_size, 0) - whole, 0) AS rest FROM t),
        p AS (SELECT doc_id, w.source, size, u, source_size, target, coalesce(whole, 0) AS whole, rest, rest * (1 + (1 - rest) * (size / (size + {mixing.TILT_WORDS}::DOUBLE) - tilt)) AS p FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source),
        r AS (SELECT *, CASE WHEN rest > 1e-12 AND size > 0 THEN u / (u + (1 - u) * (p / (1 - p))) END AS rank FROM p),
        a AS (
            SELECT source, -1::DOUBLE AS low, NULL::DOUBLE AS high, rest * source_size AS gap, NULL::DOUBLE AS most, target * {mixing.TOLERANCE} AS leave FROM f WHERE rest > 1e-12
            UNION ALL
            SELECT source, max(rank) FILTER (WHERE upto <= gap), any_value(low), any_value(gap) - max(upto) FILTER (WHERE upto <= gap), any_value(gap), any_value(leave)
            FROM (SELECT a.source, a.low, a.gap, a.leave, rank, sum(size) OVER (PARTITION BY a.source ORDER BY rank) AS upto
                  FROM a JOIN r ON r.source IS NOT DISTINCT FROM a.source AND rank > low AND size <= gap WHERE a.high IS NULL OR gap > leave) GROUP BY source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies
        FROM (SELECT r.*, whole + CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.source IS NOT DISTINCT FROM r.source AND high IS NOT NULL AND rank > high AND rank <= low AND size <= most) THEN 1 ELSE 0 END AS copies FROM r)
    """,
    "op10_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, unnest(list_transform(range(1, len(l) - 1), lambda k: l[k:k + 2])) AS g FROM w WHERE len(l) > 3),
        h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM h) GROUP BY doc_id),
        n AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM w),
        d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM n GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, len(l) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                   coalesce(dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(t) - len(replace(t, '!', '')) AS n_bangs,
                   len(list_filter(string_split(t, ''), lambda c: lower(c) <> c)) AS n_upper, len(list_filter(string_split(t, ''), lambda c: upper(c) <> c)) AS n_lower
            FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
        ), f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(n_words > 0 AND 5 * n_symbols >= n_words AS BIGINT)
                   + 8 * CAST(n_lines > 0 AND 10 * n_dup_lines > 6 * n_lines AS BIGINT) + 16 * CAST(n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 15 * n_words AS BIGINT)
                   + 32 * CAST(10 * n_upper > 7 * (n_upper + n_lower) AS BIGINT) + 64 * CAST(n_words > 0 AND 3 * n_bangs >= n_words AS BIGINT) AS fail_bits FROM m)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
    """,
    "op13_benchmark_decontamination": rf"""
        WITH w AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
        l AS (SELECT kind, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM w),
        i AS (SELECT id AS item, least(len(l), {decontamination.WINDOW}) AS n, unnest(list_transform(range(1, len(l) - least(len(l), {decontamination.WINDOW}) + 2), lambda k: array_to_string(l[k:k + least(len(l), {decontamination.WINDOW}) - 1], ' '))) AS g FROM l WHERE kind = 'b' AND len(l) > 0),
        s AS (SELECT DISTINCT n FROM i),
        p AS (SELECT doc_id, n, unnest(range(1, len(l) - n + 2)) AS k, unnest(list_transform(range(1, len(l) - n + 2), lambda k: array_to_string(l[k:k + n - 1], ' '))) AS g FROM l, s WHERE kind = 'd' AND len(l) >= n),
        o AS (SELECT DISTINCT doc_id, n, k, item FROM p JOIN i USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM o) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o WHERE item IS NOT NULL) GROUP BY doc_id)
        SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM l LEFT JOIN h ON h.doc_id = l.doc_id LEFT JOIN t ON t.doc_id = l.doc_id WHERE kind = 'd'
    """,
}

_FITS = [(h + p, v, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for h, p, v in sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))]
ORACLE["url_rules"] = rf"""
    WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for rule, _, fits in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{v}'" for _, v, fits in _FITS)} END AS ruled FROM p
"""
ORACLE["quality_ablations"] = f"""
    SELECT rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE fail_bits = bit) AS BIGINT) AS n_alone
    FROM ({ORACLE["op10_quality_rules"]}), (VALUES {", ".join(f"('{r}', {1 << i})" for i, r in enumerate(quality.RULES))}) r(rule, bit) GROUP BY rule
"""
