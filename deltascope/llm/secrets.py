"""Secret scans with a randomness test battery, in Spark expressions only.

Three base kinds come from patterns (assign, access, hex). A fourth kind, ``random``,
comes from the battery: each run of CANDIDATE characters that no base span overlaps gets
an encoding (hex, base32, base64) and three tests against uniform random symbols of it:

- chi-squared uniformity of the alphabet (Wilson-Hilferty),
- the number of runs below and above the middle of the alphabet (Wald-Wolfowitz),
- lag-1 serial correlation of the symbols' places in the alphabet.

A run passes the battery when the smallest of the three p-values, times three, is at
least BATTERY. Passing says little about a short run, so a discovery must also reject
the opposite hypothesis, structured text, in which symbols repeat as in ordinary language and
letters and digits stand in groups. Two p-values speak against it: the lower tail of the
chi-squared statistic under that text's expected excess, and (hex, base32) the upper tail of
the number of runs of letters and of digits under its expected rate of changes. Twice the smaller
one is the run's p-value, whatever the two have in common; both get smaller with length. These
p-values are held to a false-discovery rate of FDR by Benjamini-Hochberg within each encoding and
length class (powers of two), over all candidates of the corpus; p-values are binned
upwards, which is conservative.

Positions come from splitting a text at a pattern: the lengths of the parts between and
of the matches add up to offsets in code points. They are summed in blocks, so a text
with very many matches does not take quadratic time.

Edge cases: null counts as empty; empty texts have no spans; a repeated row gets a row
of its own and counts as often in the rate; no rows give no rows; other columns are
carried only when asked for, inside a struct, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.llm.common import quoted, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")
BATTERY, FDR = 0.01, 0.05
BLOCK = 512
BINS_PER_UNIT, MOST_BINS = 4.0, 400
#: Encodings: alphabet size, structured text's excess of size * sum(p^2) over 1 and rate of changes between letters and digits, pattern.
#: sum(p^2), the chance that two symbols are equal, is 0.0655 for letters of English (other European languages
#: have more) and 0.1 for decimal digits, which is what structured runs of the hex alphabet are made of: 64 * 0.0655
#: - 1, 32 * 0.0655 - 1, 16 * 0.1 - 1. Rates: a change for every 7 symbols in hex, as dates and counters behind
#: words make them, for every 10 in base32 (capital words with a number). No rate for base64, where camel case changes as often as keys do.
ENCODINGS = (
    ("hex", 16, 0.6, 1 / 7, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    ("base32", 32, 1.1, 1 / 10, r"^[A-Z2-7]+$"),
    ("base64", 64, 3.2, None, None),
)
#: The alphabets' symbols in order; base64 and its URL form share places 62 and 63.
SYMBOLS = {
    "hex": ("0123456789abcdef", None),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", None),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ("-_", "+/")),
}
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column, op, zero: int) -> Column:
    """Inclusive running op of an array of longs, in blocks, so that the time is in proportion to its length."""
    none, first = F.array().cast("array<bigint>"), F.lit(zero).cast("bigint")

    def run(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), none.alias("out"))
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(op(s["at"], x))).alias("out"))
        return F.aggregate(block, empty, step, lambda s: s["out"])

    def blocked(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        blocks = F.transform(places, lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))

        def joined(b: Column) -> Column:
            totals = F.transform(b, lambda x: F.aggregate(x, first, op))
            return let(run(totals, first), lambda t: F.flatten(F.zip_with(b, F.concat(F.array(first), F.slice(t, F.lit(1), F.size(t) - 1)), run)))

        return let(blocks, joined)

    return let(steps, lambda a: F.when(F.size(a) > 0, blocked(a)).otherwise(none))


def running_sum(steps: Column) -> Column:
    return running(steps, lambda a, b: a + b, 0)


def running_max(steps: Column) -> Column:
    """Of numbers from 0 on."""
    return running(steps, lambda a, b: F.greatest(a, b), 0)


def _offsets(gaps: Column, hits: Column) -> Column:
    """Start of each match, from the parts between matches and the matches."""
    steps = F.transform(hits, lambda h, i: (F.length(gaps[i]) + F.when(i > 0, F.length(hits[i - 1])).otherwise(0)).cast("bigint"))
    return running_sum(steps)


def _find(df: DataFrame, text: str, name: str, pattern: str, group: int | None = None) -> DataFrame:
    """Add {name}_hits, {name}_at and, with a group, {name}_group."""
    has = F.col(text).rlike(pattern)
    empty = F.array().cast("array<string>")
    lit = F.lit(pattern)
    cols = {f"{name}_hits": F.when(has, F.regexp_extract_all(text, lit, F.lit(0))).otherwise(empty), f"{name}_gaps": F.when(has, F.split(text, pattern, -1)).otherwise(empty)}
    if group:
        cols[f"{name}_group"] = F.when(has, F.regexp_extract_all(text, lit, F.lit(group))).otherwise(empty)
    df = df.withColumns(cols)
    return df.withColumn(f"{name}_at", _offsets(F.col(f"{name}_gaps"), F.col(f"{name}_hits"))).drop(f"{name}_gaps")


def _spans(name: str, kind: int) -> Column:
    return F.zip_with(f"{name}_at", f"{name}_hits", lambda a, h: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(h)).alias("end"))).cast(_SPAN)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (Zelen and Severo's approximation)."""

    def of(x: Column) -> Column:
        a = F.abs(x)
        t = 1.0 / (1.0 + 0.2316419 * a)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        tail = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi) * poly
        return F.when(x >= 0, tail).otherwise(1.0 - tail)

    return let(z, of)


def _tests(token: Column, enc: str, size: int, excess: float, changes: float | None) -> Column:
    """struct(battery: three times the smallest p-value, structured: the p-value against structured text)."""
    alphabet, also = SYMBOLS[enc]
    plain = F.rtrim(token, F.lit("=")) if enc != "hex" else F.lower(token)
    plain = F.translate(plain, *also) if also else plain

    def with_token(t: Column) -> Column:
        n = F.length(t).cast("double")
        k = float(size - 1)
        squares = F.aggregate(F.array_distinct(F.split(t, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow((F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"), F.lit(2.0))))
        chi = squares * float(size) / n - n
        half = F.translate(t, alphabet, "0" * (size // 2) + "1" * (size - size // 2))

        def runs_p(b: Column) -> Column:
            ones = F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("double")
            zeros = n - ones
            mu = 2.0 * ones * zeros / n + 1.0
            var = (mu - 1.0) * (mu - 2.0) / (n - 1.0)
            runs = F.regexp_count(b, F.lit("0+|1+")).cast("double")
            return F.when(var > 0, 2.0 * upper_tail(F.abs(runs - mu) / F.sqrt(var))).otherwise(0.0)

        def serial_p(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n

            def of(m: Column) -> Column:
                var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
                less = (F.size(v) - 1).cast("int")
                cov = F.aggregate(F.zip_with(F.slice(v, F.lit(1), less), F.slice(v, F.lit(2), less), lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda s, x: s + x)
                return F.when(var > 0, 2.0 * upper_tail(F.abs(cov / var + 1.0 / n) * F.sqrt(n))).otherwise(0.0)

            return let(mean, of)

        def battery(x: Column) -> Column:
            scaled = (F.pow(F.greatest(x, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
            values = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
            least = F.least(upper_tail(scaled), let(half, runs_p), let(values, serial_p))
            mean, sd = k + (n - 1.0) * excess, F.sqrt(2 * k + 4 * (n - 1.0) * excess)
            structured = upper_tail((mean - x) / sd)
            if changes is not None:
                found = F.regexp_count(t, F.lit("[0-9]+|[A-Za-z]+")) - 1
                more = (found - 0.5 - (n - 1.0) * changes) / F.sqrt((n - 1.0) * changes * (1 - changes))
                structured = F.least(F.lit(1.0), 2.0 * F.least(structured, upper_tail(more)))
            return F.struct((least * 3.0).alias("battery"), structured.alias("structured"))

        return F.when(n >= 2, let(chi, battery)).otherwise(F.struct(F.lit(0.0).alias("battery"), F.lit(1.0).alias("structured")))

    return let(plain, with_token)


def tested(token: Column) -> Column:
    """struct(class: encoding and length class, bin of the p-value, passed) of a candidate."""
    tests, enc = None, None
    for name, size, excess, changes, pattern in reversed(ENCODINGS):
        got, label = _tests(token, name, size, excess, changes), F.lit(name)
        tests = got if tests is None else F.when(token.rlike(pattern), got).otherwise(tests)
        enc = label if enc is None else F.when(token.rlike(pattern), label).otherwise(enc)
    length_class = F.floor(F.log2(F.length(token))).cast("string")

    def of(t: Column) -> Column:
        bin_ = F.least(F.floor(-F.log(F.greatest(t["structured"], F.lit(1e-300))) * BINS_PER_UNIT), F.lit(MOST_BINS - 1)).cast("int")
        return F.struct(F.concat(enc, F.lit("/"), length_class).alias("class"), bin_.alias("bin"), (t["battery"] >= BATTERY).alias("passed"))

    return let(tests, of)


def discoveries(scanned: DataFrame) -> dict[str, int]:
    """The bin from which on each class's p-values are discoveries; classes without any are absent."""
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    reached = F.sum("n").over(by_class.orderBy(F.desc("bin")))
    ok = F.exp(-F.col("bin") / BINS_PER_UNIT) <= FDR * F.col("reached") / F.col("all")
    found = counts.withColumns({"reached": reached, "all": F.sum("n").over(by_class)}).filter(ok).groupBy("class").agg(F.min("bin"))
    return {r[0]: r[1] for r in found.collect()}  # at most 3 encodings times the length classes


def _free(base: Column, others: Column) -> Column:
    """Those of others that no base span overlaps, by one sweep over both in order of their starts, and one back."""
    far = 1 << 62
    marks = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("other"), b["end"].alias("end"), F.lit("").alias("token"))),
        F.transform(others, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("other"), (c["start"] + F.length(c["token"])).alias("end"), c["token"].alias("token"))),
    )

    def swept(m: Column) -> Column:
        ended = running_max(F.transform(m, lambda x: F.when(x["other"] == 0, x["end"]).otherwise(0).cast("bigint")))
        begin = F.reverse(running_max(F.reverse(F.transform(m, lambda x: F.when(x["other"] == 0, F.lit(far) - x["start"]).otherwise(0).cast("bigint")))))
        return let(F.struct(ended.alias("ended"), begin.alias("begin")), lambda e: F.filter(m, lambda x, i: (x["other"] == 1) & (e["ended"][i] <= x["start"]) & (F.lit(far) - e["begin"][i] >= x["end"])))

    return F.transform(let(F.array_sort(marks), swept), lambda x: F.struct(x["start"].alias("start"), x["token"].alias("token")))


def find_secrets(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carried (struct of the carry columns), base and spans, arrays of struct(start, kind, end) by start, then kind.

    start and end are code points, end exclusive; kind is a place in KINDS; base has the kinds of patterns alone.
    """
    df = docs.select(F.struct(*quoted(carry)).alias("carried"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("scanned"))
    df = _find(df, "scanned", "assign", ASSIGN, 2)
    for name, pattern in (("access", ACCESS), ("hex", HEX), ("other", CANDIDATE)):
        df = _find(df, "scanned", name, pattern)
    assign = F.filter(_spans("assign", 0), lambda _, i: F.length(F.col("assign_group")[i]) >= LEAST_ASSIGNED)
    df = df.withColumn("base", F.array_sort(F.concat(assign, _spans("access", 1), _spans("hex", 2))))
    df = df.select("carried", "base", F.zip_with("other_at", "other_hits", lambda a, h: F.struct(a.alias("start"), h.alias("token"))).alias("others"))

    def candidate(c: Column) -> Column:
        t = tested(c["token"])
        return let(t, lambda x: F.struct(c["start"].alias("start"), (c["start"] + F.length(c["token"])).alias("end"), x["class"].alias("class"), x["bin"].alias("bin"), x["passed"].alias("passed")))

    df = df.withColumn("free", F.when((F.size("base") > 0) & (F.size("others") > 0), _free(F.col("base"), F.col("others"))).otherwise(F.col("others"))).withColumn("candidates", F.transform("free", candidate)).drop("others", "free")
    scanned = stored(df, "secrets")
    from_bin = discoveries(scanned)
    if not from_bin:
        return scanned.select("carried", "base", F.col("base").alias("spans"))
    bar = F.create_map(*[x for k, v in sorted(from_bin.items()) for x in (F.lit(k), F.lit(v))])
    won = F.filter("candidates", lambda c: c["passed"] & (c["bin"] >= F.coalesce(bar[c["class"]], F.lit(MOST_BINS))))
    extra = F.transform(won, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).cast(_SPAN)
    return scanned.select("carried", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by mark; null stays null.

    The text is cut into blocks once, so each piece that stays costs its own length and not the text's.
    """
    size = 1024

    def of(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            def block(i: Column) -> Column:
                lo = F.greatest(a - i * size, F.lit(0))
                hi = F.least(b - i * size, F.lit(size))
                return F.substring(blocks[i.cast("int")], (lo + 1).cast("int"), (hi - lo).cast("int"))

            return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / size), F.floor((b - 1) / size)), block), "")).otherwise("")

        def kept(x: Column) -> Column:
            """x: the spans and the running maximum of their ends; a span begins a run where all before have ended."""
            firsts = F.filter(x["spans"], lambda p, i: (i == 0) | (p["start"] >= x["ended"][F.greatest(i - 1, F.lit(0))]))
            lasts = F.filter(x["ended"], lambda e, i: (i == F.size(x["spans"]) - 1) | (F.get(x["spans"], i + 1)["start"] >= e))
            ends = F.concat(F.array(F.lit(0).cast("bigint")), lasts)
            starts = F.concat(F.transform(firsts, lambda p: p["start"]), F.array(F.length(text).cast("bigint")))
            return F.array_join(F.zip_with(ends, starts, piece), mark)

        return let(F.struct(spans.alias("spans"), running_max(F.transform(spans, lambda p: p["end"])).alias("ended")), kept)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), of)).otherwise(text)
