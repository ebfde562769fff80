"""Histograms, element-wise array sums and percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as P
from deltascope.operators.mixes import literals
from deltascope.sources.tables import held

MULTIPLIERS = ((1.0, 2.0, 2), (2.0, 4.0, 4), (4.0, 6.0, 6), (6.0, 8.0, 8), (8.0, None, 10))
MAGNITUDES = (("0", 0, 1), ("1-999", 1, 1_000), ("1K-9K", 1_000, 10_000), ("10K-99K", 10_000, 100_000), ("100K-999K", 100_000, 1_000_000), ("1M+", 1_000_000, None))


def sum_arrays(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Element-wise sums of arrays of any length, for each key."""
    keys = keys or []
    each = df.select(*keys, F.posexplode(column).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("s"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return each.groupBy(*keys).agg(F.transform(packed, lambda r: r["s"]).alias(column))


def sum_arrays_fixed(column: Column, n: int) -> Column:
    """Aggregate: element-wise sums of the first n elements, in one hash aggregate; missing elements are 0."""
    return F.array(*[F.coalesce(F.sum(F.coalesce(F.get(column, F.lit(i)), F.lit(0))), F.lit(0)) for i in range(n)])


def resize(column: Column, n: int) -> Column:
    """The array padded with zeros or cut to n elements."""
    return F.slice(F.concat(column, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), n - F.size(column)))), 1, n)


def filled(counts: DataFrame, bins: list[int], name: str = "bin") -> DataFrame:
    """bin, count for all bins in order, zeros included."""
    out = literals(counts.sparkSession, name, bins).join(F.broadcast(counts), name, "left")
    return out.select("ord", name, F.coalesce("count", F.lit(0)).alias("count")).orderBy("ord").drop("ord")


def gas_histogram(aggregate: DataFrame, column: str, rows: DataFrame) -> DataFrame:
    """bin 1..11, lo, hi, aggregate, drill_in, count: summed block arrays beside the rows' own bins; bin 0 is left out."""
    summed = aggregate.agg(sum_arrays_fixed(F.col(column), P.LOG2_BINS).alias("h")).select(F.posexplode("h").alias("bin", "aggregate"))
    own = rows.filter("gas_delta <> 0").groupBy(P.log2_bin(F.col("gas_delta")).alias("bin")).agg(F.count("*").alias("drill_in"))
    both = summed.join(own, "bin", "full_outer")
    out = literals(rows.sparkSession, "bin", list(range(1, P.LOG2_BINS))).join(F.broadcast(both), "bin", "left")
    lo, hi = F.pow(F.lit(2), F.col("bin") - 1).cast("bigint"), F.when(F.col("bin") < P.LOG2_BINS - 1, (F.pow(F.lit(2), F.col("bin")) - 1).cast("bigint"))
    a, d = F.coalesce("aggregate", F.lit(0)), F.coalesce("drill_in", F.lit(0))
    return out.select("bin", lo.alias("lo"), hi.alias("hi"), a.alias("aggregate"), d.alias("drill_in"), (a + d).alias("count")).orderBy("bin")


def signed_histogram(rows: DataFrame) -> DataFrame:
    sign, bin_ = P.signed_bin(F.col("gas_delta"))
    return rows.filter("gas_delta is not null").groupBy(sign.alias("sign"), bin_.alias("bin_log2")).agg(F.count("*").alias("count")).orderBy("bin_log2", "sign")


def percent_histogram(rows: DataFrame, value: Column) -> DataFrame:
    """bin 0..12, lo, hi, count; rows without a percentage are left out."""
    counts = rows.select(P.percent_bin(value).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))
    edges = F.array(*[F.lit(e) for e in P.PERCENT_EDGES])
    out = filled(counts, list(range(len(P.PERCENT_EDGES))))
    return out.select("bin", edges[F.col("bin")].alias("lo"), F.get(edges, F.col("bin") + 1).alias("hi"), "count")


def histogram_percentiles(bins: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """From (bin_log2, count), the middle (1.5 * 2^bin) of the first bin that reaches each share; 0 when empty."""
    by_bin = bins.groupBy("bin_log2").agg(F.sum("count").alias("count"))  # at most 64 rows
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("bin_log2"))
    cum = by_bin.select("bin_log2", upto.alias("upto"), total.alias("total"))
    at = [F.coalesce(F.floor(1.5 * F.pow(F.lit(2.0), F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin_log2"))))).cast("bigint"), F.lit(0)).alias(f"p{round(100 * p)}") for p in points]
    return cum.agg(*at)


def depth_histogram(rows: DataFrame, column: str, most: int = 8) -> DataFrame:
    """depth 1..8 and 9+, zeros included; 0 and null are not counted."""
    counts = rows.filter(F.col(column) >= 1).groupBy(F.least(F.col(column), F.lit(most + 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    out = filled(counts, list(range(1, most + 2)))
    return out.select(F.when(F.col("bin") > most, f"{most + 1}+").otherwise(F.col("bin").cast("string")).alias("depth"), "count")


def magnitude_histogram(rows: DataFrame, column: str) -> DataFrame:
    """Buckets of what was left; null and negative values fall in none."""
    c = F.col(column)
    counts = rows.agg(*[F.count_if((c >= lo) & (c < hi if hi else F.lit(True))).alias(name) for name, lo, hi in MAGNITUDES])
    packed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("count")) for i, (n, _, _) in enumerate(MAGNITUDES)])
    return counts.select(F.inline(packed)).orderBy("ord").drop("ord")


def multiplier_histogram(rows: DataFrame) -> DataFrame:
    """Bins (1,2], (2,4], (4,6], (6,8], (8,..), named by their upper end (10 for the last)."""
    m = F.col("min_multiplier_to_succeed")
    counts = rows.agg(*[F.count_if((m > lo) & (m <= hi if hi else F.lit(True))).alias(f"m{name}") for lo, hi, name in MULTIPLIERS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("multiplier"), F.col(f"m{n}").alias("count")) for _, _, n in MULTIPLIERS]))).orderBy("multiplier")


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """p50, p90, p99 (linear interpolation) and max of the values that are not null."""
    p = F.percentile(F.col(column), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return rows.agg(p.alias("p"), F.max(column).alias("max")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "max")


#: Distinct values of a group up to which one task holds them; beyond, its ranks are found by bins.
WIDE = 50_000
#: Bins of a step of that search.
BINS = 4096


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], points: tuple[float, ...]) -> DataFrame:
    """keys and, for each value, q_{name}: its percentiles (linear interpolation) in each group that has any, else null.

    Values are counted by group first, for all figures at once, and written. A group of at most WIDE distinct values is an
    aggregate over these counts; a wider one never meets in one task (see _ranked). Null keys are a group.
    """
    each = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("which"), v.cast("double").alias("value")) for n, v in values.items()]))).filter("value is not null")
    group = [*keys, "which"]
    counts = held(each.groupBy(*group, "value").agg(F.count("*").alias("n")), "value-counts")
    wide = counts.groupBy(*group).agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter(F.col("m") > WIDE)
    asked = F.array(*[F.lit(float(p)) for p in points])
    if wide.isEmpty():
        found = counts.groupBy(*group).agg(F.percentile("value", asked, F.col("n")).alias("q"))
    else:
        wide = held(wide, "wide-groups")
        narrow = counts.join(wide, _same(counts, wide, group), "left_anti").groupBy(*group).agg(F.percentile("value", asked, F.col("n")).alias("q"))
        found = narrow.unionByName(_ranked(held(counts.join(wide, _same(counts, wide, group), "left_semi"), "wide-values"), wide, group, points))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == n, F.col("q"))).alias(f"q_{n}") for n in values])


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def _ranked(counts: DataFrame, groups: DataFrame, keys: list[str], points: tuple[float, ...]) -> DataFrame:
    """keys, q of groups with any number of values: counts(keys, value, n), groups(keys, total).

    For each rank asked for, the values are counted in bins that keep their order, and only the bin that holds the rank goes on:
    first binary magnitudes with signs, then BINS equal parts of what is left, until one value is. Six steps end it for any doubles,
    since magnitudes are binary and a part is a BINSth. A task sees a group's bins, never all its values.
    """
    at = [F.lit(p) * (F.col("total") - 1) for p in points]
    ranks = F.array(*[F.struct(F.lit(2 * i + side).alias("point"), f(x).cast("bigint").alias("rank")) for i, x in enumerate(at) for side, f in enumerate((F.floor, F.ceil))])
    now = groups.select(*keys, F.inline(ranks)).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    names = [*keys, "point"]
    while True:
        to = now.select(*[F.col(c).alias(f"_{c}") for c in keys], "point", "rank", "low", "high")
        inside = F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))
        met = counts.join(to, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]) & inside)
        v, half = F.col("value"), lambda x: x / 2
        magnitude = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100))
        part = F.least(F.floor((half(v) - half(F.col("low"))) / (half(F.col("high")) - half(F.col("low"))) * BINS), F.lit(BINS - 1))
        bins = met.groupBy(*names, "rank", F.when(F.col("low").isNull(), magnitude).when(F.col("low") == F.col("high"), 0).otherwise(part).cast("int").alias("bin"))
        bins = bins.agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*names).orderBy("bin"))
        hit = bins.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        now = held(hit.select(*names, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high"), "ranks")
        if now.filter("low < high").isEmpty():
            break
    value = lambda k: F.max(F.when(F.col("point") == k, F.col("low")))
    got = now.groupBy(*keys).agg(*[value(k).alias(f"v{k}") for k in range(2 * len(points))])
    got = got.join(groups.select(*[F.col(c).alias(f"_{c}") for c in keys], "total"), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]))
    over = [x - F.floor(x) for x in at]
    return got.select(*keys, F.array(*[F.col(f"v{2 * i}") * (1 - o) + F.col(f"v{2 * i + 1}") * o for i, o in enumerate(over)]).alias("q"))
