"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document is first taken a whole number of times
for certain, ``floor(target / source size)``. What is left, a share ``rest`` of the source's words,
is drawn with unequal probabilities: with t = size / (size + TILT_WORDS) and t_mean its mean over
the source's words, a document's inclusion probability is

    p = rest * (1 + (1 - rest) * (t - t_mean)),

which is between 0 and 1, grows with the document's length, and makes the expected words exactly
what is left. Documents are ranked by random odds u / (1 - u) divided by inclusion odds
p / (1 - p), and those of the lowest rank are taken until the next would pass the target. The
last gap is filled the same way, further down the ranks, by documents that fit it (so short ones are a little likelier than p in small sources),
until it is at most TOLERANCE of the target or nothing fits. u is a hash of the document's id and
text and the seed, so reruns agree.

The cut in the ranks of a source is found by sums over BINS bins; the bin of the cut is binned
again until it holds at most EDGE_ROWS rows, so a source of any size is cut by small sums.

Edge cases: a null text has size 0; null is a source of its own, last in order; a
source without words gets target 0 and nothing is taken; repeated rows (of one id and text) share their
rank and are taken or left together; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.llm.common import any_names, forget, join_facts, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BINS, EDGE_ROWS = 256, 4096
TILT_WORDS = 400
SEED = 9
#: Share of a source's target that may stay open.
TOLERANCE = 0.01
_RANGES = "array<struct<low:double,high:double,most:double>>"


def ordered_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add weight: weights repeat over the sources by code point, null last.

    Positions come from range partitions and the row counts of those before, so no task sees all sources.
    """
    ranged = sources.withColumn("_k", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")))
    ranged = ranged.repartitionByRange(F.col("_k")).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "mix-ranged")
    at, before = 0, []
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy("_p").count().collect()):
        before += [F.lit(p), F.lit(at)]
        at += n
    offset = F.create_map(*before)[F.col("_p")] if before else F.lit(0)
    place = offset + F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    pick = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.withColumn("weight", F.element_at(pick, (place % len(weights) + 1).cast("int"))).drop("_k", "_p")


def water_fill(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """Add target: weights share the sum of source_size; what exceeds most times a source's size is shared anew."""
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while total > 0:
        cap = most * F.col("source_size").cast("double")
        over = (F.lit(level) * F.col("weight") >= cap) & (F.lit(level > 0) | (cap == 0))
        n, held, weight = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not weight:
            break
        full, level = n, (total - float(held or 0)) / float(weight)
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), most * F.col("source_size").cast("double")))


def _unit(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash."""
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit("/"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return docs.select("doc_id", source.alias("source"), word_count(text).alias("size"), key.alias("_key"), _unit(F.col("doc_id"), text, seed).alias("drawn"), *more)


def _tilt() -> Column:
    return F.col("size") / (F.col("size") + F.lit(float(TILT_WORDS)))


def inclusion() -> Column:
    """The probability that a document is taken once more than for certain."""
    return F.col("rest") * (1 + (1 - F.col("rest")) * (_tilt() - F.col("tilt")))


def _ranked(rows: DataFrame) -> DataFrame:
    """Add rank, random odds over inclusion odds q as q / (1 + q) (the same order, within (0, 1)); null where nothing is drawn."""
    odds = inclusion() / (1 - inclusion())
    rank = F.when((F.col("rest") > 1e-12) & (F.col("size") > 0), F.col("drawn") / (F.col("drawn") + (1 - F.col("drawn")) * odds))
    return rows.withColumn("rank", rank)


def mix_plan(sized: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row per source: n, source_size, target, whole (certain copies), rest, tilt, and the ranges of ranks that are taken once more."""
    sources = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("size") * _tilt()).alias("tilted"))
    plan = water_fill(stored(ordered_weights(sources, weights), "mix-sources"), most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(share + 1e-12), F.lit(most)).cast("int")
    tilt = F.when(F.col("source_size") > 0, F.col("tilted") / F.col("source_size")).otherwise(0.0)
    plan = stored(plan.select("_key", "n", "source_size", "target", whole.alias("whole"), F.greatest(share - whole, F.lit(0.0)).alias("rest"), tilt.alias("tilt")), "mix-shares")

    rows = stored(_ranked(join_facts(sized, plan, ["_key"], "n", ["doc_id"])).filter("rank is not null").select("_key", "doc_id", "size", "rank"), "mix-ranked")
    state = plan.filter("rest > 1e-12").select("_key", "n", F.lit(-1.0).alias("low"), (F.col("rest") * F.col("source_size")).alias("gap"), (F.col("target") * TOLERANCE).alias("leave"), F.array().cast(_RANGES).alias("ranges"))
    state, done = stored(state, "mix-state"), None
    while not state.isEmpty():
        state = stored(_fill(rows, state), "mix-state")
        ready = ~F.col("found") | (F.col("gap") <= F.col("leave"))
        ended = state.filter(ready).select("_key", "ranges")
        done = ended if done is None else done.unionByName(ended)
        state = stored(state.filter(~ready).drop("found"), "mix-state")
    if done is None:
        return plan.withColumn("ranges", F.array().cast(_RANGES))
    forget(rows)
    return stored(plan.join(done, "_key", "left"), "mix-plan")


def _fill(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One round for every source: in rank order past low, documents that fit the gap alone, until the next passes it; found tells if there were any.

    base and span are the interval of ranks that the cut is in, powers of two wide, so that bins are exact.
    """
    fit = join_facts(rows, state.select("_key", "n", "low", "gap"), ["_key"], "n", ["doc_id"]).filter("rank > low and size <= gap").select("_key", "doc_id", "size", "rank")
    cut = state.select("_key", "n", "gap", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("open"))
    span = 1.0
    while True:
        inside = join_facts(fit, cut.filter("open"), ["_key"], "n", ["doc_id"]).filter((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + span))
        bin_ = F.floor((F.col("rank") - F.col("base")) / span * BINS)
        by_bin = inside.groupBy("_key", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("gap").alias("gap"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("_key").orderBy("bin"))  # at most BINS rows of a source
        by_bin = by_bin.withColumn("upto", upto)
        over = F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rows"))
        one = by_bin.groupBy("_key").agg(F.min(over).alias("cut"), F.max("upto").alias("all"))
        got = cut.join(one, "_key", "left")
        base = F.when(F.col("cut").isNotNull(), F.col("base") + F.col("cut.bin") * span / BINS).otherwise(F.col("base"))
        before = F.coalesce("cut.before", "all", "before")
        cut = got.select("_key", "n", "gap", base.alias("base"), before.alias("before"), F.col("cut").isNotNull().alias("open"), F.col("all").isNotNull().alias("some"), F.col("cut.rows").alias("rows"))
        cut = stored(cut if span == 1.0 else cut.withColumn("some", F.lit(True)), "mix-cuts")
        span /= BINS
        if (cut.agg(F.max("rows")).first()[0] or 0) <= EDGE_ROWS or span < 2.0**-48:
            break
    edge = join_facts(fit, cut.filter("open"), ["_key"], "n", ["doc_id"]).filter((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + span))
    running = F.sum("size").over(Window.partitionBy("_key").orderBy("rank"))  # at most EDGE_ROWS rows of a source; equal ranks together
    edge = edge.withColumn("upto", F.col("before") + running).filter("upto <= gap")
    last = edge.groupBy("_key").agg(F.max("rank").alias("cut_rank"), F.max("upto").alias("upto"))
    got = state.join(cut.select("_key", "base", "before", "open", "some"), "_key").join(last, "_key", "left")
    # without a document of the cut bin, the range ends just below the bin; without a cut bin, it takes all
    high = F.when(~F.col("open"), F.lit(1.0)).otherwise(F.coalesce("cut_rank", F.col("base") * (1 - 2.0**-52)))
    ranges = F.concat("ranges", F.array(F.struct("low", high.alias("high"), F.col("gap").alias("most")))).cast(_RANGES)
    left = F.col("gap") - F.coalesce("upto", "before")
    return got.select("_key", "n", high.alias("low"), left.alias("gap"), "leave", ranges.alias("ranges"), (F.col("some") & F.col("open")).alias("found"))


def _with_copies(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    rows = _ranked(join_facts(rows, plan, ["_key"], "n", ["doc_id"]))
    more = F.exists("ranges", lambda r: (F.col("rank") > r["low"]) & (F.col("rank") <= r["high"]) & (F.col("size") <= r["most"]))
    return rows.withColumn("copies", F.least(F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(most)))


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, copies counted) of every document."""
    sized = stored(_keyed(docs, seed), "mix-sizes")
    rows = _with_copies(sized, mix_plan(sized, weights, most), most)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@any_names("doc_id", "source", "text")
def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The documents, all columns as they are, each as often as the mix takes it."""
    sized = stored(_keyed(docs, seed), "mix-sizes")
    whole = _keyed(docs, seed, F.struct(*docs.columns).alias("_carried"))
    rows = _with_copies(whole, mix_plan(sized, weights, most), most)
    return rows.select(F.explode(F.array_repeat("_carried", F.col("copies"))).alias("_c")).select("_c.*")
