"""Counts by key in their published shapes, leaderboards and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "__other__"
#: Addresses on a leaderboard.
BOARD = 12


def mix(df: DataFrame, key: Column, limit: int | None = None) -> DataFrame:
    """key, count of the rows whose key is not null, by count, then key."""
    out = df.select(key.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
    return out if limit is None else out.limit(limit)


def mix_none(df: DataFrame, key: Column) -> DataFrame:
    """As mix, with null as none."""
    return mix(df, F.coalesce(key, F.lit("none")))


def literals(spark: SparkSession, name: str, values) -> DataFrame:
    """ord and the values, in order."""
    items = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.posexplode(items).alias("ord", name))


def mix_fixed(df: DataFrame, key: Column, order) -> DataFrame:
    """key, count in a declared order, zeros included; other keys are left out."""
    counts = df.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    out = literals(df.sparkSession, "key", order).join(F.broadcast(counts.filter(F.col("key").isin(*order))), "key", "left")
    return out.select("ord", "key", F.coalesce("n", F.lit(0)).alias("count")).orderBy("ord").drop("ord")


def topk_per_key(counts: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def mix_per_key(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, mix: the k most frequent values of each key that are not null, as an array of (contract, count)."""
    counts = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("count"))
    top = topk_per_key(counts, [key], k, [F.desc("count"), F.col(value)])
    rows = F.array_sort(F.collect_list(F.struct("place", F.col(value).alias("contract"), "count")))
    return top.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["contract"].alias("contract"), r["count"].alias("count"))).alias("mix"))


def top_and_others(counts: DataFrame, k: int) -> DataFrame:
    """The k largest of (key, count) and one row Others for the rest, if it counts anything; Others is last.

    Only k rows meet in one task: the rest is told apart by a broadcast of those k keys.
    """
    top = counts.orderBy(F.desc("count"), "key").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "key")))
    rest = counts.join(F.broadcast(top.select("key")), "key", "left_anti").agg(F.sum("count").alias("count")).filter("count > 0")
    return top.unionByName(rest.select(F.lit("Others").alias("key"), "count", F.lit(k + 1).alias("rank"))).orderBy("rank")


def leaderboard(df: DataFrame, column: str, labels: DataFrame, limit: int = BOARD) -> DataFrame:
    """addr, count, label, category of the most frequent addresses; only these meet the labels."""
    top = mix(df, F.col(column), limit).withColumnRenamed("key", "addr")
    known = labels.select(F.col("address").alias("addr"), "label", "category").join(F.broadcast(top.select("addr")), "addr", "left_semi")
    out = top.join(F.broadcast(known), "addr", "left")
    category = F.when(F.col("category") != "unknown", F.col("category"))
    return out.select("addr", "count", F.coalesce("label", "addr").alias("label"), category.alias("category")).orderBy(F.desc("count"), "addr")


def rich_leaderboard(df: DataFrame, column: str, labels: DataFrame, probes: DataFrame | None, limit: int = BOARD) -> DataFrame:
    """As leaderboard with the whole record: a probe's positive tags first (if there are probes), then the cache's.

    The three upgrade columns come from one record, the probe's if it names a mechanism.
    Unknown and default values are null, so that they are left out of JSON.
    """
    top = mix(df, F.col(column), limit).withColumnRenamed("key", "addr")
    few = F.broadcast(top.select("addr"))
    probes = labels.filter(F.lit(False)) if probes is None else probes
    rec = labels.withColumnRenamed("address", "addr").join(few, "addr", "left_semi")
    got = probes.select(F.col("address").alias("addr"), F.struct("is_proxy", "is_factory", "is_safe", "erc_type", "is_upgradable", "upgrade_mechanism", "upgrade_admin").alias("p")).join(few, "addr", "left_semi")
    j = top.join(F.broadcast(rec), "addr", "left").join(F.broadcast(got), "addr", "left")
    yes = lambda c: F.when(c, True)
    from_probe = F.coalesce(F.col("p.upgrade_mechanism") != "none", F.lit(False))
    pick = lambda c: F.when(from_probe, F.col(f"p.{c}")).otherwise(F.col(c))
    mechanism = pick("upgrade_mechanism")
    known = F.col("source") != "unknown"
    return j.select(
        "addr",
        F.coalesce(F.nullif("label", F.lit("")), "addr").alias("label"),
        F.when(F.col("category") != "unknown", F.col("category")).alias("category"),
        F.nullif("owner_project", F.lit("")).alias("owner_project"),
        F.when(known, F.col("source")).alias("source"),
        F.when(known, F.col("confidence")).alias("confidence"),
        yes(F.col("is_mev_bot")).alias("is_mev_bot"),
        F.when(F.col("is_mev_bot"), F.col("mev_role")).alias("mev_role"),
        *[F.coalesce(yes(F.col(f"p.{t}")), yes(F.col(t))).alias(t) for t in ("is_proxy", "is_factory", "is_safe")],
        F.coalesce(F.nullif("p.erc_type", F.lit("")), F.nullif("erc_type", F.lit(""))).alias("erc_type"),
        yes(pick("is_upgradable")).alias("is_upgradable"),
        F.when(mechanism != "none", mechanism).alias("upgrade_mechanism"),
        pick("upgrade_admin").alias("upgrade_admin"),
        "count",
    ).orderBy(F.desc("count"), "addr")


def rate_leaderboards(df: DataFrame, column: str, totals: DataFrame | None, pool: int = 200, limit: int = 12, floor: int = 100) -> DataFrame:
    """board (count or rate), addr, count, total_tx, rate: a pool of the most frequent addresses gets denominators, then is ranked twice.

    Without totals (an optional source that failed) rates are null and the second board is empty.
    """
    top = mix(df, F.col(column), pool).withColumnRenamed("key", "addr")
    if totals is None:
        met = top.withColumn("total_tx", F.lit(None).cast("bigint"))
    else:
        met = top.join(F.broadcast(totals.select("addr", "total_tx").join(F.broadcast(top.select("addr")), "addr", "left_semi")), "addr", "left")
    met = met.withColumn("rate", F.try_divide(F.col("count").cast("double"), F.col("total_tx").cast("double")))
    by_count = met.orderBy(F.desc("count"), "addr").limit(limit).withColumn("board", F.lit("count"))
    by_rate = met.filter(F.col("total_tx") >= floor).orderBy(F.desc("rate"), F.desc("count"), "addr").limit(limit).withColumn("board", F.lit("rate"))
    return by_count.unionByName(by_rate).select("board", "addr", "count", "total_tx", "rate")


def flow(df: DataFrame, source: str, target: str, top: int = 10) -> DataFrame:
    """e, t, n: links between the top sources and targets; the others fold into __other__ on each side."""
    rows = df.select(F.col(source).alias("e"), F.col(target).alias("t")).filter("e is not null and t is not null")
    pairs = rows.groupBy("e", "t").agg(F.count("*").alias("n"))  # all that follows reads pairs, not rows

    def keep(side: str) -> DataFrame:
        return F.broadcast(pairs.groupBy(side).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), side).limit(top).select(side, F.lit(True).alias(f"top_{side}")))

    met = pairs.join(keep("e"), "e", "left").join(keep("t"), "t", "left")
    e, t = (F.when(F.col(f"top_{s}"), F.col(s)).otherwise(OTHER).alias(s) for s in ("e", "t"))
    return met.select(e, t, "n").groupBy("e", "t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e", "t")


def flow_document(links: list, target_side: str, label=lambda a: a) -> dict:
    """nodes and links with places in first-seen order, from collected links (at most 11 x 11)."""
    nodes, places = [], {}

    def place(addr: str, side: str) -> int:
        if (side, addr) not in places:
            places[side, addr] = len(nodes)
            folded = addr == OTHER
            nodes.append({"label": (f"Other {'entries' if side == 'entry' else side + 's'}" if folded else label(addr)), "addr": None if folded else addr, "side": side})
        return places[side, addr]

    return {"links": [{"source": place(r["e"], "entry"), "target": place(r["t"], target_side), "value": r["n"]} for r in links], "nodes": nodes}


def aligned(mixes: DataFrame, series: list[str]) -> DataFrame:
    """key and, for each series, its count and share, over the union of keys; missing ones are 0. mixes: series, key, count."""
    totals = mixes.groupBy("series").agg(F.sum("count").alias("total"))
    rows = mixes.join(F.broadcast(totals), "series").withColumn("share", F.try_divide(F.col("count").cast("double"), F.col("total").cast("double")))
    wide = rows.groupBy("key").pivot("series", series).agg(F.sum("count").alias("count"), F.sum("share").alias("share"))
    return wide.fillna(0).orderBy("key")
