"""Search by a part of a name over stored postings of pieces of three and of six characters.

The index of a table of names is three stored tables: entries, sorted by address; postings (piece, address), in folders by the
piece's first character and sorted by piece inside; and the number of postings of each piece. A query of three characters or more asks for its
rarest piece alone (of six characters, if it has so many); a shorter one asks for the pieces that begin with it (a name is
padded, so each of its characters begins one). Every candidate is then held against the name itself, so hits are those of a plain search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a piece, and of a long one: with many names, most of three characters are too frequent to choose by.
PIECE, LONG = 3, 6
#: Folders of postings, and parts that each is written in, so that a frequent piece is no single task's.
FOLDERS, SPREAD = 64, 8


def searched_text() -> Column:
    """What a query is looked for in: label and owner, joined by a space, in small letters."""
    return F.lower(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce("owner_project", F.lit(""))))


def _folder(piece: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(piece, 1, 1)), F.lit(FOLDERS)).cast("int")


def _pieces(text: Column, n: Column, size: int = PIECE) -> Column:
    """The distinct pieces that begin at the first n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))


def _whole_pieces(text: Column) -> Column:
    """The pieces that a query of PIECE characters or more can ask for."""
    of = lambda size: _pieces(text, F.length(text) - (size - 1), size)
    return F.when(F.length(text) >= LONG, of(LONG)).otherwise(of(PIECE))


def write_index(names: DataFrame, folder: str) -> None:
    """Index names: address (one row each), label, owner_project, footprint and whatever else is to be shown."""
    entries = names.withColumn("text", searched_text())
    entries.repartitionByRange("address").sortWithinPartitions("address").write.mode("overwrite").parquet(f"{folder}/entries")
    text = names.sparkSession.read.schema(entries.schema).parquet(f"{folder}/entries").select("address", "text")
    padded = F.concat(F.col("text"), F.lit("\u0000" * (PIECE - 1)))
    long = F.when(F.length("text") >= LONG, _pieces(F.col("text"), F.length("text") - (LONG - 1), LONG)).otherwise(F.array().cast("array<string>"))
    each = text.select(F.explode(F.concat(_pieces(padded, F.length("text")), long)).alias("piece"), "address").withColumn("part", _folder(F.col("piece")))
    spread = F.pmod(F.xxhash64("address"), F.lit(SPREAD))
    each.repartition("part", spread).sortWithinPartitions("part", "piece", "address").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    counts = _postings(names.sparkSession, folder).groupBy("part", "piece").agg(F.count("*").alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "piece").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/counts")


def _postings(spark: SparkSession, folder: str, what: str = "postings") -> DataFrame:
    rest = {"postings": "address string", "counts": "n bigint"}[what]
    return spark.read.schema(f"piece string, {rest}, part int").parquet(f"{folder}/{what}")


def _narrowed(rows: DataFrame, texts: list[str] | None) -> DataFrame:
    """Only the pieces that a few given texts can ask for, as filters that reach the files."""
    if texts is None:
        return rows
    spark = rows.sparkSession
    firsts = sorted({c for t in texts for c in t})
    parts = [r[0] for r in spark.createDataFrame([(c,) for c in firsts], "piece string").select(_folder(F.col("piece"))).distinct().collect()]
    size = {t: LONG if len(t) >= LONG else PIECE for t in texts}
    whole = sorted({t[i : i + size[t]] for t in texts if len(t) >= PIECE for i in range(len(t) - size[t] + 1)})
    hit = reduce(lambda a, b: a | b, [F.col("piece").startswith(t) for t in texts if len(t) < PIECE], F.col("piece").isin(whole))
    return rows.filter(F.col("part").isin(parts) & hit)


def search(spark: SparkSession, folder: str, queries: DataFrame | list[str], most: int = 20) -> DataFrame:
    """query, n_hits, kind (none, one, many) and hits, the first most entries by footprint, then address.

    queries is a table with a column query, or a few texts. A query is looked for in small letters, without blanks around it; an empty
    one finds nothing; a query that repeats is answered once.
    """
    few = None if isinstance(queries, DataFrame) else sorted({t for q in queries if (t := q.strip(" ").lower())})
    table = queries if few is None else spark.createDataFrame([(q,) for q in queries], "query string")
    asked = table.select("query", F.lower(F.trim("query")).alias("needle")).distinct()
    texts = asked.filter("needle <> ''").select("needle").distinct()
    long = texts.filter(F.length("needle") >= PIECE).select("needle", F.explode(_whole_pieces(F.col("needle"))).alias("piece")).withColumn("part", _folder(F.col("piece")))
    counted = long.join(_narrowed(_postings(spark, folder, "counts"), few), ["part", "piece"], "left")
    own = Window.partitionBy("needle")  # the pieces of one query
    rare = counted.withColumns({"place": F.row_number().over(own.orderBy("n", "piece")), "unknown": F.count_if(F.col("n").isNull()).over(own)})
    rare = rare.filter((F.col("unknown") == 0) & (F.col("place") == 1)).select("needle", "part", "piece")
    postings = _narrowed(_postings(spark, folder), few)
    found = postings.join(rare, ["part", "piece"]).select("needle", "address")  # once each, as a piece is posted once a name
    short = texts.filter(F.length("needle") < PIECE).withColumn("part", _folder(F.col("needle")))
    begun = postings.join(short.withColumnRenamed("part", "_part"), (F.col("part") == F.col("_part")) & F.col("piece").startswith(F.col("needle"))).select("needle", "address").distinct()
    entries = spark.read.parquet(f"{folder}/entries")
    # few postings can give many candidates, so these are dealt anew: the tasks that join postings were sized by what they read
    hits = found.unionByName(begun).repartition("address").join(entries, "address").filter(F.contains("text", "needle"))
    order = Window.partitionBy("needle").orderBy(F.desc("footprint"), "address")
    shown = [c for c in entries.columns if c not in ("address", "text")]
    total = hits.groupBy("needle").agg(F.count("*").alias("n_hits"))
    top = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).groupBy("needle").agg(F.array_sort(F.collect_list(F.struct("place", "address", *shown))).alias("hits"))
    out = asked.join(total, "needle", "left").join(top, "needle", "left")
    n = F.coalesce("n_hits", F.lit(0))
    return out.select("query", n.alias("n_hits"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("kind"), "hits")


def entry(spark: SparkSession, folder: str, address: str) -> DataFrame:
    """The entry of one address; files and row groups without it are skipped by their ranges."""
    return spark.read.parquet(f"{folder}/entries").filter(F.col("address") == address.strip().lower()).drop("text")
