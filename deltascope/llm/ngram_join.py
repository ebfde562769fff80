"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct word shingles; two documents link when
100 * |intersection| >= threshold * |union|. Of sets that similar, the first
``n - ceil(threshold n / 100) + 1`` tokens under any one global order must share a token,
so candidates must share a prefix token under every order: the first puts tokens by
document frequency, rarest first, the others (SEEDS) by hashes. Only pairs that pass all of
them are verified, on whole sets.

Steps, none of which gathers a key's rows in one task, broadcasts what grows, or emits a group's pairs:

1. Equal sets are one class, by a 128-bit hash of the set, with a number of its own.
2. Most texts are alone, and a few of their tokens prove it: each set sends its tokens
   with the lowest hashes (a share that depends on its size alone), and if as many of
   them as a prefix is long occur in no other set, it can have no link. For that, only
   tokens count that every set of a compatible size would have sent.
3. The other sets send all tokens. A token's frequency is the number of these sets that have it,
   one number for all of them, so that the first order is global.
4. Sets that share a prefix token and a size are tied to the least of them. Sizes are classes
   a factor 100 / threshold wide, so linked sets are of one class or of neighbouring ones.
   Components of the ties are clusters: every link lies inside one.
5. Clusters too large for a block are split further by the same ties under the orders by hash,
   one after the other, inside the cluster: what stays together passes all filters.
6. What is still too large is cut into blocks by size class and hash; blocks of compatible
   sizes meet. Inside a block, the filters by hash are intersected pair by pair, and what
   passes is verified by products of membership matrices. A block reports a
   spanning forest of links, never all pairs.
7. Components of the links give the answer; classes take it back to rows.

A cluster's last step is quadratic in its number of different texts of compatible sizes, spread over its pairs of blocks.

Edge cases: null and empty texts and texts without words have no shingles and link with
nothing; texts with fewer words than the width have their whole sequence as one shingle;
repeated rows are copies; one id may have several texts, and each of them has its own component; rows of a
null id link with nothing; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.llm.common import any_names, forget, frugal, give_back, join_facts, small_enough, stored, worker_cache
from deltascope.llm.graph import connected_components
from deltascope.llm.vector_join import forest

#: Seeds of the orders by hash, besides the order by frequency.
SEEDS = (1, 2)
BLOCK = 512
#: Shingles of a block, summed over its sets, at most about.
BLOCK_SHINGLES = 500_000
#: Membership columns multiplied at a time.
COLUMNS = 4096
#: Words whose hashes are kept by a worker.
WORDS = 100_000


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and the six ASCII spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    held = worker_cache("words")
    if len(held) > WORDS:
        held.clear()
    got = []
    for w in words:
        h = held.get(w)
        if h is None:
            h = held[w] = xxhash.xxh3_64_intdigest(w)
        got.append(h)
    h = np.array(got, dtype=np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(out))


def prefix_length(n, threshold: int):
    """For an int, an array or a Column of ints."""
    most = threshold * n + 99
    return n - (F.floor(most / 100) if isinstance(n, Column) else most // 100) + 1


def prefix(tokens: np.ndarray, seed: int, threshold: int) -> np.ndarray:
    """The first tokens under the order by the seed's hash."""
    p = prefix_length(len(tokens), threshold)
    return tokens[np.argpartition(_mix(tokens, seed), min(p, len(tokens) - 1))[:p]] if p < len(tokens) else tokens


def sent_share(n: int, threshold: int) -> float:
    """Share of the hash range from which a set of n tokens sends; it falls with n."""
    return min(1.0, 1.12 * (100 - threshold) / 100 + 2.2 / math.sqrt(n) + 3 / n)


def signatures(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n, k1, k2 (hash of the set, null without shingles), sent (its lowest tokens; bit 0 tells if a token can prove it alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, k1, k2, offsets, flat = [], [], [], [0], []
            for t in batch.column("text"):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                more = 0
                if len(s):
                    key = _key(s)
                    k1.append(key[0]), k2.append(key[1])
                    if k1[-1] not in seen:  # a copy in this partition has sent them
                        seen.add(k1[-1])
                        bounds = [int(sent_share(m, threshold) * (1 << 53)) << 11 for m in (len(s), len(s) * 100 // threshold + 1)]
                        more, proof = (len(s) if b >= 1 << 64 else int(np.searchsorted(s, np.uint64(b))) for b in bounds)
                        out = s[:more] & ~np.uint64(1)
                        out[:proof] |= np.uint64(1)
                        flat.append(out.view(np.int64))
                else:
                    k1.append(None), k2.append(None)
                offsets.append(offsets[-1] + more)
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *flat])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(k1, type=pa.int64()), pa.array(k2, type=pa.int64()), lists], names=["doc_id", "n", "k1", "k2", "sent"])

    return docs.mapInArrow(frugal(run), "doc_id long, n long, k1 long, k2 long, sent array<long>")


def lonely(sent: DataFrame) -> DataFrame:
    """half (a set's k1 without its last bit), alone: tokens of a set that no other set has sent, of those that can prove it alone.

    Rows are combined by token before they are shuffled, so a token of very many sets weighs as little as any other.
    """
    who = F.col("k1").bitwiseAND(F.lit(~1)).bitwiseOR(F.col("token").bitwiseAND(F.lit(1)))
    by_token = sent.select(F.shiftright("token", 1).alias("token"), who.alias("who")).groupBy("token").agg(F.min("who").alias("who"), F.max("who").alias("last"))
    alone = by_token.filter((F.col("who") == F.col("last")) & (F.col("who").bitwiseAND(F.lit(1)) == 1))
    return alone.groupBy(F.shiftright("who", 1).alias("half")).agg(F.count("*").alias("alone"))


def size_class(n: Column, threshold: int) -> Column:
    """Linked sets are of one class or of neighbouring ones."""
    width = max(math.log(100 / threshold), 1e-9) * (1 + 1e-9)
    return F.floor(F.log(n.cast("double")) / width).cast("int")


def ties(postings: DataFrame, threshold: int, within: list[str]) -> DataFrame:
    """a, b: each node of postings(*within, n, node) and the least node of its key and size.

    A node stands on both edges of its size class, so neighbouring classes meet on the edge between them.
    """
    key = [*within, "edge"]
    c = size_class(F.col("n"), threshold)
    edges = postings.select(*within, "node", F.explode(F.array(c, c + 1)).alias("edge"))
    least = stored(edges.groupBy(*key).agg(F.min("node").alias("least"), F.count("*").alias("rows")).filter("rows > 1"), "ngram-least")
    return join_facts(edges, least, key, "rows", ["node"]).filter("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b"))


def _member(rows: list[np.ndarray], columns: int) -> Iterator[np.ndarray]:
    """The membership matrix of rows of column numbers, COLUMNS columns at a time."""
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for lo in range(0, columns, COLUMNS):
        a, b = np.searchsorted(flat, [lo, lo + COLUMNS])
        m = np.zeros((len(rows), min(COLUMNS, columns - lo)), dtype=np.float32)
        m[owner[a:b], flat[a:b] - lo] = 1
        yield m


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; tokens of one set alone are left out of the products."""
    tokens, times = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_counts=True)
    shared = tokens[times > 1]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    if len(shared):
        rows = []
        for s in sets:
            at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
            rows.append(at[shared[at] == s])
        for m in _member(rows, len(shared)):
            out += (m @ m.T).astype(np.int64)  # of at most COLUMNS ones, so exact
    return out


def linked(sets: list[np.ndarray], threshold: int, side: np.ndarray | None = None) -> np.ndarray:
    """Symmetric boolean matrix of links: sizes and prefix filters of the orders by hash intersected, then whole sets verified.

    With side, only pairs of different sides count.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    pass_ = 100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(pass_, False)
    if side is not None:
        pass_ &= side[:, None] != side[None, :]
    for seed in SEEDS:
        use = np.flatnonzero(pass_.any(axis=1))
        share = np.zeros_like(pass_)
        share[np.ix_(use, use)] = overlaps([prefix(sets[i], seed, threshold) for i in use]) > 0
        pass_ &= share
    use = np.flatnonzero(pass_.any(axis=1))
    out = np.zeros_like(pass_)
    if len(use):
        both = overlaps([sets[i] for i in use])
        m = n[use]
        out[np.ix_(use, use)] = 100 * both >= threshold * (m[:, None] + m[None, :] - both)
    return out & pass_


def _key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _few(df: DataFrame) -> DataFrame:
    """df, a stored table, broadcast if it is small."""
    return F.broadcast(df) if small_enough(df) else df


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, tokens (packed) of the wanted classes (node, rep, k1, k2), from the rows that name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                node, n, raw = [], [], []
                for i, k1, k2, t in zip(*[part.column(c) for c in ("node", "k1", "k2", "text")]):
                    s = shingles(t.as_py(), width)
                    if _key(s) == (k1.as_py(), k2.as_py()):
                        node.append(i.as_py()), n.append(len(s)), raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(raw, type=pa.binary())], names=["node", "n", "tokens"])

    named = rows.join(_few(wanted.withColumnRenamed("rep", "doc_id")), "doc_id").select("node", "k1", "k2", "text")
    found = stored(named.mapInArrow(frugal(run), "node long, n long, tokens binary"), "ngram-sets")
    if found.count() == wanted.count():
        return found
    once = stored(found.dropDuplicates(["node"]), "ngram-sets")  # repeated rows name a class more than once
    forget(found)
    return once


def _flat(seed: int | None, threshold: int):
    """Rows of node, n, tokens as a row per token; with a seed, of the prefix under its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.frombuffer(raw, dtype=np.uint64) for raw in part.column("tokens").to_pylist()]
                sets = sets if seed is None else [prefix(x, seed, threshold) for x in sets]
                times = [len(x) for x in sets]
                rest = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), times) for c in part.schema.names if c != "tokens"]
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), *[pa.array(c) for c in rest]], names=["token", *[c for c in part.schema.names if c != "tokens"]])

    return frugal(run)


def first_order_prefixes(loaded: DataFrame, threshold: int) -> DataFrame:
    """token, n, node of the tokens in the sets' prefixes by frequency that two sets or more have."""
    tokens = loaded.mapInArrow(_flat(None, threshold), "token long, node long, n long")
    frequent = stored(tokens.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1"), "ngram-frequent")
    live = join_facts(tokens, frequent.withColumn("df", F.col("rows")), ["token"], "rows", ["node"]).filter("df is not null")
    by_node = Window.partitionBy("node")
    place = F.row_number().over(by_node.orderBy("df", F.xxhash64("token"), "token"))
    rare = F.col("n") - F.count("*").over(by_node)  # tokens of this node alone come first and tie with nothing
    postings = live.withColumns({"place": place, "rare": rare}).filter(F.col("place") + F.col("rare") <= prefix_length(F.col("n"), threshold))
    return postings.select("token", "n", "node")


def _refined(loaded: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    """node, n, component, whole (fits one block): clusters too large for a block are split under the orders by hash."""

    def measured(df: DataFrame) -> DataFrame:
        size = df.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        whole = (F.col("members") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
        size = stored(size.withColumn("whole", whole), "ngram-cluster-sizes")
        return stored(join_facts(df, size.select("component", "members", "whole"), ["component"], "members", ["node"]), "ngram-clusters")

    done = measured(clusters)
    for seed in SEEDS:
        large = stored(done.filter("not whole").select("node", "component"), "ngram-large")
        if large.isEmpty():
            break
        members = loaded.join(_few(large), "node").select("tokens", "node", "n", "component")
        postings = stored(members.mapInArrow(_flat(seed, threshold), "token long, node long, n long, component long"), "ngram-postings")
        split = connected_components(ties(postings, threshold, ["component", "token"]))
        forget(postings)
        split = measured(split.join(done.select("node", "n"), "node").select("node", "n", "component"))
        done = stored(done.filter("whole").unionByName(split), "ngram-clusters")
    return done


def _dealt(clusters: DataFrame, threshold: int) -> DataFrame:
    """node, component, and the groups that a node meets others in: struct(lo, lo_part, hi, hi_part, side)."""
    cut = clusters.filter("not whole").withColumn("c", size_class(F.col("n"), threshold))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    per_class = cut.groupBy("component", "c").agg(parts.alias("parts"), F.count("*").alias("members"))
    sizes = per_class.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("c", "parts"))).alias("parts"), F.sum("members").alias("members"))  # as many entries as there are size classes
    met = join_facts(cut, stored(sizes, "ngram-parts"), ["component"], "members", ["node"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")[F.col("c")]).cast("int")

    def meet(step: int) -> Column:
        d = F.col("c") + step
        there = F.coalesce(F.try_element_at("parts", d), F.lit(0))

        def group(q: Column) -> Column:
            at, to = F.struct(F.col("c").alias("c"), F.col("own").alias("part")), F.struct(d.alias("c"), q.alias("part"))
            lo, hi = F.least(at, to), F.greatest(at, to)
            return F.struct(lo["c"].alias("lo"), lo["part"].alias("lo_part"), hi["c"].alias("hi"), hi["part"].alias("hi_part"), F.when(at == lo, 0).otherwise(1).alias("side"))

        return F.when(there > 0, F.transform(F.sequence(F.lit(0), there - 1), group)).otherwise(F.array().cast(_GROUPS))

    cut = met.withColumn("own", own).select("node", "component", F.concat(meet(-1), meet(0), meet(1)).cast(_GROUPS).alias("groups"))
    one = F.array(F.struct(*[F.lit(0).alias(x) for x in ("lo", "lo_part", "hi", "hi_part", "side")])).cast(_GROUPS)
    return clusters.filter("whole").select("node", "component", one.alias("groups")).unionByName(cut)


_GROUPS = "array<struct<lo:int,lo_part:int,hi:int,hi_part:int,side:int>>"


def _links(loaded: DataFrame, dealt: DataFrame, threshold: int) -> DataFrame:
    """a, b: a spanning forest of the links of each group."""

    def verify(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(t, dtype=np.uint64) for t in table.column("tokens").to_pylist()]
        lo, hi = ((table.column(x)[0].as_py(), table.column(f"{x}_part")[0].as_py()) for x in ("lo", "hi"))
        root = forest(linked(sets, threshold, None if lo == hi else table.column("side").to_numpy()))
        child = np.flatnonzero(root != np.arange(len(root)))
        out = pa.table({"a": pa.array(nodes[root[child]]), "b": pa.array(nodes[child])})
        if len(sets) > BLOCK // 2:
            give_back()
        return out

    key = ["component", "lo", "lo_part", "hi", "hi_part"]
    spread = loaded.join(_few(dealt), "node").select("node", "component", "tokens", F.inline("groups"))
    return spread.groupBy(*key).applyInArrow(verify, "a long, b long")


def _found(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, n, k1, k2, sent) and facts of their classes: k1, k2, copies, component_id, first (this class has its component's smallest id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(rows, width, threshold), "ngram-signed")
    named = signed.filter("k1 is not null and doc_id is not null")
    classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")

    alone = lonely(named.select("k1", F.explode("sent").alias("token")))
    proven = classes.withColumn("half", F.shiftright("k1", 1)).join(alone, "half", "left")
    open_ = proven.filter(F.coalesce("alone", F.lit(0)) < prefix_length(F.col("n"), threshold))
    loaded = _sets(rows, stored(open_.select("node", "rep", "k1", "k2"), "ngram-open"), width)

    clusters = connected_components(ties(stored(first_order_prefixes(loaded, threshold), "ngram-postings"), threshold, ["token"]))
    clusters = _refined(loaded, clusters.join(classes.select("node", "n"), "node").select("node", "n", "component"), threshold)
    links = stored(_links(loaded, stored(_dealt(clusters, threshold), "ngram-dealt"), threshold), "ngram-links")
    forget(loaded)
    roots = stored(connected_components(links), "ngram-roots")
    linked_ = stored(classes.join(roots, "node").select("k1", "k2", "rep", "copies", "component"), "ngram-linked")
    least = F.min(F.struct("rep", "k1", "k2"))
    least = stored(linked_.groupBy("component").agg(least.alias("least"), F.count("*").alias("members")), "ngram-components")
    several = join_facts(linked_, least, ["component"], "members", ["k1"])
    first = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    several = several.select("k1", "k2", "copies", F.col("least.rep").alias("component_id"), first.alias("first"))
    lone = classes.join(roots, "node", "left_anti").select("k1", "k2", "copies", F.col("rep").alias("component_id"), F.lit(True).alias("first"))
    return signed, stored(several.unionByName(lone), "ngram-facts")


def join(docs: DataFrame, width: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    signed, facts = _found(docs, width, threshold)
    out = join_facts(signed.select("doc_id", "n", "k1", "k2"), facts.drop("first"), ["k1", "k2"], "copies", ["doc_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@any_names("doc_id", "text")
def keep_one(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of each component one document, all columns as they are: that of the smallest id, and of the class that names it.

    Rows that repeat its id and its shingles are copies, of which the one whose columns hash lowest stays. Other texts
    under the same id stay if they are the first of their own component. Rows without words or without an id all stay.
    """
    signed, facts = _found(docs, width, threshold)
    judged = join_facts(signed.select("doc_id", "k1", "k2"), facts, ["k1", "k2"], "copies", ["doc_id"])
    stays = F.col("k1").isNull() | (F.col("first") & (F.col("doc_id") == F.col("component_id")))
    ids = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(stays).alias("stay"))
    ids = stored(ids.filter("stay = 0 or rows > 1"), "ngram-ids")
    other = _few(stored(ids.select("doc_id"), "ngram-gone"))
    kept = docs.join(other, "doc_id", "left_anti").select(*docs.columns)
    again = stored(ids.filter("stay > 0").select("doc_id"), "ngram-repeats")
    if again.isEmpty():
        return kept
    carried = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.join(_few(again), "doc_id", "left_semi").select(carried.alias("carried"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(s) if len(s) else (None, None) for s in (shingles(t.as_py(), width) for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("carried", "doc_id")], *[pa.array([k[i] for k in keys], type=pa.int64()) for i in (0, 1)]], names=["carried", "doc_id", "k1", "k2"])

    schema = T.StructType([T.StructField("carried", rows.schema["carried"].dataType), *[T.StructField(c, T.LongType()) for c in ("doc_id", "k1", "k2")]])
    rows = stored(rows.mapInArrow(sign, schema), "ngram-again")
    rows = join_facts(rows, facts, ["k1", "k2"], "copies", ["doc_id"]).filter(stays)
    once = rows.filter("k1 is not null").groupBy("doc_id", "k1", "k2").agg(F.min_by("carried", F.xxhash64("carried")).alias("carried"))
    return kept.unionByName(once.select("carried.*")).unionByName(rows.filter("k1 is null").select("carried.*"))
