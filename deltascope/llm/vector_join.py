"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label (and one dimension) are linked when their cosine is at least
``least``; on unit vectors that is a distance of at most eps = sqrt(2 - 2 least).
Equal vectors are one class first. Classes are projected on the leading principal
directions, sorted by label and grid cells of side eps (range-partitioned on the whole
order, so a hot label is cut too) and packed into sequence intervals of at most BLOCK
vectors with their bounding boxes. A projection shortens distances, so two intervals
whose boxes are more than eps apart hold no link and are skipped; pairs of intervals are
found by the cells of all kept directions, and a cell of many intervals is salted. The
pairs that are left are joined recursively, halving until an interval is short, with the same
test on each half. What is left then is compared exactly, in double precision.

TILE neighbouring intervals travel together: an interval goes once to each tile of pairs
that needs it, not once for each pair. A tile reports each vector's number of links and a
spanning forest of links, never all pairs, so dense groups cost time but no rows. The
principal directions are fitted on at most SAMPLE vectors or so (by a hash of the class);
they steer skipping only and no result depends on them.

Classes have numbers of their own in the graph of links; ids come back at the end, so ids
may be null, negative or repeated.

Edge cases: vectors that are null, empty, zero, of a null label or with null or
non-finite components link with nothing; vectors of different length link with nothing;
repeated rows are linked copies and count each other; null ids count as links of others but
name no component: a component of null ids alone has a null component_id, and a row of a
null id is never kept; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import forget, join_facts, stored
from deltascope.llm.graph import connected_components

LEAST = 0.93
DIRECTIONS = 4
#: Vectors in an interval, and their bytes, at most; a node is its block's number and PLACES bits for the place in it.
BLOCK, BLOCK_BYTES, PLACES = 512, 1 << 20, 10
#: Bits of the place of an interval in its tile (16 intervals).
TILE = 4
#: Labels of at most so many intervals need no cells; cells of more than CROWD intervals are salted.
FEW, CROWD = 32, 256
#: Intervals of at most so many vectors are compared without further halving.
LEAF = 64
SAMPLE = 10_000


def forest(links: np.ndarray) -> np.ndarray:
    """Root of each node of a symmetric boolean matrix: the lowest place in its component."""
    n = len(links)
    root = np.arange(n)
    open_ = links.any(axis=1)
    for s in range(n):
        if not open_[s]:
            continue
        front = np.array([s])
        open_[s] = False
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & open_)
            open_[front] = False
            root[front] = s
    return root


def _reader(kind: str):
    """Vectors to class (a hash of label and components) and bytes of the given number type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, vecs = [], [], []
            lists = batch.column("embedding")
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, dtype=kind)  # null is NaN, -0 is 0
            at = lists.offsets.to_numpy()
            for label, some, lo, hi in zip(batch.column("label").to_pylist(), lists.is_valid().to_pylist(), at[:-1], at[1:]):
                v = flat[lo:hi] if some else flat[:0]
                ok = label is not None and len(v) and np.isfinite(v).all() and v.any()
                dims.append(len(v))
                keys.append(hashlib.blake2b(repr(label).encode() + b"/" + v.tobytes(), digest_size=16).digest() if ok else None)
                vecs.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, type=pa.int32()), pa.array(keys, type=pa.binary()), pa.array(vecs, type=pa.binary())], names=["vec_id", "label", "dim", "class", "vec"])

    return run


def _vectors(raw: list[bytes], dim: int, rows: int | None = None) -> np.ndarray:
    """Rows in double precision, whatever the number type of their bytes; rows is their number where raw holds several in one."""
    data = b"".join(raw)
    single = len(data) == 4 * dim * (len(raw) if rows is None else rows)
    return np.frombuffer(data, dtype="<f4" if single else "<f8").reshape(-1, dim).astype(np.float64)


def principal_directions(classes: DataFrame, n: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """By dimension, the leading directions of unit vectors about their label's mean, fitted on a bounded sample."""
    total = classes.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = F.shiftrightunsigned(F.xxhash64("class"), 12).cast("double") / float(1 << 52)
    rows = classes.filter(drawn < share).select("label", "dim", "vec").collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        x = unit(_vectors([r["vec"] for r in own], dim))
        labels = np.unique([r["label"] for r in own], return_inverse=True)[1]
        for k in range(labels.max() + 1):
            x[labels == k] -= x[labels == k].mean(axis=0)
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :n]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(given: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return given.get(dim, np.eye(dim, DIRECTIONS))


def grid_cells(classes: DataFrame, directions: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Add cells, the grid cell of each class on the leading directions."""
    sent = classes.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros((batch.num_rows, DIRECTIONS), dtype=np.int32)
            vecs = batch.column("vec").to_pylist()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                p = unit(_vectors([vecs[i] for i in own], int(dim))) @ _directions(sent.value, int(dim))
                cells[own, : p.shape[1]] = np.floor(p / eps)
            cols = [pa.array(cells[:, k]) for k in range(DIRECTIONS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *[f"c{k}" for k in range(DIRECTIONS)]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, fields + "".join(f", c{k} int" for k in range(DIRECTIONS)))


def pack(sorted_rows: DataFrame, directions: dict[int, np.ndarray], label_type: str) -> DataFrame:
    """Sequence intervals: block, label, dim, lo, hi (bounding box), vecs, and by place in the block classes, reps and copies."""
    sent = sorted_rows.sparkSession.sparkContext.broadcast(directions)
    columns = ["class", "rep", "n", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        label = dim = kind = None
        held: list[tuple] = []
        most = BLOCK

        def flush() -> pa.RecordBatch:
            classes, reps, copies, vecs = zip(*held)
            p = unit(_vectors(vecs, dim)) @ _directions(sent.value, dim)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([label], type=kind), pa.array([dim], type=pa.int32()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]), pa.array([b"".join(vecs)]),
                 pa.array([list(classes)], type=pa.list_(pa.binary())), pa.array([list(reps)], type=pa.list_(pa.int64())), pa.array([list(copies)], type=pa.list_(pa.int64()))],
                names=["block", "label", "dim", "lo", "hi", "vecs", "classes", "reps", "copies"],
            )
            held.clear()
            return out

        for batch in batches:
            kind = batch.column("label").type
            for la, d, *row in zip(*[batch.column(c).to_pylist() for c in ("label", "dim", *columns)]):
                if held and (len(held) >= most or la != label or d != dim):
                    yield flush()
                    number += 1
                label, dim = la, d
                most = max(1, min(BLOCK, BLOCK_BYTES // len(row[3])))
                held.append(row)
        if held:
            yield flush()

    return sorted_rows.select("label", "dim", *columns).mapInArrow(run, f"block long, label {label_type}, dim int, lo array<double>, hi array<double>, vecs binary, classes array<binary>, reps array<long>, copies array<long>")


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """a, b (a <= b): intervals of one label whose boxes are at most eps apart on every direction.

    Of a label with more than FEW intervals, an interval appears in all grid cells that it spans, and one below on
    every direction; a pair is made in the upper of the two lowest cells, so once. The intervals of a crowded cell
    are dealt over salts, and meet all others of the cell in each.
    """
    slack = eps * (1 + 1e-9) + 1e-12
    boxes = blocks.select("block", "label", "dim", "lo", "hi")
    many = stored(boxes.groupBy("label", "dim").agg(F.count("*").alias("intervals")), "vec-labels")
    boxes = join_facts(boxes, many.withColumn("rows", F.col("intervals")), ["label", "dim"], "rows", ["block"])
    cells = [f"cell{k}" for k in range(DIRECTIONS)]
    for k in range(DIRECTIONS):
        grid = (F.col("intervals") > FEW) & (F.size("lo") > k)
        low = F.when(grid, F.floor((F.try_element_at("lo", F.lit(k + 1)) - slack) / eps)).otherwise(0)
        high = F.when(grid, F.floor(F.try_element_at("hi", F.lit(k + 1)) / eps)).otherwise(0)
        boxes = boxes.withColumn(f"low{k}", low).withColumn(f"cell{k}", F.explode(F.sequence(low, high)))
    key = ["label", "dim", *cells]
    boxes = stored(boxes.drop("intervals"), "vec-cells")
    crowd = boxes.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > CROWD)
    crowd = stored(crowd.withColumn("salts", F.ceil(F.col("rows") / CROWD).cast("int")), "vec-crowds")
    boxes = join_facts(boxes, crowd, key, "rows", ["block"]).withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = boxes.withColumn("salt", F.pmod(F.xxhash64("block"), "salts").cast("int")).alias("a")
    b = boxes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    near = F.forall(F.arrays_zip(F.col("a.lo").alias("alo"), F.col("a.hi").alias("ahi"), F.col("b.lo").alias("blo"), F.col("b.hi").alias("bhi")), lambda x: (x["alo"] <= x["bhi"] + slack) & (x["blo"] <= x["ahi"] + slack))
    on = (F.col("a.salt") == F.col("b.salt")) & (F.col("a.block") <= F.col("b.block"))
    for c in key:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for k in range(DIRECTIONS):
        near = near & (F.col(f"a.cell{k}") == F.greatest(f"a.low{k}", f"b.low{k}"))
    return a.join(b, on).filter(near).select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, eps: float, out: np.ndarray) -> None:
    """Mark in out the pairs of unit-norm rows of x and y with cosine >= least, halving and skipping by the projections px and py."""
    slack = eps * (1 + 1e-9) + 1e-12
    if (px.min(axis=0) > py.max(axis=0) + slack).any() or (py.min(axis=0) > px.max(axis=0) + slack).any():
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        out[...] = (x @ y.T) >= least
        return
    if len(x) >= len(y):
        h = len(x) // 2
        join_intervals(x[:h], y, px[:h], py, least, eps, out[:h])
        join_intervals(x[h:], y, px[h:], py, least, eps, out[h:])
    else:
        h = len(y) // 2
        join_intervals(x, y[:h], px, py[:h], least, eps, out[:, :h])
        join_intervals(x, y[h:], px, py[h:], least, eps, out[:, h:])


def join_tiles(pairs: DataFrame, blocks: DataFrame, directions: dict[int, np.ndarray], least: float, eps: float) -> DataFrame:
    """kind 0: a has b further links (copies of partners counted); kind 1: a and b are linked. Nodes are block << PLACES and the place in the block."""
    sent = pairs.sparkSession.sparkContext.broadcast(directions)
    tile = [F.shiftright("a", TILE).alias("i"), F.shiftright("b", TILE).alias("j")]
    needs = pairs.select(*tile, F.explode(F.array("a", "b")).alias("block")).distinct()

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        parts = []
        for r in rows:
            x = unit(_vectors([r["vecs"]], r["dim"], len(r["copies"])))
            parts.append((r["block"], (r["label"], r["dim"]), (r["block"] << PLACES) + np.arange(len(x)), np.array(r["copies"]), x, x @ _directions(sent.value, r["dim"])))
        i, j = rows[0]["i"], rows[0]["j"]
        nodes, more, ends, roots = [], [], [], []
        for a, ga, na, ca, x, px in parts:
            for b, gb, nb, cb, y, py in parts:
                if a > b or ga != gb or a >> TILE != i or b >> TILE != j:
                    continue
                hit = np.zeros((len(x), len(y)), dtype=bool)
                join_intervals(x, y, px, py, least, eps, hit)
                if a == b:
                    hit |= hit.T
                    np.fill_diagonal(hit, False)
                    links, names, degree = hit, na, hit @ ca
                else:
                    n = len(x)
                    links = np.zeros((n + len(y),) * 2, dtype=bool)
                    links[:n, n:], links[n:, :n] = hit, hit.T
                    names, degree = np.concatenate((na, nb)), np.concatenate((hit @ cb, hit.T @ ca))
                if not hit.any():
                    continue
                root = forest(links)
                own, child = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(root)))
                nodes.append(names[own]), more.append(degree[own])
                ends.append(names[child]), roots.append(names[root[child]])
        none = [np.zeros(0, dtype=np.int64)]
        own, at = np.unique(np.concatenate(none + nodes), return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, at, np.concatenate(none + more))
        ends, roots = np.concatenate(none + ends), np.concatenate(none + roots)
        kind = np.repeat([0, 1], [len(own), len(ends)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate((own, ends))), "b": pa.array(np.concatenate((total, roots)))})

    held = blocks.select("block", "label", "dim", "vecs", "copies")
    return needs.join(held, "block").groupBy("i", "j").applyInArrow(run, "kind long, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, label, embedding)."""
    eps = math.sqrt(2 - 2 * least)
    label_type = vectors.schema["label"].dataType.simpleString()
    number = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    read = rows.mapInArrow(_reader("<f4" if number == "float" else "<f8"), f"vec_id long, label {label_type}, dim int, class binary, vec binary")
    rows = stored(read.select("vec_id", "class"), "vec-rows")
    classes = read.filter("class is not null").groupBy("class", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = stored(classes, "vec-classes")
    directions = principal_directions(classes)
    order = ["label", "dim", *[f"c{k}" for k in range(DIRECTIONS)], "class"]
    ordered = grid_cells(classes, directions, eps).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(pack(ordered, directions, label_type), "vec-blocks")
    forget(classes)
    pairs = stored(interval_pairs(blocks, eps), "vec-pairs")
    found = stored(join_tiles(pairs, blocks, directions, least, eps), "vec-found")
    degrees = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("more"))
    roots = connected_components(found.filter("kind = 1").select("a", "b"))
    inside = blocks.select("block", F.posexplode(F.arrays_zip("classes", "reps", "copies")).alias("place", "c"))
    nodes = inside.select((F.shiftleft("block", PLACES) + F.col("place")).alias("node"), F.col("c.classes").alias("class"), F.col("c.reps").alias("rep"), F.col("c.copies").alias("n"))
    nodes = nodes.join(degrees, "node", "left").join(roots, "node", "left")
    nodes = stored(nodes.select("class", "rep", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "component"), "vec-nodes")
    forget(blocks)
    least_id = stored(nodes.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least_id"), F.count("*").alias("size")), "vec-components")
    named = join_facts(nodes, least_id, ["component"], "size", ["class"])
    component = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least_id"))
    facts = stored(named.select("class", "n", "links", component.alias("component_id"), F.lit(True).alias("placed")), "vec-facts")
    out = join_facts(rows, facts, ["class"], "n", ["vec_id"])
    component = F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
