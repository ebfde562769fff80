"""Connected components of a graph given as edges, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import forget, join_facts, stored

#: Edges of a graph that one task finishes (4 MB).
ONE_TASK = 250_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches: smaller roots are hooked in, then paths are halved."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finished(edges: DataFrame) -> DataFrame:
    """node, component of at most ONE_TASK edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches if b.num_rows]
        if parts:
            nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction (large: over all neighbours, else over smaller ones)."""
    if large:
        edges = edges.union(edges.select("v", "u"))
    least = stored(edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")), "cc-least")
    met = join_facts(edges, least, ["u"], "n", ["v"])
    if large:
        new = met.filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
    else:
        new = met.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        new = new.union(least.select("u", F.col("least").alias("v")))
    out = stored(new.filter("u <> v").distinct(), "cc-edges")
    forget(least)
    return out


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Large-star and small-star contraction: each step keeps at most as many edges as
    before, and the number of steps grows with the logarithm of the longest chain.
    Hot nodes are joined by join_facts, so no task gathers a node's neighbours. A graph that
    has at most ONE_TASK edges, at the start or after a step, is finished by one task.
    Null ends and loops are dropped; an edge may repeat. No edges give no rows.
    """
    now = edges.filter("a is not null and b is not null and a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    seen = None
    for _ in range(most):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        if mark[0] <= ONE_TASK:
            out = stored(_finished(now), "cc-components")
            forget(now)
            return out
        seen = mark
        big = _star(now, True)
        forget(now)
        now = _star(big, False)
        forget(big)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
