"""Connected components over an edge table, without collecting anything.

Alternating large-star and small-star steps: every step replaces a node's
neighbours by links to the smallest of them, so the edges shrink to stars whose
centre is the smallest node of the component. Minima are aggregated before the
shuffle, and the join back leaves a busy node to Spark's skew handling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _contract(batches):
    """Replace the edges of a partition by the stars of their own components."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 100_000:
            yield _stars(parent, root)
            parent.clear()
    if parent:
        yield _stars(parent, root)


def _stars(parent, root):
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
    keep = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])


def _star(edges: DataFrame, large: bool, parts: list[DataFrame]) -> DataFrame:
    """One step over edges (u, v) with u > v; tables that it writes go to ``parts``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written first, so that the join deals out the edges anew and a busy node can be split.
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    parts.append(least)
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    ``edges`` has long columns u and v in any order; loops and repeats are
    allowed, null ends are ignored. An empty table gives an empty result. Rounds
    go on until one changes nothing, about the logarithm of the longest path.
    """
    flat = edges.where("u is not null and v is not null and u != v")
    flat = flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = materialize(flat.mapInArrow(_contract, "u long, v long").distinct(), "edges"), None
    while True:
        parts = [now]
        now = materialize(_star(_star(now, True, parts), False, parts), "edges")
        for old in parts:
            release(old)
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
