"""Connected components of a graph that no task and no driver holds whole.

Edges are first contracted inside each partition by union-find. If at most ONE_TASK are left, one task finishes them;
else alternating large-star and small-star steps point every node at the smallest node of its component. Minima are pre-aggregated and written before they are joined
back, so that a hub's edges can be split among tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, over_batches


#: So many edges, 1 MB of numbers, one task may hold.
ONE_TASK = 1 << 16


def _contract(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.record_batch({"u": np.array(nodes, np.int64), "v": np.array([root(x) for x in nodes], np.int64)})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (two long columns); comp is the component's smallest node."""
    now = scratch.keep(over_batches(edges.toDF("u", "v").where("u <> v"), _contract, "u long, v long"))
    last = None
    if now.count() <= ONE_TASK:
        done = scratch.keep(over_batches(now.coalesce(1), _contract, "u long, v long"))
        scratch.drop(now)
        return _labels(done)
    while True:
        both = now.union(now.select("v", "u"))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct())
        small = scratch.keep(large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")))
        step = large.join(small, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.keep(step.union(small.select("_u", "m")).distinct())
        scratch.drop(now, least, large, small)
        mark = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = step
        if mark == last:
            break
        last = mark
    return _labels(now)


def _labels(now: DataFrame) -> DataFrame:
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())
