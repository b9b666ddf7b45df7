"""Connected components of an edge table by alternating large and small stars; nothing but two figures reaches the driver.

A table of at most ``ONE_TASK`` edges, once counted, is joined by one task instead, in one job; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stash, unstash


ONE_TASK = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["node", "component"])


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    Each round writes its edges to the shared folder; rounds end when the edge set stays the same, after O(log n) of them.
    Self-loops and repeated edges are fine; edges with a null end are ignored.
    """
    now = stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    if now.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return stash(now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        after = stash(_small(_large(now)), "edges")
        unstash(now)
        now = after
