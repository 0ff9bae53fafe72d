"""Connected components by alternating large-star and small-star rounds.

Edges stay in distributed tables; each round is a partially aggregated
minimum per node and a join that Spark can split where a hub is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import Stage

EDGES = "u long, v long"


def _contract(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars around local minima, ``most`` edges at a time."""

    def stars(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in edges:
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= most:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, stage: Stage, tag: str = "cc") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reachable.

    ``edges``: two long columns, in any direction and repeated at will; null
    ends and loops are ignored.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    held = stage.write(edges.mapInArrow(_contract, EDGES).distinct(), f"{tag}-0")
    mark = None
    for turn in range(1, 100):
        fresh = _small_star(_large_star(held).distinct()).distinct()
        now = stage.write(fresh, f"{tag}-{turn}")
        stage.drop(f"{tag}-{turn - 1}")
        held = now
        new = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark or not new[0]:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
    raise RuntimeError("components did not settle")
