"""Embedding near-dedup: labels compared whole, very large ones in buckets of projection signs.

A label is compared pair by pair in blocks, by cosine in double precision,
unless sorting it into buckets costs less. Then each pass hashes every vector
to signs of random projections, and all vectors of a label that share the
first ``depth`` signs are compared with each other, however many they are.
The number of passes follows from the depth and the threshold alone, so that a
pair at the threshold is missed by all passes with probability ``MISS`` at
most, wherever the vectors lie; how many share their signs is measured per
label and decides only the depth. Where signs do not spread a label (its
vectors lie close together), depth 0 costs least and no pair is missed.

Pairs are united inside each comparison and then over all of them. In labels
compared whole links are counted there; in others they are counted inside each
component, block against block, which also counts pairs that no bucket held.

Equal vectors of one label are one vector with a weight, so copies are never
compared with each other.

Edge cases: vectors that are null, zero, or hold a null or a non-finite number
do not link; neither do vectors without a label; vectors of one label but
another number of components are compared among themselves, as a label of
their own; rows that repeat a vec_id with the same vector are one; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import Stage
from meshline.llm.components import components

THRESHOLD, MISS, BITS, BLOCK = 0.93, 1e-3, 32, 1024
#: Vectors of a block of a label or bucket; comparisons that cost as much as hashing and moving a vector once.
SPAN, MOVE = 4096, 2048


def passes_for(depth: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes so that a pair at the threshold shares the first ``depth`` signs in one of them."""
    if not depth:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-((1 - math.acos(threshold) / math.pi) ** depth))))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    x = batch.column(column)
    return np.asarray(x.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; by way of the largest component, since squares of very large or small ones leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(vectors: DataFrame, turn: int) -> DataFrame:
    """``vectors`` with their signs in this turn's projections, the first in the highest of ``BITS`` bits."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("x")))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                planes = np.random.default_rng([turn, 7919]).standard_normal((size, BITS))
                key = (_units(_matrix(part)) @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, pa.int64())], [*part.schema.names, "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, key long")


def _plan(vectors: DataFrame, stage: Stage) -> DataFrame:
    """(label, depth, passes) of least cost: vectors moved and pairs compared, over all passes."""
    sizes = stage.write(vectors.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    cost = lambda pairs: F.col("passes") * (F.col("n") * MOVE + pairs)
    plans = sizes.withColumns({"depth": F.lit(0), "passes": F.lit(1)}).select("label", "depth", "passes", cost(F.col("n").cast("double") * F.col("n") / 2).alias("cost"))
    # Two signs take five passes; labels that compare whole for less are not measured.
    large = sizes.where(F.col("n") > 6 * MOVE)
    if large.first() is not None:
        keys = _keyed(vectors.join(large, "label"), 0).groupBy("label", "n", "key").count()
        each = keys.withColumn("depth", F.explode(F.array(*map(F.lit, range(2, BITS + 1, 2)))))
        shared = each.groupBy("label", "n", "depth", F.expr(f"shiftright(key, {BITS} - depth)").alias("bucket")).agg(F.sum("count").alias("c"))
        passes = F.element_at(F.create_map(*(F.lit(v) for d in range(2, BITS + 1, 2) for v in (d, passes_for(d)))), F.col("depth"))
        deep = shared.groupBy("label", "n", "depth").agg(F.sum(F.col("c").cast("double") * F.col("c") / 2).alias("pairs")).withColumn("passes", passes)
        plans = plans.unionByName(deep.select("label", "depth", "passes", cost(F.col("pairs")).alias("cost")))
    best = plans.groupBy("label").agg(F.min(F.struct("cost", "depth", "passes")).alias("p"))
    return stage.write(best.select("label", "p.depth", "p.passes"), "plan")


def _unite(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``least`` (each place's lowest place so far) after the pairs of places (a, b)."""
    while len(a):
        u, v = least[a], least[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while ((up := least[least]) != least).any():
            least = up
    return least


def _pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at the threshold, each once, of a block with another or (left is right) with itself."""
    for start in range(0, len(left), 512):
        rows, columns = left[start : start + 512], right[start:] if left is right else right
        at = np.flatnonzero(x[rows] @ x[columns].T >= THRESHOLD)
        a, b = np.divmod(at, len(columns))
        if left is right:
            once = a < b
            a, b = a[once], b[once]
        yield rows[a], columns[b]


def _compared(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of (*by, bi, bj, b, id, weight, x) in order: each vector with links in its group, the least id it is united with there and the links."""
    keys = [*by, "bi", "bj"]

    def compare(group: tuple, rows: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        b, ids, weight = (np.concatenate([np.asarray(r.column(c)) for r in rows]) for c in ("b", "id", "weight"))
        x = _units(np.concatenate([_matrix(r) for r in rows]))
        order = np.argsort(ids, kind="stable")
        b, ids, weight, x = b[order], ids[order], weight[order], x[order]
        left = np.flatnonzero(b == group[-2])
        right = left if group[-2] == group[-1] else np.flatnonzero(b == group[-1])
        least, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for p, q in _pairs(x, left, right) if len(right) else ():
            least = _unite(least, p, q)
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
        some = links > 0
        return ids[some], ids[least[some]], links[some]

    def run(batches):
        held: list[pa.RecordBatch] = []
        group = None
        out: list[tuple[np.ndarray, ...]] = []

        def flush():
            if sum(r.num_rows for r in held) > 1:
                out.append(compare(group, held))
            held.clear()

        def found():
            packed = pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], ["id", "least", "links"])
            out.clear()
            return packed

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in keys:
                v = batch.column(c)
                change |= np.asarray(pa.compute.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False), dtype=bool)
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                here = tuple(batch.column(c)[start].as_py() for c in keys)
                if here != group:
                    flush()
                    group = here
                held.append(batch.slice(start, end - start))
            if out:
                yield found()
        flush()
        if out:
            yield found()

    return run


def _compare(vectors: DataFrame, by: list[str], block: int) -> DataFrame:
    """(id, least, links) of vectors against all others of their group, in pairs of blocks; groups of several blocks give several rows a vector."""
    large = vectors.groupBy(*by).count().where(F.col("count") > block).select(*by, F.ceil(F.col("count") / block).cast("int").alias("nb"))
    blocked = vectors.join(F.broadcast(large), by, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    pairs = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).select(*by, F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), "b", "id", "weight", "x")
    return pairs.repartition(*by, "bi", "bj").sortWithinPartitions(*by, "bi", "bj").mapInArrow(_compared(by), "id long, least long, links long")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    stage = Stage(rows.sparkSession, "embeddings")
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    label = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    fit = rows.where(sound).select("vec_id", label.alias("label"), x.alias("x")).distinct()
    own = stage.write(fit, "sound")
    vectors = stage.write(own.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).select("id", "label", "weight", "x"), "vectors")
    plan = _plan(vectors, stage)
    planned = vectors.join(plan, "label")
    whole = stage.write(_compare(planned.where("depth = 0"), ["label"], SPAN), "whole")
    edges, links = whole.select("id", "least"), whole.select("id", "links")
    deep = planned.where("depth > 0")
    turns = plan.where("depth > 0").agg(F.max("passes")).first()[0] or 0
    for turn in range(turns):
        keyed = _keyed(deep.where(F.col("passes") > turn), turn).withColumn("bucket", F.expr(f"shiftright(key, {BITS} - depth)"))
        edges = edges.unionByName(stage.write(_compare(keyed, ["label", "bucket"], SPAN), f"pass{turn}").select("id", "least"))
    united = stage.write(components(edges, stage), "united")
    if turns:
        # Links inside each component, block against block.
        links = links.unionByName(_compare(deep.join(united, deep["id"] == united["node"]), ["component", "label"], BLOCK).select("id", "links"))
    linked = links.groupBy("id").agg(F.sum("links").alias("links"))
    per_vector = stage.write(vectors.join(linked, "id", "left").join(united, vectors["id"] == united["node"], "left").select("id", "label", "x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "per-vector")
    mine = own.join(per_vector, ["label", "x"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("vec_id").join(mine, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
