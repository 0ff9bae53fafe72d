"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences of their own. The others are dealt by a hash into shards of some
thousand pieces; each shard is packed by several islands, each a small
population of packings, the first best-fit decreasing. A generation crosses
two parents: well-filled whole bins of one are injected into the other, bins
that hold a duplicate are removed, and displaced pieces are put back
best-fit, largest first. Between rounds each island gets its neighbour's
elite. An island rests when its bins are as few as can be. In the end the bins
of many shards that are not full are packed together again, with the bins as
they are as one of the parents, until they are as few as can be, one shard
holds them, or no fewer remain.

Edge cases: a null or empty text is a piece of length 1 (the closing id); an
empty table has no pieces; equal rows, and rows that repeat a doc_id, are
packed as often as they stand; further columns may have any names. One task
holds one text and its ids, or one shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshline.llm.bpe import encoder
from meshline.llm.common import Stage, blocks

CAPACITY = 2048
SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 16384, 2, 2, 6, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KEYS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """The pieces of every document: its ids, then ``closing``, cut after each ``capacity``."""
    end = np.array([closing], dtype="<u4").tobytes()

    def run(batches):
        e = encoder(path)
        for block in blocks(batches):
            out: list[list] = [[], [], [], [], []]
            texts = [x or "" for x in block.column("text").to_pylist()]
            for doc, ids in zip(block.column("doc_id").to_pylist(), e.by_words(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], _KEYS)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Packing:
    """Bins of one packing under construction; finds the fullest bin with room in about one operation on a bit set."""

    def __init__(self, capacity: int):
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity = 0, capacity

    def add_bin(self, room: int) -> int:
        self.room.append(room)
        self._list(len(self.room) - 1, room)
        return len(self.room) - 1

    def _list(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.mask |= 1 << room

    def put(self, length: int) -> int:
        """Best fit."""
        above = self.mask >> length
        if not above:
            return self.add_bin(self.capacity - length)
        room = length + (above & -above).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.room[b] = room - length
        self._list(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    p = Packing(capacity)
    out = np.empty(len(lengths), dtype=np.int32)
    for i in order.tolist():
        out[i] = p.put(int(lengths[i]))
    return out


def fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Fewer bins first; among equals, fuller and emptier ones rather than even ones."""
    f = fills(bins, lengths) / capacity
    return -len(f) + float(np.mean(f * f))


def cross(base: np.ndarray, donor: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``base`` with some well-filled bins of ``donor``."""
    full = fills(donor, lengths)
    best = np.argsort(-full, kind="stable")[: max(1, len(full) // 3)]
    chosen = rng.choice(best, size=max(1, len(best) // 6), replace=False)
    injected = np.isin(donor, chosen)
    broken = np.unique(base[injected])
    free = np.isin(base, broken) & ~injected
    weak = fills(base, lengths)  # the emptiest bins are also opened
    free |= np.isin(base, np.argsort(weak, kind="stable")[:2]) & ~injected
    gone = np.zeros(len(weak), dtype=bool)
    gone[broken] = True
    gone[base[free]] = True
    p, out = Packing(capacity), np.empty(len(base), dtype=np.int32)
    kept = np.flatnonzero(~gone)
    number = np.full(len(weak), -1, dtype=np.int32)
    for b in kept.tolist():
        number[b] = p.add_bin(capacity - int(weak[b]))
    stay = ~injected & ~free
    out[stay] = number[base[stay]]
    renumber = {int(b): p.add_bin(capacity - int(full[b])) for b in chosen}
    out[injected] = [renumber[int(b)] for b in donor[injected]]
    loose = np.flatnonzero(free)
    for i in loose[np.argsort(-lengths[loose], kind="stable")].tolist():
        out[i] = p.put(int(lengths[i]))
    return out


def rests(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> bool:
    """Whether a packing has the least number of bins."""
    return int(bins.max(initial=-1)) + 1 <= -(-int(lengths.sum()) // capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, size: int = POPULATION) -> list[np.ndarray]:
    """The population after some generations, best first. Its first member is best-fit decreasing's packing where ``population`` has no better one."""
    rng = np.random.default_rng(seed)
    rank = lambda packings: sorted(packings, key=lambda x: -fitness(x, lengths, capacity))
    population = rank([*population, best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity)])[:size]
    if len(lengths) < 2 or rests(population[0], lengths, capacity):
        return population
    while len(population) < size:
        population.append(best_fit(lengths, np.argsort(-(lengths * rng.uniform(0.8, 1.25, len(lengths))), kind="stable"), capacity))
    population = rank(population)
    for _ in range(generations):
        children = []
        for _ in range(size):
            a, b = rng.choice(len(population), 2, replace=False)
            children.append(cross(population[a], population[b], lengths, capacity, rng))
        population = rank(population + children)[:size]
        if rests(population[0], lengths, capacity):
            break
    return population


def _pack_shards(rows: DataFrame, stage: Stage, tag: str, capacity: int) -> DataFrame:
    """``rows`` (shard, the keys, old) with ``bin``; ``old`` names the bin a piece was in before, or is null."""
    item = F.struct(F.negative("length").alias("less"), *_KEYS, "old")
    held = stage.write(rows.groupBy("shard").agg(F.array_sort(F.collect_list(item)).alias("items")), f"{tag}-shards")
    lengths = held.select("shard", F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"), F.transform("items", lambda x: x["old"]).alias("old"))
    state = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array().cast("array<array<int>>").alias("packings"))
    schema = "shard long, lengths array<int>, old array<long>, island int, packings array<array<int>>, bins int, score double"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard, island = row.column("shard")[0].as_py(), row.column("island")[0].as_py()
                n = np.asarray(row.column("lengths")[0].values, dtype=np.int64)
                packings = [np.asarray(x.values, dtype=np.int32) for x in row.column("packings")[0]]
                before = row.column("old")[0].values
                if not packings and not before.null_count:
                    packings = [np.unique(np.asarray(before), return_inverse=True)[1].astype(np.int32)]
                new = evolve(n, packings, capacity, seed=(shard * 1_000_003 + island * 101 + len(packings)) % (1 << 63))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), row.column("old"), pa.array([island], pa.int32()), pa.array([[x.tolist() for x in new]], pa.list_(pa.list_(pa.int32()))), pa.array([int(new[0].max(initial=-1)) + 1], pa.int32()), pa.array([fitness(new[0], n, capacity)], pa.float64())], ["shard", "lengths", "old", "island", "packings", "bins", "score"])

    tags = [f"{tag}-shards"]
    for turn in range(ROUNDS):
        state = stage.write(state.select("shard", "lengths", "old", "island", "packings").mapInArrow(run, schema), f"{tag}-islands-{turn}")
        tags.append(f"{tag}-islands-{turn}")
        if turn + 1 < ROUNDS:  # elites migrate in a ring
            elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("packings", 1, 1).alias("elite"))
            state = state.join(elite, ["shard", "island"]).withColumn("packings", F.concat("packings", "elite"))
    best = state.groupBy("shard").agg(F.max_by(F.element_at("packings", 1), F.struct("score", F.negative("island").alias("i"))).alias("bins"))
    placed = held.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("shard", *(F.col(f"x.items.{k}").alias(k) for k in _KEYS), F.col("x.bins").alias("bin"))
    found = stage.write(placed, f"{tag}-placed")
    stage.drop(*tags)
    return found


def pack(rows: DataFrame, stage: Stage, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (``PIECES``) with sequence_id and offset."""
    rows = stage.write(rows, "pieces")
    # The row's number is in the hash, so that rows of one id are dealt out too.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    whole = rows.where(F.col("length") >= capacity).select(*_KEYS, (-1 - F.col("row")).alias("sequence_id"))
    part = rows.where(F.col("length") < capacity)
    n, turn, done = part.count(), 0, [whole]
    shards = max(1, -(-n // SHARD))
    part = part.select(F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).alias("shard"), *_KEYS, F.lit(None).cast("long").alias("old"))
    while n:
        placed = _pack_shards(part, stage, f"pack{turn}", capacity)
        name = F.lit(turn << 58).bitwiseOR(F.shiftleft("shard", 16)).bitwiseOR(F.col("bin").cast("long"))
        named = placed.select(*_KEYS, name.alias("sequence_id"))
        weak = stage.write(named.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n")).where(F.col("fill") < capacity).select("sequence_id", "fill", "n"), f"weak{turn}")
        bins, fill, m = weak.agg(F.count("*"), F.sum("fill"), F.sum("n")).first()
        if shards == 1 or bins <= -(-(fill or 0) // capacity) or (turn and 4 * m > 3 * n) or turn == 30:
            done.append(named)
            break
        # Bins of all shards that are not full are packed together again.
        done.append(named.join(weak, "sequence_id", "left_anti").select(*_KEYS, "sequence_id"))
        n, shards, turn = m, max(1, -(-m // SHARD)), turn + 1
        again = named.join(weak.select("sequence_id"), "sequence_id", "left_semi")
        part = stage.write(again.select(F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).alias("shard"), *_KEYS, F.col("sequence_id").alias("old")), f"part{turn}")
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    # A sequence has at most ``capacity`` pieces, so a window over it is bounded.
    inside = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "start", "ids_crc32")
    return every.select(*_KEYS, "sequence_id", (F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document cut, tokenised and packed."""
    stage = Stage(docs.sparkSession, "packing")
    return pack(pieces(docs, path, capacity), stage, capacity)
