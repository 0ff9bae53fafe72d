"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets are one kind. Each kind posts itself under
its ``COORDINATES`` (coordinate, value) pairs. Pairs that one kind alone has
cannot collide; a kind with fewer than ``MATCHES`` others is skipped whole.
Of the rest, ordered from the rarest on, a kind with n left needs only the
first n - MATCHES + 1: two kinds with enough collisions share one of those
(prefix). Merging a posting list compares whole signatures and keeps pairs
with at least ``MATCHES`` collisions; pairs already in one component are
skipped. Every kept pair is confirmed on the full shingle sets.

Lists are merged in two rounds, so that large groups never become all pairs:
first each member with the list's least member; then, in lists whose members
are still in several components, blocks of members against blocks, for pairs
of different components alone. So every link between components is found.

Edge cases: a null text, or one without words, has an empty set and no link;
with fewer words than a shingle the whole sequence is one; equal sets link;
rows that repeat a doc_id with one text are one document (with different
texts, the id has the larger set's size, and its links are confirmed on one of
the texts alone); an empty table gives no rows; further columns may have any
names. A text is held whole by one task, with some 60 bytes a word beside it.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import Stage, WordHashes, blocks, bytes_of, mix64, windows64
from meshline.llm.components import components

WORDS, SIMILARITY = 5, 75  # hundredths
COORDINATES, MATCHES, BLOCK, TILE = 32, 14, 1024, 128
#: Shingles of a matrix of two tiles; bytes of sets that a task holds beside those of two tiles.
WIDTH, SET_BYTES = 1 << 16, 128 << 20
_A = np.random.default_rng(32).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(33).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
SETS = "doc_id long, n_shingles long, k1 long, k2 long, signature array<long>"


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows64(words, min(size, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set; 48 bits of it with the coordinate above them."""
    least = np.array([((found * a + b) >> np.uint64(16)).min() for a, b in zip(_A, _B, strict=True)], dtype=np.uint64)
    return (mix64(least) & np.uint64((1 << 57) - 1)) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(57))


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        known = WordHashes()
        for block in blocks(batches):
            rows = []
            for doc, raw in zip(block.column("doc_id").to_pylist(), bytes_of(block.column("text")), strict=True):
                found = shingles(known.of(raw.lower().split()))
                if len(found):
                    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64).tolist()
                    rows.append((doc, len(found), k1, k2, signature(found).view(np.int64)))
                else:
                    rows.append((doc, 0, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in SETS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _postings(kinds: DataFrame, stage: Stage) -> DataFrame:
    """(key, members, least, kind, signature): the prefix of every kind that has enough shared pairs."""
    posted = stage.write(kinds.select("kind", F.explode("signature").alias("key")), "posted")
    shared = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    mine = stage.write(posted.join(shared, "key").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("keys")).where(F.size("keys") >= MATCHES), "shared")
    stage.drop("posted")
    prefix = mine.select("kind", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1))).alias("x")).select("kind", F.col("x.key").alias("key"))
    heads = prefix.groupBy("key").agg(F.count("*").alias("members"), F.min("kind").alias("least")).where("members > 1")
    return stage.write(prefix.join(heads, "key"), "prefix")


def _packed(docs: DataFrame, needed: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """(doc_id, packed): compressed texts of the documents that are needed, one of each doc_id."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array([press.compress(raw.lower()) for raw in bytes_of(block.column("text"))], pa.binary())], ["doc_id", "packed"])

    # Packed before they are dealt out; the side of those needed grows with the corpus, so it is never broadcast.
    packed = docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, packed binary").join(needed.hint("merge"), "doc_id", "left_semi")
    return stage.write(packed.groupBy("doc_id").agg(F.min("packed").alias("packed")), tag)


def _confirmed(pairs: DataFrame, docs: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """The pairs (u, v) of kinds whose sets are similar enough. Texts travel compressed, those of u's in order so that a worker keeps the last ones' sets."""
    pairs = stage.write(pairs.distinct(), f"{tag}-pairs")
    needed = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()

    texts = _packed(docs, needed, stage, f"{tag}-texts")
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "v", "packed": "pv"}), "v").join(texts.withColumnsRenamed({"doc_id": "u", "packed": "pu"}), "u")

    def check(batches):
        known, held, open_ = WordHashes(), OrderedDict(), zstandard.ZstdDecompressor()

        def of(doc: int, packed: bytes) -> np.ndarray:
            if doc not in held:
                if len(held) >= 64:
                    held.popitem(last=False)
                held[doc] = shingles(known.of(open_.decompress(packed).split()))
            held.move_to_end(doc)
            return held[doc]

        for block in batches:
            out: list[tuple[int, int]] = []
            for u, v, pu, pv in zip(*(block.column(c).to_pylist() for c in ("u", "v", "pu", "pv")), strict=True):
                a, b = of(u, pu), of(v, pv)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) else 0
                if 100 * both >= SIMILARITY * (len(a) + len(b) - both):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    found = stage.write(both.select("u", "v", "pu", "pv").mapInArrow(check, "u long, v long"), f"{tag}-links")
    stage.drop(f"{tag}-pairs", f"{tag}-texts")
    return found


def shared(sets: dict[int, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, as a product of incidence matrices, ``WIDTH`` shingles at a time."""
    mine = [sets[i] for i in left.tolist()] + [sets[i] for i in right.tolist()]
    _, place = np.unique(np.concatenate(mine), return_inverse=True)
    row = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
    # Shingles that one of the sets alone has do not count.
    often = np.bincount(place)[place] > 1
    used, place = np.unique(place[often], return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, place = row[often][order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for begin in range(0, len(used), WIDTH):
        a, b = np.searchsorted(place, [begin, begin + WIDTH])
        held = np.zeros((len(mine), min(WIDTH, len(used) - begin)), dtype=np.float32)
        held[row[a:b], place[a:b] - begin] = 1
        out += np.rint(held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def _linked(rows: DataFrame) -> DataFrame:
    """Links between kinds of different components, from rows (key, bi, bj, b, kind, component, signature, packed) in order.

    Pairs with enough collisions are confirmed on their full sets, a tile of
    blocks at a time; of the links of one group, those that join components
    not joined yet are kept, so a group never gives more than its size.
    """

    def run(batches):
        known, open_ = WordHashes(), zstandard.ZstdDecompressor()
        out: list[tuple[int, int]] = []

        def compare(group: list[tuple]) -> None:
            b = np.array([r[0] for r in group])
            kind, component, s = np.array([r[1] for r in group]), np.array([r[2] for r in group]), np.stack([r[3] for r in group])
            sets: dict[int, np.ndarray] = {}
            size = np.zeros(len(group), dtype=np.int64)
            root = {c: c for c in component.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            left, right = np.flatnonzero(b == b.min()), np.flatnonzero(b == b.max())
            for i in range(0, len(left), TILE):
                for j in range(0, len(right), TILE):
                    x, y = left[i : i + TILE], right[j : j + TILE]
                    hits = np.zeros((len(x), len(y)), dtype=np.int16)
                    for k in range(COORDINATES):
                        hits += s[x, k][:, None] == s[y, k][None, :]
                    near = (hits >= MATCHES) & (component[x][:, None] != component[y][None, :])
                    x, y = x[near.any(axis=1)], y[near.any(axis=0)]
                    if not len(x):
                        continue
                    if 8 * size[list(sets)].sum() > SET_BYTES:  # sets are made anew where they are needed again
                        sets.clear()
                    for k in {*x.tolist(), *y.tolist()} - sets.keys():
                        sets[k] = shingles(known.of(open_.decompress(group[k][4]).split()))
                        size[k] = len(sets[k])
                    both = shared(sets, x, y)
                    fit = (100 * both >= SIMILARITY * (size[x][:, None] + size[y][None, :] - both)) & (component[x][:, None] != component[y][None, :])
                    for p, q in zip(*np.nonzero(fit), strict=True):
                        u, v = top(int(component[x[p]])), top(int(component[y[q]]))
                        if u != v:
                            root[max(u, v)] = min(u, v)
                            out.append((int(kind[x[p]]), int(kind[y[q]])))

        def pack() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])
            out.clear()
            return found

        held, group = [], None
        for block in batches:
            signatures_ = np.asarray(block.column("signature").flatten()).reshape(block.num_rows, -1)
            for n, (key, bi, bj, b, kind, component, packed) in enumerate(zip(*(block.column(c).to_pylist() for c in ("key", "bi", "bj", "b", "kind", "component", "packed")), strict=True)):
                if (key, bi, bj) != group:
                    if len(held) > 1:
                        compare(held)
                    held, group = [], (key, bi, bj)
                held.append((b, kind, component, signatures_[n], packed))
            yield pack()
        if len(held) > 1:
            compare(held)
        yield pack()

    return rows.mapInArrow(run, "u long, v long")


def components_of(docs: DataFrame, stage: Stage) -> DataFrame:
    """doc_id, n_shingles, component_id of every doc_id."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    sets = stage.write(signatures(docs), "sets")
    full = sets.where("n_shingles > 0")
    # One kind per distinct set, named by its least doc_id. A doc_id with several texts joins their kinds below.
    kinds = stage.write(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("kind"), F.first("signature").alias("signature")), "kinds")
    prefix = _postings(kinds.select("kind", "signature"), stage)

    # Round one: each member with its list's least one, if their signatures agree enough.
    s = kinds.select("kind", "signature")
    star = prefix.where("kind <> least").select(F.col("least").alias("u"), F.col("kind").alias("v")).distinct()
    star = star.join(s.withColumnsRenamed({"kind": "u", "signature": "su"}), "u").join(s.withColumnsRenamed({"kind": "v", "signature": "sv"}), "v")
    agreed = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, x: t + x)
    links = _confirmed(star.where(agreed >= MATCHES).select("u", "v"), docs, stage, "star")
    named = full.join(kinds.select("k1", "k2", "kind"), ["k1", "k2"]).select("doc_id", "kind")
    several = named.where("doc_id <> kind")
    first = stage.write(components(links, stage, "cc1"), "first")

    # Round two: what is left between different components of one list. Lists of the same members are one.
    here = stage.write(prefix.select("key", "kind").join(first, F.col("kind") == F.col("node"), "left").select("key", "kind", F.coalesce("component", "kind").alias("component")), "here")
    marks = F.sum(F.xxhash64("kind").cast("decimal(20,0)"))
    groups = here.groupBy("key", "component").agg(F.count("*").alias("count"), marks.alias("mark"))
    split = groups.groupBy("key").agg(F.sum("count").alias("members"), F.count("*").alias("n"), F.sum("mark").alias("mark"), F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("in_main")).where("n > 1")
    alike = split.groupBy("members", "mark").agg(F.min(F.struct("key", "main", "in_main")).alias("x")).select("x.*", "members")
    lists = here.join(stage.write(alike, "alike"), "key").withColumn("out", (F.col("component") != F.col("main")).cast("int"))
    # Members of the list's main component are not compared with each other; the blocks of the others are, with all.
    no, ni = F.ceil((F.col("members") - F.col("in_main")) / BLOCK).cast("int"), F.ceil(F.col("in_main") / BLOCK).cast("int")
    lists = lists.withColumns({"no": no, "ni": ni}).withColumn("b", F.when((F.col("out") == 1) | (F.col("members") <= BLOCK), F.pmod(F.xxhash64("kind"), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("kind"), F.col("ni"))).cast("int"))
    other = F.when(F.col("members") <= BLOCK, F.array(F.lit(0))).when(F.col("out") == 1, F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1))
    dealt = stage.write(lists.select("key", "kind", "component", "b", F.explode(other).alias("o")).select("key", "kind", "component", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")), "dealt")
    texts = _packed(docs, dealt.select(F.col("kind").alias("doc_id")).distinct(), stage, "texts")
    full_rows = dealt.join(s.join(texts.withColumnRenamed("doc_id", "kind"), "kind"), "kind")
    ordered = full_rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = stage.write(_linked(ordered.select("key", "bi", "bj", "b", "kind", "component", "signature", "packed")), "more")
    stage.drop("alike", "dealt", "texts")
    every = links.unionByName(more).unionByName(several.select(F.col("doc_id").alias("u"), F.col("kind").alias("v")))
    last = stage.write(components(every, stage, "cc2"), "last")
    stage.drop("prefix", "here", "kinds")
    sizes = sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return sizes.join(last, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    found = components_of(docs, Stage(docs.sparkSession, "minhash"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are first of their component, all columns kept; rows that repeat a doc_id stay or go together."""
    found = components_of(docs, Stage(docs.sparkSession, "minhash"))
    dropped = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
