import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from meshline.llm import bpe, components, embeddings, langid, media, packing, quality
from meshline.llm.common import Stage
from meshline.llm.queries import vocabulary

ODD = ["", None, "a" * 3000, "é" * 1500, "<|endoftext|> x<|startoftext|>y ", "don't WE'LL 12345 4.5,6!?...", "\t\r\n a\x1cb  c d ", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ŉ ǅ Å", "漢字かな交じり文" * 200, "\U0001d518" * 300, "x. y, z; ?! ..., 'tis " * 40]
TEXTS = [*ODD, "The quick brown fox, and so on. " * 60, "The quick brown fox, and so on. " * 60 + "end"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_encode_and_decode(frame, library):
    found = {r["doc_id"]: r for r in bpe.encode_decode(frame(TEXTS, extra=True), vocabulary()).collect()}
    for d, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[d]["n_tokens"] == len(ids) and found[d]["ids_sha256"] == brute.sha(" ".join(map(str, ids)).encode())
        assert found[d]["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False).encode())


def test_chunks_are_reused_and_end_at_characters():
    rng = random.Random(8)
    raw = (" ".join("".join(rng.choice("abcdeé漢") for _ in range(6)) for _ in range(3000)) + "é漢" * 3000).encode()
    places = bpe.cuts(raw)
    assert places and all(raw[p] & 0xC0 != 0x80 for p in places) and max(np.diff([0, *places, len(raw)])) <= bpe.MOST
    shifted = bpe.cuts(b"another start " + raw)
    assert len({p - 14 for p in shifted} & set(places)) > len(places) // 2


def test_merges_equal_the_library(library):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioutnshrdléüß") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    ours = bpe.Merges(vocabulary()).encode([w.encode() for w in words])
    for w, ids in zip(words, ours, strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(w, add_special_tokens=False).ids


def test_packing(frame, library):
    rng = random.Random(5)
    texts = [*ODD[:4], *(" ".join(rng.choice(("the", "of", "blue", "xyzzy")) for _ in range(rng.randint(1, 1500))) for _ in range(60)), "word " * 5000, "word " * 2047, "word " * 2048]
    rows = packing.pack_documents(frame(texts, extra=True), vocabulary()).collect()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in enumerate(texts)}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == [(d, p) for d in sorted(ids) for p in range(-(-len(ids[d]) // 2048))]
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # No worse than best-fit decreasing.
    rest = np.array([n for n in (len(v) % 2048 for v in ids.values()) if n])
    whole = sum(len(v) // 2048 for v in ids.values())
    assert len(sequences) <= whole + packing.best_fit(rest, np.argsort(-rest, kind="stable"), 2048).max() + 1
    assert packing.pack_documents(frame(["x"]).where("false"), vocabulary()).collect() == []


def test_crossing_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 300)
    a, b = (packing.best_fit(lengths, rng.permutation(300), 2048) for _ in range(2))
    for _ in range(20):
        child = packing.cross(a, b, lengths, 2048, rng)
        assert packing.fills(child, lengths).max() <= 2048 and len(child) == 300
        a, b = b, child
    best = packing.evolve(lengths, [], 2048, 1)[0]
    assert best.max() + 1 <= packing.best_fit(lengths, np.argsort(-lengths), 2048).max() + 1


def test_media(frame):
    texts = [None, "", "a", "x" * 576, "x" * 577, "é" * 1000, "a"]
    rows = {r["doc_id"]: r for r in media.media_columns(frame(texts, extra=True)).collect()}
    for d, t in enumerate(texts):
        data = media.payload((t or "").encode())
        assert len(data) % 576 == 0 and data
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), brute.sha(data), zlib.crc32(data[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_png(data)).hexdigest() and r["media_bytes"] == len(media.to_png(data))
    assert rows[2]["feature"] == rows[6]["feature"] and media.from_png(media.to_png(data)) == data


def test_bad_members_are_rows_of_their_own(frame, spark, tmp_path):
    docs = frame([f"text {k} " * 50 for k in range(40)])
    stage = Stage(spark, "media-test")
    folder, members = stage.path("a"), stage.path("m")
    media.store(docs.coalesce(1), folder).write.partitionBy("archive").parquet(members)
    (archive,) = (r["archive"] for r in spark.read.parquet(members).select("archive").distinct().collect())
    bad = spark.read.parquet(members).where("doc_id = 7").first()
    path = f"{folder}/{archive}".removeprefix("file://").removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(bad["offset"] + 20)
        f.write(b"\0\0\0\0")
    rows = media.open_archives(spark, folder, members, range_bytes=2000)
    assert rows.rdd.getNumPartitions() > 3
    found = {r["doc_id"]: r["error"] for r in rows.select("doc_id", "error").collect()}
    assert len(found) == 40 and [d for d, e in found.items() if e] == [7] and f"@{bad['offset']}" in found[7]


def test_language(frame, spark):
    texts = {"en": "the cat and the dog were walking with their friends in the town", "de": "der hund und die katze gingen mit ihren freunden durch die stadt"}
    docs = frame([texts["en"]] * 5).unionByName(frame([texts["de"]] * 5, "de")).unionByName(frame([None, "x"], None))
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    found = {r["doc_id"]: r for r in langid.predict(frame(["the friends were walking", "die freunde gingen", None, "", "123 !?", "die\0stadt", "a" * 5000], extra=True), model).collect()}
    assert [found[d]["lang_pred"] for d in range(6)] == ["en", "de", "und", "und", "und", "de"] and all(0 <= r["score"] <= 1 for r in found.values())
    empty = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_language_held_out(spark, sf):
    from meshline.llm.queries import op6_language

    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op6_language(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_quality_held_out(spark):
    from meshline.llm.queries import op5_quality

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op5_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r["quality"] == r["predicted"] for r in rows) >= 0.95 * len(rows)


def test_quality_edges(frame, spark):
    labels = spark.createDataFrame([(0, 1), (1, None)], "doc_id long, quality int")
    rows = quality.classify(frame([None, "", "a b"], extra=True), labels).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1
    assert all(np.isfinite(quality.statistics(t)).all() for t in (b"", b" ", b"\xff" * 10, b"!!!", b"A" * 5000))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(None, 3), (5, 5)]
    groups = brute.Union(range(500))
    for a, b in pairs:
        if a is not None:
            groups.join(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges, Stage(spark, "cc-test")).collect()}
    assert found == {x: groups.root(x) for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert components.components(edges.where("false"), Stage(spark, "cc-test")).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    rows += [(100 + k, (base[0] + rng.standard_normal(16) * 0.12 * np.linalg.norm(base[0]) / 4).tolist(), 0) for k in range(50)]
    rows += [(200 + k, base[1].tolist(), 1) for k in range(4)] + [(300, base[1].tolist(), 2), (301, (base[1] * 3).tolist(), 1)]
    bad = [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, base[0].tolist(), None), (404, [1.0, None] + [0.0] * 14, 0), (405, [1.0], 0)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    groups, links = brute.Union([i for i, _, _ in [*rows, *bad]]), dict.fromkeys([i for i, _, _ in [*rows, *bad]], 0)
    for a in x:
        for b in x:
            if a < b and label[a] == label[b] and x[a] @ x[b] >= 0.93:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame).collect()}
    assert found == {i: (links[i], groups.root(i), groups.root(i) == i) for i in links}
    assert embeddings.near_duplicates(frame.where("false")).collect() == []


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16)
    rows = [(k, (v + rng.standard_normal(16) * 0.1).tolist(), 1) for k in range(40)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r["n_links"] for r in found] == want.tolist()


def close_label(n, mean, size=64, seed=11):
    """``n`` vectors with about ``mean`` as cosine of any two."""
    rng = np.random.default_rng(seed)
    centre, rest = rng.standard_normal(size), rng.standard_normal((n, size))
    return np.sqrt(mean) * centre / np.linalg.norm(centre) + np.sqrt(1 - mean) * rest / np.sqrt(size)


def plain_links(x, label):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        lower = np.minimum(least, np.where(near, least[None], len(x)).min(axis=1))
        if (lower == least).all():
            return near.sum(axis=1), least
        least = lower


def embedding_rows(spark, x, label):
    frame = spark.createDataFrame([(k, v, int(y)) for k, (v, y) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(frame).orderBy("vec_id").collect()
    return [r["n_links"] for r in found], [r["component_id"] for r in found]


@pytest.mark.parametrize("mean", [0.85, 0.87, 0.88])
def test_embeddings_of_a_close_label(spark, mean):
    x, label = close_label(5000, mean), np.zeros(5000, dtype=int)
    links, least = plain_links(x, label)
    assert links.sum() > 1000
    assert embedding_rows(spark, x, label) == (links.tolist(), least.tolist())


def test_embeddings_in_buckets(spark, monkeypatch):
    """A loose label goes through sign buckets, a close one beside it is compared whole; both in several blocks."""
    monkeypatch.setattr(embeddings, "MOVE", 8)
    monkeypatch.setattr(embeddings, "SPAN", 300)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(12)
    loose = np.repeat(rng.standard_normal((500, 64)), 3, axis=0)
    x = np.concatenate([loose + rng.standard_normal(loose.shape) * 0.2, close_label(700, 0.87)])
    label = np.repeat([0, 1], [1500, 700])
    stage = Stage(spark, "plan-test")
    frame = spark.createDataFrame([(k, str(y), 1, v) for k, (v, y) in enumerate(zip(x.tolist(), label, strict=True))], "id long, label string, weight long, x array<double>")
    depths = {r["label"]: r["depth"] for r in embeddings._plan(frame, stage).collect()}
    assert depths["0"] > 0 and depths["1"] == 0
    links, least = plain_links(x, label)
    assert embedding_rows(spark, x, label) == (links.tolist(), least.tolist())


def test_passes_hold_a_pair_at_the_threshold():
    for depth in range(2, embeddings.BITS + 1, 2):
        share = (1 - np.arccos(0.93) / np.pi) ** depth
        assert (1 - share) ** embeddings.passes_for(depth) <= embeddings.MISS


@pytest.mark.parametrize("move", [embeddings.MOVE, 8])
def test_embeddings_of_several_sizes(spark, monkeypatch, move):
    """Vectors of each size link among themselves, in labels compared whole and in buckets."""
    monkeypatch.setattr(embeddings, "MOVE", move)
    rng = np.random.default_rng(13)
    parts = [np.repeat(rng.standard_normal((150, size)), 2, axis=0) for size in (64, 48)]
    parts = [p + rng.standard_normal(p.shape) * 0.1 for p in parts]
    wide = np.zeros((600, 64))
    wide[:300], wide[300:, :48] = parts
    links, least = plain_links(wide, np.repeat([0, 1], 300))
    assert links[300:].sum() > 200
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*parts[0], *parts[1]])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert ([r["n_links"] for r in found], [r["component_id"] for r in found]) == (links.tolist(), least.tolist())
