"""The same edge cases for every operator: null and empty texts, repeated rows, an empty table, clashing columns, long texts."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshline.llm import bpe, embeddings, langid, lines, media, minhash, packing, quality, substrings, suffixes
from meshline.llm.queries import vocabulary

NAMES = ("n_links", "component_id", "kept", "lang_pred", "fit", "_gone", "_spans", "_id", "asked", "d", "j", "i", "h", "s", "node", "least", "label", "shard", "bin", "old", "row", "media", "archive", "crc", "text_", "n_bytes", "n_words")
PASSAGE = " ".join(f"word{k % 37}x{k}" for k in range(90))
TEXTS = [(0, PASSAGE), (1, f"start {PASSAGE} end"), (2, None), (3, ""), (4, "one"), (4, "one"), (5, PASSAGE), (5, PASSAGE), (6, "a\nb\nc\nd"), (7, "x\na\nb\nc")]


def _languages(docs):
    return langid.predict(docs, langid.fit(docs))


def _quality(docs):
    return quality.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))


OPERATORS = {
    "near texts": minhash.near_duplicates, "near texts kept": minhash.clean, "lines": lines.digest, "lines cut": lines.clean, "media": media.media_columns, "quality": _quality, "languages": _languages,
    "tokens": lambda docs: bpe.tokens(docs, vocabulary()), "digests": lambda docs: bpe.encode_decode(docs, vocabulary()), "packing": lambda docs: packing.pack_documents(docs, vocabulary()),
    "suffixes": suffixes.digest, "suffixes cut": suffixes.clean, "substrings": substrings.digest, "substrings cut": substrings.clean,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_rows_and_nothing(frame, name):
    """Columns with any names change nothing; equal rows give equal rows, none lost; no rows give none."""
    operator = OPERATORS[name]
    plain = operator(frame(TEXTS)).collect()
    clash = frame(TEXTS)
    for c in NAMES:
        clash = clash.withColumn(c, F.lit(7))
    other = operator(clash)
    fields = [c for c in frame(TEXTS).columns if c in other.columns] if name.endswith(("cut", "kept")) or name == "languages" else None
    drop = {"sequence_id", "offset"}
    view = lambda rows: sorted(repr([(c, r[c]) for c in (fields or r.asDict()) if c not in drop]) for r in rows)
    assert view(plain) == view(other.collect())
    assert operator(frame(TEXTS).where("false")).collect() == []
    ids = sorted(r["doc_id"] for r in plain)
    every = sorted(d for d, _ in TEXTS)
    if name == "near texts kept":
        assert ids == [0, 2, 3, 4, 4, 6, 7]  # 1 is a near copy of 0
    elif name == "substrings cut":
        assert {r["doc_id"]: r["text"] for r in plain}[1] == "start end"
        assert ids == every
    elif name.startswith(("lines", "substrings")) or name in ("media", "quality", "languages", "tokens", "digests", "packing", "near texts") or name.startswith("suffixes"):
        assert ids == every
    for d in (4, 5):
        mine = [[r[c] for c in r.asDict() if c not in drop] for r in plain if r["doc_id"] == d]
        assert not mine or mine[0] == mine[1]


def test_suffix_texts(frame):
    kept = {r["doc_id"]: r["text"] for r in suffixes.clean(frame([PASSAGE, f"é{PASSAGE}é", None, "short"])).collect()}
    assert kept == {0: "", 1: "éé", 2: None, 3: "short"}


def test_embedding_norms_and_columns(spark):
    """Cosines of very large and small vectors, and columns named like the results."""
    rows = [(0, [1e200, 0.0], 1), (1, [1e200, 1e199], 1), (2, [1e-200, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 5e-324], 1), (4, [0.0, 5e-324], 1), (5, [0.0, 1e308], 1), (6, [0.0, 1.0], None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("n_links", "component_id", "kept", "id", "x", "weight", "node", "component"):
        docs = docs.withColumn(c, F.lit(9))
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(docs).collect())
    assert found == [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (3, 3, 0, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def test_languages_against_plain(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "")[:600], r["lang"]) for r in table.limit(60).collect()] + [(900, None, "en"), (901, "12 + 3", "de"), (902, "the\0of İ ǅ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    want = brute.languages(train, [t for _, t, _ in rows], langid.BUCKETS, langid.SMOOTHING)
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for (d, *_), (lang, score) in zip(rows, want, strict=True):
        assert found[d][0] == lang and abs(found[d][1] - score) < 1e-3, d


def test_quality_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: quality.statistics((r["text"] or "").encode()) for r in docs.collect()}
    mine = [d for d in texts if known.get(d) in (0, 1)]
    model = quality.Model.__init__.__defaults__
    want = brute.discriminant([texts[d] for d in mine], [known[d] for d in mine], list(texts.values()), *model)
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert np.allclose([found[d] for d in texts], want, atol=1e-6)


def test_packing_against_plain(frame):
    """No more sequences than best-fit decreasing over all pieces, from several shards; rows without an id are dealt out too."""
    rng = random.Random(3)
    texts = [(None if k % 3 else k, " ".join(["word"] * rng.choice((5, 40, 300, 700, 1200, 1500)))) for k in range(260)]
    packing_shard, packing.SHARD = packing.SHARD, 32
    try:
        rows = packing.pack_documents(frame(texts), vocabulary()).collect()
    finally:
        packing.SHARD = packing_shard
    assert len(rows) == 260
    fill: dict = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in f) <= 2048 and [o for o, _ in sorted(f)] == np.cumsum([0] + [n for _, n in sorted(f)])[:-1].tolist() for f in fill.values())
    assert len(fill) <= brute.best_fit_decreasing([r["length"] for r in rows], 2048)


def test_media_against_plain(frame, spark, tmp_path):
    """Archives read by tarfile and pictures read by the format's definition give back the payloads."""
    import glob
    import tarfile

    texts = {k: t for k, t in enumerate([None, "", "a", "é" * 400, "x" * 575, "x" * 576, "漢" * 9000])}
    media.store(frame(list(texts.items())), str(tmp_path / "a")).write.parquet(str(tmp_path / "m"))
    found = {}
    for path in glob.glob(f"{tmp_path}/a/*.tar"):
        with tarfile.open(path) as f:
            found |= {int(m.name.removesuffix(".png")): brute.samples(f.extractfile(m).read()) for m in f}
    for d, t in texts.items():
        raw = (t or "").encode()
        assert found[d] == raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))


def test_chunks_are_encoded_once(monkeypatch):
    """A passage that many texts share is encoded for the first of them only; joins that do not agree are widened."""
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000))
    e = bpe.Encoder(vocabulary())
    texts = [f"start {k} {passage} end {k}".encode() for k in range(8)]
    ids = e.encode(texts[:1])
    once = e.encoded
    ids += e.encode(texts[1:])
    assert once > 20 and e.encoded - once < 8 * 4
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert ids == want
    # A chunk whose margin's ids are wrong: the join does not agree, and the text is encoded whole.
    raw = next(iter(e.chunks))
    e.chunks[raw] = e.chunks[raw]._replace(last_ids=b"\1\0\0\0", first_ids=b"\1\0\0\0")
    asked = []
    monkeypatch.setattr(e, "_widened", lambda *a: asked.append(a))
    assert e.encode(texts[:1]) == want[:1] and asked


def test_long_texts(frame):
    """A text of 4 MB beside short ones."""
    words = " ".join(f"w{k}" for k in range(70_000))
    long = "\n".join([words, words, "tail " * 300_000])
    texts = [long, words, "short"]
    assert len(long) > 2_400_000
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digest(frame(texts)).collect()}
    assert found == {0: (440_000, 70_000 + 300_000 - 1), 1: (70_000, 70_000), 2: (1, 0)}
    cut = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffixes.digest(frame(texts)).collect()}
    assert cut[1] == 0 and cut[2] == 5 and cut[0] <= 2
    lines_ = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.digest(frame(texts)).collect()}
    assert lines_ == {0: (3, 1), 1: (1, 1), 2: (1, 0)}
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(texts)).collect()}
    assert near == {0: 0, 1: 0, 2: 2}
