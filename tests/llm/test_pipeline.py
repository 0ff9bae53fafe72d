import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshline.llm import langid
from meshline.llm.queries import vocabulary


def test_stages_and_their_columns(spark, frame):
    text = "the quick brown fox jumps over the lazy dog again and again until the day is done and everybody goes home to sleep"
    texts = [f"{text} {k}\nheader line of some length here\nbody {k} {'and more words ' * k}" for k in range(8)] + ["123 !!", None, "header line of some length here"]
    docs = frame(texts)
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.where("text is null or n_chars <> length(text)").count() == 0 or name == "language"
    ids = {r["doc_id"] for r in docs.collect()}
    assert 0 in ids and not ids & {8, 9, 10}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} == ids


def test_against_plain_stages(spark):
    """All five stages over a small table, each fed with what the plain version of the one before keeps."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in table.collect()}

    def docs(texts):
        return spark.createDataFrame([(d, t, rows[d]["lang"], rows[d]["source"], len(t)) for d, t in texts.items()], table.schema)

    def texts_of(frame):
        return {r["doc_id"]: r["text"] for r in frame.collect()}

    words = lambda found: {d: t for d, t in found.items() if t.split()}
    train = [(r["text"], r["lang"]) for r in rows.values() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    short = [r for r in rows.values() if len(r["text"] or "") < 1500]
    plain = dict(zip((r["doc_id"] for r in short), brute.languages(train, [r["text"] for r in short], langid.BUCKETS, langid.SMOOTHING), strict=True))
    stage = texts_of(corpus_pipeline.language(spark, table, ""))
    assert {d for d, (lang, _) in plain.items() if lang != "und"} == {d for d in stage if d in plain}
    assert all(stage[d] == rows[d]["text"] for d in stage)
    found = stage
    want = words(brute.cut_lines(found.items(), 20, 3))
    stage = texts_of(corpus_pipeline.line_dedup(spark, docs(found), ""))
    assert stage == want != found
    found = want
    want = {d: found[d] for d, (_, _, first) in brute.near_texts(found.items()).items() if first}
    stage = texts_of(corpus_pipeline.near_dedup(spark, docs(found), ""))
    assert stage == want != found
    found = want
    want = words(brute.cut_words(found.items(), 20))
    stage = texts_of(corpus_pipeline.substring_dedup(spark, docs(found), ""))
    assert stage == want != found
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    packed = corpus_pipeline.pack(spark, docs(want), "").collect()
    total = dict.fromkeys(sizes, 0)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == sizes
    whole, rest = sum(n // 2048 for n in sizes.values()), [n % 2048 for n in sizes.values() if n % 2048]
    assert len({r["sequence_id"] for r in packed}) <= whole + brute.best_fit_decreasing(rest, 2048)


def test_foreign_texts_go(spark, frame):
    """Texts of no learned language are rejected, clean ones of any length stay."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    foreign = ["".join(chr(97 + (k * k * 7 + 3 * k) % 26) for k in range(700)), "Στην αρχή δημιούργησε ο Θεός τον ουρανό και τη γη " * 4, "吾輩は猫である。名前はまだ無い。" * 8, "function foo(a, b) { return a.map(x => x + b); } console.log(foo([1, 2], 3)); " * 4]
    extra = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(foreign)], table.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, table.unionByName(extra), "").select("doc_id").collect()}
    lettered = {r["doc_id"] for r in table.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == lettered


@pytest.mark.parametrize("n", [10, 50, 200, 1000])
def test_foreign_texts_by_any_model(spark, n):
    """Fits tell program text, Finnish and random letters from clean texts, however few texts were learned."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id")
    model = langid.fit(table.where(f"doc_id < {n}"))
    clean = [r["text"] for r in table.collect() if r["lang"] in model.langs and any(c.isalpha() for c in r["text"])]
    foreign = ["function foo(a, b) { return a.map(x => x + b); } console.log(foo([1, 2], 3)); " * 4, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "".join(chr(97 + (k * k * 7 + 3 * k) % 26) for k in range(700))]
    assert min(model.score(clean)[2]) >= corpus_pipeline.LEAST_FIT > max(model.score(foreign)[2])


def test_clashing_columns_and_repeated_rows(spark, frame):
    """Columns named like internal ones pass through every stage unchanged; rows that repeat an id stay or go together."""
    text = "the quick brown fox jumps over the lazy dog again and again until the day is done and everybody goes home"
    docs = frame([(k, f"{text} {k}\nbody {k} {'and more words ' * k}") for k in (0, 1, 2, 3, 3, 4, 4)])
    names = ("score", "lang_pred", "fit", "_gone", "_spans", "_id", "n_links", "component_id", "component", "bin", "shard", "sequence_id", "offset", "d", "j", "i")
    for c in names:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in names), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_empty_table(spark, frame):
    docs = frame(["x"]).where("false")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.collect() == [] and out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []
