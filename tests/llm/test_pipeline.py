"""The corpus pipeline, stage by stage, against plain versions of its stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.common import materialize

from . import brute
from .test_operators import odd, pieces_are_whole, texts_of  # noqa: F401


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-stage")
        held.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known, single, cut, mixed, packed = held
    assert known.count() >= 0.98 * start.count()
    classes = brute.joined(texts_of(known))
    assert {i for i, _ in texts_of(single)} == {i for i, x in classes.items() if x[0] == i}
    want = brute.repeats(texts_of(single))
    got = dict(texts_of(cut))
    assert set(got) == {i for i, (n, gone, _) in want.items() if n > gone or not gone}
    for i, t in got.items():
        assert len(brute.words(t)) == want[i][0] - want[i][1]
    sizes = {i: len(brute.words(t)) for i, t in got.items()}
    taken = {}
    for i, t in texts_of(mixed):
        taken[i] = taken.get(i, 0) + len(brute.words(t))
    assert all(n <= 3 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 20
    copies = [(i, t) for i, t in texts_of(mixed)]
    pieces_are_whole(packed.collect(), copies)


def test_rejected_languages(spark, odd):  # noqa: F811
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, odd, "").select("doc_id").collect()}
    assert not kept & {0, 1, 2, 4} and langid.UNKNOWN == "und"


def test_documents_of_several_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = {r["lang"]: r["text"].split() for r in docs.where("lang is not null and length(text) > 600").orderBy("doc_id").collect()}
    assert len(parts) >= 3
    text = " ".join(w for name in sorted(parts) for w in parts[name][:60])
    mixed = docs.limit(1).select(F.lit(10_000_000).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit(None).cast("string").alias("lang"), "source", F.lit(len(text)).cast("long").alias("n_chars"))
    kept = corpus_pipeline.keep_known_languages(spark, docs.union(mixed.select(docs.columns)), sf_dir)
    assert kept.where("doc_id = 10000000").count() == 1


def test_stages_take_odd_documents(spark, odd):  # noqa: F811
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "test-odd")
    assert docs.agg(F.count("*")).first()[0] > 0


def test_stages_keep_row_counts_of_shared_null_and_repeated_ids(spark, sf_dir):
    known = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(12).collect()]
    texts = sorted({" ".join(t.split()[:40]) for t in known})
    # every text unlike the others; ids shared, null or given twice
    ids = [1, 1, None, None, 2, 3, 4, 5, 6, 7, 8, 9][: len(texts)]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("first", F.lit("x")).withColumn("row", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    named = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    twice = sorted((str(i), t) for i, t, *_ in rows + rows)
    assert named(corpus_pipeline.keep_known_languages(spark, docs.union(docs.limit(1).withColumn("text", F.lit("12 34"))), sf_dir)) == twice
    got = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    classes = brute.joined_rows([(i, t) for i, t, *_ in rows])
    assert got.columns == docs.columns and named(got) == sorted((str(i), t) for i, t in classes)
    cut = stages["substring dedup"](spark, docs, sf_dir)
    assert cut.columns == docs.columns and sorted(str(r["doc_id"]) for r in cut.collect()) == [x for x, _ in twice]
    mixed = stages["mixing sources"](spark, docs, sf_dir)
    assert named(mixed) == twice


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
