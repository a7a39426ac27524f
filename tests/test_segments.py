"""The segmented index: what it finds, what it reads, and what changes leave as it was."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R, segments as S

CHUNK = "document_id long, version string, chunk_key string, user_id long, file_md5 string, model_version string, org_tag string, is_public boolean, text_content string, vector array<float>"


def rows(n, seed=1, begin=1):
    """Words that are common in a part of the chunks only, and vectors in clusters; some without text or vector."""
    rng, v = random.Random(seed), np.random.default_rng(seed)
    centers = v.normal(size=(20, 16))
    out = []
    for i in range(begin, begin + n):
        words = [rng.choice(["the", "of", "and"]) for _ in range(rng.randrange(1, 30))] + (["rare"] * rng.randrange(1, 4) if i // 64 % 8 == 3 and i % 3 == 0 else []) + (["once"] if i == begin + 70 else [])
        vector = (centers[i % 20] + 0.3 * v.normal(size=16)).astype(np.float32).tolist()
        out.append((i, "v1", f"c{i % 2}", i % 7, f"m{i}", f"m{i % 2}", [None, "a", "b"][i % 3], i % 11 == 0, None if i % 97 == 0 else " ".join(words), [None, [], [0.0] * 16][i % 3] if i % 53 == 0 else vector))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, CHUNK)


def questions(spark, data):
    return spark.createDataFrame([(1, "the rare", data[0][9]), (2, "of and", data[5][9]), (3, "once the", data[40][9]), (4, "nowhere", None)], "query_id long, question string, vector array<float>")


def words_by_hand(spark, chunks, q, k):
    m = R.matches(R.index(chunks.withColumn("text_content", F.coalesce("text_content", F.lit("")))), q, phrases=False).withColumn("score", F.round("bm_or", 6))
    return sorted((r["query_id"], r["rank"], r["document_id"], r["score"]) for r in R.best(m, "score", k).collect())


def found(df, *columns):
    return sorted((r["query_id"], r["rank"], r["document_id"], *(r[c] for c in columns)) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    return rows(3000)


@pytest.fixture(scope="module")
def held(spark, data, tmp_path_factory):
    out = S.Segments(spark, str(tmp_path_factory.mktemp("segments")))
    out.append(frame(spark, data[:1800]))
    out.append(frame(spark, data[1800:]))
    return out


def test_words_are_found_and_most_blocks_are_not_read(spark, data, held):
    q = questions(spark, data)
    got, counts = held.bm25(q, 5)
    chunks = frame(spark, data)
    df = chunks.where("length(text_content) > 0")
    assert held.statistics() == (3000, pytest.approx(R.lengths(chunks.withColumn("text_content", F.coalesce("text_content", F.lit("")))).agg(F.avg("n_tokens")).first()[0]))
    assert found(got, "score") == words_by_hand(spark, chunks, q, 5) and df.count() < 3000
    by = {r["query_id"]: r for r in counts.collect()}
    assert by[1]["read"] < 0.5 * by[1]["blocks"] and by[2]["read"] < by[2]["blocks"] and 4 not in by


def test_only_what_a_viewer_may_see_is_found(spark, data, held):
    viewer = S.Viewer(3, ["a"], "m1")
    seen = [r for r in data if (r[3] == 3 or r[7] or r[6] == "a") and r[5] == "m1"]
    bits = held.visible(viewer).collect()
    assert sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in bits) == len(seen)
    q = questions(spark, data)
    m = R.matches(R.index(frame(spark, data).withColumn("text_content", F.coalesce("text_content", F.lit("")))), q, frame(spark, seen).select(*R.KEY), phrases=False).withColumn("score", F.round("bm_or", 6))
    assert found(held.bm25(q, 5, viewer)[0], "score") == sorted((r["query_id"], r["rank"], r["document_id"], r["score"]) for r in R.best(m, "score", 5).collect())
    good = frame(spark, seen).where(S.is_vector(F.col("vector")))
    assert found(held.nearest(q, 7, viewer=viewer)[0], "cos") == found(R.nearest(good, q, 7), "cos")


def test_all_cells_are_exact_and_few_are_enough(spark, data, held):
    good = frame(spark, data).where(S.is_vector(F.col("vector")))
    q = good.where("document_id % 37 = 5").select(F.col("document_id").alias("query_id"), F.lit("").alias("question"), "vector")
    true = found(R.nearest(good, q, 10), "cos")
    got, counts = held.nearest(q, 10)
    assert found(got, "cos") == true
    c = counts.agg(F.sum("vectors"), F.sum("scored")).first()
    assert c[1] < 0.2 * c[0]
    n = held.probes(10)
    got, fewer = held.nearest(q, 10, n)
    near = {x[:1] + x[2:3] for x in found(got)}
    assert n < len(held.centers()) / 2 and len(near & {x[:1] + x[2:3] for x in true}) >= 0.93 * len(true)
    assert fewer.agg(F.sum("vectors")).first()[0] < 0.6 * c[0]


def test_changes_leave_other_segments_and_end_as_a_new_index(spark, data, tmp_path):
    held = S.Segments(spark, str(tmp_path / "a"))
    first = held.append(frame(spark, data[:2000]))
    files = lambda name: sorted(str(p) for p in (tmp_path / "a" / "segments" / name).rglob("*.parquet"))
    before = files(first)
    held.append(frame(spark, data[2000:2300]))
    held.append(frame(spark, data[2300:2600]))
    new = [(*r[:8], "of rare " + (r[8] or ""), r[9]) for r in data[:2600] if r[0] % 10 == 3]
    held.replace(frame(spark, new))
    held.delete(frame(spark, [r for r in data if r[0] % 10 == 7]))
    final = frame(spark, [r for r in data[:2600] if r[0] % 10 not in (3, 7)] + new)
    q = questions(spark, data)
    for merged in (False, True):
        if merged:
            assert len(held.merge(500)) == 3
        assert held.statistics()[0] == final.count() == held.live().count()
        assert found(held.bm25(q, 6)[0], "score") == words_by_hand(spark, final, q, 6)
        assert found(held.nearest(q, 6)[0], "cos") == found(R.nearest(final.where(S.is_vector(F.col("vector"))), q, 6), "cos")
    assert files(first) == before and held.merge(500) == []


def test_what_may_be_read_now(spark, data, tmp_path):
    held = S.Segments(spark, str(tmp_path / "a"))
    held.append(frame(spark, data[:300]))
    files = spark.createDataFrame([(r[0], r[3], r[4], "f", 1 if r[0] % 4 else 2) for r in data[:300]], "id long, user_id long, file_md5 string, file_name string, status int")
    states = spark.createDataFrame([(r[0], r[3], "v1" if r[0] % 5 else "v2", "ready") for r in data[:300]], "document_id long, user_id long, active_version string, status string")
    held.open_to(files, states)
    seen = {r[0] for r in data[:300] if r[5] == "m0" and r[0] % 4 and r[0] % 5 and (r[3] == 2 or r[7])}
    got = held.visible(S.Viewer(2, [], "m0")).collect()
    assert sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in got) == len(seen)
    assert {r["document_id"] for r in held.bm25(spark.createDataFrame([(1, "the of and")], "query_id long, question string"), 300, S.Viewer(2, [], "m0"))[0].collect()} <= seen


def test_an_index_without_vectors_or_words(spark, tmp_path):
    held = S.Segments(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        held.live()
    held.append(frame(spark, [(1, "v1", "c", 1, "m", "m0", None, False, None, None)]))
    q = spark.createDataFrame([(1, "the", [1.0])], "query_id long, question string, vector array<float>")
    assert held.bm25(q, 3)[0].count() == 0 and held.nearest(q, 3)[0].count() == 0 and held.probes(3) == 1


def batch_of_words(n: int, words: int, seed: int = 3) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    texts = [[f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 2 * words))] for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["v"] * n), pa.array([f"c{k}" for k in range(n)]), pa.array(texts, pa.list_(pa.string()))], names=[*R.KEY, "words"])


def test_postings_look_at_a_bounded_number_of_words(monkeypatch):
    whole = batch_of_words(200, 20)
    monkeypatch.setattr(R.runs, "__defaults__", (None, 100))
    parts = list(R.word_places(iter([whole.slice(0, 0), whole, whole.slice(150, 5)])))
    assert max(sum(p.column(5).to_pylist()) for p in parts) <= 100
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = []
    for r in [*whole.to_pylist(), *whole.slice(150, 5).to_pylist()]:
        for term in set(r["words"]):
            places = [k for k, w in enumerate(r["words"]) if w == term]
            want.append((r["document_id"], r["version"], r["chunk_key"], len(r["words"]), term, len(places), places))
    assert sorted(got) == sorted(want)


def test_blocks_are_written_from_a_bounded_number_of_words(monkeypatch):
    whole = batch_of_words(1000, 20).select(["document_id", "words"])
    monkeypatch.setattr(R.runs, "__defaults__", (None, 2000))
    parts = list(S.written_blocks(iter([whole])))
    assert len(parts) > 5
    places = [sum(len(x) // 4 for x in p.column(7).to_pylist()) for p in parts]
    # whole blocks only: a term has one row for each of its blocks
    assert max(places) <= 64 * 40 and sum(places) == sum(len(w) for w in whole.column(1).to_pylist())
    rows = [(r["term"], r["block"]) for p in parts for r in p.to_pylist()]
    assert len(rows) == len(set(rows)) and sum(r["n"] for p in parts for r in p.to_pylist()) == sum(len(set(w)) for w in whole.column(1).to_pylist())


def moved(spark):
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList
    stages = context.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.length()))


def test_postings_are_written_where_they_are_made(spark, tmp_path):
    rng = random.Random(7)
    text = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(200)) for _ in range(200)]
    chunks = frame(spark, [(k, "v1", "c0", 1, f"m{k}", "m0", None, True, t, None) for k, t in enumerate(text)])
    before = moved(spark)
    index = S.Segments(spark, str(tmp_path))
    index.append(chunks)
    assert moved(spark) - before < 0.1 * sum(map(len, text))  # they were 2.8 times the text
    found = index.postings(spark.createDataFrame([(text[9].split()[3],)], "term string"), "docs", "n").collect()
    assert [r["n"] for r in found] == [1]
