"""Words found in Python workers are those that Spark's pattern finds."""

from pyspark.sql import functions as F

from tessera.functions import text as T, words
from tessera.operators import retrieval as R


def test_words_are_what_the_pattern_finds(spark, monkeypatch):
    # every character alone, between letters and beside itself, a stretch of them in a row
    every = spark.range(words.CODE_POINTS).where("id not between 55296 and 57343").repartition(4)
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = every.select("id", c.alias("c")).select(F.col("id").alias("document_id"), F.lit("v").alias("version"), F.lit("c").alias("chunk_key"), F.concat(F.lit("A "), "c", F.lit(" b"), "c", "c", F.lit("9x中文"), "c").alias("text_content"))
    want = rows.select("document_id", F.explode(T.tokens(F.col("text_content"))).alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("tf"))
    got = R.postings(rows).select("document_id", "term", "tf")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    odd = spark.createDataFrame([(1, "ÀB-9 İx 漢字kana_ｆ\x00é"), (2, ""), (3, None), (4, " - "), (5, "中"), (6, "word " * 9), (7, "ςΣ ΑΣ.")], "document_id long, text_content string")
    odd = odd.union(spark.sql("select 8L, cast(unhex('4120C3412062FF63') as string)")).select("document_id", F.lit("v").alias("version"), F.lit("c").alias("chunk_key"), "text_content").coalesce(1)
    want = {r[0]: r[1] for r in odd.select("document_id", T.tokens(F.col("text_content"))).collect()}
    got = {n: {} for n in want}
    for r in R.postings(odd).collect():
        got[r["document_id"]] |= dict.fromkeys(r["positions"], r["term"])
    assert got == {n: dict(enumerate(w or [])) for n, w in want.items()}
    assert {r[0]: r[1] for r in R.lengths(odd).select("document_id", "n_tokens").collect()} == {n: None if w is None else len(w) for n, w in want.items()}


def test_texts_are_split_a_bounded_number_of_bytes_at_a_time():
    import pyarrow as pa

    table = words.table_of([(48, 58, 1), (97, 123, 1), (0x4E00, 0x9FFD, 2)])
    texts = ["", "one two", None, "中文a", "", "three" * 4, " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "text"]).slice(1)
    parts = list(words.slices(batch, 1, 8))
    assert [p.num_rows for p in parts] == [2, 2, 1, 1] and sum(p.num_rows for p in parts) == 6
    assert [w for p in parts for w in words.split(p.column(1), table).to_pylist()] == [["one", "two"], [], ["中", "文", "a"], [], ["three" * 4], []]


def test_postings_find_a_text_s_words_once(spark):
    # the pattern ran twice over each text: once to filter, once for the words
    rows = spark.createDataFrame([(1, "v", "c", "a b a")], "document_id long, version string, chunk_key string, text_content string")
    plan = R.postings(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and R.postings(rows).count() == 2


def test_a_batch_s_index_holds_what_it_asks_and_finds_what_a_whole_index_finds(spark, tmp_path, monkeypatch):
    # a search wrote postings of every word of every chunk, though its batch asks for a few
    monkeypatch.setattr(R, "WORDS_AT_ONCE", 7)
    texts = ["the cat and the dog", "the the dog", "", None, "of the cat sat on the mat " * 5, "nothing here", "Cat, 区 the"]
    data = [(n, "v", "c", t, None) for n, t in enumerate(texts)]
    chunks = spark.createDataFrame(data, "document_id long, version string, chunk_key string, text_content string, vector array<float>")
    asked = spark.createDataFrame([(1, "the cat", None), (2, "dog 区", None), (3, "?", None), (4, "absent", None)], "query_id int, question string, vector array<float>")
    held = R.batch_index(chunks, asked, str(tmp_path / "batch"))
    assert {r[0] for r in held.postings.select("term").distinct().collect()} == {"the", "cat", "dog", "区"}
    want = R.postings(chunks).where("term in ('the', 'cat', 'dog', '区')")
    assert want.count() == held.postings.count() and want.exceptAll(held.postings.select(*want.columns)).isEmpty()
    assert held.stats.collect() == R.corpus_stats(chunks).collect()
    found = R.matches(held, asked).orderBy("query_id", *R.KEY).collect()
    assert found and found == R.matches(R.index(chunks), asked).orderBy("query_id", *R.KEY).collect()
    kept = R.store_index(chunks, str(tmp_path / "whole"))
    assert found == R.matches(kept, asked).orderBy("query_id", *R.KEY).collect()
    nobody = R.batch_index(chunks, asked.where("query_id = 3"), str(tmp_path / "nobody"))
    assert nobody.postings.isEmpty() and R.matches(nobody, asked.where("query_id = 3")).isEmpty()
