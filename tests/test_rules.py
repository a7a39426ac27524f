"""Budgets, fusion, recall, access, evidence, tasks: known values."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access, chunking, conversation, fusion, lifecycle, planning, retrieval
from tessera.plans.search_queries import BY_PLAN
from tessera.sources import files as S, store
from tessera.streaming import tasks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("test", 4), ("中文", 6), ("😀", 4), ("é", 3)])
def test_estimate(spark, text, n):
    assert value(spark, T.estimate(F.lit(text))) == n


def test_message_cost(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("中文").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("😀").alias("content")))
    assert value(spark, T.message_cost(m)) == 71
    assert value(spark, T.message_cost(F.slice(m, 1, 0))) == 16


@pytest.mark.parametrize(("n", "out"), [(-1, ""), (0, ""), (2, ""), (3, "…"), (5, "…"), (6, "中…"), (9, "中文…"), (12, "中文…"), (13, "中文😀…"), (14, "中文😀tail")])
def test_truncate(spark, n, out):
    assert value(spark, T.truncated(F.lit("中文😀tail"), n)) == out
    assert value(spark, T.truncated(F.lit("a"), 1)) == "a"


@pytest.mark.parametrize(("pairs", "budget", "kept", "cutoff"), [(6, 157, [1, 2, 3], 0), (6, 110, [2, 3], 1), (6, 109, [3], 2), (1, 1000, [3], 2), (6, 63, [3], 2), (6, 62, [], 3), (6, 0, [], 3), (6, -1, [], 3), (0, 1000, [], 3), (-1, 1000, [], 3)])
def test_recent_turns(spark, pairs, budget, kept, cutoff):
    turns = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", "B"), (1, 3, "c", "C")], "conv_id int, turn_no int, question string, answer string")
    r = conversation.fit_recent(turns, pairs, budget).first()
    assert (r["kept"], r["cutoff"]) == (kept, cutoff)


def test_recent_turns_stop_at_what_does_not_fit(spark):
    schema = "conv_id int, turn_no int, question string, answer string"
    large = spark.createDataFrame([(1, 2, "b", "B"), (1, 3, "😀" * 100, "C")], schema)
    blank = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", " "), (1, 3, "c", "C")], schema)
    assert tuple(conversation.fit_recent(large, 6, 110).first())[1:] == ([], 3)
    assert tuple(conversation.fit_recent(blank, 6, 1000).first())[1:] == ([3], 2)


NOW = "2026-09-03 00:00:00"
MEMORIES = [
    (1, 7, "global", "preference", "k1", "c", [], None), (2, 7, "项目A", "project", "k2", "c", ["OCR"], None), (3, 7, "项目B", "project", "k3", "c", ["OCR"], None),
    (4, 8, "global", "preference", "k4", "c", [], None), (5, 7, "global", "preference", "k5", "c", [], "2026-01-01 00:00:00"),
]


@pytest.mark.parametrize(("query", "recent", "ids"), [
    ("项目B的OCR怎么做", None, [3, 1]), ("对比项目A与项目B的OCR", None, [2, 3, 1]), ("普通问题", None, [1]),
    ("它的OCR呢", "介绍项目A", [2, 1]), ("换个话题，项目B的OCR", "介绍项目A", [3, 1]), ("项目B的这个OCR怎么做", "介绍项目A", [3, 1]),
])
def test_recall(spark, query, recent, ids):
    m = spark.createDataFrame(MEMORIES, "id long, user_id long, scope string, kind string, key string, content string, keywords array<string>, e string")
    m = m.select("*", F.col("e").cast("timestamp").alias("expires_at"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"))
    q = spark.createDataFrame([(1, 7, query, recent, recent is not None, [])], "question_id long, user_id long, query string, recent string, has_recent boolean, topics array<string>")
    got = conversation.recalled(m, q, 1500, F.lit(NOW).cast("timestamp")).orderBy("place").collect()
    assert [r["memory_id"] for r in got] == ids


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "plan_id int, step_id int, rank int, owner string, file_md5 string, document_id long, version string, chunk_key string, chunk int")


def test_fusion_with_pins(spark):
    rows = [(1, k + 1, "1", "a", 1, "v", f"a{k}", k) for k in range(5)] + [(2, k + 1, "1", "b", 2, "v", f"b{k}", k) for k in range(5)]
    third = [(3, 1, "9", "z", 3, "v", "bridge", 0)] + [(3, k + 2, "9", "z", 3, "v", f"z{k}", k + 1) for k in range(7)]
    pins = hits(spark, [third[-1]]).select("plan_id", *fusion.IDENTITY, F.lit(1).alias("pin_order"))
    got = fusion.selected(hits(spark, rows + third), pins).orderBy("number").collect()
    assert len(got) == 12 and got[0]["chunk"] == 7 and got[1]["file_md5"] == "a" and got[2]["file_md5"] == "b"
    assert fusion.selected(hits(spark, rows), pins).count() == 10 and BY_PLAN.split(", ") == fusion.IDENTITY


def test_containment_equals_all_pairs(spark):
    """Made spans over several strides, nulls, empty blocks, ties, repeated rows and clashing columns."""
    rng = random.Random(3)
    schema = "span_id long, doc long, block_id string, page_no int, start int, end int, reach int"

    def made(n):
        out = []
        for k in range(n):
            start = rng.choice([rng.randrange(50), rng.randrange(1 << 13), rng.randrange(1 << 24), 2**31 - 600 + rng.randrange(300), -rng.randrange(5000)])
            out.append((k, rng.choice([1, 1, 1, 2, None]), rng.choice(["b", "b", "b", "c", "", None]), rng.choice([None, 0, 3]), start, start + rng.randrange(200), 0))
        return [*out, out[0], (n, 1, "b", None, None, 3, 0), (n + 1, 1, "b", None, 3, None, 0), (n + 2, 1, "b", None, 0, 2**31 - 1, 0)]

    inner, outer = made(800), [r for r in made(500) if r[4] != 0]
    for o in (outer, [*outer, (9, 1, "b", 0, 40, 1 << 23, 0)], []):
        want = sorted(i[0] for i in inner if None not in (i[1], i[2], i[4], i[5]) and i[2] and any(x[1:4] == i[1:4] and None not in x[4:6] and x[4] <= i[4] and x[5] >= i[5] for x in o))
        got = fusion.contained(spark.createDataFrame(inner, schema), spark.createDataFrame(o, schema))
        assert sorted(r["span_id"] for r in got.collect()) == want and got.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_fusion_counts_a_step_once_and_keeps_gaps(spark):
    rows = [(1, 1, "1", "a", 1, "v", "x", 0), (1, 2, "1", "a", 1, "v", "x", 0), (1, 3, "1", "a", 1, "v", "y", 1)]
    got = {r["chunk_key"]: r["score"] for r in fusion.fused(hits(spark, rows)).collect()}
    assert got == {"x": round(1 / 61, 12), "y": round(1 / 63, 12)}


def test_versioned_access(spark):
    files = spark.createDataFrame([(1, 5, "m", "f", 1), (2, 6, "m", "f", 1), (3, 5, "n", "f", 3)], "id long, user_id long, file_md5 string, file_name string, status int")
    states = spark.createDataFrame([(1, 5, "v1", "ready"), (2, 6, "", "parsing"), (3, 5, "v1", "ready")], "document_id long, user_id long, active_version string, status string")
    rows = [(1, "v1", 5, "m"), (1, "", 5, "m"), (0, "v1", 5, "m"), (1, "v2", 5, "m"), (1, "v1", 6, "m"), (4, "v1", 5, "m"), (2, "v1", 6, "m"), (3, "v1", 5, "n")]
    got = access.gated(spark.createDataFrame(rows, "document_id long, version string, user_id long, file_md5 string"), files, states).collect()
    assert [tuple(r) for r in got] == [(1, "v1", 5, "m")]


def test_tags_with_cycles_and_orphans(spark):
    tags = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "gone"), ("R", None), ("S", "R"), ("E", "")], "tag_id string, parent_tag string").withColumn("name", F.col("tag_id"))
    users = spark.createDataFrame([(1, "A, S"), (2, "D,unknown"), (3, ""), (4, None)], "id long, org_tags string")
    got = {(r["user_id"], r["tag"]) for r in access.effective_tags(users, tags).collect()}
    assert got == {(1, x) for x in "ABCSR"} | {(2, x) for x in ("D", "gone", "unknown")}
    assert {r["path"] for r in access.tag_paths(tags).collect()} == {"R", "R/S", "E"}


def test_parents_share_one_budget(spark):
    h = spark.createDataFrame([(1, 1, 1, "v", "p0", 7), (1, 2, 1, "v", "p1", 7), (1, 3, 1, "v", "p0", 7)], "query_id int, rank int, document_id long, version string, parent_id string, user_id long")

    def attached(bodies):
        places = "source_spans array<struct<block_id:string,page_no:int,start:int,end:int>>, row_range array<int>, column_paths array<array<string>>"
        p = spark.createDataFrame([(1, "v", f"p{k}", 7, True, "", b, [("b0", None, 0, 1)], None, None) for k, b in enumerate(bodies)], f"document_id long, version string, chunk_id string, user_id long, is_parent boolean, context_prefix string, body_text string, {places}")
        return [r["parent_text"] is not None for r in retrieval.attach_parents(h, p).orderBy("rank").collect()]

    assert attached(["x" * 2000, "y" * 2000]) == [True, False, True]
    assert attached(["中" * 1001, "y"]) == [False, True, False]


def test_evidence_drops_parents_then_low_results(spark):
    item = "array<struct<id:string,cost:long,parent:string,parent_cost:long,mandatory:boolean>>"
    names = [("parent", True), ("low", False), ("bridge", True), ("child", True), ("lowest", False)]
    rows = [(1, [(n, 1, "q" if k < 2 else "", 5, m) for k, (n, m) in enumerate(names)], 0)]
    df = spark.createDataFrame(rows, f"case_id int, items {item}, base long")
    assert tuple(fusion.fitted(df, 10).first())[1:] == ([n for n, _ in names], ["q"], True)
    assert tuple(fusion.fitted(df, 5).first())[1:] == ([n for n, _ in names], [], True)
    assert tuple(fusion.fitted(df, 3).first())[1:] == (["parent", "bridge", "child"], [], True)
    assert not fusion.fitted(df, 2).first()["fits"]


def test_covering_parents(spark):
    span = "array<struct<block_id:string,page_no:int,start:int,end:int>>"
    rows = [("xay", [("b", None, 0, 3)], "a", [("b", None, 1, 2)], True), ("xay", [("b", 1, 0, 3)], "a", [("b", None, 1, 2)], False), ("xay", [("b", None, 0, 3)], "z", [("b", None, 1, 2)], False), ("xay", [("b", None, 0, 3)], "a", [], False)]
    df = spark.createDataFrame(rows, f"p string, ps {span}, t string, s {span}, want boolean")
    assert all(r[0] == r[1] for r in df.select(fusion.covers(F.col("p"), F.col("ps"), F.col("t"), F.col("s")), "want").collect())


def test_publication_keeps_the_active_version_on_failure(spark):
    log = [("begin", "v1"), ("publish", "v1"), ("stage", "v1"), ("publish", "v1"), ("begin", "v2"), ("stage", "v1"), ("fail", "v2")]
    events = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(log)], "document_id long, seq long, kind string, version string")
    assert tuple(lifecycle.folded(events).first()) == (1, "v1", "v2", "failed")


def test_page_box(spark):
    args = [F.lit(float(x)) for x in (10, 80, 60, 20, 100, 100)]
    assert value(spark, T.page_box(*args, F.lit(True))) == [0.1, 0.2, 0.6, 0.8]
    assert value(spark, T.page_box(*args[:4], F.lit(0.0), F.lit(0.0), F.lit(True))) is None


def test_plans_in_two_layers(spark):
    plans = spark.createDataFrame([("a", [(1, "who", []), (2, "age of {{step:1}}", [1])]), ("b", [(1, "none", [])]), ("c", [(1, "none", []), (2, "x {{step:1}}", [1])])], f"plan_id string, steps array<{planning.STEP}>")
    bindings = spark.createDataFrame([("a", 2, False, None, [("s1:1", "is Anna", "Anna")])], "plan_id string, step_id int, no_evidence boolean, clarification string, evidence array<struct<source_id:string,quote:string,value:string>>")

    def search(questions, top_k):
        answers = spark.createDataFrame([("who", "she is Anna"), ("age of Anna", "forty")], "question string, text string")
        return questions.join(answers, "question").select("plan_id", "step_id", F.lit(1).alias("rank"), "text")

    status, found = planning.execute(plans, bindings, search)
    assert {tuple(r) for r in status.collect()} == {("a", 1, "retrieved"), ("a", 2, "retrieved"), ("b", 1, "empty"), ("c", 1, "empty"), ("c", 2, "blocked_no_evidence")}
    assert {(r["plan_id"], r["text"]) for r in found.collect()} == {("a", "she is Anna"), ("a", "forty")}


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"alpha")
    (tmp_path / "in/sub/b.txt").write_bytes(b"alpha")
    (tmp_path / "in/d.docx").write_bytes(b"PK\x03\x04 broken")
    good, bad = S.guarded(S.read_files(spark, str(tmp_path / "in")))
    assert {r["file_name"] for r in good.collect()} == {"a.txt", "b.txt"}
    assert {(r["file_name"], r["fault"]) for r in bad.collect()} == {("d.docx", "broken archive")}
    none = spark.createDataFrame([("c.txt", 0, b""), ("e.txt", 9, b"123456789")], "file_name string, size long, content binary")
    assert {(r["file_name"], r["fault"]) for r in S.guarded(none, most=5)[1].collect()} == {("c.txt", "empty"), ("e.txt", "too large")}
    known = spark.createDataFrame([("x", 1, 1)], "file_md5 string, status int, user_id long")
    assert S.to_import(good, known, 1).count() == 1
    rows = spark.createDataFrame([(str(k), f"text {k}") for k in range(70)], "vector_id string, embedding_text string")
    out = S.embedded(rows, lambda: S.hashing_embedder(16), "m1", 16)
    assert out.count() == 70 and out.where(F.size("vector") != 16).count() == 0
    at = str(tmp_path / "index")
    assert S.append_index(out, at, 16).count() == 70
    with pytest.raises(ValueError, match="index"):
        S.append_index(out, at, 8)
    with pytest.raises(RuntimeError, match="acknowledge"):
        S.append_index(out, at, 16)  # a second time: ids are there twice
    assert S.acknowledged(rows, out).count() == 0 and S.acknowledged(rows, out.limit(60)).count() == 10


def test_stream_retries_and_records_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"document_id":1,"user_id":1,"file_md5":"m","version":"v1"}', '{"document_id":1,"user_id":1,"file_md5":"m","version":"v1"}', "broken", '{"document_id":2,"user_id":1,"file_md5":"m","version":"v1"}']
    (tmp_path / "in/1.txt").write_text("\n".join(lines))
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("not yet")
        return df.select("document_id", "version")

    def run(work, name):
        stream = spark.readStream.text(str(tmp_path / "in"))
        tasks.consume(stream, work, str(tmp_path / "done"), str(tmp_path / f"failed-{name}"), str(tmp_path / f"check-{name}")).awaitTermination()

    run(flaky, "a")
    assert len(calls) == 3 and sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [1, 2]
    run(lambda df: df.select("document_id", "version"), "b")  # delivered again: nothing new
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2


def test_stream_failure_is_terminal_and_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text('{"document_id":3,"user_id":1,"file_md5":"m","version":"v1"}')

    def broken(df):
        raise RuntimeError("never")

    tasks.consume(spark.readStream.text(str(tmp_path / "in")), broken, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "check")).awaitTermination()
    assert [(r["document_id"], r["error"]) for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [(3, "never")]


def test_stream_parts_tasks_that_fail_together(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, ids in (("1", range(1, 9)), ("2", range(5, 13))):
        (tmp_path / f"in/{name}.txt").write_text("\n".join(f'{{"document_id":{k},"user_id":1,"file_md5":"m","version":"v1"}}' for k in ids))

    def picky(df):
        bad = [r["document_id"] for r in df.where("document_id in (3, 10)").collect()]
        if bad:
            raise RuntimeError(f"{bad[0]} is bad")
        return df.select("document_id", "version")

    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    tasks.consume(stream, picky, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "check"), attempts=2).awaitTermination()
    assert sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [k for k in range(1, 13) if k not in (3, 10)]
    assert sorted((r["document_id"], r["error"]) for r in spark.read.parquet(str(tmp_path / "failed")).collect()) == [(3, "3 is bad"), (10, "10 is bad")]


def test_stream_of_whole_uploads(spark, tmp_path):
    rows = [(1, 1, "part", 0, 2, 0), (1, 2, "merge", 0, 2, 1), (1, 3, "part", 0, 2, 2), (1, 4, "part", 1, 2, 3), (1, 5, "part", 5, 2, 3), (1, 6, "merge", 0, 2, 10), (1, 7, "merge", 0, 2, 20), (1, 8, "part", 1, 2, 21), (1, 9, "corrupt", 0, 2, 30)]
    rows += [(1, 10, "merge", 0, 2, 31), (1, 11, "part", 1, 2, 32), (1, 12, "part", 0, 2, 33), (1, 13, "merge", 0, 2, 40), (1, 14, "merge", 0, 2, 40 + 300_000), (1, 15, "verified", 0, 2, 300_100), (1, 16, "part", 0, 2, 300_101), (1, 17, "delete", 0, 2, 300_102), (1, 18, "merge", 0, 2, 300_103)]
    names = "document_id long, seq long, kind string, chunk_index int, total int, at long"
    for k in range(0, len(rows), 6):
        spark.createDataFrame(rows[k : k + 6], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    tasks.uploads(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = [(r["outcome"], r["uploaded"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [
        ("part", 1), ("incomplete", 1), ("replaced", 1), ("part", 2), ("rejected", 2), ("merging", 2), ("busy", 2), ("rejected", 2), ("reset", 0), ("incomplete", 0), ("part", 1), ("part", 2), ("merging", 2), ("merging", 2), ("complete", 2), ("complete", 2),
        ("deleting", 2), ("rejected", 2),
    ]


def test_converted_files(spark):
    answers = {b"a": (200, b"<p>x</p>"), b"b": (302, b""), b"c": (500, b""), b"d": (200, b"<p>" + b"x" * 100)}
    parse = S.converted(answers.get, most=50)
    assert [b["text"] for b in parse(b"a").blocks] == ["x"]
    for bad in (b"b", b"c", b"d"):
        with pytest.raises(ValueError, match="converter"):
            parse(bad)


def test_artifacts_have_keys_and_digests(spark, tmp_path):
    from tessera.operators import chunking

    files = spark.createDataFrame([(1, "a.txt", b"alpha"), (2, "b.txt", b"beta")], "document_id long, file_name string, content binary")
    parsed = chunking.parse_and_chunk(files).withColumn("user_id", F.lit(7))
    got = {r["document_id"]: r for r in S.write_artifacts(parsed, str(tmp_path / "ir"), "v1").collect()}
    assert got[1]["key"] == "document-ir/7/1/v1/ir.json" and len(got[1]["sha256"]) == 64 and got[1]["sha256"] != got[2]["sha256"]
    S.append_chunks(chunking.chunk_rows(parsed), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4
    with pytest.raises(ValueError, match="identity"):
        S.append_chunks(chunking.chunk_rows(parsed).withColumn("chunk_id", F.lit("other")), str(tmp_path / "chunks"))


def test_stored_documents_are_read_by_identity(spark, tmp_path):
    from tessera.sources import artifacts

    files = spark.createDataFrame([(1, "a.html", b"<h1>A</h1><table><caption>Tides</caption><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>1</td></tr></table>"), (2, "b.txt", "beta\n\nγ".encode())], "document_id long, file_name string, content binary")
    parsed = chunking.parse_and_chunk(files).withColumn("user_id", F.lit(7))
    at = str(tmp_path / "ir")
    refs = S.write_artifacts(parsed, at, "007").union(S.write_artifacts(parsed.where("document_id = 2"), at, "v2").withColumn("document_id", F.lit(9).cast("long")))
    wanted = refs.selectExpr("document_id", "7 as user_id", "case when document_id = 9 then 'v2' else '007' end as version", "shown_sha256")
    wanted = wanted.union(wanted.where("document_id = 2")).union(spark.createDataFrame([(2, 8, "007", "x"), (2, 7, "v2", None), (None, 7, "v2", "x")], wanted.schema))
    got = {(r["document_id"], r["user_id"], r["version"]): (r["text"], r["fault"]) for r in artifacts.stored_previews(spark, at, wanted).collect()}
    assert got[1, 7, "007"][1] is None and got[1, 7, "007"][0].startswith("A\n\nTides\n") and got[1, 7, "007"][0].count("Tides") == 1
    assert got[2, 7, "007"] == ("beta\n\nγ", None)
    assert got[9, 7, "v2"] == got[2, 8, "007"] == got[None, 7, "v2"] == (None, "missing") and got[2, 7, "v2"] == (None, "digest") and len(got) == 6
    answers = artifacts.stored_previews(spark, at, wanted)
    artifacts.set_aside(spark, at, answers, str(tmp_path / "aside"))
    aside = spark.read.parquet(str(tmp_path / "aside")).collect()
    assert [(r["key"], r["fault"], r["version"]) for r in aside] == [("document-ir/7/2/v2/ir.json", "digest", "v2")] and aside[0]["children"]
    assert artifacts.stored_previews(spark, at, wanted.limit(0)).count() == 0


def test_blank_blocks_and_captions_in_previews(spark):
    block = "text string, table_id string, table_caption string"
    rows = [(1, [("\u3000\n\t", None, None), ("a", None, None), ("r1", "t0", "C"), ("r2", "t0", "C"), ("r3", "t1", "C")]), (2, [])]
    got = dict(chunking.preview(spark.createDataFrame(rows, f"document_id long, blocks array<struct<{block.replace(' string', ':string')}>>")).collect())
    assert got == {1: "a\n\nC\nr1\n\nr2\n\nC\nr3", 2: ""}


def stored_tables(spark, root, documents=40, buckets=8):
    tables = store.Tables(spark, str(root), buckets)
    ids = spark.range(documents)
    tables.write("files", ids.select("id", (F.col("id") % 5).alias("user_id"), F.when(F.col("id") == 3, 3).otherwise(1).alias("status")))
    tables.write("chunks", ids.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit("p0"), F.lit("c0"))).alias("chunk_id"), F.lit(None).cast("int").alias("_note")))
    tables.write("objects", ids.select(F.explode(F.array(T.part_key(F.col("id") % 5, F.col("id"), F.lit(0)), T.artifact_key(F.col("id") % 5, F.col("id"), F.lit("v1")))).alias("key")))
    tables.write("outbox", spark.createDataFrame([], "document_id long, attempts int"))
    return tables


def test_deletion_rewrites_its_buckets_alone(spark, tmp_path):
    """Files of other buckets keep their names, a reader of the table before finishes, and a table may become empty."""
    tables = stored_tables(spark, tmp_path)
    names = ("files", "chunks", "objects")
    before = {n: set(tables.read(n).inputFiles()) for n in names}
    reader = tables.read("chunks")
    requests = spark.createDataFrame([(7, 2, "USER"), (8, 4, "USER"), (99, 0, "ADMIN"), (None, 0, "ADMIN")], "document_id long, by_user long, role string")
    store.delete_documents(tables, requests)  # 8 isn't its owner's request; 3 was marked before
    touched = {f"_bucket={b}/" for b in tables.touched(spark.createDataFrame([(3,), (7,)], "document_id long"))}
    for n in names:
        after = set(tables.read(n).inputFiles())
        rewritten = before[n] - after
        assert rewritten and all(any(b in f for b in touched) for f in rewritten | (after - before[n]))
    left = sorted(set(range(40)) - {3, 7})
    assert sorted(r["id"] for r in tables.read("files").collect()) == left
    assert sorted({r["document_id"] for r in tables.read("chunks").collect()}) == left and tables.read("chunks").count() == 2 * len(left)
    assert tables.read("objects").count() == 2 * len(left) and tables.read("outbox").count() == 0
    assert reader.count() == 80
    store.delete_documents(tables, tables.read("files").selectExpr("id as document_id", "user_id as by_user", "'USER' as role"))
    assert tables.read("files").count() == tables.read("chunks").count() == tables.read("objects").count() == 0
    assert tables.read("chunks").columns == ["document_id", "chunk_id", "_note"]


def test_a_deletion_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    tables, whole = stored_tables(spark, tmp_path), store.without_prefixes
    monkeypatch.setattr(store, "without_prefixes", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.delete_documents(tables, spark.createDataFrame([(7, 2, "USER")], "document_id long, by_user long, role string"))
    assert tables.read("files").where("status = 3").count() == 2 and tables.read("chunks").count() == 80
    monkeypatch.setattr(store, "without_prefixes", whole)
    store.delete_documents(tables, spark.createDataFrame([], "document_id long, by_user long, role string"))
    assert tables.read("files").count() == 38 and tables.read("chunks").count() == tables.read("objects").count() == 76


def test_a_missing_user_fails_the_request(spark):
    turns = spark.createDataFrame([(1, 7), (2, 8)], "turn_id long, user_id long")
    users = spark.createDataFrame([(7, "ana")], "id long, username string")
    assert [r["username"] for r in conversation.with_users(turns.where("user_id = 7"), users).collect()] == ["ana"]
    with pytest.raises(Exception, match="no user 8"):
        conversation.with_users(turns, users).collect()


def test_text_rules(spark):
    from tessera.functions import text as X

    row = spark.createDataFrame([("a,b , c", "x" * 1200)], "t string, long string")
    got = row.select(X.has_tag(F.col("t"), F.lit("b")), X.has_tag(F.col("t"), F.lit("d")), F.length(X.error_text(F.col("long"))), X.shortened(F.col("t"), 3), X.shortened(F.col("t"), 30)).first()
    assert tuple(got) == (True, False, 1000, "a,b…", "a,b , c")
    keyed = tasks.keyed(spark.createDataFrame([(5, 7, "m", "v1")], tasks.TASK)).first()
    assert keyed["key"] == "7:5:m" and '"document_id":5' in keyed["value"]
    refs = spark.range(1001).select(F.col("id").alias("document_id"), F.lit("v").alias("version"), F.lit("p").alias("chunk_id"))
    assert access.too_many_refs(refs) and not access.too_many_refs(refs.limit(1000))
    late = lifecycle.retried(spark.createDataFrame([(1, 2)], "document_id long, attempts int"), F.lit("2026-01-01 00:00:00").cast("timestamp")).first()
    assert late["attempts"] == 3 and str(late["available_at"]) == "2026-01-01 00:00:08" and late["lease_token"] is None


def test_stream_of_leases(spark, tmp_path):
    import time

    source, seen = tmp_path / "in", []
    source.mkdir()

    def give(name, *rows):
        (tmp_path / "part").write_text("".join(f"{document},{kind}\n" for document, kind in rows))
        (tmp_path / "part").rename(source / name)

    def wait(row):
        end = time.time() + 60
        while row not in seen and time.time() < end:
            time.sleep(0.1)
        assert row in seen

    give("a", (1, "enqueue"), (1, "enqueue"), (2, "enqueue"), (3, "ack"))
    events = spark.readStream.schema("document_id long, kind string").csv(str(source))
    query = tasks.leases(events, lease_ms=20_000).writeStream.foreachBatch(lambda rows, _: seen.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        wait((2, "claim", 0))
        give("b", (1, "ack"), (2, "fail"))
        wait((2, "retry", 1))
        wait((2, "claim", 1))  # after the backoff, without an attempt more
        give("c", (2, "enqueue"))  # changes nothing, its timer least of all
        wait((2, "expired", 2))  # nobody answered the second lease
    finally:
        query.stop()
    assert seen.count((1, "claim", 0)) == 1 and (1, "ack", 0) in seen
    assert not any(r[0] == 3 for r in seen) and (2, "claim", 2) in seen


@pytest.mark.parametrize(
    "text",
    [
        "", "not JSON", "null", "[]", "5", "{}{}", '{"steps":[]} x', "```json\n{}\n```", '{"standalone_question":"q","steps":[],"extra":1}', "x" * 17_000, '{"standalone_question":"q","steps":[{"id":1,"question":"a"}]}' + " " * 16_384,
        '{"standalone_question":5}', '{"standalone_question":"q","steps":{}}', '{"standalone_question":"q","steps":[{"id":"1","question":"a"}]}', '{"standalone_question":"q","steps":[{"id":1.0,"question":"a"}]}', '{"standalone_question":"q","steps":[{"id":true,"question":"a"}]}',
        '{"standalone_question":"q","steps":[{"id":1,"question":["a"]}]}', '{"standalone_question":"q","steps":[{"id":1,"question":"a","depends_on":[1.0]}]}', '{"standalone_question":"q","steps":[{"id":NaN,"question":"a"}]}', '{"standalone_question":"q","steps":[{"id":99999999999,"question":"a"}]}', "[" * 9000,
    ],
)
def test_what_is_no_plan_is_refused(spark, text):
    got = planning.parsed_plans(spark.createDataFrame([(1, text), (2, '{"standalone_question":"q","steps":[{"id":1,"question":"a"}]} \n'), (3, None)], "plan_id long, json string")).orderBy("plan_id").collect()
    assert got[0]["plan"] is None and got[1]["plan"]["steps"][0]["id"] == 1 and got[2]["plan"] is None


def staged(spark, folder, rows):
    return spark.createDataFrame([(i, f"d{i}.txt", t.encode()) for i, t in rows], "document_id long, file_name string, content binary")


def test_batches_of_one_version_and_reruns_keep_what_others_published(spark, tmp_path):
    held = store.Versions(spark, str(tmp_path))
    run = lambda rows, version, index=lambda c: c: held.process(staged(spark, tmp_path, rows), chunking.parse_and_chunk, index, version)
    said = lambda: {r["document_id"]: r["data"]["body_text"] for r in held.readable().where("is_parent").collect()}
    run([(1, "one"), (2, "two")], "007")
    run([(3, "three")], "007")
    assert said() == {1: "one", 2: "two", 3: "three"} and {r["version"] for r in held.readable().collect()} == {"007"}
    run([(2, "two again")], "007")
    assert said() == {1: "one", 2: "two again", 3: "three"}
    run([(1, "never whole")], "007", lambda c: c.where("false"))
    assert said()[1] == "one"
    before = {(r["document_id"], r["active_version"], r["status"]) for r in held.states().collect()}
    assert before == {(1, "007", "failed"), (2, "007", "ready"), (3, "007", "ready")}
    held.snapshot()
    assert {(r["document_id"], r["active_version"], r["status"]) for r in held.states().collect()} == before
    reader = held.readable()
    assert len(held.discard()) == 2 and held.chunks().select("document_id").distinct().count() == 3
    assert reader.count() > 0 and said() == {1: "one", 2: "two again", 3: "three"}
    held.snapshot()
    assert held.discard() == [] and said() == {1: "one", 2: "two again", 3: "three"}


def test_a_run_that_dies_while_it_discards_loses_nothing(spark, tmp_path, monkeypatch):
    held = store.Versions(spark, str(tmp_path))
    batch = held.process(staged(spark, tmp_path, [(1, "one"), (2, "two")]), chunking.parse_and_chunk, lambda c: c.where("document_id = 1"), "v")
    whole = store.names_in
    # the second generation was begun, and never finished
    held.chunks().where("false").write.parquet(str(tmp_path / "chunks" / batch / "g1"))
    (tmp_path / "chunks" / batch / "g1" / "_SUCCESS").unlink()
    assert [r["document_id"] for r in held.readable().select("document_id").distinct().collect()] == [1]
    assert held.discard() == [batch] and [r["document_id"] for r in held.chunks().select("document_id").distinct().collect()] == [1]
    monkeypatch.setattr(store, "remove", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        held.discard()
    assert [r["document_id"] for r in held.readable().select("document_id").distinct().collect()] == [1] and whole is store.names_in


def test_chunks_without_an_identity_are_not_staged(spark, tmp_path):
    good = spark.createDataFrame([(1, "v1", "c0", "p0", ("c0", "p0"))], "document_id long, version string, chunk_id string, parent_id string, data struct<chunk_id:string,parent_id:string>")
    S.append_chunks(good, str(tmp_path / "c"))
    for bad in ("null as chunk_id", "'c1' as chunk_id", "repeat('c', 129) as chunk_id"):
        rows = good.selectExpr("document_id", "version", bad, "parent_id", "data")
        with pytest.raises(ValueError, match="identity"):
            S.append_chunks(rows, str(tmp_path / "c"))


def test_ancestors_of_chains_cycles_and_several_parents_are_written_once(spark, monkeypatch):
    from tessera.operators import access

    chain = [(f"c{k}", f"c{k - 1}") for k in range(1, 70)] + [("c0", None)]
    others = [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), ("d", "c"), ("m", "c3"), ("m", "a"), ("m", "gone"), ("r", "")]
    rows = [0]
    plain = access.written

    def counting(df, what):
        out = plain(df, what)
        rows[0] += out.count()
        return out

    monkeypatch.setattr(access, "written", counting)
    got = [tuple(r) for r in access.ancestors(spark.createDataFrame(chain + others, "tag_id string, parent_tag string")).collect()]
    up = {}
    for tag, parent in chain + others:
        if parent:
            up.setdefault(tag, set()).add(parent)
    want = set()
    for tag in up:
        seen, todo = set(), {tag}
        while todo:
            todo = {p for t in todo for p in up.get(t, ())} - seen
            seen |= todo
        want |= {(tag, x) for x in seen | {tag}}
    assert len(got) == len(set(got)) and set(got) == want
    assert rows[0] < 1.5 * len(want)


def test_embedded_rows_leave_a_task_in_small_batches(spark):
    # how many rows a task holds shows in the batches that leave it
    rows = spark.createDataFrame([(k, "a b" if k % 3 else None) for k in range(100)], "id long, embedding_text string").coalesce(1)
    made = S.embedded(rows, lambda: S.hashing_embedder(4), "m", 4)
    assert made.columns == ["id", "embedding_text", "vector", "model_version"] and made.count() == 100
    got = {r["id"]: r["vector"] for r in made.collect()}
    plain = S.hashing_embedder(4)(["a b", ""])
    assert all(got[k] == plain[0 if k % 3 else 1].tolist() for k in range(100))
    assert "MapInArrow" in made._jdf.queryExecution().toString()


def test_bindings_are_dealt_so_that_no_task_s_share_grows(spark, monkeypatch):
    # parts were joined by their compressed bytes: one task held as many plans as compress well
    monkeypatch.setattr("tessera.session.ROWS_A_TASK", 250)
    ids = spark.range(3000).withColumnRenamed("id", "plan_id")
    step = (F.col("plan_id") % 2 + 2).cast("int")
    pending = ids.select("plan_id", step.alias("step_id"), F.lit("of {{step:1}}").alias("question"), F.array(F.lit(1)).alias("depends_on"))
    sources = ids.select("plan_id", F.concat(F.lit("s"), (F.col("plan_id") % 3).cast("string")).alias("source_id"), F.lit(1).alias("step_id"), F.lit("the Anna").alias("text"))
    evidence = F.array(F.struct(F.concat(F.lit("s"), (F.col("plan_id") % 3).cast("string")).alias("source_id"), F.lit("Anna").alias("quote"), F.lit("Anna").alias("value")))
    bindings = ids.select("plan_id", step.alias("step_id"), (F.col("plan_id") % 2 == 0).alias("no_evidence"), F.lit(None).cast("string").alias("clarification"), evidence.alias("evidence"))
    for out, rows in ((planning.binding_faults(pending, sources, bindings), 1500), (planning.bound_questions(pending, sources, bindings), 1500)):
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == rows and max(held) < 300


def test_parents_texts_are_not_sorted_with_hits_and_parts_are_bounded(spark, monkeypatch):
    # every hit was sorted with its parent's text before it was known which fit
    monkeypatch.setattr("tessera.session.ROWS_A_TASK", 250)
    hits = spark.range(3000).select(F.floor(F.col("id") / 3).alias("query_id"), (F.col("id") % 3 + 1).cast("int").alias("rank"), F.lit(1).cast("long").alias("document_id"), F.lit("v").alias("version"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("parent_id"), F.lit(7).alias("user_id"))
    place = F.array(F.struct(F.lit("b").alias("block_id")))
    parents = spark.range(2).select(F.lit(1).cast("long").alias("document_id"), F.lit("v").alias("version"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("chunk_id"), F.lit(7).alias("user_id"), F.lit(True).alias("is_parent"), F.lit("").alias("context_prefix"), F.repeat(F.lit("x"), F.lit(60)).alias("body_text"), place.alias("source_spans"), F.array(F.lit(1)).alias("row_range"), F.array().cast("array<array<string>>").alias("column_paths"))
    out = retrieval.attach_parents(hits, parents, budget=100)
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 3000 and max(held) < 500
    assert out.groupBy("query_id").agg(F.count("parent_text").alias("n")).where("n < 1 or n > 2").isEmpty()


def test_spans_are_dealt_so_that_no_task_s_share_grows(spark, monkeypatch):
    # parts were joined by their compressed bytes
    monkeypatch.setattr("tessera.session.ROWS_A_TASK", 250)
    spans = spark.range(3000).select("id", F.floor(F.col("id") / 4).alias("doc"), F.lit("b").alias("block_id"), F.lit(1).alias("page_no"), (F.col("id") % 4).cast("int").alias("start"), F.lit(9).alias("end"))
    out = fusion.contained(spans.where("id % 2 = 1"), spans.where("id % 2 = 0"))
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 1500 and max(held) < 400


def test_a_document_s_text_is_stored_as_artifact_and_as_chunks_that_share_it(spark, tmp_path):
    rng = random.Random(3)
    texts = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(900))) for k in range(40)]
    held = store.Versions(spark, str(tmp_path))
    held.process(staged(spark, tmp_path, texts), chunking.parse_and_chunk, lambda c: c, "v1")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 2.2 * sum(len(t) for _, t in texts)  # seven copies were 7.9 times the text
    got = {r["document_id"]: r for r in held.chunks().where("is_parent").collect()}
    assert {k: got[k]["data"]["body_text"] for k, _ in texts} == dict(texts)
    kept = spark.read.parquet(str(tmp_path / "artifacts")).select("document.document_id", F.col("document.blocks")[0]["text"]).collect()
    assert {tuple(r) for r in kept} == set(texts)


def test_chunks_are_read_as_they_were_given(spark, tmp_path):
    held = store.Versions(spark, str(tmp_path))

    def parse(files):
        rows = chunking.parse_and_chunk(files)
        text = F.when(F.col("document_id") == 2, "other").when(F.col("document_id") != 3, F.col("children")[0]["embedding_text"])
        return rows.withColumn("children", F.transform("children", lambda c: c.withField("embedding_text", text)))

    files = staged(spark, tmp_path, [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "")])
    rows = lambda c: sorted(map(repr, c.select("document_id", "version", "chunk_id", "parent_id", "is_parent", "data").collect()))
    given, seen = chunking.chunk_rows(parse(files), "007"), []
    held.process(files, parse, lambda c: seen.append(rows(c)) or c.where("document_id <> 4"), "007")
    assert seen == [rows(given)] and len(seen[0]) == 8
    assert held.discard() and rows(held.chunks()) == rows(given.where("document_id <> 4"))
    # nothing could be parsed
    batch = held.process(staged(spark, tmp_path, [(6, "")]), chunking.parse_and_chunk, lambda c: c, "008")
    assert held.chunks().where(F.col("batch") == batch).count() == 0 and {r["document_id"]: r["status"] for r in held.states().collect()}[6] == "failed"


def test_rows_stay_by_documents_however_they_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "document_id long, t string")
    kept = spark.createDataFrame([(2,), (3,), (3,), (9,), (None,)], "document_id long")
    for most, way in ((10, "LeftAnti"), (3, "LeftAnti"), (0, "LeftSemi")):
        monkeypatch.setattr(store, "SHOWN_TO_ALL", most)
        got = store.of_documents(rows, kept)
        assert sorted(r["t"] for r in got.collect()) == ["b", "c", "d"] and way in got._jdf.queryExecution().analyzed().toString()


def test_setting_documents_aside_moves_few_but_the_faulty_ones(spark, tmp_path):
    from tessera.sources import artifacts

    def moved():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        none = spark._jvm.java.util.ArrayList
        stages = context.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.length()))

    rng = random.Random(5)
    texts = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(300))) for k in range(200)]
    parsed = chunking.parse_and_chunk(staged(spark, tmp_path, texts)).withColumn("user_id", F.lit(7))
    refs = S.write_artifacts(parsed, str(tmp_path / "ir"), "v1")
    wanted = refs.selectExpr("document_id", "7 as user_id", "'v1' as version", "if(document_id % 50 = 0, 'other', shown_sha256) as shown_sha256")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many faults
    try:
        before = moved()
        artifacts.set_aside(spark, str(tmp_path / "ir"), artifacts.stored_previews(spark, str(tmp_path / "ir"), wanted), str(tmp_path / "aside"))
        assert moved() - before < 0.5 * sum(len(t) for _, t in texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    aside = {r["document_id"]: r for r in spark.read.parquet(str(tmp_path / "aside")).withColumn("document_id", F.col("envelope.document_id")).collect()}
    assert {k: (r["fault"], r["blocks"][0]["text"], len(r["children"]) > 0) for k, r in aside.items()} == {k: ("digest", texts[k][1], True) for k in (0, 50, 100, 150)}


def test_documents_too_large_or_repeated_are_named_before_their_text_is_read(spark, tmp_path, monkeypatch):
    from tessera.sources import artifacts

    monkeypatch.setattr(artifacts, "MOST_BYTES", 10)
    parsed = chunking.parse_and_chunk(staged(spark, tmp_path, [(1, "short"), (2, "much longer than that"), (3, "twice")])).withColumn("user_id", F.lit(7))
    at = str(tmp_path / "ir")
    refs = S.write_artifacts(parsed, at, "v1").selectExpr("document_id", "7 as user_id", "'v1' as version", "shown_sha256")
    spark.read.parquet(f"{at}/version=v1").where("document_id = 3").write.mode("append").parquet(f"{at}/version=v1")
    got = {r["document_id"]: (r["text"], r["fault"]) for r in artifacts.stored_previews(spark, at, refs).collect()}
    assert got == {1: ("short", None), 2: (None, "too large"), 3: (None, "repeated")}
