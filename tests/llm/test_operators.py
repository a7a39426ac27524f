"""Operators of training data against plain versions, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chosenpath, components, cotraining, hilbert, langid, matroska, mixing, packing, queries, substrings, toxicity, wordpiece
from tessera.llm.common import materialize

from ..oracle import check, connect
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, on columns they must ignore
CLASHES = ["key", "node", "size", "score", "bucket", "part", "copy", "pos", "known", "side", "target", "label", "words", "ids", "at"]


def odd_documents():
    """Nulls, empty and blank texts, repeated rows and texts, other scripts, a long text."""
    rng = random.Random(4)
    base = [" ".join(rng.choice("the of and thing one two three und der la de que".split()) + str(rng.randrange(40)) for _ in range(n)) for n in (3, 4, 5, 21, 60, 400)]
    texts = [None, "", "  \n\t ", "a", "¿¡ — 12", "漢字 漢字 text", *base, *base, base[4] + " tail", "x " + base[5], " ".join([base[5]] * 12), "und " * 50, "don't it's 'tis x"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "", "s1", "s2"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[8:11]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# language ID


def test_posteriors_are_those_of_the_plain_recursion():
    rng = np.random.default_rng(0)
    scores, a = rng.normal(size=(300, 4)) * 2, rng.normal(size=(4, 4))
    at = np.array([0, 1, 1, 33, 97, 300])
    got = langid.posteriors(scores, at, a)
    for x, y in zip(at[:-1], at[1:], strict=True):
        e, t, n = np.exp(scores[x:y]), np.exp(a), y - x
        ahead, v = np.zeros((n, 4)), np.full(4, 0.25)
        for k in range(n):
            v = (v @ t) * e[k]
            v /= v.sum()
            ahead[k] = v
        b = np.ones(4)
        for k in range(n - 1, -1, -1):
            p = ahead[k] * b
            np.testing.assert_allclose(got[x + k], p / p.sum(), atol=1e-12)
            b = t @ (b * e[k])
            b /= b.sum()


def test_languages_of_held_out_documents(spark, sf_dir):
    found = langid.language_id(documents(spark, sf_dir)).where("held_out").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in found)
    assert len(found) > 50 and right >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_spans_of_switching_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.train(langid.sample(docs, 50, 10))
    by = {r["lang"]: r["text"].lower() for r in docs.where("length(text) > 600 and doc_id % 3 <> 0").select("lang", "text").collect()}
    en, de = " ".join(by["en"].split()[:60]), " ".join(by["de"].split()[:60])
    spans = langid.spans(spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string"), model).orderBy("start").collect()
    border = len(en.encode())
    right = sum(s["words"] for s in spans if s["lang"] == ("en" if s["start"] < border else "de"))
    assert right >= 0.85 * sum(s["words"] for s in spans)


def test_languages_beyond_the_bound_are_learned_too(spark):
    rows = [(100 * k + i, f"w{k} x{k}", f"l{k}") for k in range(6) for i in range(60 - 9 * k)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 6, 2)
    assert {x for x, _ in got} == {f"l{k}" for k in range(6)} and len(got) <= 12


def test_language_sample_is_bounded_in_bytes(spark):
    """An id given very often counts once, and of a very long text a stretch that follows from the id is learned from."""
    often = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("ein satz "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    long = spark.range(6).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("one more word "), 700_000).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(200, 240).select(F.col("id").alias("doc_id"), F.lit("kurz").alias("text"), F.lit("de").alias("lang"))
    docs = often.union(long).union(few)
    got = langid.sample(docs, 20, 4)
    assert sorted(got) == sorted(langid.sample(docs.repartition(7), 20, 4))
    assert {x for x, _ in got} == {"de", "en"} and sum(x == "de" for x, _ in got) <= 20
    assert sum(t.startswith("ein satz") for _, t in got) <= 1
    assert all(len(t) <= langid.LONGEST and (x != "en" or set(t.split()[1:-1]) == {"one", "more", "word"}) for x, t in got)


def test_sequences_to_learn_from_grow_with_languages(monkeypatch):
    rng, made, whole = random.Random(6), [], langid._switching
    monkeypatch.setattr(langid, "_switching", lambda *args: made.append(whole(*args)) or made[-1])
    names = [f"l{k:02}" for k in range(10)]
    text = lambda x: " ".join(f"{x}{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(60))
    letters = dict(zip(names, ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu"], strict=True))
    model = langid.train([(x, text(letters[x])) for x in names for _ in range(5)])
    lang, _ = made[0]
    assert lang.shape == (64, 375 * len(names))
    found, *_ = langid._documents(pa.array([text(letters[x]) for x in names]), model)
    assert found == names


def test_language_edges(odd, empty):
    got = {r["doc_id"]: r for r in langid.language_id(odd).collect()}
    for i in (0, 1, 2, 4):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[5]["lang_pred"] != "und"
    assert langid.language_id(odd).count() == odd.count()
    assert langid.language_id(empty).count() == 0
    unlabelled = langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlabelled] == [("und", 0.0)]


# token counts


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(8)} for _ in range(2))
        automaton = wordpiece.Automaton(a, b)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(w) == brute.greedy_pieces(w, a, b)


def test_token_counts(odd, empty):
    path = queries.vocabulary()
    starting, continuing = wordpiece.byte_level(path)
    got = sorted(map(tuple, wordpiece.token_counts(odd, path).collect()))
    want = []
    for i, t in texts_of(odd):
        n = [brute.greedy_pieces(w, starting, continuing) for w in brute.words(t)]
        want.append((i, len(n), sum(max(1, k) for k in n), n.count(0)))
    assert got == sorted(want)
    assert wordpiece.token_counts(empty, path).count() == 0


# media columns


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 8192, 8193, 70_000, 600_000])
def test_media_round_trip(n):
    text = random.Random(n).randbytes(n)
    raw = matroska.write(matroska.padded(text))
    got = matroska.parse(raw)
    assert b"".join(raw[s : s + k] for _, _, _, s, k, _, _ in got.packets) == matroska.padded(text)
    assert len(matroska.padded(text)) % 64 == 0 and len(matroska.padded(text)) >= 64
    assert [p for _, _, p in got.cues] == got.clusters and got.tracks[1]["depth"] == 8
    assert [p[2] for p in got.packets] == [k * 128_000_000 for k in range(len(got.packets))]


def test_lacing_of_all_kinds():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(0, 70_000 if rng.random() < 0.1 else 300) for _ in range(rng.randint(2, 9))]
        flag, head = matroska.lace_sizes(sizes)
        assert matroska.laced(head + bytes(sum(sizes)), 0, len(head) + sum(sizes), flag >> 1 & 3)[0] == sizes
        xiph = bytes([len(sizes) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        assert matroska.laced(xiph + bytes(sum(sizes)), 0, len(xiph) + sum(sizes), 1)[0] == sizes


def test_media_unknown_sizes_and_block_groups():
    frame = b"\x81\x00\x05\x00abcd"
    cluster = (0x1F43B675).to_bytes(4, "big") + b"\xff" + matroska.number(0xE7, 10) + matroska.element(0xA0, matroska.element(0xA1, frame))
    raw = matroska.element(0x1A45DFA3, b"") + (0x18538067).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    got = matroska.parse(raw)
    assert [(p[0], p[1], p[2], raw[p[3] : p[3] + p[4]]) for p in got.packets] == [(1, 0, 15_000_000, b"abcd"), (1, 1, 15_000_000, b"abcd")]


def test_media_files_with_deep_or_huge_numbers_are_errors(spark):
    def whole(tracks, time=b"\x05"):
        cluster = matroska.element(0x1F43B675, matroska.element(0xE7, time) + matroska.element(0xA3, b"\x81\x00\x05\x00abcd"))
        return matroska.element(0x1A45DFA3, b"") + matroska.element(0x18538067, matroska.element(0x1654AE6B, tracks) + cluster)

    deep = b""
    for _ in range(5000):
        deep = matroska.element(0xE1, deep)
    files = [whole(matroska.element(0xAE, deep)), whole(b"", b"\xff" * 8), whole(b"", b"\x01" * 9), whole(b"")]
    media = spark.createDataFrame([(None if k == 1 else k, 0, f) for k, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = sorted((str(r["doc_id"]), r["error"] is None) for r in matroska.packets(media).collect())
    assert got == [("0", True), ("2", False), ("3", True), ("None", False)]
    assert sorted(r["error"] is None for r in matroska.features(media).collect()) == [False, False, True, True]


def test_long_texts_and_null_ids(spark, labels):
    long = " ".join(f"word{k % 977} über {k}" for k in range(150_000))
    rows = [(1, long, "en", "s", len(long)), (None, long, "en", None, 1), (None, "short one", "de", "s", 1), (2, long + " end", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    path = queries.vocabulary()
    for found in (
        langid.language_id(docs), wordpiece.token_counts(docs, path), matroska.features(matroska.store(docs)), toxicity.toxicity(docs, labels), chosenpath.similar_documents(docs),
        substrings.remove_repeats(docs), cotraining.quality(docs, labels), mixing.mix_sources(docs),
    ):
        assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "2", "None", "None"]
    assert {str(r["doc_id"]): r["class_id"] for r in chosenpath.similar_documents(docs).where("n_copies > 0 or n_links > 0").collect()} == {"1": 1, "2": 1, "None": 1}
    pieces = packing.pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] - r["t"] for r in pieces if r["doc_id"] is not None} == {1: 0, 2: 0}


def test_media_columns(odd, empty, spark):
    got = {(r["doc_id"], r["n_bytes"]): r for r in matroska.features(matroska.store(odd)).collect()}
    for i, t in texts_of(odd):
        raw = (t or "").encode()
        payload = matroska.padded(raw)
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["error"] is None and r["media_bytes"] > r["payload_bytes"]
    assert matroska.features(matroska.store(empty)).count() == 0
    table = matroska.packets(matroska.store(odd)).where("error is null")
    assert table.agg(F.sum("length")).first()[0] == matroska.features(matroska.store(odd)).agg(F.sum("payload_bytes")).first()[0]
    broken = spark.createDataFrame([(1, 3, b"abc"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] for r in matroska.packets(broken).collect()) and all(r["error"] for r in matroska.features(broken).collect())


# toxicity


def test_fold():
    assert toxicity.fold("L0ser, tr@sh! стуpid $cum lóser").split() == ["ioser", "trash", "ctypid", "scum", "ioser"]


def test_lexicon_learns_words_and_beginnings_with_exceptions():
    rng = random.Random(3)
    filler = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeou" for c in ("nt", "rs", "mb", "lk", "st")]

    def text(extra):
        w = [rng.choice(filler) for _ in range(60)]
        for x in extra:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    endings = ["ar", "en", "um", "ost", "ida"]
    rows = [(text(["nasty"] if k % 2 else ["zort" + rng.choice(endings)]), 1) for k in range(80)]
    rows += [(text(["nasty weather"] if k % 30 == 0 else []), 0) for k in range(400)]
    model = toxicity.learn(rows, 1 / 6)
    assert any(p.startswith(" zort") for p in model.entries)
    assert any(p.startswith(" nasty") for p in model.entries) and " nasty weather " in model.exceptions
    a = model.automaton()
    assert toxicity.matched(a, toxicity.fold("what nasty weather"))[0] == 0
    assert toxicity.matched(a, toxicity.fold("what n4sty w"))[0] > 0


def test_matching_is_that_of_a_plain_search():
    rng = random.Random(6)
    for _ in range(300):
        text = " " + " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))) + " "
        entries = {rng.choice([" {} ", " {}"]).format("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))): rng.random() + 0.1 for _ in range(5)}
        clear = [f" {'a' * rng.randrange(1, 3)} {'b' * rng.randrange(1, 3)} "]
        lexicon = toxicity.Lexicon(bias=0.0)
        lexicon.entries.update(entries)
        lexicon.exceptions = clear
        excepted = [(k, k + len(x) - 1) for x in clear for k in range(len(text)) if text.startswith(x, k)]
        weight = hits = 0
        for k in range(len(text)):
            here = [e for e in entries if text.startswith(e, k)]
            if here and not any(a <= k and k + len(max(here, key=len)) - 1 <= b for a, b in excepted):
                weight, hits = weight + entries[max(here, key=len)], hits + 1
        got = toxicity.matched(lexicon.automaton(), text)
        assert got[1] == hits and abs(got[0] - weight) < 1e-9


def test_toxicity_of_null_and_shared_ids_whatever_the_order(spark, labels):
    rows = [(i, t, "en", "s", 1) for i, t in clashing()]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(str, toxicity.toxicity(docs.repartition(n), labels).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.05 * len(rows)


def test_toxicity_edges(odd, empty, labels):
    got = toxicity.toxicity(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).agg(F.max("score")).first()[0] < 0.01


# Jaccard join


def joined(df, **more):
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"], r["n_copies"]) for r in chosenpath.similar_documents(df, **more).collect()}


def test_join_is_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert joined(docs) == brute.joined(texts_of(docs))


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(w)))
    return out + [(n + i, " ".join(words[:40] + [f"y{i}_{k}" for k in range(60)])) for i in range(n)]


def test_join_of_dense_groups_and_shared_passages(spark):
    rows = near_copies(120, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # small limits, so that buckets are split, compared in blocks, and groups dealt into several
    got, want = joined(docs, limit=20, block=16, recall=0.99999), brute.joined(rows)
    assert [x[0] for x in got.values()] == [want[i][0] for i in got]
    assert got == want


def test_join_recall_at_the_deepest_level(spark):
    # pairs at the bound, one set inside the other, followed down all levels; the registered recall is 0.999
    n, rows = 1000, []
    for i in range(n):
        words = [f"w{i}_{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:84]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = materialize(chosenpath.describe(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")).select("node", F.floor(F.col("doc_id") / 2).alias("pair")), "test-pairs")
    level = materialize(chosenpath.paths(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), chosenpath.runs_for(0.999, 0.8, 0.7), 0.7, 3), "test-paths").withColumn("token", F.col("key"))
    for k in range(chosenpath.LEVELS - 1):
        level = materialize(chosenpath.next_level(level.withColumn("members", F.lit(2)), k), "test-paths")
    met = level.join(pairs, "node").groupBy("pair", "key").agg(F.countDistinct("node").alias("sets")).where("sets = 2")
    assert met.select("pair").distinct().count() >= 0.998 * n


def test_join_recall_at_the_bound(spark):
    # pairs at 0.8 and little above, beside a large group that makes the buckets of common shingles split
    rng, rows = random.Random(12), near_copies(150, 3)
    n = 500
    for i in range(n):
        words = [f"w{i}_{k}" for k in range(104)]
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(words[: 84 + rng.randrange(3)]))]
    got = joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit=50)
    found = sum(got[10_001 + 2 * i][0] == 10_000 + 2 * i and got[10_000 + 2 * i][2] == 1 for i in range(n))
    assert found >= 0.998 * n


def test_join_of_texts_that_share_an_id(spark):
    # ids 0 to 19 have two texts each, every one with a near copy under an id of its own
    rows = []
    for i in range(20):
        for side in (0, 1):
            words = [f"s{i}_{side}_{k}" for k in range(60)]
            rows += [(i, " ".join(words)), (100 + 2 * i + side, " ".join(words[:57]))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosenpath.similar_documents(docs).collect()]
        assert sorted(got) == sorted((i, i if i < 100 else (i - 100) // 2, 1) for i, _ in rows)


def test_join_edges(odd, empty):
    rows = {i: t for i, t in texts_of(odd)}
    got, want = joined(odd), brute.joined(rows.items())
    again = {8, 9, 10}  # ids whose rows are there twice
    for i in want:
        assert got[i][:3] == want[i][:3]
        if not again & {j for j in want if want[j][1] == want[i][1]}:
            assert got[i] == want[i]
    assert joined(empty) == {}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


# substring dedup


def removed(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()}


def test_repeats_are_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert removed(docs) == brute.repeats(texts_of(docs))


def test_repeats_of_made_documents(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnopqrstuv") for _ in range(300)] for _ in range(5)]
    rows = []
    for i in range(200):
        x = rng.choice(base)
        a = rng.randrange(250)
        y = [rng.choice("xyz") + str(rng.randrange(9)) for _ in range(rng.randrange(30))] + x[a : a + rng.randrange(5, 60)] + ["und"] * rng.choice([0, 0, 25]) + x[: rng.randrange(40)]
        rows.append((i, "\t ".join(y) if i % 7 else None))
    rows += [(1000 + i, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows + rows[50:90:5], "doc_id long, text string").repartition(7)
    assert removed(docs) == brute.repeats(rows)


def test_repeats_edges(odd, empty):
    assert removed(odd) == brute.repeats({i: t for i, t in texts_of(odd)}.items())
    assert removed(empty) == {}
    kept = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(odd, with_text=True).collect()}
    for i, t in texts_of(odd):
        if not kept[i][0]:
            assert kept[i][1] == (t or "")


def test_repeats_of_tables_with_fewer_words_than_a_quarter_window(spark):
    for n in range(6):
        rows = [(1, " ".join("abcdef"[:n])), (2, None), (3, "")]
        assert removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute.repeats(rows)


def clashing(seed=8, n=60):
    """Rows of shared and null ids, with texts of their own, repeated rows and passages in common."""
    rng = random.Random(seed)
    passages = [[f"p{k}_{j}" for j in range(30)] for k in range(4)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(40))]
        rows.append((rng.choice([None, 1, 5, 5, i, i, i]), " ".join(own + rng.choice(passages) * rng.choice([0, 1, 1, 2]) + own[:3])))
    rows += [(5, " ".join(passages[0] + ["tail"] * 25)), (5, " ".join(f"u{k}" for k in range(40))), (None, None), (None, "")]
    return rows + rows[::7]


def test_repeats_of_shared_and_null_ids(spark):
    rows = clashing()
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long").repartition(parts)
        got = substrings.remove_repeats(docs, with_text=True, carry=["place", "text"]).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute.repeats_of_rows(rows)
        assert sorted(r["carried"]["place"] for r in got) == list(range(len(rows)))
        assert all((r["doc_id"], r["carried"]["text"]) == rows[r["carried"]["place"]] for r in got)


# quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = cotraining.quality(documents(spark, sf), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_co_training_over_a_table_is_that_over_arrays(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents(spark, sf)
    docs = docs.union(docs.limit(200)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    got = {r["doc_id"]: r["score"] for r in cotraining.quality(docs, labels).collect()}
    # the same by plain Python: every unlabelled document outside the fold, none of the labelled ones
    label = {}
    for r in labels.where("quality is not null").collect():
        label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["quality"])
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    vectors = {r["doc_id"]: (np.array(r["content"], float), np.array(r["metadata"], float)) for r in cotraining.views(docs).collect()}
    taught = sorted((i for i in label if not fold(i) and i in vectors), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    pool = [i for i in vectors if i is not None and not fold(i) and i not in label]
    assert len(pool) > 100 and len(taught) > 100
    told = []

    def choose(models, used, downs, ups, sure):
        out = []
        for pupil in (0, 1):
            p = {i: float(cotraining.sigmoid(models[1 - pupil].logit(vectors[i][1 - pupil][None]))[0].round(9)) for i in pool if i not in used[pupil]}
            low = sorted((i for i in p if 1 - p[i] >= sure), key=lambda i: (p[i] - 1, i))[:downs]
            high = sorted((i for i in p if p[i] >= sure), key=lambda i: (-p[i], i))[:ups]
            told.extend(low + high)
            out.append((np.array(low + high, np.int64), np.array([0.0] * len(low) + [1.0] * len(high)), np.array([vectors[i][pupil] for i in low + high]).reshape(len(low + high), len(models[pupil].mean))))
        return out

    model = cotraining.co_train((np.array([vectors[i][0] for i in taught]), np.array([vectors[i][1] for i in taught]), np.array([label[i] for i in taught], float)), choose)
    assert told and not set(told) & set(label)
    assert len(got) == len(vectors)
    for i, (c, m) in ((i, x) for i, x in vectors.items() if i is not None):
        assert abs(got[i] - model.score(c[None], m[None])[0][0]) < 1e-4


def test_quality_edges(odd, empty, labels):
    got = cotraining.quality(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert cotraining.quality(empty, labels).count() == 0
    assert [r[0] for r in cotraining.quality(odd, labels.limit(0)).select("score").distinct().collect()] == [0.5]


# mixing


def test_mixing_is_its_sql(spark, sf_dir):
    check(mixing.mix_sources(documents(spark, sf_dir)), connect(sf_dir), mixing.oracle_sql())


def test_mixing_edges(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and mixing.mix_sources(empty).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix_sources(odd.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_water_filling(spark):
    sources = spark.createDataFrame([(False, s, n) for s, n in (("a", 10), ("b", 1000), ("c", 1000), ("d", 0))], "no_source boolean, source_key string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(sources, 3, (1, 2, 3)).collect()}
    assert got["a"] == 30 and got["d"] == 0
    assert abs(got["b"] / got["c"] - 2 / 3) < 1e-9 and abs(sum(got.values()) - 2010) < 1e-6


def test_the_mix_itself_has_the_words_taken(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mixed = mixing.mix_sources(docs)
    rows = mixing.repeated(docs).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert mixed.where("taken > 0").join(rows, "doc_id", "left").where("n is null or n <> taken").count() == 0


def test_the_mix_of_shared_and_null_ids_takes_each_row_by_itself(spark):
    rows = [(i, t, "en", "ab"[k % 2], 1) for k, (i, t) in enumerate(clashing())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = mixing.mix_sources(docs, carry=["text", "doc_id"]).collect()
    assert sorted((r["carried"]["doc_id"], r["carried"]["text"]) for r in mixed if r["doc_id"] is not None) == sorted((i, t) for i, t, *_ in rows if i is not None)
    assert all(r["size"] == len(brute.words(r["carried"]["text"])) and r["doc_id"] == r["carried"]["doc_id"] for r in mixed)
    words = sum(len(brute.words(r["text"])) for r in mixing.repeated(docs).collect())
    assert words == sum(r["taken"] for r in mixed) and abs(words - sum(len(brute.words(t)) for _, t, *_ in rows)) <= 2


# nearest neighbours


def test_hilbert_curve_visits_every_cell_by_steps():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_recall(spark, sf_dir):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    hits = total = 0
    for q, group in hilbert.search(v, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id"):
        s = x @ rows[q]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(group["vec_id"]))
        total += 20
        assert list(group.sort_values("rank")["score"]) == sorted(group["score"], reverse=True)
    assert hits >= 0.9 * total


def vectors_of(kind, n=3000, dims=48):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims))
    if kind == "clustered":
        x = rng.normal(size=(40, dims))[rng.integers(40, size=n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x * np.exp(rng.normal(size=n))[:, None] if kind == "varied" else x


@pytest.mark.parametrize("kind", ["unit", "clustered", "varied"])
def test_neighbours_recall_by_inner_product(spark, kind):
    x = vectors_of(kind)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = hilbert.search(v, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q, group in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.argsort(-s)[:20]
        assert len(group) == 20
        hits += len(set(best) & set(group["vec_id"]))
        np.testing.assert_allclose(group.sort_values("rank")["score"], s[group.sort_values("rank")["vec_id"]])
    assert hits >= 0.9 * 20 * len(x[::20])


def test_neighbours_of_clusters_need_few_ranges(spark, monkeypatch):
    seen, whole = [], hilbert.needed_reach
    monkeypatch.setattr(hilbert, "needed_reach", lambda *args: seen.append(whole(*args)) or seen[-1])
    for kind in ("clustered", "unit"):
        v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(vectors_of(kind))], "vec_id long, embedding array<double>")
        hilbert.search(v, F.col("vec_id") % 20 == 0)
    assert seen[0] <= 1 < 3 <= seen[1]


def test_neighbours_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(600)]
    rows += rows[::5]
    got = [tuple(r) for r in hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()]
    one = {}
    for i, x in rows:
        if i is not None:
            one[i] = min(one.get(i, x), x)
    want = []
    for q in sorted(one):
        if q % 2 == 0:
            best = sorted((-sum(a * b for a, b in zip(one[q], x, strict=True)), i) for i, x in one.items() if i != q)[:20]
            want += [(q, n, i) for n, (_, i) in enumerate(best, 1)]
    assert [r[:3] for r in got] == want


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
    v = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in hilbert.search(v, F.col("vec_id") >= 0).orderBy("query_id", "rank").collect()]
    assert {r[0] for r in got} == {7, 8, 9, 10} and len(got) == 12
    assert [r[2] for r in got if r[0] == 10] == [7, 8, 9] and [r[2] for r in got if r[0] == 7] == [8, 10, 9]
    assert hilbert.search(v.limit(0), F.col("vec_id") >= 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<float>")
    top = hilbert.search(same, F.col("vec_id") == 30).orderBy("rank").collect()
    assert [r["vec_id"] for r in top] == list(range(20))


# packing


def test_pretokens_are_those_of_the_tokenizer():
    rng = random.Random(3)
    signs = ["a", "b", "'", "s", "'s", "'t", "'ll", "'re", "'ve", " ", "  ", "\n", "\t", "1", "2", "é", "É", "ß", "ñ", "!", "?", "$", "\n\n", " '", "' ", "×", "漢", "\x1f", "²", "½", "_", "-", "<|endoftext|>", "\r\n", " ", "ŀ", "ɏ", "ɐ"]
    texts = ["".join(rng.choice(signs[: 24 if k % 2 else None]) for _ in range(rng.randint(0, 25))) for k in range(4000)] + [None, ""]
    encoder = bpe.ids_of(queries.vocabulary())
    flat, at = encoder.encode(pa.array(texts), 0)
    want = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, e in enumerate(want):
        assert flat[at[i] : at[i + 1]].tolist() == [*e.ids, 0]


def pieces_are_whole(rows, docs, size=1024):
    """Every id of every document once, sequences without gaps, all but the last full."""
    encoder = bpe.ids_of(queries.vocabulary()).tokenizer
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append([*encoder.encode(t or "", add_special_tokens=False).ids, 0])
    sequences, got = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, copies in want.items():
        expect = []
        for s, n, _ in got[i]:
            expect += [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for ids in copies[:1]]
        assert sum(n for _, n, _ in got[i]) == sum(map(len, copies))
        if len(copies) == 1:
            assert [c for _, _, c in got[i]] == expect
            assert sorted((s, s + n) for s, n, _ in got[i])[0][0] == 0
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == size if k < last else at <= size


def test_packing(spark, sf_dir):
    docs = documents(spark, sf_dir).repartition(3)
    rows = packing.pack(docs, queries.vocabulary()).collect()
    pieces_are_whole(rows, texts_of(docs))
    # every full window holds each queue's share of the tokens, to a token or two
    total = sum(r["length"] for r in rows)
    queue, window = {}, {}
    for r in rows:
        queue[r["queue"]] = queue.get(r["queue"], 0) + r["length"]
        window[r["sequence_id"], r["queue"]] = window.get((r["sequence_id"], r["queue"]), 0) + r["length"]
    last = max(r["sequence_id"] for r in rows)
    for (k, q), n in window.items():
        if k < last:
            assert abs(n - 1024 * queue[q] / total) < 2


def test_packing_edges(odd, empty, spark):
    pieces_are_whole(packing.pack(odd, queries.vocabulary()).collect(), texts_of(odd))
    assert packing.pack(empty, queries.vocabulary()).count() == 0
    # more sources than a window has tokens: small ones share a queue
    many = spark.createDataFrame([(i, "one two", "en", f"s{i}", 7) for i in range(1500)] + [(5000, "big " * 9000, "en", "big", 1)], SCHEMA).repartition(4)
    rows = packing.pack(many, queries.vocabulary()).collect()
    pieces_are_whole(rows, texts_of(many))
    assert len({r["queue"] for r in rows}) <= 1024


def test_large_numbers_of_tokens_stay_exact():
    rng = random.Random(4)
    for total in (1, 1024, 2**31 - 1, 2**31 + 11, 10**13 + 7, 2**60 + 3):
        for up_to in {0, 1, min(12345, total), total // 3, total - 1, total}:
            a = [0, total, total // 2, *(rng.randrange(total + 1) for _ in range(50))]
            assert packing.times_over(np.array(a), up_to, total).tolist() == [x * up_to // total for x in a]
    sums = [10**13, 7, 10**12 + 1]
    plan = packing.Schedule(sums, 1024)
    w = np.array([0, 1, 10**9, plan.windows - 1, plan.windows, plan.windows + 1])
    for q in range(4):
        assert plan.served(w, q).tolist() == [min(int(x) * 1024, plan.total) * sum(sums[:q]) // plan.total for x in w]
    position = np.array([0, 1, 5 * 10**12, 10**13 - 1])
    got = plan.window(position, 0)
    assert (plan.before(got, 0) <= position).all() and (plan.before(got + 1, 0) > position).all()


def test_schedule_of_weights_is_the_rounds_it_stands_for():
    sums, shares = [5000, 800, 0, 3000, 400], [1.0, 3.0, 1.0, 0.5, 0.0]
    plan = packing.Schedule(sums, 64, shares)
    w = np.arange(plan.windows + 1)
    served = np.array([plan.before(w, q) for q in range(5)])
    assert served[:, 0].tolist() == [0] * 5 and served[:, -1].tolist() == sums
    assert (np.diff(served.sum(0))[:-1] == 64).all() and (np.diff(served) >= 0).all()
    # while all with a weight have tokens, windows hold them by weight; who has none comes last
    full = np.diff(served)[:, :15]
    assert (np.abs(full - 64 * np.array([1, 3, 0, 0.5, 0])[:, None] / 4.5) < 2).all()
    assert served[4][served[0] < 5000].max() == 0


def test_packing_to_target_proportions(spark, sf_dir):
    docs = documents(spark, sf_dir).repartition(3)
    names = sorted({r[0] for r in docs.select("source").distinct().collect() if r[0] is not None})
    rows = packing.pack(docs, queries.vocabulary(), weights={names[0]: 1.0, names[1]: 2.0}).collect()
    pieces_are_whole(rows, texts_of(docs))
    first = {}
    for r in rows:
        if r["sequence_id"] < 5:
            first[r["queue"]] = first.get(r["queue"], 0) + r["length"]
    a, b = sorted(first.values())
    assert abs(b - 2 * a) <= 4 and a + b == 5 * 1024


def test_packing_of_shared_and_null_ids(spark):
    rows = [(i, t, "en", "s", 1) for i, t in clashing(n=30)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = packing.pack(docs, queries.vocabulary()).collect()
        encoder = bpe.ids_of(queries.vocabulary()).tokenizer
        want, have = {}, {}
        for i, t, *_ in rows:
            want[i] = want.get(i, 0) + len(encoder.encode(t or "", add_special_tokens=False).ids) + 1
        for r in got:
            have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
        assert have == want


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("사과 시간 상자", "사과 시간 상자"), ("ﬁne ﬂoor", "fine fioor"), ("“quoted”—dash", " quoted  dash"), ("ÉÈ ünïcode", "ee unicode"), ("h3ll0 6ood 2oo", "heiio good zoo"), ("ｆｕｌｌ", "fuii"), ("а漢字", "a漢字"), ("Ⅷ", "viii"),
    ],
)
def test_folding_keeps_every_letter_however_it_is_composed(text, folded):
    import unicodedata

    for form in ("NFC", "NFD"):
        assert toxicity.fold(unicodedata.normalize(form, text)) == f" {folded} "


def test_what_toxicity_learns_from_is_bounded(spark):
    docs = spark.range(4000).select((F.col("id") % 4).alias("doc_id"), F.lit("bad words here").alias("text"))
    long = spark.createDataFrame([(5, "bad " * 2_000_000), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    got = toxicity.sample_labelled(docs.union(long), labels, 3000)
    held = {i for i in range(8) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert got == sorted([("bad words here", i % 2) for i in range(4) if i not in held] + ([("", 0)] if 6 not in held else []))
