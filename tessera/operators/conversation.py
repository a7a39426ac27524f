"""Conversations and long-term memories: pairs, windows, budgets, summaries, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import bounded, estimate, follows_up, has_credential, pair_cost
from ..schemas import MEMORIES_PER_USER, RECALLED
from .retrieval import greedy


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", "") == "", F.lit(True))


def pair_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, question, answer) of user rows that an assistant row follows, neither blank."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & ~is_blank(F.col("text")) & ~is_blank(F.col("answer"))).select("conv_id", F.col("turn").alias("turn_no"), F.col("text").alias("question"), "answer")


def newest(turns: DataFrame, n: int = 10) -> DataFrame:
    """Each conversation's last n turns; WindowGroupLimit cuts before the shuffle."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn_no"))
    return turns.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n).drop("back")


def newest_by_chars(turns: DataFrame, pairs: int = 6, chars: int = 8000) -> DataFrame:
    """The newest pairs while their code points fit; the first that doesn't ends the walk."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn_no"))
    size = F.char_length("question") + F.char_length("answer")
    rows = turns.withColumn("back", F.row_number().over(back)).withColumn("chars", F.sum(size).over(back.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where((F.col("back") <= pairs) & (F.col("chars") <= chars)).drop("back", "chars")


def fit_recent(turns: DataFrame, pairs: int, budget: int) -> DataFrame:
    """(conv_id, kept turn numbers ascending, cutoff): the suffix that fits, and the last turn before it (0: none).

    The walk from the newest stops at the first pair that is blank, not UTF-8 or over the budget.
    """
    back = W.partitionBy("conv_id").orderBy(F.desc("turn_no")).rowsBetween(W.unboundedPreceding, 0)
    bad = is_blank(F.col("question")) | is_blank(F.col("answer")) | ~F.is_valid_utf8("question") | ~F.is_valid_utf8("answer")
    rows = turns.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn_no"))))
    rows = rows.withColumn("cost", F.sum(pair_cost(F.col("question"), F.col("answer"))).over(back) + 16).withColumn("bad", F.max(bad.cast("int")).over(back))
    keep = (F.col("n") <= max(pairs, 0)) & (F.col("cost") <= budget) & (F.col("bad") == 0)
    rows = rows.withColumn("keep", keep)
    return rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("keep"), F.col("turn_no")))).alias("kept"),
        F.coalesce(F.max(F.when(~F.col("keep"), F.col("turn_no"))), F.lit(0)).cast("long").alias("cutoff"),
    )


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two messages a turn, in order: (conv_id, seq, role, content)."""
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    rows = turns.select("conv_id", "turn_no", F.explode(both).alias("m"))
    order = W.partitionBy("conv_id").orderBy("turn_no", "m.k")
    return rows.select("conv_id", F.row_number().over(order).alias("seq"), "m.role", "m.content")


def legacy_turns(histories: DataFrame) -> DataFrame:
    """Turns of stored message lists (conv_id, json); lists that don't alternate strictly give none.

    A turn's id is ``legacy-{n}-`` and half of the hash of its question and answer.
    """
    parsed = histories.select("conv_id", F.from_json("json", "array<struct<role:string,content:string>>").alias("m"))
    pair_up = F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.get("m", i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    good = parsed.where((F.size("m") > 0) & (F.size("m") % 2 == 0)).where(F.forall(pair_up, lambda x: x))
    rows = good.select("conv_id", "m", F.explode(F.sequence(F.lit(1), (F.size("m") / 2).cast("int"))).alias("turn_no"))
    question, answer = F.get("m", F.col("turn_no") * 2 - 2)["content"], F.get("m", F.col("turn_no") * 2 - 1)["content"]
    digest = F.substring(F.sha2(F.concat(question, F.lit("\n"), answer), 256), 1, 32)
    return rows.select("conv_id", "turn_no", F.concat(F.lit("legacy-"), F.col("turn_no").cast("string"), F.lit("-"), digest).alias("turn_id"), question.alias("question"), answer.alias("answer"))


def append_turns(turns: DataFrame, incoming: DataFrame) -> DataFrame:
    """(conv_id, turn_id, outcome, turn_no) of new turns: appended, repeated (same payload) or conflict.

    incoming: conv_id, turn_id, question, answer, arrival. New ids are numbered on from the last turn.
    """
    known = turns.select("conv_id", "turn_id", F.col("question").alias("old_q"), F.col("answer").alias("old_a"), F.col("turn_no").alias("old_no"))
    last = turns.groupBy("conv_id").agg(F.max("turn_no").alias("last_no"))
    first = W.partitionBy("conv_id", "turn_id").orderBy("arrival")
    rows = incoming.withColumn("n", F.row_number().over(first)).withColumn("first_q", F.first("question").over(first)).withColumn("first_a", F.first("answer").over(first))
    rows = rows.join(known, ["conv_id", "turn_id"], "left").join(last, "conv_id", "left")
    q, a = F.coalesce("old_q", "first_q"), F.coalesce("old_a", "first_a")
    same = (F.col("question") == q) & (F.col("answer") == a)
    outcome = F.when(~same, "conflict").when(F.col("old_no").isNotNull() | (F.col("n") > 1), "repeated").otherwise("appended")
    rows = rows.withColumn("outcome", outcome)
    number = F.sum((F.col("outcome") == "appended").cast("int")).over(W.partitionBy("conv_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("turn_no", F.when(F.col("outcome") == "appended", F.coalesce("last_no", F.lit(0)) + number).otherwise(F.col("old_no"))).select("conv_id", "turn_id", "arrival", "outcome", F.col("turn_no").cast("long").alias("turn_no"))


def valid_turns(turns: DataFrame) -> DataFrame:
    """Turns with ``valid``: at most 24 sources, with numbers 1 to 24, none twice."""
    n = F.transform("sources", lambda s: s["number"])
    good = (F.size("sources") <= 24) & F.forall(n, lambda x: (x >= 1) & (x <= 24)) & (F.size(F.array_distinct(n)) == F.size("sources"))
    return turns.withColumn("valid", good & ~is_blank(F.col("question")) & ~is_blank(F.col("answer")))


def pending_for_summary(turns: DataFrame, cutoffs: DataFrame, batch: int = 4, batches: int = 2) -> DataFrame:
    """(conv_id, batch, turn numbers, gap) of turns after the summary's watermark that left the recent window.

    cutoffs: conv_id, summary_until, cutoff. ``gap`` tells of a number missing between them.
    """
    rows = turns.join(cutoffs, "conv_id").where("turn_no > summary_until and turn_no <= cutoff")
    order = W.partitionBy("conv_id").orderBy("turn_no")
    rows = rows.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < batch * batches)
    rows = rows.withColumn("before", F.coalesce(F.lag("turn_no").over(order), F.col("summary_until")))
    return rows.groupBy("conv_id", F.floor(F.col("n") / batch).cast("int").alias("batch")).agg(F.sort_array(F.collect_list("turn_no")).alias("turns"), F.max(F.col("turn_no") - F.col("before") > 1).alias("gap"))


def summary_faults(items: DataFrame, allowed: DataFrame, budget: int) -> DataFrame:
    """(conv_id, rule) that a summary breaks. items: conv_id, pos, kind, text, source_turns, bytes; allowed: conv_id, turn_no."""
    kinds = ["topic", "entity", "constraint", "decision", "open_question"]
    many = items.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    out = many.where("n > 16").select("conv_id", F.lit("items").alias("rule")).union(many.where(F.col("bytes") > budget).select("conv_id", F.lit("budget")))
    out = out.union(items.where(~F.col("kind").isin(kinds)).select("conv_id", F.lit("kind")))
    out = out.union(items.where(~bounded(F.col("text"), 500)).select("conv_id", F.lit("text")))
    out = out.union(items.where((F.size("source_turns") < 1) | (F.size("source_turns") > 6)).select("conv_id", F.lit("sources")))
    out = out.union(items.where(F.size(F.array_distinct("source_turns")) < F.size("source_turns")).select("conv_id", F.lit("duplicate")))
    cited = items.select("conv_id", F.explode("source_turns").alias("turn_no"))
    return out.union(cited.join(allowed, ["conv_id", "turn_no"], "left_anti").select("conv_id", F.lit("unknown"))).distinct()


def reset_context(states: DataFrame, changed: DataFrame) -> DataFrame:
    """States of users whose memories changed begin anew after their last turn."""
    hit = changed.select("user_id").distinct().withColumn("hit", F.lit(True))
    rows = states.join(hit, "user_id", "left")
    new = F.coalesce("hit", F.lit(False))
    return rows.select("conv_id", "user_id", F.when(new, "{}").otherwise(F.col("summary")).alias("summary"), F.when(new, F.col("last_turn")).otherwise(F.col("summary_until")).alias("summary_until"), F.when(new, F.col("last_turn")).otherwise(F.col("context_after")).alias("context_after"), "last_turn")


def recall_json(item: Column) -> Column:
    """A memory as it is shown to the model."""
    return F.to_json(F.struct(item["id"].alias("memory_id"), item["scope"].alias("scope"), item["kind"].alias("kind"), item["key"].alias("key"), item["content"].alias("content")), {"ignoreNullFields": "false"})


def recalled(memories: DataFrame, questions: DataFrame, budget: int, now: Column) -> DataFrame:
    """(question_id, place, memory_id, score) of a user's memories that a question calls up.

    questions: question_id, user_id, query, recent (last user message, null: none), has_recent, topics
    (texts of the summary's topics and entities). A question meets its own user's memories only, of
    which there are at most 50.
    """
    m = memories.alias("m")
    q = questions.alias("q")
    rows = q.join(m, F.expr("q.user_id = m.user_id")).select("q.question_id", "q.query", "q.recent", "q.has_recent", "q.topics", *[F.col(f"m.{c}") for c in ("id", "scope", "kind", "key", "content", "keywords", "expires_at", "updated_at")])
    lower = F.lower("query")
    named = (F.col("scope") != "") & (F.col("scope") != "global") & F.contains(lower, F.lower("scope"))
    rows = rows.withColumn("explicit", F.max(named).over(W.partitionBy("question_id")))
    more = F.when(F.col("recent").isNotNull(), F.concat(F.lit("\n"), F.lower("recent"))).when(~F.col("has_recent"), F.concat(F.lit("\n"), F.lower(F.array_join("topics", "\n")))).otherwise("")
    lookup = F.when(follows_up(F.col("query")) & ~F.col("explicit"), F.concat(lower, more)).otherwise(lower)
    rows = rows.withColumn("lookup", lookup).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    rows = rows.where((F.col("scope") == "global") | F.contains("lookup", F.lower("scope")))
    hits = F.size(F.filter("keywords", lambda k: (F.trim(k) != "") & F.contains(F.col("lookup"), F.lower(F.trim(k)))))
    score = 2 * hits + ((F.col("scope") == "global") & (F.col("kind") == "preference")).cast("int")
    rows = rows.withColumn("score", score).where("score > 0")
    item = F.struct("id", "scope", "kind", "key", "content")
    # a JSON array costs its brackets, its items, and a comma before each but the first
    cost = estimate(recall_json(item)) + 1
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("updated_at"), "id")))
    taken = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("id").alias("id"), cost.cast("long").alias("cost")))).alias("items"))
    # two brackets, less the comma that the first item doesn't need
    chosen = taken.select("question_id", F.posexplode(greedy(F.col("items"), budget - 1, RECALLED)).alias("p", "chosen"))
    return chosen.join(ranked.select("question_id", F.col("id").cast("string").alias("chosen"), "score"), ["question_id", "chosen"]).select("question_id", (F.col("p") + 1).alias("place"), F.col("chosen").cast("long").alias("memory_id"), "score")


def memory_faults(inputs: DataFrame, counts: DataFrame, now: Column, budget: int) -> DataFrame:
    """Memories to be saved with ``fault``: the first rule that one breaks, or null.

    inputs: id, user_id, scope, kind, key, content, keywords, expires_at, confirmed; counts: user_id, active.
    """
    scope = F.when(F.trim("scope") == "", "global").otherwise(F.trim("scope"))
    keywords = F.array_distinct(F.transform("keywords", lambda k: F.lower(F.trim(k))))
    rows = inputs.join(counts, "user_id", "left").withColumn("scope", scope).withColumn("words", keywords)
    text = F.concat_ws(" ", "scope", F.trim("key"), F.trim("content"), F.array_join("words", " "))
    fault = (
        F.when(~F.coalesce("confirmed", F.lit(False)), "unconfirmed")
        .when(~(bounded(F.col("scope"), 64) & bounded(F.trim("key"), 64) & bounded(F.trim("content"), 500)), "length")
        .when(~F.col("kind").isin("preference", "project", "decision"), "kind")
        .when(F.col("expires_at") <= now, "expired")
        .when((F.size("keywords") > 8) | F.exists("words", lambda k: ~bounded(k, 40)), "keywords")
        .when((F.size("words") == 0) & ~((F.col("scope") == "global") & (F.col("kind") == "preference")), "no keyword")
        .when(has_credential(text), "credential")
        .when(estimate(recall_json(F.struct("id", "scope", "kind", "key", "content"))) + 2 > budget, "budget")
        .when(F.coalesce("active", F.lit(0)) >= MEMORIES_PER_USER, "too many")
    )
    return rows.withColumn("fault", fault).drop("words", "active")


def unexpired(memories: DataFrame, now: Column) -> DataFrame:
    return memories.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def page(rows: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    """A page (from 1) of ordered rows."""
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def oldest_first(rows: DataFrame, *order: Column) -> DataFrame:
    """A page, which holds few rows, with ``place`` from its oldest row on: it is read forwards though it is found backwards."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)))


def with_users(turns: DataFrame, users: DataFrame) -> DataFrame:
    """Turns with the name of their user; a user who isn't there fails the whole request."""
    names = users.select(F.col("id").alias("user_id"), "username")
    rows = turns.join(names, "user_id", "left")
    missing = F.raise_error(F.concat(F.lit("no user "), F.col("user_id").cast("string"))).cast("string")
    return rows.withColumn("username", F.when(F.col("username").isNull(), missing).otherwise(F.col("username")))


def summaries_advanced(states: DataFrame, writes: DataFrame) -> DataFrame:
    """(conv_id, summary_until, version) after summaries that batches write (conv_id, seq, expected, first, until).

    A write counts if it expects the version that is there, begins right behind the watermark, and moves it on.
    """
    log = writes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "expected", "first", "until"))).alias("log"))
    start = F.struct(F.col("summary_until").cast("long").alias("until"), F.col("version").cast("long").alias("version"))

    def step(s: Column, w: Column) -> Column:
        ok = (w["expected"] == s["version"]) & (w["first"] == s["until"] + 1) & (w["until"] > s["until"])
        return F.struct(F.when(ok, w["until"].cast("long")).otherwise(s["until"]).alias("until"), F.when(ok, s["version"] + 1).otherwise(s["version"]).alias("version"))

    none = F.array().cast("array<struct<seq:bigint,expected:bigint,first:bigint,until:bigint>>")
    rows = states.join(log, "conv_id", "left").withColumn("s", F.aggregate(F.coalesce(F.col("log").cast("array<struct<seq:bigint,expected:bigint,first:bigint,until:bigint>>"), none), start, step))
    return rows.select("conv_id", F.col("s.until").alias("summary_until"), "s.version")


def within_days(rows: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows from the first day to 23:59:59 of the last; what lies within that day's last second is out."""
    end = F.lit(f"{last} 23:59:59").cast("timestamp_ntz")
    return rows.where((F.col(at).cast("timestamp_ntz") >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (F.col(at).cast("timestamp_ntz") <= end))


def after_turn(turns: DataFrame, after: int, size: int) -> DataFrame:
    """The next turns of each conversation behind a number, and none behind those."""
    order = W.partitionBy("conv_id").orderBy("turn_no")
    return turns.where(F.col("turn_no") > after).withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).drop("n")
