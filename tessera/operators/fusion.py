"""Reciprocal-rank fusion of step results, selection with pins, citations and evidence budgets.

Hits carry ``plan_id``, ``step_id``, ``rank`` (from 1) and the six parts of a chunk's identity. Plans are fused side by
side: every window and every join goes by plan, and a plan's few steps bound what one of them holds.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import FUSED_RESULTS, RRF_OFFSET
from ..session import parts
from .retrieval import DIGITS

PLAN = "plan_id"
#: Owner is compared as text.
IDENTITY = ["owner", "file_md5", "document_id", "version", "chunk_key", "chunk"]


def fused(hits: DataFrame, digits: int = 12) -> DataFrame:
    """(plan_id, identity, score): each step adds 1 / (60 + rank) for a chunk's best rank in it; ranks keep their gaps."""
    once = hits.groupBy(PLAN, "step_id", *IDENTITY).agg(F.min("rank").alias("rank"))
    return once.groupBy(PLAN, *IDENTITY).agg(F.round(F.sum(1 / (F.lit(float(RRF_OFFSET)) + F.col("rank"))), digits).alias("score"))


def ordered(scored: DataFrame) -> DataFrame:
    """With ``position`` in the plan by score, then identity."""
    return scored.withColumn("position", F.row_number().over(W.partitionBy(PLAN).orderBy(F.desc("score"), *IDENTITY)))


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each step."""
    return hits.withColumn("n", F.row_number().over(W.partitionBy(PLAN, "step_id").orderBy("rank", *IDENTITY))).where("n = 1")


def selected(hits: DataFrame, pins: DataFrame, most: int = FUSED_RESULTS) -> DataFrame:
    """(plan_id, number, identity): pins in order if they are candidates, then each step's first hit, then by score.

    pins: plan_id, identity and pin_order.
    """
    scored = ordered(fused(hits))
    order = [PLAN, *IDENTITY]
    pinned = pins.join(scored.select(*order), order, "left_semi").select(*order, F.lit(0).alias("kind"), F.col("pin_order").alias("place"))
    tops = first_hits(hits).select(*order, F.lit(1).alias("kind"), F.col("step_id").alias("place"))
    rest = scored.select(*order, F.lit(2).alias("kind"), F.col("position").alias("place"))
    first = pinned.unionByName(tops).unionByName(rest).groupBy(*order).agg(F.min(F.struct("kind", "place")).alias("at"))
    numbered = first.withColumn("number", F.row_number().over(W.partitionBy(PLAN).orderBy("at", *IDENTITY)))
    return numbered.where(F.col("number") <= most).select(PLAN, "number", *IDENTITY)


def mandatory(hits: DataFrame, pins: DataFrame) -> DataFrame:
    """Identities that no budget may drop: a plan's pins, and the first hit of each of its steps."""
    return pins.select(PLAN, *IDENTITY).union(first_hits(hits).select(PLAN, *IDENTITY)).distinct()


def step_citations(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """(plan_id, step_id, sources): the numbers of chosen results that each step found."""
    found = hits.select(PLAN, "step_id", *IDENTITY).distinct().join(chosen, [PLAN, *IDENTITY])
    return found.groupBy(PLAN, "step_id").agg(F.sort_array(F.collect_list("number")).alias("sources"))


def interleaved(hits: DataFrame) -> DataFrame:
    """Hits of a plan's parent steps by rank, then step: ``place`` from 1."""
    return hits.withColumn("place", F.row_number().over(W.partitionBy(PLAN).orderBy("rank", "step_id", *IDENTITY)))


def citation_numbers(results: DataFrame) -> DataFrame:
    """(plan_id, number, kind, key): results keep their numbers, their parents, each once, follow in order of first use.

    results: plan_id, number, document_id, version, chunk_key, parent_id, has_parent. Without identity there is no citation.
    """
    known = results.where((F.col("document_id") != 0) & (F.col("version") != ""))
    children = known.select(PLAN, "number", F.lit("child").alias("kind"), "document_id", "version", F.col("chunk_key").alias("key"))
    n = results.groupBy(PLAN).agg(F.count("*").alias("n"))
    first = results.where("has_parent").groupBy(PLAN, "document_id", "version", "parent_id").agg(F.min("number").alias("at"))
    numbered = first.withColumn("k", F.row_number().over(W.partitionBy(PLAN).orderBy("at"))).join(n, PLAN)
    parents = numbered.where("document_id <> 0 and version <> ''").select(PLAN, (F.col("n") + F.col("k")).cast("int").alias("number"), F.lit("parent_context").alias("kind"), "document_id", "version", F.col("parent_id").alias("key"))
    return children.union(parents)


#: Bits of a position that one window of ``contained`` covers: no window holds more rows than 2 to this.
STRIDE = 11


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans of ``inner`` (span_id, doc, block_id, page_no, start, end) that a span of ``outer`` of the same block and page holds.

    A span is held where the farthest end of the outer spans that begin no later reaches its own end, so no pair of spans
    is ever looked at. That farthest end is a running maximum over a block's distinct beginnings. It is taken inside
    stretches of 2048 positions, over the stretches of a stretch of stretches, and over these: a block of any number of
    spans is many small windows. Nulls in doc, block, start or end, and an empty block, hold nothing and aren't held;
    pages without a number are one page. Rows are given as they came, repeated ones too.
    """
    block = ["_doc", "_block", "_paged", "_page"]
    keys = [F.col("doc").alias("_doc"), F.col("block_id").alias("_block"), F.col("page_no").isNotNull().alias("_paged"), F.coalesce("page_no", F.lit(0)).alias("_page"), F.col("start").cast("int").alias("_start")]
    known = "doc is not null and block_id <> '' and start is not null and `end` is not null"
    # beginnings with the farthest end that starts there; inner ones only ask
    asks = inner.where(known).select(*keys, F.lit(None).cast("int").alias("_end"))
    # dealt by stretches, so that no task's share grows: all but the last step of a stretch is done where its rows lie
    n = parts(inner, outer)
    stretch, wide = [*block, "_s1"], [*block, "_s2"]
    points = outer.where(known).select(*keys, F.col("end").cast("int").alias("_end")).union(asks).withColumn("_s1", F.shiftright("_start", STRIDE))
    points = points.repartition(n, *stretch).groupBy(*stretch, "_start").agg(F.max("_end").alias("_end"))
    upto = W.partitionBy(*stretch).orderBy("_start").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = points.withColumn("_here", F.max("_end").over(upto))

    def before(order: str, *within: str) -> Column:
        return F.max("_end").over(W.partitionBy(*block, *within).orderBy(order).rowsBetween(W.unboundedPreceding, -1))

    s1 = points.groupBy(*stretch).agg(F.max("_end").alias("_end")).withColumn("_s2", F.shiftright("_s1", STRIDE)).repartition(n, *wide)
    s2 = s1.groupBy(*wide).agg(F.max("_end").alias("_end")).repartition(n, *block).withColumn("_before2", before("_s2")).drop("_end")
    s1 = s1.withColumn("_before1", before("_s1", "_s2")).join(s2.repartition(n, *wide), wide).select(*stretch, F.greatest("_before1", "_before2").alias("_before"))
    reach = here.join(s1.repartition(n, *stretch), stretch).select(*block, "_start", F.greatest("_here", "_before").alias("_reach")).where("_reach is not null").repartition(n, *block, "_start")
    same = [F.col("doc") == F.col("_doc"), F.col("block_id") == F.col("_block"), F.col("page_no").isNotNull() == F.col("_paged"), F.coalesce("page_no", F.lit(0)) == F.col("_page"), F.col("start").cast("int") == F.col("_start"), F.col("end") <= F.col("_reach")]
    return inner.join(reach, reduce(and_, same), "left_semi")


def covers(parent_text: Column, parent_spans: Column, text: Column, spans: Column) -> Column:
    """Whether a parent holds a child's text and each of its spans."""

    def inside(c: Column) -> Column:
        return F.exists(parent_spans, lambda p: (c["block_id"] != "") & (p["block_id"] == c["block_id"]) & (p["start"] <= c["start"]) & (p["end"] >= c["end"]) & p["page_no"].eqNullSafe(c["page_no"]))

    return (F.size(spans) > 0) & F.contains(parent_text, text) & F.forall(spans, inside)


def fitted(evidence: DataFrame, budget: int) -> DataFrame:
    """Evidence (case_id, items in order, base) after dropping what doesn't fit: ``kept`` ids, ``parents`` kept, ``fits``.

    items: array of (id, cost, parent, parent_cost, mandatory). Parents go first, the last seen before the
    others; then items from the end, mandatory ones aside. A dropped item takes its own cost alone.
    """
    items = F.col("items")
    # the first item of each parent pays for it
    named = F.transform(items, lambda x: x["parent"])
    firsts = F.filter(F.array_distinct(named), lambda p: p != "")
    seen = F.transform(firsts, lambda p: F.struct(p.alias("parent"), F.get(items, F.array_position(named, p).cast("int") - 1)["parent_cost"].cast("long").alias("cost")))
    rows = evidence.withColumn("seen", seen)
    own = F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    # parents are dropped as a suffix: keep the longest beginning that fits
    room = F.lit(budget) - F.col("base") - F.col("own")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.when(room >= 0, 0).otherwise(-1).alias("n"), F.lit(True).alias("open"))

    def hold(s: Column, x: Column) -> Column:
        total = s["sum"] + x["cost"]
        open_ = s["open"] & (total <= room)
        return F.struct(total.alias("sum"), F.when(open_, s["n"] + 1).otherwise(s["n"]).alias("n"), open_.alias("open"))

    rows = rows.withColumn("own", own).withColumn("n_parents", F.greatest(F.aggregate("seen", start, hold)["n"], F.lit(0)))
    over = F.greatest(F.col("own") + F.col("base") - F.lit(budget), F.lit(0))
    state = F.struct(over.cast("long").alias("over"), F.array().cast("array<string>").alias("kept"))

    def drop(s: Column, x: Column) -> Column:
        goes = (s["over"] > 0) & ~x["mandatory"]
        return F.struct(F.when(goes, s["over"] - x["cost"]).otherwise(s["over"]).alias("over"), F.when(goes, s["kept"]).otherwise(F.concat(F.array(x["id"].cast("string")), s["kept"])).alias("kept"))

    # once an item goes no parents are left, and those that come with items are gone with them
    rows = rows.withColumn("end", F.aggregate(F.reverse("items"), state, drop))
    return rows.select("case_id", F.col("end.kept").alias("kept"), F.transform(F.slice("seen", F.lit(1), F.col("n_parents")), lambda x: x["parent"]).alias("parents"), (F.col("end.over") <= 0).alias("fits"))


__all__ = ["DIGITS", "IDENTITY", "citation_numbers", "contained", "covers", "first_hits", "fitted", "fused", "interleaved", "mandatory", "ordered", "selected", "step_citations"]
