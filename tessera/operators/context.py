"""What an answer is made from: references as text, the budget of a message list, memories that give way to evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import context_text, estimate, message_cost
from ..schemas import MAX_INPUT, OUTPUT_TOKENS, PARENT_BYTES, WINDOW_MARGIN, WINDOW_TOKENS
from .fusion import PLAN, covers, fitted
from .retrieval import greedy

# fixed values: marks around references, and what stands for none of them or for a text that a parent holds
REF_START, REF_END = "<<REF>>", "<<END>>"
NO_RESULTS = "（本轮无检索结果）"
HELD_BY_PARENT = ("命中原文已包含于父块补充来源#", "；本来源仅指上述子块范围。")
SOURCE = ("(来源#", ": ", ") ")
UNKNOWN_FILE = "unknown"
# fixed values: signs that JSON in these texts writes by their number
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026"}

PARENT = ["document_id", "version", "parent_id"]


def described(kind: str, chunk_key: str, spans: str, row_range: str, column_paths: str) -> Column:
    """A source's identity and places as JSON, without what is empty, and a space."""

    def list_of(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name))

    def text_of(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    parts = F.struct(
        F.lit(kind).alias("kind"), F.when(F.col("document_id") != 0, F.col("document_id")).alias("document_id"), text_of("version").alias("version"), text_of(chunk_key).alias("chunk_key"), text_of("parent_id").alias("parent_id"),
        list_of("heading_path").alias("heading_path"), list_of(spans).alias("source_spans"), text_of("table_id").alias("table_id"), list_of(row_range).alias("row_range"), list_of(column_paths).alias("column_paths"),
    )
    out = F.to_json(parts)
    for sign, code in ESCAPED.items():
        out = F.replace(out, F.lit(sign), F.lit(code))
    return F.concat(out, F.lit(" "))


def selected_parents(results: DataFrame, budget: int = PARENT_BYTES) -> DataFrame:
    """(plan_id, document_id, version, parent_id, at, parent_number): parents in the order of their first hit, numbered after the results.

    A parent costs its bytes once; what doesn't fit what is left is passed over.
    """
    known = results.where((F.col("document_id") != 0) & (F.col("version") != "") & (F.col("parent_id") != "") & (F.col("parent_text") != "") & (F.size("parent_spans") > 0))
    first = known.groupBy(PLAN, *PARENT).agg(F.min(F.struct("number", estimate(F.col("parent_text")).alias("cost"))).alias("x"))
    # as many as a plan has results
    items = first.groupBy(PLAN).agg(F.array_sort(F.collect_list(F.struct(F.col("x.number").alias("at"), F.col("x.number").alias("id"), F.col("x.cost").alias("cost")))).alias("items"))
    chosen = items.select(PLAN, F.posexplode(greedy(F.col("items"), budget)).alias("k", "id")).select(PLAN, F.col("id").cast("int").alias("at"), "k")
    count = results.groupBy(PLAN).agg(F.count("*").alias("n"))
    return first.withColumn("at", F.col("x.number")).join(chosen, [PLAN, "at"]).join(count, PLAN).select(PLAN, *PARENT, "at", (F.col("n") + F.col("k") + 1).cast("int").alias("parent_number"))


def references(plans: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, references): each plan's sources as numbered lines between marks; plans without results say so.

    results: plan_id, number (from 1, in order), file_name, text_content, context_prefix, document_id, version,
    chunk_key, parent_id, heading_path, source_spans, table_id, row_range, column_paths, and parent_text,
    parent_spans, parent_row_range, parent_column_paths. A hit whose text and places its parent holds points to it.
    """
    file = F.when(F.coalesce("file_name", F.lit("")) == "", UNKNOWN_FILE).otherwise(F.col("file_name"))
    parents = selected_parents(results)
    held = results.join(parents.select(PLAN, *PARENT, "parent_number", "at"), [PLAN, *PARENT], "left")
    # what the parent's own first hit says of it counts for all of its hits
    said = results.select(PLAN, F.col("number").alias("at"), F.col("parent_text").alias("said_text"), F.col("parent_spans").alias("said_spans"))
    held = held.join(said, [PLAN, "at"], "left")
    inside = F.coalesce(covers(F.col("said_text"), F.col("said_spans"), F.col("text_content"), F.col("source_spans")), F.lit(False))
    pointer = F.concat(F.lit(HELD_BY_PARENT[0]), F.col("parent_number").cast("string"), F.lit(HELD_BY_PARENT[1]))
    body = F.when(F.col("parent_number").isNotNull() & inside, pointer).otherwise(F.col("text_content"))
    bare = (F.col("document_id") == 0) & (F.size("heading_path") <= 0) & (F.size("source_spans") <= 0)
    meta = F.when(bare, "").otherwise(described("child", "chunk_key", "source_spans", "row_range", "column_paths"))

    def line(number: Column, *parts: Column) -> Column:
        return F.concat(F.lit(SOURCE[0]), number.cast("string"), F.lit(SOURCE[1]), file, F.lit(SOURCE[2]), *parts)

    children = held.select(PLAN, "number", line(F.col("number"), meta, context_text(F.col("context_prefix"), body)).alias("line"))
    firsts = held.where(F.col("at") == F.col("number"))
    more = firsts.select(PLAN, F.col("parent_number").alias("number"), line(F.col("parent_number"), described("parent_context", "parent_id", "parent_spans", "parent_row_range", "parent_column_paths"), F.col("parent_text")).alias("line"))
    lines = children.union(more).groupBy(PLAN).agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("lines"))
    told = plans.select(PLAN).distinct().join(lines, PLAN, "left")
    inner = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).otherwise(NO_RESULTS)
    return told.select(PLAN, F.concat(F.lit(REF_START + "\n"), inner, F.lit("\n" + REF_END)).alias("references"))


def input_limit(output: Column) -> Column:
    """What messages may cost: the most of an input, or what the window leaves beside the answer and a margin."""
    answer = F.when(output <= 0, OUTPUT_TOKENS).otherwise(output)
    return F.least(F.lit(MAX_INPUT), F.lit(WINDOW_TOKENS - WINDOW_MARGIN) - answer)


def within_budget(messages: Column, output: Column) -> Column:
    """Whether a list of (role, content) leaves room for an answer of so many tokens; 0 stands for the usual size."""
    return message_cost(messages) <= input_limit(output)


def fitted_with_memories(cases: DataFrame, budget: int) -> DataFrame:
    """(case_id, memories, kept, parents, fits): memories give way, from the last, until the evidence fits.

    cases: case_id, items (fusion.fitted), base, memories: array of (id, cost) in order. What evidence can't do without
    is its mandatory items; with the memories that leave room for these, it is fitted.
    """
    needed = F.aggregate(F.filter("items", lambda x: x["mandatory"]), F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    room = F.lit(budget) - F.col("base") - needed
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("ids"), F.lit(True).alias("open"))

    def hold(s: Column, m: Column) -> Column:
        total = s["sum"] + m["cost"]
        fits = s["open"] & (total <= room)
        return F.struct(F.when(fits, total).otherwise(s["sum"]).alias("sum"), F.when(fits, F.concat(s["ids"], F.array(m["id"].cast("string")))).otherwise(s["ids"]).alias("ids"), fits.alias("open"))

    kept = cases.withColumn("held", F.aggregate("memories", start, hold))
    known = kept.select("case_id", F.col("held.ids").alias("memories"))
    return fitted(kept.withColumn("base", F.col("base") + F.col("held.sum")), budget).join(known, "case_id").select("case_id", "memories", "kept", "parents", "fits")


__all__ = ["described", "fitted_with_memories", "input_limit", "references", "selected_parents", "within_budget"]
