"""A quality report of parsed documents: (document_id, rule, count) of what breaks a rule.

Every rule is an expression over a document's own arrays, so the report is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MAX_CHUNKS
from .chunking import CHILD_MAX, PARENT_MAX

ID = r"^[A-Za-z0-9_-]{1,96}$"


# fixed values: kinds of chunks
KINDS = ["text", "code", "row_group"]


def count_if(array: Column, bad) -> Column:
    return F.size(F.filter(array, bad))


def flag(bad: Column) -> Column:
    return F.coalesce(bad, F.lit(True)).cast("int")


def covered(spans: Column, start: Column, end: Column) -> Column:
    """Whether spans leave no gap in [start, end)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    reach = F.aggregate(ordered, start, lambda at, s: F.when(s["start"] <= at, F.greatest(at, s["end"])).otherwise(at))
    return reach >= end


def inside(inner: Column, spans: Column) -> Column:
    return F.exists(spans, lambda o: (o["block_id"] == inner["block_id"]) & o["page_no"].eqNullSafe(inner["page_no"]) & (o["start"] <= inner["start"]) & (o["end"] >= inner["end"]))


def of_block(spans: Column, block: Column) -> Column:
    return F.filter(spans, lambda s: s["block_id"] == block)


def bad_place(s: Column) -> Column:
    """A bounding box needs a page, four shares of it, and two corners in order."""
    b = s["bbox"]
    return b.isNotNull() & (s["page_no"].isNull() | (F.size(b) != 4) | F.exists(b, lambda v: (v < 0) | (v > 1)) | (F.get(b, F.lit(0)) > F.get(b, F.lit(2))) | (F.get(b, F.lit(1)) > F.get(b, F.lit(3))))


def body_of(chunk: Column, blocks: Column) -> Column:
    """The text that a chunk's spans say: ranges of a block that touch are one, others part by a blank line."""
    start = F.struct(F.lit("").alias("block"), F.lit(-1).alias("end"), F.lit("").alias("text"))

    def add(s: Column, x: Column) -> Column:
        text = F.get(F.filter(blocks, lambda b: b["block_id"] == x["block_id"]), F.lit(0))["text"]
        begin = F.when((s["block"] == x["block_id"]) & (x["start"] <= s["end"]), s["end"]).otherwise(x["start"])
        more = F.when(x["end"] > begin, F.substring(text, begin + 1, x["end"] - begin)).otherwise("")
        apart = (s["end"] >= 0) & ~((s["block"] == x["block_id"]) & (x["start"] <= s["end"]))
        return F.struct(x["block_id"].alias("block"), F.greatest(x["end"], F.when(s["block"] == x["block_id"], s["end"]).otherwise(-1)).alias("end"), F.concat(s["text"], F.when(apart, "\n\n").otherwise(""), more).alias("text"))

    return F.aggregate(chunk["source_spans"], start, add, lambda s: s["text"])


def rules() -> dict[str, Column]:
    blocks, tables, parents, children = (F.col(c) for c in ("blocks", "tables", "parents", "children"))
    names = F.transform(blocks, lambda b: b["block_id"])
    every = F.concat(parents, children)
    ids = F.transform(every, lambda c: c["chunk_id"])

    def parent_of(c: Column) -> Column:
        return F.get(F.filter(parents, lambda p: p["chunk_id"] == c["parent_id"]), F.lit(0))

    def own(p: Column) -> Column:
        return F.filter(children, lambda c: c["parent_id"] == p["chunk_id"])

    def chunk_faults(c: Column, most: int) -> Column:
        spans = c["source_spans"]
        return (
            ~F.coalesce(c["kind"].isin(KINDS), F.lit(False)) | ~F.is_valid_utf8(c["body_text"]) | (c["token_count"] <= 0) | (c["token_count"] > most) | (F.trim(c["body_text"]) == "") | (F.size(spans) == 0) | (F.size(c["block_ids"]) == 0)
            | (F.size(F.array_distinct(c["block_ids"])) < F.size(c["block_ids"])) | (F.size(F.array_except(c["block_ids"], names)) > 0)
            | (F.size(F.array_except(F.transform(spans, lambda s: s["block_id"]), c["block_ids"])) > 0) | (F.size(F.array_except(c["block_ids"], F.transform(spans, lambda s: s["block_id"]))) > 0)
        )

    def overlap_fault(c: Column) -> Column:
        before = F.get(F.filter(children, lambda o: o["chunk_id"] == c["prev_id"]), F.lit(0))
        alone = (F.size(c["block_ids"]) == 1) & (c["block_ids"] == before["block_ids"]) & (before["parent_id"] == c["parent_id"])
        shared = F.forall(c["overlap_spans"], lambda s: inside(s, c["source_spans"]) & inside(s, before["source_spans"]))
        return (F.size(c["overlap_spans"]) > 0) & ~F.coalesce(alone & shared, F.lit(False))

    def parent_covered(p: Column) -> Column:
        mine = F.flatten(F.transform(own(p), lambda c: c["source_spans"]))
        return F.forall(p["source_spans"], lambda s: covered(F.filter(mine, lambda x: (x["block_id"] == s["block_id"]) & x["page_no"].eqNullSafe(s["page_no"])), s["start"], s["end"]))

    parent_spans = F.flatten(F.transform(parents, lambda p: p["source_spans"]))
    sizes = F.size(parents) + F.size(children)

    def cell_text(c: Column) -> Column:
        s = F.get(c["source_spans"], F.lit(0))
        text = F.get(F.filter(blocks, lambda b: b["block_id"] == s["block_id"]), F.lit(0))["text"]
        return (F.size(c["source_spans"]) == 0) | (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == c["raw_text"])

    return {
        "V2 chunks": flag((F.size(parents) < 1) | (F.size(children) < 1) | (sizes > MAX_CHUNKS)),
        "V3 ids": F.size(ids) - F.size(F.array_distinct(ids)) + count_if(every, lambda c: ~F.rlike(c["chunk_id"], F.lit(ID))) + count_if(parents, lambda p: (p["parent_id"] != "") | (F.size(p["overlap_spans"]) > 0)),
        "V4 chunk": count_if(parents, lambda c: chunk_faults(c, PARENT_MAX)) + count_if(children, lambda c: chunk_faults(c, CHILD_MAX)),
        "V5 embedding text": count_if(children, lambda c: c["embedding_text"] != F.concat(c["context_prefix"], c["body_text"])),
        "V6 parent": count_if(children, lambda c: ~F.coalesce(F.forall(c["source_spans"], lambda s: inside(s, parent_of(c)["source_spans"])), F.lit(False))),
        "V7 overlap": count_if(children, overlap_fault),
        "V8 children": count_if(parents, lambda p: (F.size(own(p)) == 0) | ~parent_covered(p)),
        "V9 blocks": count_if(blocks, lambda b: (b["type"] != "heading") & (b["text"] != "") & ~covered(of_block(parent_spans, b["block_id"]), F.lit(0), F.char_length(b["text"]))),
        "V10 body": count_if(every, lambda c: body_of(c, blocks) != c["body_text"]),
        "V11 document": count_if(blocks, lambda b: (b["text"] == "") | ~covered(b["source_spans"], F.lit(0), F.char_length(b["text"])) | F.exists(b["source_spans"], lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.char_length(b["text"])) | bad_place(s)))
        + F.size(F.filter(blocks, lambda b, i: b["reading_order"] != i)),
        "V12 tables": count_if(tables, lambda t: F.size(F.array_distinct(F.transform(t["cells"], lambda c: c["cell_id"]))) < F.size(t["cells"]))
        + count_if(F.flatten(F.transform(tables, lambda t: t["cells"])), lambda c: ~F.coalesce(cell_text(c), F.lit(False)))
        + count_if(blocks, lambda b: (b["type"] == "table_row") & ~F.exists(tables, lambda t: (t["table_id"] == b["table_id"]) & F.array_contains(t["block_ids"], b["block_id"])))
        + count_if(tables, lambda t: F.exists(t["block_ids"], lambda n: ~F.exists(blocks, lambda b: (b["block_id"] == n) & (b["table_id"] == t["table_id"])))),
    }


def report(parsed: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """(document_id, rule, count) of broken rules; ``config`` gives columns and what they must equal (V1)."""
    checks = dict(rules())
    for name, value in (config or {}).items():
        checks[f"V1 {name}"] = flag(~F.col(name).eqNullSafe(F.lit(value)))
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(1)).cast("long").alias("count")) for k, v in checks.items()])
    return parsed.where("error is null").select("document_id", F.explode(found).alias("x")).select("document_id", "x.rule", "x.count").where("count > 0")
