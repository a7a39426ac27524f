"""Question plans as data: validation, execution in two layers, bindings."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import bounded, substituted
from ..session import parts

STEP = "struct<id:int,question:string,depends_on:array<int>>"
PLAN = f"struct<standalone_question:string,clarification_question:string,steps:array<{STEP}>>"
# fixed values: the fields of a plan and of a step
PLAN_FIELDS, STEP_FIELDS = ["clarification_question", "standalone_question", "steps"], ["depends_on", "id", "question"]


#: fixed value: bytes of an answer that may hold a plan
MAX_PLAN_BYTES = 16 * 1024


def strict_plan(text: str) -> dict | None:
    """A plan as it is written, or nothing: one JSON object of known fields, each of its type, and nothing behind it."""

    def refuse(word: str):
        raise ValueError(word)

    def holds(value, kind: type) -> bool:
        return value is None or type(value) is kind

    try:
        plan = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    if type(plan) is not dict or not set(plan) <= set(PLAN_FIELDS) or not all(holds(plan.get(f), str) for f in PLAN_FIELDS[:2]) or not holds(plan.get("steps"), list):
        return None
    for step in plan.get("steps") or []:
        if type(step) is not dict or not set(step) <= set(STEP_FIELDS) or not holds(step.get("question"), str) or not holds(step.get("depends_on"), list):
            return None
        numbers = [0 if step.get("id") is None else step["id"], *(step.get("depends_on") or [])]
        if not all(type(n) is int and abs(n) < 1 << 31 for n in numbers):
            return None
    steps = [{"id": x.get("id") or 0, "question": x.get("question") or "", "depends_on": x.get("depends_on") or []} for x in plan.get("steps") or []]
    return {"standalone_question": plan.get("standalone_question") or "", "clarification_question": plan.get("clarification_question") or "", "steps": steps}


def parsed_plans(plans: DataFrame) -> DataFrame:
    """Plans (plan_id, json) with ``plan``, null where the text is no UTF-8, longer than 16 KiB, or anything but one plan."""

    kind = to_arrow_type(_parse_datatype_string(PLAN))

    @F.arrow_udf(PLAN)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else strict_plan(t) for t in texts.to_pylist()], kind)

    fits = F.is_valid_utf8("json") & (F.octet_length("json") <= MAX_PLAN_BYTES)
    return plans.withColumn("plan", read(F.when(fits, F.col("json"))))


def holder(n: Column) -> Column:
    return F.concat(F.lit("{{step:"), n.cast("string"), F.lit("}}"))


def plan_fault(plan: Column) -> Column:
    """The first rule a plan breaks, or null."""
    steps = F.coalesce(plan["steps"], F.array().cast(f"array<{STEP}>"))
    asks = F.coalesce(plan["clarification_question"], F.lit("")) != ""

    def deps(s: Column) -> Column:
        return F.coalesce(s["depends_on"], F.array().cast("array<int>"))

    numbered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: (F.get(steps, i - 1)["id"] == i) & bounded(F.get(steps, i - 1)["question"], 1024))
    sound = F.forall(steps, lambda s: F.forall(deps(s), lambda d: (d >= 1) & (d < s["id"]) & (F.size(deps(F.get(steps, d - 1))) == 0)) & (F.size(F.array_distinct(deps(s))) == F.size(deps(s))))
    placed = F.forall(steps, lambda s: F.forall(deps(s), lambda d: F.contains(s["question"], holder(d))))
    bare = F.forall(steps, lambda s: ~F.contains(F.aggregate(deps(s), s["question"], lambda t, d: F.replace(t, holder(d), F.lit(""))), F.lit("{{step:")))
    return (
        F.when(plan.isNull(), "json")
        .when(~bounded(plan["standalone_question"], 4096), "question")
        .when(asks & (~bounded(plan["clarification_question"], 1024) | (F.size(steps) > 0)), "clarification")
        .when(asks, F.lit(None).cast("string"))
        .when((F.size(steps) < 1) | (F.size(steps) > 3), "steps")
        .when(~numbered, "step")
        .when(~sound, "dependency")
        .when(~placed, "placeholder")
        .when(~bare, "undeclared")
    )


def propagated(steps: DataFrame) -> DataFrame:
    """(plan_id, step_id, status) of dependent steps by their parents: blocked_service, blocked_no_evidence or pending.

    steps: plan_id, step_id, depends_on, status (of those without dependencies).
    """
    need = steps.where(F.size("depends_on") > 0).select("plan_id", "step_id", F.explode("depends_on").alias("parent"))
    known = steps.select("plan_id", F.col("step_id").alias("parent"), F.col("status").alias("parent_status"))
    met = need.join(known, ["plan_id", "parent"])
    severity = F.max(F.when(F.col("parent_status") == "failed", 2).when(F.col("parent_status") != "retrieved", 1).otherwise(0))
    return met.groupBy("plan_id", "step_id").agg(severity.alias("s")).select("plan_id", "step_id", F.when(F.col("s") == 2, "blocked_service").when(F.col("s") == 1, "blocked_no_evidence").otherwise("pending").alias("status"))


def binding_faults(pending: DataFrame, sources: DataFrame, bindings: DataFrame) -> DataFrame:
    """(plan_id, rule) broken by a plan's bindings; any fault fails all of the plan's pending steps.

    pending: plan_id, step_id, question, depends_on; sources: plan_id, source_id, step_id, text;
    bindings: plan_id, step_id, no_evidence, clarification, evidence (array of source_id, quote, value).
    """
    n = parts(pending, sources, bindings)
    by_plan = bindings.repartition(n, "plan_id").groupBy("plan_id").agg(F.count("*").alias("m"), F.countDistinct("step_id").alias("d"))
    counts = pending.repartition(n, "plan_id").groupBy("plan_id").agg(F.count("*").alias("n")).join(by_plan, "plan_id", "left")
    out = counts.where("m is null or n <> m or d <> m").select("plan_id", F.lit("missing").alias("rule"))
    waiting, given = [x.repartition(n, "plan_id", "step_id") for x in (pending, bindings)]
    out = out.union(given.join(waiting, ["plan_id", "step_id"], "left_anti").select("plan_id", F.lit("unknown")))
    b = given.withColumn("asks", F.coalesce("clarification", F.lit("")) != "").join(waiting, ["plan_id", "step_id"])
    open_ = F.col("asks") | F.col("no_evidence")
    out = out.union(b.where(open_ & ((F.size("evidence") > 0) | (F.col("asks") & F.col("no_evidence")) | (F.col("asks") & ~bounded(F.col("clarification"), 1024)))).select("plan_id", F.lit("state")))
    bound = b.where(~open_)
    out = out.union(bound.where((F.size("evidence") < 1) | (F.size("evidence") > 6)).select("plan_id", F.lit("evidence")))
    each = bound.select("plan_id", "step_id", "depends_on", F.explode("evidence").alias("e")).select("plan_id", "step_id", "depends_on", "e.*")
    found = sources.select("plan_id", "source_id", F.col("step_id").alias("parent"), "text").repartition(n, "plan_id", "source_id")
    met = each.repartition(n, "plan_id", "source_id").join(found, ["plan_id", "source_id"], "left")
    grounded = F.coalesce(F.array_contains("depends_on", F.col("parent")) & bounded(F.col("quote"), 1000) & bounded(F.col("value"), 256) & F.contains("text", F.col("quote")) & F.contains("quote", F.col("value")) & ~F.contains("value", F.lit("{{step:")), F.lit(False))
    out = out.union(met.where(~grounded).select("plan_id", F.lit("grounding")))
    step = ["plan_id", "step_id", "parent"]
    values = met.where(grounded).select(*step, "value").repartition(n, *step).groupBy(*step).agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    out = out.union(values.where("n > 1").select("plan_id", F.lit("conflict")))
    needed = bound.select("plan_id", "step_id", F.explode("depends_on").alias("parent")).repartition(n, *step)
    out = out.union(needed.join(values, step, "left_anti").select("plan_id", F.lit("parent")))
    return out.repartition(n, "plan_id").distinct()


def bound_questions(pending: DataFrame, sources: DataFrame, bindings: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(plan_id, step_id, question) of plans without a fault, with the values in their places; ``faults`` where they are known."""
    n = parts(pending, sources, bindings)
    faults = binding_faults(pending, sources, bindings) if faults is None else faults.repartition(n, "plan_id")
    good = bindings.where(~F.col("no_evidence") & (F.coalesce("clarification", F.lit("")) == "")).repartition(n, "plan_id").join(faults, "plan_id", "left_anti")
    each = good.select("plan_id", "step_id", F.explode("evidence").alias("e")).select("plan_id", "step_id", "e.source_id", "e.value").repartition(n, "plan_id", "source_id")
    found = sources.select("plan_id", "source_id", F.col("step_id").alias("parent")).repartition(n, "plan_id", "source_id")
    met = each.join(found, ["plan_id", "source_id"]).select("plan_id", "step_id", "parent", "value").repartition(n, "plan_id", "step_id")
    values = met.distinct().groupBy("plan_id", "step_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parent", "value")))).alias("v"))
    return pending.repartition(n, "plan_id", "step_id").join(values, ["plan_id", "step_id"]).select("plan_id", "step_id", substituted(F.col("question"), F.col("v")).alias("question"))


def trimmed_sources(sources: DataFrame, budget: int) -> DataFrame:
    """Sources (plan_id, place, step_id, cost) that stay: the lowest of a step that has others go until the rest fits.

    A step's first source always stays. Places run by rank, then step, so what goes is a suffix of the others.
    """
    from pyspark.sql import Window as W

    first = W.partitionBy("plan_id", "step_id").orderBy("place")
    rows = sources.withColumn("n", F.row_number().over(first))
    fixed = F.sum(F.when(F.col("n") == 1, F.col("cost")).otherwise(0)).over(W.partitionBy("plan_id"))
    others = F.sum(F.when(F.col("n") > 1, F.col("cost")).otherwise(0)).over(W.partitionBy("plan_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("fixed", fixed).withColumn("others", others).where((F.col("n") == 1) | (F.col("fixed") + F.col("others") <= budget)).drop("n", "fixed", "others")


def execute(plans: DataFrame, bindings: DataFrame, search: Callable[[DataFrame, str], DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Run plans in two layers, each one job for all plans: (steps with status, hits).

    plans: plan_id, steps; ``search`` takes (plan_id, step_id, question) and top-k's name, and gives hits
    (plan_id, step_id, rank, source_id, text, ...). A plan of one step asks for ten results, others for five.
    ``keep`` gives rows back as they are stored: each layer's hits, the steps that wait and the faults are read several times.
    """
    steps = plans.select("plan_id", F.size("steps").alias("n"), F.explode("steps").alias("s")).select("plan_id", F.when(F.col("n") == 1, 10).otherwise(5).alias("top_k"), F.col("s.id").alias("step_id"), F.col("s.question").alias("question"), F.coalesce("s.depends_on", F.array().cast("array<int>")).alias("depends_on"))
    roots = steps.where(F.size("depends_on") == 0)
    first = keep(search(roots, "top_k").where(F.trim("text") != ""))
    found = first.select("plan_id", "step_id").distinct().withColumn("hit", F.lit(True))
    done = roots.join(found, ["plan_id", "step_id"], "left").select("plan_id", "step_id", "depends_on", F.when(F.col("hit"), "retrieved").otherwise("empty").alias("status"))
    waiting = steps.where(F.size("depends_on") > 0).select("plan_id", "step_id", "depends_on", F.lit("pending").alias("status"))
    state = keep(propagated(done.union(waiting)))
    pending = keep(steps.join(state.where("status = 'pending'").select("plan_id", "step_id"), ["plan_id", "step_id"]))
    sources = first.select("plan_id", F.concat(F.lit("s"), F.col("step_id").cast("string"), F.lit(":"), F.col("rank").cast("string")).alias("source_id"), "step_id", "text")
    broken = keep(binding_faults(pending, sources, bindings).select("plan_id").distinct())
    questions = keep(bound_questions(pending, sources, bindings, broken))
    second = keep(search(questions.join(steps.select("plan_id", "step_id", "top_k"), ["plan_id", "step_id"]), "top_k").where(F.trim("text") != ""))
    hit_again = second.select("plan_id", "step_id").distinct().withColumn("hit", F.lit(True))
    asked = questions.select("plan_id", "step_id").withColumn("asked", F.lit(True))
    faults = broken.withColumn("fault", F.lit(True))
    later = state.join(asked, ["plan_id", "step_id"], "left").join(hit_again, ["plan_id", "step_id"], "left").join(faults, "plan_id", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("fault"), "failed_binding").when(F.col("hit"), "retrieved").when(F.col("asked"), "empty").otherwise("blocked_no_evidence")
    return done.select("plan_id", "step_id", "status").union(later.select("plan_id", "step_id", status)), first.unionByName(second, allowMissingColumns=True)
