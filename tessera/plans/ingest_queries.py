"""Queries of imports, staged chunks, embedding, plan execution and small column rules, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .. import roles
from ..functions import text as X
from ..operators import chunking, planning
from ..schemas import UPLOAD_PART
from ..sources import files as S
from .document_queries import CHUNKS_SQL, documents
from .store_queries import scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with d as (select doc_id, 'seed/doc-' || doc_id || '.txt' as path, coalesce(text, '') as text, md5(coalesce(text, '')) as md5 from documents)
select min(path) as path, md5, any_value(strlen(text))::bigint as size, greatest(1, ceil(any_value(strlen(text)) / 5242880.0))::bigint as parts, true as is_public from d
where md5 not in (select md5 from d where doc_id % 7 = 2 and doc_id % 10 > 2) group by md5""")
def folder_import(spark, sf_dir) -> DataFrame:
    """All documents as files of a folder that user 3 imports: contents the user has completed stay out, each content comes once."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    found = roles.table(spark, sf_dir, "documents").select(F.concat(F.lit("seed/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length(text).cast("long").alias("size"), F.md5(text).alias("md5"), text.alias("content"))
    new = S.to_import(found, roles.files(spark, sf_dir), 3)
    return new.select("path", "md5", "size", F.greatest(F.lit(1), F.ceil(F.col("size") / UPLOAD_PART)).cast("long").alias("parts"), F.lit(True).alias("is_public"))


@query(f"""with ck as (select document_id, is_parent, length(body_text) as n from ({CHUNKS_SQL})), v as (select *, '007' as version from ck union all select *, '7' from ck where document_id % 2 = 0)
select document_id, version, count(*) filter (is_parent) as parents, count(*) filter (not is_parent) as children, sum(n)::bigint as chars from v group by document_id, version""")
def appended_chunks(spark, sf_dir) -> DataFrame:
    """All documents' chunks appended as one version, half of them as another whose name is the same number; read back."""
    at, parsed = f"{scratch(spark)}/chunks", chunking.parse_and_chunk(documents(spark, sf_dir)).where("error is null")
    S.append_chunks(chunking.chunk_rows(parsed, "007"), at)
    stored = spark.read.schema(chunking.chunk_rows(parsed, "7").schema).parquet(at)
    S.append_chunks(stored.where("document_id % 2 = 0").withColumn("version", F.lit("7")), at)
    return stored.sparkSession.read.schema(stored.schema).parquet(at).groupBy("document_id", "version").agg(F.count_if("is_parent").alias("parents"), F.count_if(~F.col("is_parent")).alias("children"), F.sum(F.length("data.body_text")).cast("long").alias("chars"))


def shape_embedder():
    """Vectors that SQL can follow: characters, letters e and blanks."""
    return lambda texts: np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], np.float32)


@query(f"""with ck as (select document_id || '/' || version || '/' || chunk_id as vector_id, context_prefix || body_text as t from ({CHUNKS_SQL}) where not is_parent)
select vector_id, 'shape' as model_version, [length(t), length(t) - length(replace(t, 'e', '')), length(t) - length(replace(t, ' ', ''))]::float[] as vector from ck""")
def embedded_index(spark, sf_dir) -> DataFrame:
    """Children of all documents, embedded in batches of 32, appended to an index that has to acknowledge each once."""
    rows = chunking.chunk_rows(chunking.parse_and_chunk(documents(spark, sf_dir)).where("error is null")).where("not is_parent")
    named = rows.select(F.concat_ws("/", F.col("document_id").cast("string"), "version", "chunk_id").alias("vector_id"), F.col("data.embedding_text").alias("embedding_text"))
    stored = S.append_index(S.embedded(named, shape_embedder, "shape", 3), scratch(spark), 3)
    return stored.select("vector_id", "model_version", "vector")


@query("""with c as (select c_custkey as p, case when c_custkey % 4 = 0 then 10 else 5 end as k from customer),
o as (select p, o_orderkey as key, row_number() over (partition by p order by o_totalprice desc, o_orderkey) as rank, k from c join orders on o_custkey = p),
h as (select * from o where rank <= k and key % 5 <> 0),
one as (select p, case when count(h.key) > 0 then 'retrieved' else 'empty' end as status, count(h.key) as hits, min(h.rank) as first_rank from c left join h using (p) group by p),
n as (select o.p, least(count(*), 5) as lines from o join lineitem on l_orderkey = o.key where o.rank = 1 group by o.p),
two as (select one.p, case when one.status = 'empty' or one.p % 7 in (2, 3) then 'blocked_no_evidence' when one.p % 7 = 1 or o.key % 5 = 0 then 'failed_binding' when n.lines > 0 then 'retrieved' else 'empty' end as status, lines from one left join o on o.p = one.p and o.rank = 1 left join n on n.p = one.p where one.p % 4 <> 0)
select p as plan_id, 1 as step_id, status, hits, first_rank::int as first_rank from one union all select p, 2, status, case when status = 'retrieved' then lines else 0 end, case when status = 'retrieved' then 1 end from two""")
def executed_plans(spark, sf_dir) -> DataFrame:
    """A plan a customer: its orders, then the lines of the dearest one, bound by evidence that some plans lack, decline or misquote."""
    customers, orders, lines = (roles.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    p = F.col("c_custkey")

    def step(number: int, question, *needs: int):
        return F.struct(F.lit(number).alias("id"), question.alias("question"), F.array(*[F.lit(x) for x in needs]).cast("array<int>").alias("depends_on"))

    first, second = step(1, F.concat(F.lit("orders of "), p.cast("string"))), step(2, F.lit("lines of {{step:1}}"), 1)
    plans = customers.select(p.alias("plan_id"), F.when(p % 4 == 0, F.array(first)).otherwise(F.array(first, second)).alias("steps"))
    dearest = orders.groupBy(F.col("o_custkey").alias("plan_id")).agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).cast("string").alias("key"))
    rest, quote = F.col("plan_id") % 7, F.concat(F.lit("order "), F.col("key"))
    evidence = F.struct(F.lit("s1:1").alias("source_id"), quote.alias("quote"), F.when(rest == 1, "none").otherwise(F.col("key")).alias("value"))
    none = F.array().cast("array<struct<source_id:string,quote:string,value:string>>")
    bindings = dearest.where("plan_id % 4 <> 0").select("plan_id", F.lit(2).alias("step_id"), (rest == 2).alias("no_evidence"), F.when(rest == 3, "which?").otherwise("").alias("clarification"), F.when(rest.isin(2, 3), none).otherwise(F.array(evidence)).alias("evidence"))
    answers = orders.select(F.concat(F.lit("orders of "), F.col("o_custkey").cast("string")).alias("question"), (-F.col("o_totalprice")).cast("double").alias("place"), F.col("o_orderkey").alias("tie"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("text"))
    answers = answers.union(lines.select(F.concat(F.lit("lines of "), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("double"), F.col("l_linenumber").cast("long"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))))

    def search(questions: DataFrame, top_k: str) -> DataFrame:
        ranked = questions.join(answers, "question").withColumn("rank", F.row_number().over(W.partitionBy("plan_id", "step_id").orderBy("place", "tie")))
        return ranked.where(F.col("rank") <= F.col(top_k)).select("plan_id", "step_id", "rank", "text")

    def keep(rows: DataFrame) -> DataFrame:
        at = scratch(spark)
        rows.write.parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    status, hits = planning.execute(plans, bindings, search, keep)
    found = hits.groupBy("plan_id", "step_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first_rank"))
    return status.join(found, ["plan_id", "step_id"], "left").select("plan_id", "step_id", "status", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "first_rank")


@query("select doc_id, case when length(text) <= 80 then text else left(text, 80) || '…' end as shown, left(text, 1000) as error from documents")
def short_texts(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text"), 80).alias("shown"), X.error_text(F.col("text")).alias("error"))


@query("""with b as (select l_orderkey * 10 + l_linenumber as line_id, l_quantity::double * 12 - 20 as x0, l_quantity::double * 12 + l_linenumber * 9 as x1, (l_partkey % 800)::double as y0, (l_partkey % 800 + l_suppkey % 60 - 30)::double as y1, case when l_suppkey % 9 = 0 then 0.0 else 500.0 end as w, 700.0::double as h, l_linenumber % 2 = 0 as up from lineitem),
f as (select *, case when up then h - y0 else y0 end as t, case when up then h - y1 else y1 end as u from b)
select line_id, round(least(1.0, greatest(0.0, x0 / w)), 6) as x_min, round(least(1.0, greatest(0.0, least(t, u) / h)), 6) as y_min, round(least(1.0, greatest(0.0, x1 / w)), 6) as x_max, round(least(1.0, greatest(0.0, greatest(t, u) / h)), 6) as y_max from f where w <> 0
union all select line_id, null, null, null, null from f where w = 0""")
def page_boxes(spark, sf_dir) -> DataFrame:
    """Boxes made of all lines, some beyond the page, some counted from its bottom, some without a page."""
    q, y = F.col("l_quantity").cast("double") * 12, (F.col("l_partkey") % 800).cast("double")
    width = F.when(F.col("l_suppkey") % 9 == 0, 0.0).otherwise(500.0)
    box = X.page_box(q - 20, y, q + F.col("l_linenumber") * 9, y + F.col("l_suppkey") % 60 - 30, width, F.lit(700.0), F.col("l_linenumber") % 2 == 0)
    rows = roles.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), box.alias("b"))
    return rows.select("line_id", *[F.round(F.get("b", F.lit(k)), 6).alias(n) for k, n in enumerate(("x_min", "y_min", "x_max", "y_max"))])
