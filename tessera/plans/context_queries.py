"""Queries of what an answer is made from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import roles
from ..operators import context as C

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Results of plans of eight documents. Hits of parents p0 to p2: a parent's text holds that of every hit but the fourth's
# kind, its places those of odd documents; some hits have no identity, no parent, or a parent that is too long
RESULTS_SQL = """rs as (select doc_id // 8 as plan_id, (doc_id % 8 + 1)::int as number, case when doc_id % 9 = 4 then '' else 'f<' || doc_id || '>.txt' end as file_name, 't' || doc_id % 4 as text_content,
case when doc_id % 3 = 0 then '' else 'head' || doc_id % 2 || chr(10) || chr(10) end as context_prefix, case when doc_id % 11 = 0 then 0 else doc_id // 24 + 1 end as document_id, 'v1' as version, 'c' || doc_id as chunk_key, 'p' || doc_id % 3 as parent_id,
doc_id % 5 <> 0 as headed, doc_id % 7 <> 0 as placed, doc_id % 10 as a, doc_id % 10 + 5 as z, case when doc_id % 8 in (2, 5) then '' else 'say t0 t1 t2 ' || repeat('x', (doc_id % 3 * 1400)::int) end as parent_text from documents),
el as (select * from rs where document_id <> 0 and parent_text <> ''),
fi as (select plan_id, document_id, parent_id, min(number) as first_at from el group by all),
fc as (select fi.*, strlen(parent_text) as cost, row_number() over (partition by fi.plan_id order by first_at) as k from fi join el on el.plan_id = fi.plan_id and el.number = fi.first_at),
gr as (with recursive g as (select distinct plan_id, 0::bigint as k, 3000::bigint as room, []::int[] as taken from fc union all
 select f.plan_id, f.k, case when cost <= room then room - cost else room end, case when cost <= room then list_append(taken, f.first_at) else taken end from g join fc f on f.plan_id = g.plan_id and f.k = g.k + 1)
 select plan_id, taken from (select *, row_number() over (partition by plan_id order by k desc) as n from g) where n = 1),
ch as (select fc.plan_id, fc.document_id, fc.parent_id, fc.first_at, ((select count(*) from rs r where r.plan_id = fc.plan_id) + list_position(taken, fc.first_at))::int as parent_number from fc join gr using (plan_id) where list_contains(taken, fc.first_at))"""


def _json(kind: str, key: str, a: str, z: str, rows: str, always: str) -> str:
    return f"""replace(replace('{{"kind":"{kind}"' || case when r.document_id <> 0 then ',"document_id":' || r.document_id else '' end || ',"version":"v1","chunk_key":"' || {key} || '","parent_id":"' || r.parent_id || '"' ||
 case when r.headed then ',"heading_path":["h & i"]' else '' end || case when {always} then ',"source_spans":[{{"block_id":"b0","page_no":1,"start":' || {a} || ',"end":' || {z} || '}}]' else '' end || {rows} || '}} ', '&', '\\u0026'), '<', '\\u003c')"""


CHILD = _json("child", "r.chunk_key", "r.a", "r.z", "''", "r.placed")
FROM_PARENT = _json("parent_context", "r.parent_id", "1", "14", "',\"row_range\":[0,2]'", "true")


@query(f"""with {RESULTS_SQL},
ln as (select r.plan_id, r.number, '(来源#' || r.number || ': ' || case when r.file_name = '' then 'unknown' else r.file_name end || ') ' || case when r.document_id = 0 and not r.headed and not r.placed then '' else {CHILD} end ||
 case when r.context_prefix = '' then '' else rtrim(r.context_prefix, chr(10)) || chr(10) end ||
 case when c.parent_number is not null and r.placed and r.text_content <> 't3' and r.a >= 1 and r.z <= 14 then '命中原文已包含于父块补充来源#' || c.parent_number || '；本来源仅指上述子块范围。' else r.text_content end as line
 from rs r left join ch c on c.plan_id = r.plan_id and c.document_id = r.document_id and c.parent_id = r.parent_id
union all select r.plan_id, c.parent_number, '(来源#' || c.parent_number || ': ' || case when r.file_name = '' then 'unknown' else r.file_name end || ') ' || {FROM_PARENT} || r.parent_text from ch c join rs r on r.plan_id = c.plan_id and r.number = c.first_at),
pl as (select distinct unnest([doc_id // 8, -1 - doc_id // 8]) as plan_id from documents)
select plan_id, '<<REF>>' || chr(10) || coalesce(lines, '（本轮无检索结果）') || chr(10) || '<<END>>' as "references" from pl left join (select plan_id, string_agg(line, chr(10) order by number) as lines from ln group by plan_id) using (plan_id)""")
def context_references(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    docs = roles.table(spark, sf_dir, "documents").select("doc_id")
    place = lambda a, z: F.array(F.struct(F.lit("b0").alias("block_id"), F.lit(1).alias("page_no"), F.lit(None).cast("array<double>").alias("bbox"), a.alias("start"), z.alias("end")))
    none = F.array()
    parent = F.concat(F.lit("say t0 t1 t2 "), F.repeat(F.lit("x"), (d % 3 * 1400).cast("int")))
    results = docs.select(
        F.floor(d / 8).alias("plan_id"), (d % 8 + 1).cast("int").alias("number"), F.when(d % 9 == 4, "").otherwise(F.concat(F.lit("f<"), d.cast("string"), F.lit(">.txt"))).alias("file_name"), F.concat(F.lit("t"), (d % 4).cast("string")).alias("text_content"),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("head"), (d % 2).cast("string"), F.lit("\n\n"))).alias("context_prefix"), F.when(d % 11 == 0, 0).otherwise(F.floor(d / 24) + 1).alias("document_id"), F.lit("v1").alias("version"),
        F.concat(F.lit("c"), d.cast("string")).alias("chunk_key"), F.concat(F.lit("p"), (d % 3).cast("string")).alias("parent_id"), F.filter(F.array(F.lit("h & i")), lambda _: d % 5 != 0).alias("heading_path"),
        F.filter(place(d % 10, d % 10 + 5), lambda _: d % 7 != 0).alias("source_spans"), F.lit("").alias("table_id"), none.cast("array<int>").alias("row_range"), none.cast("array<array<string>>").alias("column_paths"),
        F.when((d % 8).isin(2, 5), "").otherwise(parent).alias("parent_text"), place(F.lit(1).cast("long"), F.lit(14).cast("long")).alias("parent_spans"), F.array(F.lit(0), F.lit(2)).alias("parent_row_range"), none.cast("array<array<string>>").alias("parent_column_paths"),
    )
    # as many plans again have no results
    plan = F.floor(d / 8)
    return C.references(docs.select(F.explode(F.array(plan, -1 - plan)).alias("plan_id")), results)


@query("""select conv_id, output, 16 + sum(16 + strlen(role) + strlen(coalesce(text, ''))) <= least(20000, 32768 - 1024 - case when output <= 0 then 8192 else output end) as fits
from conversations, (values (0), (1000), (31000), (31500)) o(output) group by conv_id, output""")
def context_budget(spark, sf_dir) -> DataFrame:
    m = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    lists = roles.messages(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(m).alias("messages"))
    rows = lists.withColumn("output", F.explode(F.array(*[F.lit(x) for x in (0, 1000, 31000, 31500)])))
    return rows.select("conv_id", "output", C.within_budget(F.col("messages"), F.col("output")).alias("fits"))


@query("""with it as (select o_custkey as case_id, row_number() over (partition by o_custkey order by o_orderkey) as spot, o_orderkey as id, (o_orderkey % 1900 + 50)::bigint as cost, o_orderkey % 3 = 0 as mandatory from orders),
nd as (select case_id, coalesce(sum(cost) filter (mandatory), 0) as needed, sum(cost) as whole from it group by case_id),
me as (select case_id, k, (case_id % 5 + k) * 300 as cost, needed, sum((case_id % 5 + k) * 300) over (partition by case_id order by k) as total from nd, (values (1), (2), (3), (4)) m(k)),
kp as (select case_id, coalesce(max(k) filter (total + needed + 100 <= 6000), 0)::int as n from me group by case_id)
select case_id, n as memories, needed + 100 + coalesce((select max(total) from me where me.case_id = kp.case_id and k <= n), 0) <= 6000 as fits from kp join nd using (case_id)""")
def memories_until_fit(spark, sf_dir) -> DataFrame:
    o = roles.table(spark, sf_dir, "orders")
    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    item = F.struct("at", F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 1900 + 50).cast("long").alias("cost"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("parent_cost"), (F.col("o_orderkey") % 3 == 0).alias("mandatory"))
    items = o.withColumn("at", at).groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    memories = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(k.cast("string").alias("id"), ((F.col("case_id") % 5 + k) * 300).cast("long").alias("cost")))
    out = C.fitted_with_memories(items.withColumn("base", F.lit(100).cast("long")).withColumn("memories", memories), 6000)
    return out.select("case_id", F.size("memories").alias("memories"), "fits")
