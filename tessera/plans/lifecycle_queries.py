"""Queries of uploads, tasks, versions and question plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import roles
from ..functions.text import backoff_seconds
from ..operators import lifecycle as L, planning as P

QUERIES, SQL = {}, {}
CLOCK = "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PARTS_SQL = """parts as (select l_orderkey % 500 + 1 as document_id, (case when l_suppkey % 3 = 0 then -1 else l_linenumber - 1 end)::int as chunk_index from lineitem),
up as (select doc_id + 1 as id, (doc_id % 9) * 5242880 - 7 as total_size from documents)"""


def _parts(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500 + 1).alias("document_id"), F.when(F.col("l_suppkey") % 3 == 0, -1).otherwise(F.col("l_linenumber") - 1).cast("int").alias("chunk_index"))


def _uploads(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), ((F.col("doc_id") % 9) * 5242880 - 7).alias("total_size"))


@query(f"""with {PARTS_SQL}, t as (select id, case when total_size <= 0 then 0 else (total_size - 1) // 5242880 + 1 end::bigint as total from up),
d as (select p.document_id as id, count(distinct p.chunk_index) as uploaded from parts p join t on t.id = p.document_id where p.chunk_index >= 0 and p.chunk_index < t.total group by 1)
select t.id, total, coalesce(uploaded, 0)::bigint as uploaded, case when total = 0 then 0.0::double else round(coalesce(uploaded, 0) * 100.0::double / total, 6) end as percent, total > 0 and coalesce(uploaded, 0) >= total as complete from t left join d using (id)""")
def upload_progress(spark, sf_dir) -> DataFrame:
    return L.progress(_uploads(spark, sf_dir), _parts(spark, sf_dir))


@query("select doc_id, case when n <= 0 then 0 else (n - 1) // 5242880 + 1 end::bigint as parts from (select doc_id, doc_id * 1048576 - 1048576 as n from documents)")
def total_chunks(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", L.total_parts(F.col("doc_id") * 1048576 - 1048576).alias("parts"))


@query("""select id, list_filter(range(0, total), lambda i: (strpos('0123456789abcdef', substr(h, (i // 4 + 1)::int, 1)) - 1) // (2 ** (3 - i % 4))::int % 2 = 1) as parts from
(select doc_id + 1 as id, substr(md5('b' || doc_id), 1, 6) as h, doc_id % 25 as total from documents)""")
def bitmap_indexes(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    rows = roles.table(spark, sf_dir, "documents").select((d + 1).alias("id"), F.unhex(F.substring(F.md5(F.concat(F.lit("b"), d.cast("string")).cast("binary")), 1, 6)).alias("bitmap"), (d % 25).alias("total"))
    return L.parts_of_bitmap(rows).select("id", F.transform("parts", lambda x: x.cast("long")).alias("parts"))


@query("""with p as (select doc_id // 4 as id, (doc_id % 4)::int as k, doc_id, coalesce(text, '') as t from documents),
w as (select id, count(*) as n, md5(string_agg(t, '' order by k)) as m from p where not (id % 5 = 0 and k = 2) group by id)
select id, case when n = 4 then m end as md5, case when n < 4 then 'incomplete' when id % 7 = 0 then 'corrupt' else 'ready' end as outcome from w""")
def merge_uploads(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    p = roles.table(spark, sf_dir, "documents").select(F.floor(d / 4).alias("document_id"), (d % 4).cast("int").alias("chunk_index"), text.alias("t"), d.alias("seq"))
    whole = p.groupBy(F.col("document_id").alias("id")).agg(F.md5(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "t"))), lambda x: x["t"])).cast("binary")).alias("m"))
    files = whole.select("id", F.when(F.col("id") % 7 == 0, F.lit("0" * 32)).otherwise(F.upper("m")).alias("file_md5"), F.lit(4 * 5242880).cast("long").alias("total_size"))
    # a part that was uploaded twice: the later content counts
    old = p.select("document_id", "chunk_index", F.lit(b"old").alias("content"), (F.col("seq") - 1000).alias("seq"))
    kept = p.select("document_id", "chunk_index", F.col("t").cast("binary").alias("content"), "seq").union(old)
    return L.merged(kept.where("not (document_id % 5 = 0 and chunk_index = 2)"), files)


def _outbox(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    at = F.col("ts").cast("timestamp_ntz")
    lease = F.when(e % 4 == 1, at + F.expr("interval 2 days")).when(e % 4 == 2, at - F.expr("interval 1 day"))
    return roles.table(spark, sf_dir, "events").select(e.alias("document_id"), "user_id", (e % 8).cast("int").alias("attempts"), at.alias("available_at"), lease.alias("lease_until"))


OUTBOX_SQL = """ob as (select event_id as document_id, user_id, (event_id % 8)::int as attempts, ts::timestamp as available_at,
case event_id % 4 when 1 then ts::timestamp + interval 2 days when 2 then ts::timestamp - interval 1 day end as lease_until from events)"""


@query(f"with {OUTBOX_SQL} select document_id, attempts, available_at from ob where available_at <= timestamp '{CLOCK}' and (lease_until is null or lease_until <= timestamp '{CLOCK}') order by available_at, document_id limit 50")
def outbox_claimable(spark, sf_dir) -> DataFrame:
    return L.claim(_outbox(spark, sf_dir), F.lit(CLOCK).cast("timestamp_ntz"), "t1", 50).select("document_id", "attempts", "available_at")


@query(f"with {OUTBOX_SQL} select document_id, attempts, least(2.0::double ** least(greatest(attempts, 1), 6), 60.0) as seconds from ob")
def outbox_backoff(spark, sf_dir) -> DataFrame:
    return _outbox(spark, sf_dir).select("document_id", "attempts", backoff_seconds(F.col("attempts")).alias("seconds"))


@query(f"""with {OUTBOX_SQL} select user_id as document_id, min(available_at) as available_at from ob where user_id not in (select user_id from ob where user_id % 3 = 0) group by user_id""")
def coalesced_enqueue(spark, sf_dir) -> DataFrame:
    o = _outbox(spark, sf_dir).select(F.col("user_id").alias("document_id"), "available_at")
    return L.enqueued(o.where("document_id % 3 = 0"), o)


EVENTS_SQL = """ev as (select user_id as document_id, event_id as seq, case event_id % 4 when 0 then 'begin' when 1 then 'stage' when 2 then 'publish' else 'fail' end as kind, 'v' || (event_id // 4 % 3) as version from events)"""


def version_events(spark, sf_dir) -> DataFrame:
    """Every third user's log is a run of complete publications; the others' events come as they fall."""
    e = roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"))
    k = F.row_number().over(W.partitionBy("document_id").orderBy("seq")) - 1
    rows = e.withColumn("k", F.when(F.col("document_id") % 3 == 0, k).otherwise(F.col("seq")))
    kind = F.when(F.col("k") % 4 == 0, "begin").when(F.col("k") % 4 == 1, "stage").when(F.col("k") % 4 == 2, "publish").otherwise("fail")
    return rows.select("document_id", "seq", kind.alias("kind"), F.concat(F.lit("v"), (F.floor(F.col("k") / 4) % 3).cast("string")).alias("version"))


@query("""with recursive ev0 as (select user_id as document_id, event_id as seq, case when user_id % 3 = 0 then row_number() over (partition by user_id order by event_id) - 1 else event_id end as k, row_number() over (partition by user_id order by event_id) as n from events),
ev as (select document_id, n, case k % 4 when 0 then 'begin' when 1 then 'stage' when 2 then 'publish' else 'fail' end as kind, 'v' || (k // 4 % 3) as version from ev0),
f as (select distinct document_id, 0::bigint as n, '' as active_version, '' as pending_version, '' as status from ev
union all select e.document_id, e.n,
 case when e.kind = 'publish' and f.pending_version = e.version and f.status = 'embedding' then e.version else f.active_version end,
 case when e.kind = 'begin' then e.version when e.kind = 'publish' and f.pending_version = e.version and f.status = 'embedding' then '' else f.pending_version end,
 case when e.kind = 'begin' then 'parsing' when e.kind = 'stage' and f.pending_version = e.version and f.status = 'parsing' then 'embedding'
  when e.kind = 'publish' and f.pending_version = e.version and f.status = 'embedding' then 'ready' when e.kind = 'fail' and f.pending_version = e.version then 'failed' else f.status end
from f join ev e on e.document_id = f.document_id and e.n = f.n + 1)
select document_id, active_version, pending_version, status from (select *, row_number() over (partition by document_id order by n desc) as back from f) where back = 1""")
def published_snapshot(spark, sf_dir) -> DataFrame:
    return L.folded(version_events(spark, sf_dir))


CHUNKS_SQL = "ch as (select doc_id + 1 as document_id, v.version, doc_id from documents, (values ('v0'), ('v1'), ('v9')) v(version))"


def _chunks(spark, sf_dir) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("document_id"))
    return d.withColumn("version", F.explode(F.array(*[F.lit(v) for v in ("v0", "v1", "v9")])))


@query(roles.sql("states", body=f", {CHUNKS_SQL} select c.document_id, c.version from ch c join states s on s.document_id = c.document_id and s.active_version = c.version where s.active_version <> ''"))
def readable_versions(spark, sf_dir) -> DataFrame:
    return L.readable(_chunks(spark, sf_dir), roles.states(spark, sf_dir))


@query(roles.sql("states", body=f", {CHUNKS_SQL} select c.document_id, c.version from ch c where not exists (select 1 from states s where s.document_id = c.document_id and c.version in (s.active_version, s.pending_version))"))
def stale_versions(spark, sf_dir) -> DataFrame:
    return L.stale(_chunks(spark, sf_dir), roles.states(spark, sf_dir))


@query(roles.sql("states", body=f", {CHUNKS_SQL} select c.document_id, c.version from ch c where c.version <> 'v1' or exists (select 1 from states s where s.document_id = c.document_id and s.active_version = 'v1')"))
def discard_versions(spark, sf_dir) -> DataFrame:
    c = _chunks(spark, sf_dir)
    return L.discarded(c, roles.states(spark, sf_dir), c.where("version = 'v1'"))


@query(roles.sql("files", "states", body="""select s.document_id, s.status from states s where s.document_id not in (select f.id from files f where f.id % 4 = 1 and (f.user_id = 2 or f.id % 8 = 1))"""))
def cascade_delete(spark, sf_dir) -> DataFrame:
    f = roles.files(spark, sf_dir)
    requests = f.where("id % 4 = 1").select(F.col("id").alias("document_id"), F.lit(2).alias("by_user"), F.when(F.col("id") % 8 == 1, "ADMIN").otherwise("USER").alias("role"))
    return L.without(roles.states(spark, sf_dir), L.deletable(f, requests)).select("document_id", "status")


@query("""select key, (1 + count(w))::bigint as version, coalesce(max_by(w, w), 's') as value from (select c_custkey as key, case when c_custkey % 3 = 0 then 'a' end as w from customer) group by key""")
def compare_and_set(spark, sf_dir) -> DataFrame:
    c = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    states = c.select("key", F.lit(1).cast("long").alias("version"), F.lit("s").alias("value"))
    ok = c.where("key % 3 = 0").select("key", F.lit(1).cast("long").alias("expected"), F.lit("a").alias("value"), F.lit(1).cast("long").alias("seq"))
    late = c.where("key % 6 = 0").select("key", F.lit(1).cast("long").alias("expected"), F.lit("b").alias("value"), F.lit(2).cast("long").alias("seq"))
    return L.compare_and_set(states, ok.union(late))


@query("""select document_id, seq, status from (select user_id as document_id, event_id as seq, event_type as status, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1""")
def upsert_latest(spark, sf_dir) -> DataFrame:
    return L.latest(roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


#: What a model might answer to the question of an order, as text that both engines build alike.
ANSWERS = """case o_orderkey % 28
when 1 then concat('{"standalone_question":"q","steps":[{"id":1,"question":"who is ', o_custkey, '"},{"id":2,"question":"of {{step:1}}","depends_on":[1]}]}')
when 2 then concat('{"standalone_question":"q","clarification_question":"which of ', o_orderkey, '?","steps":[]}')
when 3 then concat('{"standalone_question":"q","clarification_question":"which of ', o_orderkey, '?","steps":[{"id":1,"question":"a"}]}')
when 4 then '{"standalone_question":"  ","steps":[{"id":1,"question":"a"}]}'
when 5 then '{"standalone_question":"q","steps":[]}'
when 6 then concat('{"standalone_question":"q","steps":[', repeat(concat('{"id":1,"question":"', o_custkey, '"},'), 3), '{"id":4,"question":"a"}]}')
when 7 then concat('{"standalone_question":"q","steps":[{"id":', o_orderkey % 3, ',"question":"a"}]}')
when 8 then '{"standalone_question":"q","steps":[{"id":1,"question":"{{step:1}}","depends_on":[1]}]}'
when 9 then '{"standalone_question":"q","steps":[{"id":1,"question":"a"},{"id":2,"question":"{{step:1}}","depends_on":[1]},{"id":3,"question":"{{step:2}}","depends_on":[2]}]}'
when 10 then concat('{"standalone_question":"q","steps":[{"id":1,"question":"a"},{"id":2,"question":"{{step:1}}","depends_on":[1,', o_custkey % 2 + 1, ']}]}')
when 11 then concat('{"standalone_question":"q","steps":[{"id":1,"question":"a"},{"id":2,"question":"b {{step:', o_custkey % 2, '}}","depends_on":[1]}]}')
when 12 then '{"standalone_question":"q","steps":[{"id":1,"question":"of {{step:2}}"}]}'
when 13 then concat('{"standalone_question":"q","mode":"', o_custkey, '","steps":[{"id":1,"question":"a"}]}')
when 14 then concat('{"standalone_question":"', o_custkey)
when 15 then '{"standalone_question":"q","steps":[{"id":1,"question":"a"}]}{}'
when 16 then '{"standalone_question":"q","steps":[{"id":1,"question":"a"}]} x'
when 17 then concat('{"standalone_question":"q","steps":[{"id":1,"question":"a"}]}', repeat(' ', 16320 + cast(o_custkey % 9 as int)))
when 18 then '{"standalone_question":"q","steps":[{"id":"1","question":"a"}]}'
when 19 then '{"standalone_question":"q","steps":[{"id":1.0,"question":"a"}]}'
when 20 then concat('{"standalone_question":', o_custkey, ',"steps":[{"id":1,"question":"a"}]}')
when 21 then '{"standalone_question":"q","steps":[{"id":1,"question":"a","depends_on":null}]}'
when 22 then '{"standalone_question":"q","steps":[{"id":1,"question":"a","why":"b"}]}'
when 23 then '{"standalone_question":"q","steps":[5]}'
when 24 then '[]'
when 25 then '{"standalone_question":"q","steps":[{"id":1,"question":"a"},{"id":2,"question":"b"},{"id":3,"question":"{{step:1}} {{step:2}}","depends_on":[1,2]}]}'
when 26 then concat('{"standalone_question":"q","steps":[{"id":1,"question":"', repeat('x', 1020 + cast(o_custkey % 9 as int)), '"}]}')
when 27 then '{"standalone_question":"q","steps":[{"id":1,"question":"a","depends_on":["1"]}]}'
else concat('{"standalone_question":"about ', o_custkey, '","clarification_question":null,"steps":[{"id":1,"question":"what is ', o_orderkey, '","depends_on":[]}]}') end"""

KINDS = "coalesce(json_type({0}, '{1}'), 'NULL') in ({2}, 'NULL')"
INTEGER, TEXT_TYPE, LIST = "'UBIGINT', 'BIGINT'", "'VARCHAR'", "'ARRAY'"
STEP_OK = " and ".join(
    ["json_type(x) = 'OBJECT'", "len(list_filter(json_keys(x), lambda k: k not in ('id', 'question', 'depends_on'))) = 0", KINDS.format("x", "$.id", INTEGER), KINDS.format("x", "$.question", TEXT_TYPE), KINDS.format("x", "$.depends_on", LIST),
     f"len(list_filter(json_extract(x, '$.depends_on[*]'), lambda d: json_type(d) not in ({INTEGER}))) = 0"]
)


@query(f"""with raw as (select o_orderkey as plan_id, {ANSWERS} as t from orders),
valid as (select *, strlen(t) <= 16384 and json_valid(t) as ok from raw),
plain as (select plan_id, case when ok then t else '[]' end as t from valid),
top as (select *, json_type(t) = 'OBJECT' and len(list_filter(json_keys(t), lambda k: k not in ('standalone_question', 'clarification_question', 'steps'))) = 0
  and {KINDS.format('t', '$.standalone_question', TEXT_TYPE)} and {KINDS.format('t', '$.clarification_question', TEXT_TYPE)} and {KINDS.format('t', '$.steps', LIST)} as ok, json_extract(t, '$.steps[*]') as xs from plain),
typed as (select plan_id, coalesce(ok and len(list_filter(xs, lambda x: not ({STEP_OK}))) = 0, false) as ok, t, xs from top),
p as (select plan_id, ok, coalesce(t->>'$.standalone_question', '') as q, coalesce(t->>'$.clarification_question', '') as c,
  case when ok then list_transform(xs, lambda x: {{'id': coalesce((x->>'$.id')::bigint, 0), 'q': coalesce(x->>'$.question', ''), 'd': list_transform(json_extract(x, '$.depends_on[*]'), lambda d: d::bigint)}}) end as st from typed)
select plan_id, case when not ok then 'json' when trim(q) = '' or length(q) > 4096 then 'question'
 when c <> '' then case when trim(c) = '' or length(c) > 1024 or len(st) > 0 then 'clarification' end
 when len(st) < 1 or len(st) > 3 then 'steps'
 when len(list_filter(range(1, len(st) + 1), lambda i: not (st[i].id = i and trim(st[i].q) <> '' and length(st[i].q) <= 1024))) > 0 then 'step'
 when len(list_filter(st, lambda s: len(list_distinct(s.d)) <> len(s.d) or len(list_filter(s.d, lambda d: not (d >= 1 and d < s.id and coalesce(len(st[d].d), 0) = 0))) > 0)) > 0 then 'dependency'
 when len(list_filter(st, lambda s: len(list_filter(s.d, lambda d: not contains(s.q, '{{{{step:' || d || '}}}}'))) > 0)) > 0 then 'placeholder'
 when len(list_filter(st, lambda s: contains(list_reduce(list_concat([s.q], list_transform(s.d, lambda d: '{{{{step:' || d || '}}}}')), lambda a, b: replace(a, b, '')), '{{{{step:'))) > 0 then 'undeclared' end as fault from p""")
def plan_validation(spark, sf_dir) -> DataFrame:
    """A model's answer to each order's question: the first rule it breaks."""
    plans = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.expr(ANSWERS).alias("json"))
    return P.parsed_plans(plans).select("plan_id", P.plan_fault(F.col("plan")).alias("fault"))


#: Plans of two steps, one for each order: what was found for the first, and how a model binds the second to it.
FOUND = """select o_orderkey as plan_id, concat('s1:', k) as source_id, 1 as step_id, case when k = 1 then concat('the daughter of Anna', o_custkey) when o_orderkey % 5 = 0 then '' else concat('Anna', o_custkey, ' is old') end as text from orders cross join (select explode(array(1, 2)) as k)"""
BOUND = """select o_orderkey as plan_id, case when o_orderkey % 13 = 12 then 3 else 2 end as step_id, o_orderkey % 13 in (2, 4) as no_evidence, case when o_orderkey % 13 in (3, 4) then concat('which Anna of ', o_custkey, '?') end as clarification,
 case when o_orderkey % 13 = 6 then 's9:1' else 's1:1' end as s1, case when o_orderkey % 13 = 7 then 'of Bert' when o_orderkey % 13 = 8 then 'daughter of' else concat('of Anna', o_custkey) end as q1, case when o_orderkey % 13 = 7 then 'Bert' else concat('Anna', o_custkey) end as v1,
 's1:2' as s2, concat('Anna', o_custkey, ' is') as q2, case when o_orderkey % 13 = 9 then 'is' else concat('Anna', o_custkey) end as v2,
 case when o_orderkey % 13 in (2, 3, 4, 5) then 0 when o_orderkey % 13 in (1, 9) then 2 else 1 end as n from orders where o_orderkey % 13 <> 10"""


def binding_case(spark, sf_dir):
    roles.table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_bindings")
    read = lambda text: spark.sql(text.replace("from orders", "from orders_of_bindings"))
    pending = read("select o_orderkey as plan_id, 2 as step_id, concat('age of {{step:1}} in ', o_custkey) as question, array(1) as depends_on from orders")
    each = F.array(*[F.struct(F.col(f"s{k}").alias("source_id"), F.col(f"q{k}").alias("quote"), F.col(f"v{k}").alias("value")) for k in (1, 2)])
    bindings = read(BOUND).select("plan_id", "step_id", "no_evidence", "clarification", F.slice(each, F.lit(1), F.col("n")).alias("evidence"))
    return pending, read(FOUND), bindings


_BIND = f"""src as ({FOUND.replace("(select explode(array(1, 2)) as k)", "(select unnest([1, 2]) as k)")}),
b as (select *, coalesce(clarification, '') <> '' as asks, step_id = 2 as known from ({BOUND})),
e as (select plan_id, s1 as source_id, q1 as quote, v1 as value from b where known and not asks and not no_evidence and n >= 1 union all select plan_id, s2, q2, v2 from b where known and not asks and not no_evidence and n >= 2),
g as (select e.*, src.step_id as parent, coalesce(src.step_id = 1 and trim(quote) <> '' and length(quote) <= 1000 and trim(value) <> '' and length(value) <= 256 and contains(text, quote) and contains(quote, value) and not contains(value, '{{{{step:'), false) as grounded from e left join src using (plan_id, source_id)),
faults as (
 select o_orderkey as plan_id, 'missing' as rule from orders where o_orderkey not in (select plan_id from b)
 union select plan_id, 'unknown' from b where not known
 union select plan_id, 'state' from b where known and ((asks or no_evidence) and n > 0 or asks and no_evidence)
 union select plan_id, 'evidence' from b where known and not asks and not no_evidence and n < 1
 union select plan_id, 'grounding' from g where not grounded
 union select plan_id, 'conflict' from g where grounded group by plan_id, parent having count(distinct value) > 1
 union select plan_id, 'parent' from b where known and not asks and not no_evidence and plan_id not in (select plan_id from g where grounded and parent = 1))"""


@query(f"with {_BIND} select plan_id, rule from faults")
def binding_validation(spark, sf_dir) -> DataFrame:
    return P.binding_faults(*binding_case(spark, sf_dir))


@query(f"""with {_BIND} select distinct plan_id, 2 as step_id, 'age of ' || value || ' in ' || o_custkey as question from g join orders on o_orderkey = plan_id where plan_id not in (select plan_id from faults)""")
def bound_questions(spark, sf_dir) -> DataFrame:
    return P.bound_questions(*binding_case(spark, sf_dir))


@query("""select plan_id, place, step_id from (select *, sum(case when n = 1 then cost else 0 end) over (partition by plan_id) as fixed, sum(case when n > 1 then cost else 0 end) over (partition by plan_id order by place rows between unbounded preceding and current row) as others
from (select *, row_number() over (partition by plan_id, step_id order by place) as n from (select o_custkey as plan_id, row_number() over (partition by o_custkey order by o_orderkey)::int as place, (o_orderkey % 3)::int as step_id, (o_orderkey % 97 + 10) as cost from orders))) where n = 1 or fixed + others <= 300""")
def binding_input_trim(spark, sf_dir) -> DataFrame:
    o = roles.table(spark, sf_dir, "orders")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("plan_id"), place.alias("place"), (F.col("o_orderkey") % 3).cast("int").alias("step_id"), (F.col("o_orderkey") % 97 + 10).alias("cost"))
    return P.trimmed_sources(rows, 300).select("plan_id", "place", "step_id")


@query("""select o_custkey as plan_id, o_orderkey as step_id, case when o_custkey % 4 = 0 then 'blocked_service' when o_custkey % 4 = 1 then 'blocked_no_evidence' else 'pending' end as status from orders""")
def step_status(spark, sf_dir) -> DataFrame:
    return _step_status(roles.table(spark, sf_dir, "orders"))


def _step_status(orders: DataFrame) -> DataFrame:
    o = orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("step_id"))
    c = F.col("plan_id") % 4
    roots = o.select("plan_id").distinct().select("plan_id", F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("step_id")).withColumn("depends_on", F.array().cast("array<bigint>"))
    roots = roots.withColumn("status", F.when((F.col("step_id") == -1) & (c == 0), "failed").when((F.col("step_id") == -2) & (c <= 1), "empty").otherwise("retrieved"))
    waiting = o.select("plan_id", "step_id", F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long")).alias("depends_on"), F.lit("pending").alias("status"))
    return P.propagated(roots.union(waiting))
