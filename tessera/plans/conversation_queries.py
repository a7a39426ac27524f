"""Queries of conversations and memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import roles
from ..functions.text import follows_up, has_credential, message_cost, truncated
from ..operators import conversation as C

QUERIES, SQL = {}, {}
NOW = "2026-09-03 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def turns(spark, sf_dir) -> DataFrame:
    return C.pair_turns(roles.messages(spark, sf_dir))


@query(roles.sql("turns", body="select * from pairs"))
def pair_turns(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir)


@query(roles.sql("turns", body="select conv_id, turn_no, question, answer from (select *, row_number() over (partition by conv_id order by turn_no desc) as n from pairs) where n <= 2"))
def newest_turns(spark, sf_dir) -> DataFrame:
    return C.newest(turns(spark, sf_dir), 2)


@query(roles.sql("turns", body="""select conv_id, turn_no, question, answer from (select *, row_number() over w as n, sum(length(question) + length(answer)) over (partition by conv_id order by turn_no desc rows between unbounded preceding and current row) as chars
from pairs window w as (partition by conv_id order by turn_no desc)) where n <= 6 and chars <= 400"""))
def turn_window_chars(spark, sf_dir) -> DataFrame:
    return C.newest_by_chars(turns(spark, sf_dir), 6, 400)


@query(roles.sql("turns", body="""select conv_id, coalesce(list(turn_no order by turn_no) filter (keep), []) as kept, coalesce(max(turn_no) filter (not keep), 0)::bigint as cutoff from
(select *, n <= 2 and cost <= 600 as keep from (select conv_id, turn_no, row_number() over (partition by conv_id order by turn_no desc) as n,
16 + sum(45 + strlen(question) + strlen(answer)) over (partition by conv_id order by turn_no desc rows between unbounded preceding and current row) as cost from pairs)) group by conv_id"""))
def fit_recent_turns(spark, sf_dir) -> DataFrame:
    return C.fit_recent(turns(spark, sf_dir), 2, 600)


@query(roles.sql("turns", body="""select conv_id, row_number() over (partition by conv_id order by turn_no, k)::int as seq, role, content from
(select conv_id, turn_no, 0 as k, 'user' as role, question as content from pairs union all select conv_id, turn_no, 1, 'assistant', answer from pairs)"""))
def turn_messages(spark, sf_dir) -> DataFrame:
    return C.turn_messages(turns(spark, sf_dir))


@query(roles.sql("turns", body="""select conv_id, turn_no, question from (select *, row_number() over (partition by conv_id order by turn_no) as n from pairs where turn_no > 1) where n <= 2"""))
def keyset_page(spark, sf_dir) -> DataFrame:
    return C.after_turn(turns(spark, sf_dir), 1, 2).select("conv_id", "turn_no", "question")


@query("""select conv_id, (16 + sum(16 + strlen(role) + strlen(text)))::bigint as cost from conversations group by conv_id""")
def message_costs(spark, sf_dir) -> DataFrame:
    m = roles.messages(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return m.select("conv_id", message_cost(F.col("m")).alias("cost"))


@query(roles.sql("turns", body="""select conv_id, 'legacy-' || turn_no || '-' || substr(sha256(question || chr(10) || answer), 1, 32) as turn_id, turn_no::int as turn_no from
(select conv_id, question, answer, row_number() over (partition by conv_id order by turn_no) as turn_no from pairs)"""))
def legacy_turns(spark, sf_dir) -> DataFrame:
    m = C.turn_messages(turns(spark, sf_dir)).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return C.legacy_turns(m.select("conv_id", F.to_json("m").alias("json"))).select("conv_id", "turn_id", "turn_no")


@query(roles.sql("turns", body="""select conv_id, 't' || turn_no as turn_id, arrival::int as arrival, case when arrival = 1 then 'repeated' when conv_id % 2 = 0 then 'conflict' else 'repeated' end as outcome, turn_no::bigint as turn_no from pairs, (values (1), (2)) a(arrival)
union all select conv_id, 'new', 3, 'appended', max(turn_no) + 1 from pairs group by conv_id"""))
def append_turns(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("turn_id", F.concat(F.lit("t"), F.col("turn_no").cast("string")))
    again = t.select("conv_id", "turn_id", "question", "answer", F.lit(1).alias("arrival"))
    other = t.select("conv_id", "turn_id", "question", F.when(F.col("conv_id") % 2 == 0, F.concat("answer", F.lit("!"))).otherwise(F.col("answer")).alias("answer"), F.lit(2).alias("arrival"))
    new = t.select("conv_id").distinct().select("conv_id", F.lit("new").alias("turn_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(3).alias("arrival"))
    return C.append_turns(t, again.union(other).union(new))


@query("""select c_custkey as conv_id, (case when c_custkey % 2 = 0 and c_custkey % 3 <> 0 then 4 else 8 end)::bigint as summary_until, (case when c_custkey % 6 = 0 then 3 else 2 end)::bigint as version from customer""")
def summary_advance(spark, sf_dir) -> DataFrame:
    """Batches that write summaries: stale versions, gaps and watermarks that don't move change nothing."""
    k = F.col("c_custkey")
    c = roles.table(spark, sf_dir, "customer").select(k.alias("conv_id"))

    def write(seq, expected, first, until):
        return F.struct(*[F.lit(x).cast("long").alias(n) for n, x in (("seq", seq), ("expected", expected), ("first", first), ("until", until))])

    both = F.filter(F.array(write(0, 1, 3, 4), write(1, 1, 1, 4), write(2, 1, 1, 8), write(3, 2, 5, 4), write(4, 2, 5, 8)), lambda w: ((w["seq"] != 1) | (F.col("conv_id") % 2 == 0)) & ((w["seq"] != 4) | (F.col("conv_id") % 3 == 0)))
    writes = c.select("conv_id", F.explode(both).alias("w")).select("conv_id", "w.*")
    return C.summaries_advanced(c.withColumn("summary_until", F.lit(0)).withColumn("version", F.lit(1)), writes)


@query(roles.sql("turns", body="""select conv_id, (n // 4)::int as batch, list(turn_no order by turn_no) as turns, bool_or(turn_no - before > 1) as gap from
(select conv_id, turn_no, row_number() over w - 1 as n, coalesce(lag(turn_no) over w, -1) as before from pairs where turn_no <= 6 window w as (partition by conv_id order by turn_no)) where n < 8 group by conv_id, n // 4"""))
def pending_summary(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir)
    cut = t.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("summary_until"), F.lit(6).alias("cutoff"))
    return C.pending_for_summary(t, cut)


@query(roles.sql("turns", body="""select distinct conv_id, rule from (select conv_id, 'kind' as rule from pairs where turn_no % 4 = 2 union all select conv_id, 'unknown' from pairs where turn_no % 3 = 1
union all select conv_id, 'text' from pairs where length(question) > 500)"""))
def summary_validation(spark, sf_dir) -> DataFrame:
    t = turns(spark, sf_dir)
    no = F.col("turn_no")
    items = t.select("conv_id", no.cast("int").alias("pos"), F.when(no % 4 == 2, "chat").otherwise("topic").alias("kind"), F.col("question").alias("text"), F.array(F.when(no % 3 == 1, no + 1000).otherwise(no)).alias("source_turns"), F.lit(10).alias("bytes"))
    return C.summary_faults(items, t.select("conv_id", "turn_no"), 1500)


@query(roles.sql("turns", body="select conv_id, turn_no, turn_no % 3 <> 1 as valid from pairs"))
def turn_validation(spark, sf_dir) -> DataFrame:
    no = F.col("turn_no")
    rows = turns(spark, sf_dir).withColumn("sources", F.when(no % 3 == 1, F.array(F.struct(F.lit(2).alias("number")), F.struct(F.lit(2).alias("number")))).otherwise(F.array(F.struct(F.lit(1).alias("number")), F.struct(F.lit(24).alias("number")))))
    return C.valid_turns(rows).select("conv_id", "turn_no", "valid")


@query(roles.sql("turns", body="""select conv_id, conv_id % 5 as user_id, case when conv_id % 5 = 2 then '{}' else 's' end as summary, case when conv_id % 5 = 2 then last_turn else 0 end::bigint as summary_until,
case when conv_id % 5 = 2 then last_turn else 1 end::bigint as context_after, last_turn from (select conv_id, max(turn_no) as last_turn from pairs group by conv_id)"""))
def context_reset(spark, sf_dir) -> DataFrame:
    s = turns(spark, sf_dir).groupBy("conv_id").agg(F.max("turn_no").alias("last_turn"))
    s = s.select("conv_id", (F.col("conv_id") % 5).alias("user_id"), F.lit("s").alias("summary"), F.lit(0).cast("long").alias("summary_until"), F.lit(1).cast("long").alias("context_after"), "last_turn")
    return C.reset_context(s, spark.createDataFrame([(2,), (2,)], "user_id long"))


# users 0 to 9 have five memories each, made of short words of the corpus
MEMORY_ROWS = [(1, "global", "preference", "style", "short answers", [], None), (2, "global", "project", "p1", "about the", ["the", "und"], None), (3, "th", "decision", "d1", "that", ["of", "and", "la"], None),
               (4, "on", "project", "p2", "on it", ["re"], "2026-09-01 00:00:00"), (5, "er", "project", "p3", "her", ["and", "de", "que"], "2026-10-01 00:00:00")]
MEMORY_SQL = """mem as (select u.user_id, u.user_id * 10 + m.k as id, m.scope, m.kind, m.key, m.content, m.keywords, m.expires_at, timestamp '2026-01-01' + to_days((m.k % 3)::int) as updated_at from range(0, 10) u(user_id),
(values (1, 'global', 'preference', 'style', 'short answers', []::varchar[], null::timestamp), (2, 'global', 'project', 'p1', 'about the', ['the', 'und'], null), (3, 'th', 'decision', 'd1', 'that', ['of', 'and', 'la'], null),
(4, 'on', 'project', 'p2', 'on it', ['re'], timestamp '2026-09-01'), (5, 'er', 'project', 'p3', 'her', ['and', 'de', 'que'], timestamp '2026-10-01')) m(k, scope, kind, key, content, keywords, expires_at))"""


def memories(spark) -> DataFrame:
    base = spark.createDataFrame(MEMORY_ROWS, "k int, scope string, kind string, key string, content string, keywords array<string>, expires string")
    rows = spark.range(10).withColumnRenamed("id", "user_id").join(F.broadcast(base), F.lit(True))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("k") % 3)
    return rows.select("user_id", (F.col("user_id") * 10 + F.col("k")).alias("id"), "scope", "kind", "key", "content", "keywords", F.col("expires").cast("timestamp_ntz").alias("expires_at"), at.alias("updated_at"))


@query(f"""with {MEMORY_SQL}, q as (select conv_id * 100 + turn as question_id, conv_id % 10 as user_id, lower(text) as lookup from conversations where role = 'user'),
s as (select q.question_id, m.id, m.scope, m.kind, m.key, m.content, m.updated_at, 2 * len(list_filter(m.keywords, lambda k: contains(q.lookup, k))) + (case when m.scope = 'global' and m.kind = 'preference' then 1 else 0 end) as score
from q join mem m using (user_id) where (m.expires_at is null or m.expires_at > timestamp '{NOW}') and (m.scope = 'global' or contains(q.lookup, m.scope)))
select question_id, row_number() over (partition by question_id order by score desc, updated_at desc, id)::int as place, id as memory_id, score::int as score from s where score > 0""")
def memory_recall(spark, sf_dir) -> DataFrame:
    m = roles.messages(spark, sf_dir).where("role = 'user'")
    q = m.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), (F.col("conv_id") % 10).alias("user_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("recent"), F.lit(True).alias("has_recent"), F.array().cast("array<string>").alias("topics"))
    return C.recalled(memories(spark), q, 1500, F.lit(NOW).cast("timestamp_ntz"))


#: A memory for each order, of its customer, as text that both engines read.
KEPT = f"""select o_orderkey as id, o_custkey as user_id, case when o_orderkey % 3 = 0 then 'global' else concat('topic ', o_custkey) end as scope, case o_orderkey % 4 when 0 then 'preference' when 1 then 'decision' else 'project' end as kind, concat('k', o_orderkey) as key,
concat(case when o_orderkey % 17 = 0 then 'password: ' else 'note ' end, repeat('x', cast(o_orderkey % 50 as int)), o_custkey) as content, case when o_orderkey % 5 = 0 then '' else concat('word', o_orderkey % 7) end as word,
case when o_orderkey % 2 = 0 then timestamp '{NOW}' + make_interval(0, 0, 0, cast(o_orderkey % 11 - 5 as int)) end as expires_at, o_orderkey % 19 <> 0 as confirmed from orders"""
KEPT_SQL = KEPT.replace("make_interval(0, 0, 0, cast(o_orderkey % 11 - 5 as int))", "to_days(cast(o_orderkey % 11 - 5 as int))")


def kept_memories(spark, sf_dir) -> DataFrame:
    roles.table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_memories")
    rows = spark.sql(KEPT.replace("from orders", "from orders_of_memories").replace("timestamp '", "timestamp_ntz '"))
    return rows.withColumn("keywords", F.when(F.col("word") == "", F.array().cast("array<string>")).otherwise(F.array("word"))).drop("word")


@query(f"select user_id, count(*) as active from ({KEPT_SQL}) where expires_at is null or expires_at > timestamp '{NOW}' group by user_id")
def memory_expiry(spark, sf_dir) -> DataFrame:
    return C.unexpired(kept_memories(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("active"))


@query(f"""with mem as ({KEPT_SQL}), held as (select user_id, 5 * count(*) as active from mem where expires_at is null or expires_at > timestamp '{NOW}' group by user_id)
select id, case when not confirmed then 'unconfirmed' when expires_at <= timestamp '{NOW}' then 'expired' when word = '' and not (kind = 'preference' and scope = 'global') then 'no keyword'
when starts_with(content, 'password: ') then 'credential' when coalesce(active, 0) >= 50 then 'too many' end as fault from mem left join held using (user_id)""")
def memory_cap(spark, sf_dir) -> DataFrame:
    rows, now = kept_memories(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")
    counts = C.unexpired(rows, now).groupBy("user_id").agg((5 * F.count("*")).alias("active"))
    return C.memory_faults(rows, counts, now, 1500).select("id", "fault")


CREDENTIAL_SQL = r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk-[a-z0-9_-]{16,}|\bBearer\s+[a-z0-9_.-]{16,}|(?:password|passwd|api[_ -]?key|access[_ -]?token|secret|密码|密钥|令牌)\s*[:=：]\s*\S+)"


@query(f"select doc_id, regexp_matches(coalesce(text, ''), '{CREDENTIAL_SQL}') as credential from documents")
def credential_scan(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", has_credential(F.col("text")).alias("credential"))


@query("""select q, length(q) <= 100 and not contains(q, '换个话题') and not contains(q, '换一个话题') and regexp_matches(q, '它|他们|她们|这个|那个|前者|后者|上述|继续|刚才') as follow_up from
(select case conv_id % 4 when 0 then '它的' || conv_id when 1 then '换个话题，它' || conv_id when 2 then text else '继续' || repeat('x', (conv_id % 120)::int) end as q from conversations where role = 'user')""")
def follow_up_questions(spark, sf_dir) -> DataFrame:
    c = F.col("conv_id")
    q = F.when(c % 4 == 0, F.concat(F.lit("它的"), c.cast("string"))).when(c % 4 == 1, F.concat(F.lit("换个话题，它"), c.cast("string"))).when(c % 4 == 2, F.col("text")).otherwise(F.concat(F.lit("继续"), F.repeat(F.lit("x"), (c % 120).cast("int"))))
    return roles.messages(spark, sf_dir).where("role = 'user'").select(q.alias("q")).withColumn("follow_up", follows_up(F.col("q")))


@query("""select doc_id, case when strlen(t) <= 24 then t else substr(t, 1, (select max(n) from range(0, 22) r(n) where strlen(substr(t, 1, n)) <= 21)::int) || '…' end as short from
(select doc_id, coalesce(text, '') as t from documents)""")
def truncate_bytes(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", truncated(F.coalesce(F.col("text"), F.lit("")), 24).alias("short"))
