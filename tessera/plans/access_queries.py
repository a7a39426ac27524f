"""Queries of access, files and listing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import roles
from ..functions.text import day_of, eight_hours_east, extension, file_type, iso_time, shown_time
from ..operators import access, conversation, lifecycle

USER, TAGS = 3, ["ORG_en", "ORG_fr"]
VISIBLE = "(user_id = 3 or is_public or org_tag in ('ORG_en', 'ORG_fr'))"
NOW = "2026-09-03 00:00:00"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(roles.sql("files", body=f"select id, user_id, org_tag, is_public from files where status = 1 and {VISIBLE}"))
def access_files(spark, sf_dir) -> DataFrame:
    return access.accessible_files(roles.files(spark, sf_dir), USER, TAGS).select("id", "user_id", "org_tag", "is_public")


@query(roles.sql("files", body="select id, user_id, is_public from files where status = 1 and (user_id = 3 or is_public)"))
def access_files_no_tags(spark, sf_dir) -> DataFrame:
    return access.accessible_files(roles.files(spark, sf_dir), USER, []).select("id", "user_id", "is_public")


@query(roles.sql("files", body="""select distinct m.member_id, f.id from files f join (values (1, 'ORG_en'), (2, 'ORG_de'), (2, 'ORG_fr'), (5, 'NONE')) m(member_id, tag)
on f.user_id = m.member_id or f.org_tag = m.tag where f.status = 1"""))
def access_batch(spark, sf_dir) -> DataFrame:
    members = spark.createDataFrame([(1, "ORG_en"), (2, "ORG_de"), (2, "ORG_fr"), (5, "NONE")], "member_id int, tag string")
    return access.accessible_for_users(roles.files(spark, sf_dir), members)


@query(roles.sql("files", "states", "hits", body="""select h.document_id, h.version from hits h join files f on f.id = h.document_id and f.user_id = h.user_id and f.file_md5 = h.file_md5 and f.status = 1
join states s on s.document_id = h.document_id and s.user_id = h.user_id and s.active_version = h.version and s.active_version <> ''"""))
def versioned_gate(spark, sf_dir) -> DataFrame:
    return access.gated(roles.hits(spark, sf_dir), roles.files(spark, sf_dir), roles.states(spark, sf_dir)).select("document_id", "version")


@query(roles.sql("hits", body="select document_id, model_version from hits where model_version = 'm1'"))
def model_gate(spark, sf_dir) -> DataFrame:
    return access.of_model(roles.hits(spark, sf_dir), "m1").select("document_id", "model_version")


TAG_WALK = """walk as (
  select u.id as user_id, trim(t) as tag from users u, unnest(string_split(u.org_tags, ',')) x(t) where trim(t) <> ''
  union select w.user_id, t.parent_tag from walk w join tags t on t.tag_id = w.tag where t.parent_tag is not null and t.parent_tag <> '')"""


@query(roles.sql("tags", "users", body=f", {TAG_WALK} select user_id, tag from walk", recursive=True))
def effective_tags(spark, sf_dir) -> DataFrame:
    return access.effective_tags(roles.users(spark, sf_dir), roles.tags(spark, sf_dir))


@query(roles.sql("tags", body=""", tree as (select tag_id, tag_id as root, tag_id as path, 0 as depth from tags where parent_tag is null
union all select t.tag_id, p.root, p.path || '/' || t.tag_id, p.depth + 1 from tags t join tree p on t.parent_tag = p.tag_id) select * from tree""", recursive=True))
def tag_tree_paths(spark, sf_dir) -> DataFrame:
    return access.tag_paths(roles.tags(spark, sf_dir))


def _details(trim: bool) -> str:
    t = "trim(t)" if trim else "t"
    return roles.sql("tags", "users", body=f"""select u.id as user_id, (p - 1)::int as pos, g.tag_id, g.name from users u,
lateral (select unnest(string_split(u.org_tags, ',')) as t, generate_subscripts(string_split(u.org_tags, ','), 1) as p) x join tags g on g.tag_id = {t}""")


@query(_details(False))
def user_tags_untrimmed(spark, sf_dir) -> DataFrame:
    return access.tag_details(roles.users(spark, sf_dir), roles.tags(spark, sf_dir), trim=False)


@query(_details(True))
def user_tag_details(spark, sf_dir) -> DataFrame:
    return access.tag_details(roles.users(spark, sf_dir), roles.tags(spark, sf_dir), trim=True)


@query(roles.sql("files", body="""select f.id, f.file_name, coalesce(t.name, '') as tag_name from files f left join (values ('ORG_en', 'English'), ('ORG_de', 'Deutsch')) t(tag_id, name) on t.tag_id = f.org_tag"""))
def uploads_with_tag_name(spark, sf_dir) -> DataFrame:
    names = spark.createDataFrame([("ORG_en", "English"), ("ORG_de", "Deutsch")], "tag_id string, name string")
    return access.with_tag_names(roles.files(spark, sf_dir), names).select("id", "file_name", "tag_name")


def _requests(spark, sf_dir) -> DataFrame:
    return roles.files(spark, sf_dir).select(F.col("id").alias("request_id"), "file_md5", "user_id")


def _uploaded(there: bool) -> str:
    return roles.sql("files", body=f"""select r.id as request_id from files r where {"" if there else "not "}exists (select 1 from files f where f.status = 1 and f.file_md5 = r.file_md5 and f.user_id = r.user_id)""")


@query(_uploaded(True))
def already_uploaded(spark, sf_dir) -> DataFrame:
    return access.uploaded(_requests(spark, sf_dir), roles.files(spark, sf_dir)).select("request_id")


@query(_uploaded(False))
def not_uploaded(spark, sf_dir) -> DataFrame:
    return access.uploaded(_requests(spark, sf_dir), roles.files(spark, sf_dir), there=False).select("request_id")


@query(roles.sql("files", "states", body=f"""select f.id as document_id, 'v' || ((f.id - 1) % 3) as version from files f join states s on s.document_id = f.id and s.user_id = f.user_id and s.active_version = 'v' || ((f.id - 1) % 3)
where f.status = 1 and {VISIBLE.replace("user_id", "f.user_id")}"""))
def parent_lookup(spark, sf_dir) -> DataFrame:
    f = roles.files(spark, sf_dir)
    version = F.concat(F.lit("v"), ((F.col("id") - 1) % 3).cast("string"))
    chunks = f.select(F.col("id").alias("document_id"), version.alias("version"), F.lit("p0").alias("chunk_id"), "user_id", F.lit(True).alias("is_parent"))
    refs = chunks.select("document_id", "version", "chunk_id")
    return access.parents(chunks, f, roles.states(spark, sf_dir), refs.union(refs), USER, TAGS).select("document_id", "version")


@query(roles.sql("files", "states", body=f"""select f.id as document_id, s.active_version as version, f.file_name from files f join states s on s.document_id = f.id and s.user_id = f.user_id
where f.status = 1 and s.active_version = 'v1' and {VISIBLE.replace("user_id", "f.user_id")}"""))
def published_lookup(spark, sf_dir) -> DataFrame:
    return access.published(roles.files(spark, sf_dir), roles.states(spark, sf_dir), USER, TAGS, "v1")


@query(roles.sql("files", body="select id, file_name, user_id from files where id = 18"))
def file_by_id(spark, sf_dir) -> DataFrame:
    return roles.files(spark, sf_dir).where("id = 18").select("id", "file_name", "user_id").limit(1)


@query(roles.sql("tags", body="select tag_id, name from tags where tag_id in ('R1', 'N3', 'N99')"))
def tags_by_ids(spark, sf_dir) -> DataFrame:
    ids = spark.createDataFrame([("R1",), ("N3",), ("N99",)], "tag_id string")
    return roles.tags(spark, sf_dir).join(ids, "tag_id", "left_semi").select("tag_id", "name")


@query(roles.sql("files", body="""select id, case when e = '' then '未知类型' else coalesce(m.name, upper(e) || '文件') end as label from (select id, lower(regexp_extract(n, '\\.([^./]*)$', 1)) as e
from (select id, case id % 5 when 0 then 'a.PDF' when 1 then 'b.docx' when 2 then 'c.tar.gz' when 3 then 'noext' else file_name end as n from files)) left join
(values ('pdf', 'PDF文档'), ('doc', 'Word文档'), ('docx', 'Word文档'), ('xls', 'Excel表格'), ('xlsx', 'Excel表格'), ('ppt', 'PowerPoint演示文稿'), ('pptx', 'PowerPoint演示文稿'), ('txt', '文本文件'), ('md', 'Markdown文档')) m(ext, name) on m.ext = e"""))
def file_type_label(spark, sf_dir) -> DataFrame:
    m = F.col("id") % 5
    name = F.when(m == 0, "a.PDF").when(m == 1, "b.docx").when(m == 2, "c.tar.gz").when(m == 3, "noext").otherwise(F.col("file_name"))
    return roles.files(spark, sf_dir).select("id", file_type(name).alias("label"))


@query(roles.sql(body="""select doc_id + 1 as id, case when n <= 0 or n > 20000 then 'size' when strlen(t) <> n then 'length' when md5(t) <> m then 'digest' end as fault from
(select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + (case when doc_id % 13 = 0 then 1 else 0 end) as n, case when doc_id % 17 = 0 then md5('other') else md5(coalesce(text, '')) end as m from documents)"""))
def md5_integrity(spark, sf_dir) -> DataFrame:
    text, d = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    announced = roles.table(spark, sf_dir, "documents").select(
        (d + 1).alias("id"), text.cast("binary").alias("content"), (F.octet_length(text) + (d % 13 == 0).cast("int")).cast("long").alias("total_size"),
        F.when(d % 17 == 0, F.upper(F.md5(F.lit(b"other")))).otherwise(F.upper(F.md5(text.cast("binary")))).alias("file_md5"),
    )
    return lifecycle.integrity(announced, F.col("content"), 20_000).select("id", "fault")


@query("""select id, case when not regexp_matches(md5, '^[0-9a-f]{32}$') then 'md5' when trim(file_name) = '' or regexp_matches(file_name, '[/\\\\]') then 'name' when total_size <= 0 or total_size > 33554432 then 'size'
when chunk_index < 0 or chunk_index >= (total_size - 1) // 5242880 + 1 then 'index'
when chunk_size <> (case when chunk_index = (total_size - 1) // 5242880 then total_size - ((total_size - 1) // 5242880) * 5242880 else 5242880 end) then 'part size' end as fault from
(select doc_id + 1 as id, case when doc_id % 11 = 0 then upper(md5('x' || doc_id)) else md5('x' || doc_id) end as md5, case doc_id % 7 when 0 then 'a/b' when 1 then ' ' else 'f.txt' end as file_name,
doc_id * 40000 as total_size, (doc_id % 3)::int as chunk_index, case when doc_id % 2 = 0 then 5242880 else doc_id * 40000 end as chunk_size from documents)""")
def input_validation(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    md5 = F.md5(F.concat(F.lit("x"), d.cast("string")).cast("binary"))
    rows = roles.table(spark, sf_dir, "documents").select(
        (d + 1).alias("id"), F.when(d % 11 == 0, F.upper(md5)).otherwise(md5).alias("md5"), F.when(d % 7 == 0, "a/b").when(d % 7 == 1, " ").otherwise("f.txt").alias("file_name"),
        (d * 40000).alias("total_size"), (d % 3).cast("int").alias("chunk_index"), F.when(d % 2 == 0, F.lit(5242880).cast("long")).otherwise(d * 40000).alias("chunk_size"),
    )
    return lifecycle.upload_faults(rows).select("id", "fault")


@query("""select *, row_number() over (order by o_orderdate, o_orderkey)::int as place from (select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31 23:59:59' order by o_orderdate desc, o_orderkey desc limit 20 offset 20)""")
def archive_page(spark, sf_dir) -> DataFrame:
    rows = conversation.within_days(roles.table(spark, sf_dir, "orders"), "o_orderdate", "1995-01-01", "1996-12-31")
    found = conversation.page(rows.select("o_orderkey", "o_custkey", "o_orderdate"), 20, 2, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return conversation.oldest_first(found, F.asc("o_orderdate"), F.asc("o_orderkey"))


CHAIN = "chain as (select c_custkey as k, 'T' || c_custkey as tag_id, case when c_custkey % 100 = 1 then null else 'T' || (c_custkey - 1) end as parent_tag from customer)"


def _chain(spark, sf_dir) -> DataFrame:
    """Chains of 100 tags each."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("T"), k.cast("string"))
    return roles.table(spark, sf_dir, "customer").select(name.alias("tag_id"), name.alias("name"), F.when(k % 100 != 1, F.concat(F.lit("T"), (k - 1).cast("string"))).alias("parent_tag"), k.alias("k"))


@query(f"""with recursive {CHAIN}, walk as (select k as user_id, tag_id as tag from chain union select w.user_id, c.parent_tag from walk w join chain c on c.tag_id = w.tag where c.parent_tag is not null) select user_id, tag from walk""")
def deep_tags(spark, sf_dir) -> DataFrame:
    tags = _chain(spark, sf_dir)
    return access.effective_tags(tags.select(F.col("k").alias("id"), F.col("tag_id").alias("org_tags")), tags)


@query(f"""with recursive {CHAIN}, tree as (select tag_id, 0 as depth from chain where parent_tag is null union all select c.tag_id, t.depth + 1 from chain c join tree t on c.parent_tag = t.tag_id) select tag_id, depth from tree""")
def deep_tag_paths(spark, sf_dir) -> DataFrame:
    return access.tag_paths(_chain(spark, sf_dir)).select("tag_id", "depth")


@query("select count(*) as total, ceil(count(*) / 7)::bigint as pages from customer")
def page_counts(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "customer").agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / 7).cast("long"))


@query(roles.sql("users", body="select id, username from users order by id limit 10 offset 30"))
def users_page(spark, sf_dir) -> DataFrame:
    return conversation.page(roles.users(spark, sf_dir).select("id", "username"), 10, 4, F.asc("id"))


@query("select o_orderkey as turn_id, c_name as username from orders join customer on c_custkey = o_custkey")
def admin_conversation(spark, sf_dir) -> DataFrame:
    turns = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("user_id"))
    return conversation.with_users(turns, roles.users(spark, sf_dir)).select("turn_id", "username")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as shown, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, strftime(o_orderdate + interval 8 hours, '%Y-%m-%d %H:%M:%S') as there, (o_orderdate::date)::timestamp as day from (select o_orderkey, o_orderdate::timestamp + to_minutes((o_orderkey % 1440)::int) as o_orderdate from orders)""")
def time_texts(spark, sf_dir) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = roles.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))
    return rows.select("o_orderkey", shown_time(F.col("at")).alias("shown"), iso_time(F.col("at")).alias("iso"), shown_time(eight_hours_east(F.col("at"))).alias("there"), day_of(F.substring(shown_time(F.col("at")), 1, 10)).cast("timestamp_ntz").alias("day"))


@query(roles.sql("files", "states", body="""select f.id, coalesce(s.status, 'not_processed') as status, coalesce(s.pending_version <> '' and s.updated_at > timestamp '2026-09-03 00:00:00' - interval 5 minutes
and s.status in ('queued', 'parsing', 'normalizing', 'chunking', 'embedding', 'indexing'), false) as in_progress from files f left join states s on s.document_id = f.id where f.status = 1"""))
def processing_status_report(spark, sf_dir) -> DataFrame:
    return lifecycle.statuses(roles.files(spark, sf_dir), roles.states(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


__all__ = ["QUERIES", "SQL", "extension"]
