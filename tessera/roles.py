"""The roles of the retrieval engine's tables, played by the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import ship, spread

#: The same as common table expressions; a query's SQL takes those it names.
SQL = {
    "files": """files as (select doc_id + 1 as id, md5(coalesce(text, '')) as file_md5, 'doc-' || doc_id || '.txt' as file_name, strlen(coalesce(text, ''))::bigint as total_size,
  case doc_id % 10 when 0 then 3 when 1 then 4 when 2 then 0 else 1 end as status, doc_id % 7 + 1 as user_id, 'ORG_' || lang as org_tag, doc_id % 9 = 0 as is_public, lang from documents)""",
    "states": """states as (select doc_id + 1 as document_id, case when doc_id % 13 = 3 then 99 else doc_id % 7 + 1 end as user_id, case when doc_id % 5 = 0 then '' else 'v' || (doc_id % 3) end as active_version,
  case when doc_id % 4 = 0 then 'v9' else '' end as pending_version, case doc_id % 4 when 0 then 'parsing' when 1 then 'ready' when 2 then 'failed' else 'embedding' end as status,
  timestamp '2026-09-03 00:00:00' - to_minutes((doc_id % 11)::int) as updated_at from documents where doc_id % 8 <> 7)""",
    "hits": """hits as (select d.doc_id + 1 as document_id, 'v' || (d.doc_id % 3) as version, 'c0' as chunk_key, d.doc_id % 7 + 1 as user_id, md5(coalesce(d.text, '')) as file_md5, 'm' || (d.doc_id % 2) as model_version,
  coalesce(d.text, '') as text_content, d.lang, e.embedding as vector from documents d left join embeddings e on e.vec_id = d.doc_id)""",
    "tags": """tags as (select 'R' || r_regionkey as tag_id, r_name as name, cast(null as varchar) as parent_tag from region
  union all select 'N' || n_nationkey, n_name, 'R' || n_regionkey from nation
  union all select 'S' || s_suppkey, s_name, 'N' || s_nationkey from supplier)""",
    "users": """users as (select c_custkey as id, c_name as username, 'N' || c_nationkey || ', R' || (c_nationkey % 5) || ',X' || (c_custkey % 3) as org_tags from customer)""",
    "turns": """turns as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as next_text from conversations),
pairs as (select conv_id, turn as turn_no, text as question, next_text as answer from turns where role = 'user' and next_role = 'assistant' and trim(text) <> '' and trim(next_text) <> '')""",
}


def sql(*names: str, body: str, recursive: bool = False) -> str:
    """A query over the named roles."""
    parts = [SQL[n] for n in names]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    status = F.when(d % 10 == 0, 3).when(d % 10 == 1, 4).when(d % 10 == 2, 0).otherwise(1)
    return table(spark, sf_dir, "documents").select(
        (d + 1).alias("id"), F.md5(_text().cast("binary")).alias("file_md5"), F.concat(F.lit("doc-"), d.cast("string"), F.lit(".txt")).alias("file_name"),
        F.octet_length(_text()).cast("long").alias("total_size"), status.alias("status"), (d % 7 + 1).alias("user_id"), F.concat(F.lit("ORG_"), "lang").alias("org_tag"), (d % 9 == 0).alias("is_public"), "lang",
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(d % 8 != 7).select(
        (d + 1).alias("document_id"), F.when(d % 13 == 3, 99).otherwise(d % 7 + 1).alias("user_id"), F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("v"), (d % 3).cast("string"))).alias("active_version"),
        F.when(d % 4 == 0, "v9").otherwise("").alias("pending_version"), F.when(d % 4 == 0, "parsing").when(d % 4 == 1, "ready").when(d % 4 == 2, "failed").otherwise("embedding").alias("status"),
        (F.lit("2026-09-03 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(mins=(d % 11).cast("int"))).alias("updated_at"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).join(v, "doc_id", "left").select(
        (d + 1).alias("document_id"), F.concat(F.lit("v"), (d % 3).cast("string")).alias("version"), F.lit("c0").alias("chunk_key"), (d % 7 + 1).alias("user_id"),
        F.md5(_text().cast("binary")).alias("file_md5"), F.concat(F.lit("m"), (d % 2).cast("string")).alias("model_version"), _text().alias("text_content"), "lang", "vector",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, prefix: str, key: str, label: str, parent) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("tag_id"), F.col(label).alias("name"), parent.cast("string").alias("parent_tag"))

    return (
        level("region", "R", "r_regionkey", "r_name", F.lit(None))
        .union(level("nation", "N", "n_nationkey", "n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
        .union(level("supplier", "S", "s_suppkey", "s_name", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))))
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("c_nationkey"), F.col("c_custkey")
    csv = F.concat(F.lit("N"), n.cast("string"), F.lit(", R"), (n % 5).cast("string"), F.lit(",X"), (c % 3).cast("string"))
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_name").alias("username"), csv.alias("org_tags"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
