"""Queries of stored versions, ordered deletion, keys and names, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import roles
from ..functions import text as X
from ..operators import chunking, segments
from ..session import shared_folder, written
from ..sources import artifacts, store
from ..sources.files import hashing_embedder, write_artifacts
from ..sources.ingest import ingest, retire
from .document_queries import CHUNKS_SQL, documents
from .search_queries import _tokens_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tessera-store/{uuid.uuid4().hex}"


@query("""select doc_id + 1 as document_id, case when trim(coalesce(text, '')) = '' then '' when (doc_id + 1) % 3 = 0 and (doc_id + 1) % 9 <> 0 and (doc_id + 1) % 12 <> 0 then 'v2' else 'v1' end as active_version,
case when trim(coalesce(text, '')) = '' or (doc_id + 1) % 9 = 0 or (doc_id + 1) % 12 = 0 then 'failed' else 'ready' end as status, case when trim(coalesce(text, '')) = '' then 0 else 1 end::int as versions from documents""")
def staged_versions(spark, sf_dir) -> DataFrame:
    """All documents as v1, a third again as v2, of which some can't be parsed and some aren't indexed whole; then what failed is discarded."""
    d, held = documents(spark, sf_dir), store.Versions(spark, scratch(spark))
    held.process(d, chunking.parse_and_chunk, lambda staged: staged, "v1")
    again = d.where("document_id % 3 = 0").withColumn("content", F.when(F.col("document_id") % 9 == 0, F.lit(b"")).otherwise(F.col("content")))
    held.process(again, chunking.parse_and_chunk, lambda staged: staged.where("document_id % 12 <> 0"), "v2")
    held.discard()
    left = held.chunks().groupBy("document_id").agg(F.countDistinct("version").alias("versions"))
    active = held.readable().select("document_id", "version").distinct()
    states = held.states().alias("s").join(left, "document_id", "left").join(active, "document_id", "left")
    # a document reads as its pointer says, or not at all
    return states.where("coalesce(version, '') = active_version").select("document_id", "active_version", "status", F.coalesce("versions", F.lit(0)).cast("int").alias("versions"))


@query(f"""with ck as (select document_id, body_text from ({CHUNKS_SQL}) where not is_parent),
n as (select document_id, count(*) as chunks, sum(len({_tokens_sql('body_text')}))::bigint as words from ck group by document_id),
f as ({roles.SQL['files'].removeprefix('files as (').removesuffix(')')})
select f.id as document_id, case when n.chunks is null then '' when f.id % 6 = 0 and f.id % 12 <> 0 then 'v2' else 'v1' end as active_version, coalesce(n.chunks, 0) as chunks, coalesce(n.words, 0)::bigint as words,
 coalesce(f.status = 1 and n.chunks > 0, false) as open from f left join n on n.document_id = f.id where n.chunks is not null""")
def ingested(spark, sf_dir) -> DataFrame:
    """All documents through parse, chunk, embed, index and publish; a sixth again as v2, half of which has lost its owner and fails; then what nothing names is retired. What the index holds and opens is read back."""
    held, index = store.Versions(spark, scratch(spark)), segments.Segments(spark, scratch(spark))
    d, files = documents(spark, sf_dir), roles.files(spark, sf_dir)
    owners = files.select(F.col("id").alias("document_id"), "user_id", "file_md5", "org_tag", "is_public")
    make = lambda: hashing_embedder(32)
    ingest(held, index, d, owners, make, "v1", "m", 32)
    ingest(held, index, d.where("document_id % 6 = 0"), owners.where("document_id % 12 <> 0"), make, "v2", "m", 32)
    retire(held, index)
    states = held.states()
    index.open_to(files, states.join(owners.select("document_id", "user_id"), "document_id"))
    rows = index.live().groupBy("document_id", "version").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("words"))
    opened = index.opened().select("document_id").distinct().withColumn("open", F.lit(True))
    out = rows.join(states.select("document_id", "active_version"), "document_id").join(opened, "document_id", "left")
    return out.select("document_id", "active_version", "chunks", "words", F.coalesce("open", F.lit(False)).alias("open"))


@query("""with d as (select doc_id + 1 as document_id, text from documents where trim(coalesce(text, '')) <> ''),
f as (select *, case when document_id % 13 = 0 then 'missing' when document_id % 17 = 0 then 'repeated' when document_id % 11 = 0 or document_id % 19 = 0 then 'identity' when document_id % 7 = 0 then 'digest' end as fault from d)
select document_id, document_id % 5 as user_id, 'v1' as version, case when fault is null then text end as text, fault, fault in ('repeated', 'identity', 'digest') as set_aside from f""")
def stored_documents(spark, sf_dir) -> DataFrame:
    """All documents stored, then some changed, renamed, lost or stored twice by somebody else; read back by their pointers."""
    at, changed, aside = scratch(spark), scratch(spark), scratch(spark)
    parsed = chunking.parse_and_chunk(documents(spark, sf_dir)).where("error is null").withColumn("user_id", F.col("document_id") % 5)
    pointers = write_artifacts(parsed, at, "v1").select("document_id", (F.col("document_id") % 5).alias("user_id"), F.lit("v1").alias("version"), "shown_sha256")
    pointers = written(pointers, "pointers")
    d = F.col("document_id")
    rows = spark.read.parquet(f"{at}/version=v1").where(d % 13 != 0)
    envelope = F.when(d % 11 == 0, F.col("envelope").withField("document_id", d + 1)).when(d % 19 == 0, F.col("envelope").withField("version", F.lit("v0"))).otherwise(F.col("envelope"))
    blocks = F.transform("blocks", lambda b: F.when(d % 7 == 0, b.withField("text", F.concat(b["text"], F.lit("!")))).otherwise(b))
    rows = rows.withColumns({"envelope": envelope, "blocks": blocks})
    store.packed(rows.union(rows.where(d % 17 == 0))).parquet(f"{changed}/version=v1")
    store.remove(spark, at)  # nothing reads it any more
    answers = artifacts.stored_previews(spark, changed, pointers)
    artifacts.set_aside(spark, changed, answers, aside)
    put = spark.read.parquet(aside).select("key").distinct().select(F.split("key", "/")[2].cast("long").alias("document_id"), F.lit(True).alias("set_aside"))
    return answers.join(put, "document_id", "left").withColumn("set_aside", F.when(F.col("fault").isNotNull(), F.coalesce("set_aside", F.lit(False))).otherwise(F.col("set_aside")))


DELETED_SQL = """gone as (select id from files where status = 3 or id % 4 = 1 and (id % 3 = 0 or id % 5 = 0))"""


@query(roles.sql("files", "states", body=f""", {DELETED_SQL} select 'files' as name, count(*) as rows from files where id not in (select id from gone) union all select 'objects', 3 * count(*) from files where id not in (select id from gone)
union all select 'states', count(*) from states where document_id not in (select id from gone) union all select 'chunks', 2 * count(*) from files where id not in (select id from gone) union all select 'outbox', count(*) from files where id % 2 = 0 and id not in (select id from gone)"""))
def ordered_deletion(spark, sf_dir) -> DataFrame:
    """Owners and administrators delete documents, and what an earlier run had marked goes too: rows left in each table."""
    tables, f = store.Tables(spark, scratch(spark)), roles.files(spark, sf_dir)
    user, document = F.col("user_id"), F.col("id")
    keys = F.array(X.part_key(user, document, F.lit(0)), X.merged_key(user, document, F.lit("t")), X.artifact_key(user, document, F.lit("v1")))
    tables.write("files", f)
    tables.write("objects", f.select(F.explode(keys).alias("key")))
    tables.write("states", roles.states(spark, sf_dir))
    tables.write("chunks", f.select(document.alias("document_id"), F.explode(F.array(F.lit("p0"), F.lit("c0"))).alias("chunk_id")))
    tables.write("outbox", f.where("id % 2 = 0").select(document.alias("document_id")))
    requests = f.where("id % 4 = 1").select(document.alias("document_id"), F.when(document % 3 == 0, user).otherwise(99).alias("by_user"), F.when(document % 5 == 0, "ADMIN").otherwise("USER").alias("role"))
    store.delete_documents(tables, requests)
    left = None
    for name in ("files", "objects", "states", "chunks", "outbox"):
        rows = tables.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        left = rows if left is None else left.union(rows)
    return left


@query(roles.sql("files", body="""select id, 'chunks/' || user_id || '/' || id || '/' || id % 4 as part, 'chunks/' || user_id || '/' || id || '/attempts/' || id % 4 || '/t' || id % 3 as attempt, 'merged/' || user_id || '/' || id || '/t' || id % 3 as merged,
'document-ir/' || user_id || '/' || id || '/v1/ir.json' as artifact from files"""))
def object_keys(spark, sf_dir) -> DataFrame:
    user, document = F.col("user_id"), F.col("id")
    part, token = document % 4, F.concat(F.lit("t"), (document % 3).cast("string"))
    return roles.files(spark, sf_dir).select("id", X.part_key(user, document, part).alias("part"), X.attempt_key(user, document, part, token).alias("attempt"), X.merged_key(user, document, token).alias("merged"), X.artifact_key(user, document, F.lit("v1")).alias("artifact"))


NAMES = """case c_custkey % 6 when 0 then 'Ana_' || c_custkey when 1 then 'Élé.' || c_custkey when 2 then 'a b' when 3 then '' when 4 then repeat('n', (c_custkey % 70)::int) else '漢字-' || c_custkey end"""


@query(f"""select id, regexp_full_match(n, '[\\p{{L}}\\p{{Nd}}_.-]{{1,32}}') as user_name, regexp_full_match(n, '[!-~]{{1,64}}') as conversation_id from (select c_custkey as id, {NAMES} as n from customer)""")
def name_rules(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    k = c.cast("string")
    n = F.when(c % 6 == 0, F.concat(F.lit("Ana_"), k)).when(c % 6 == 1, F.concat(F.lit("Élé."), k)).when(c % 6 == 2, "a b").when(c % 6 == 3, "").when(c % 6 == 4, F.repeat(F.lit("n"), (c % 70).cast("int"))).otherwise(F.concat(F.lit("漢字-"), k))
    return roles.table(spark, sf_dir, "customer").select(c.alias("id"), X.valid_user_name(n).alias("user_name"), X.valid_conversation_id(n).alias("conversation_id"))
