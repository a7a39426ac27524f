"""Files on their way in: upload sessions, task outbox, versions and their publication, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import backoff_seconds, set_bits
from ..schemas import COMPLETE, IN_PROGRESS_SECONDS, IN_PROGRESS_STATUSES, LEASE_SECONDS, MAX_FILE_BYTES, UPLOAD_PART


def total_parts(size: Column) -> Column:
    return F.when(size <= 0, F.lit(0).cast("long")).otherwise(F.floor((size - 1) / UPLOAD_PART).cast("long") + 1)


def progress(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, total, uploaded, percent, complete): distinct part numbers below the total count."""
    f = files.select("id", total_parts(F.col("total_size")).alias("total"))
    done = parts.join(f.select(F.col("id").alias("document_id"), "total"), "document_id").where("chunk_index >= 0 and chunk_index < total").groupBy("document_id").agg(F.countDistinct("chunk_index").alias("uploaded"))
    rows = f.join(done.withColumnRenamed("document_id", "id"), "id", "left").withColumn("uploaded", F.coalesce("uploaded", F.lit(0)).cast("long"))
    return rows.withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("uploaded") * 100.0, F.col("total")), 6))).withColumn("complete", (F.col("total") > 0) & (F.col("uploaded") >= F.col("total")))


def parts_of_bitmap(uploads: DataFrame) -> DataFrame:
    """(id, parts): the uploaded part numbers of each bitmap."""
    return uploads.select("id", set_bits(F.col("bitmap"), F.col("total")).alias("parts"))


def merged(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(id, md5, outcome): parts joined in order; ready, incomplete, or corrupt where the digest differs.

    parts: document_id, chunk_index, content (binary), seq; a later upload of a part replaces it. One
    document's parts are aggregated by key; a file is at most the size that the guard allows.
    """
    last = parts.groupBy("document_id", "chunk_index").agg(F.max_by("content", "seq").alias("content"))
    f = files.select("id", "file_md5", total_parts(F.col("total_size")).alias("total"))
    joined = last.join(f, last["document_id"] == f["id"]).where("chunk_index >= 0 and chunk_index < total")
    whole = joined.groupBy("id", "file_md5", "total").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("p"))
    content = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["content"]))
    rows = whole.withColumn("md5", F.md5(content))
    return rows.select("id", F.when(F.col("n") == F.col("total"), F.col("md5")).alias("md5"), F.when(F.col("n") < F.col("total"), "incomplete").when(F.lower("md5") == F.lower("file_md5"), "ready").otherwise("corrupt").alias("outcome"))


def integrity(files: DataFrame, content: Column, most: int = MAX_FILE_BYTES) -> DataFrame:
    """Files with ``fault``: size, length or digest that differ from what was announced, else null."""
    fault = F.when((F.col("total_size") <= 0) | (F.col("total_size") > most), "size").when(F.octet_length(content) != F.col("total_size"), "length").when(F.lower(F.md5(content)) != F.lower("file_md5"), "digest")
    return files.withColumn("fault", fault)


def upload_faults(requests: DataFrame) -> DataFrame:
    """Requests (md5, file_name, total_size, chunk_index, chunk_size) with ``fault``, the first rule broken."""
    total = total_parts(F.col("total_size"))
    expected = F.when(F.col("chunk_index") == total - 1, F.col("total_size") - (total - 1) * UPLOAD_PART).otherwise(F.lit(UPLOAD_PART).cast("long"))
    fault = (
        F.when(~F.rlike("md5", F.lit("^[0-9a-f]{32}$")), "md5")
        .when((F.trim("file_name") == "") | F.rlike("file_name", F.lit(r"[/\\\x00]")), "name")
        .when((F.col("total_size") <= 0) | (F.col("total_size") > MAX_FILE_BYTES), "size")
        .when((F.col("chunk_index") < 0) | (F.col("chunk_index") >= total), "index")
        .when(F.col("chunk_size") != expected, "part size")
    )
    return requests.withColumn("fault", fault)


def claimable(outbox: DataFrame, now: Column) -> DataFrame:
    return outbox.where((F.col("available_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))


def claim(outbox: DataFrame, now: Column, token: str, n: int = 1) -> DataFrame:
    """The first tasks to hand out, with their lease."""
    return claimable(outbox, now).orderBy("available_at", "document_id").limit(n).withColumn("lease_token", F.lit(token)).withColumn("lease_until", now + F.expr(f"interval {LEASE_SECONDS} seconds"))


def retried(tasks: DataFrame, now: Column) -> DataFrame:
    """Failed tasks as they go back: one attempt more, available after the backoff, no lease."""
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("attempts") + 1).cast("decimal(18,6)"))
    return tasks.withColumn("available_at", now + wait).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_token", F.lit(None).cast("string")).withColumn("lease_until", F.lit(None).cast("timestamp"))


def enqueued(outbox: DataFrame, requests: DataFrame) -> DataFrame:
    """New rows: one for each requested document that isn't queued, its first request."""
    once = requests.groupBy("document_id").agg(F.min("available_at").alias("available_at"))
    return once.join(outbox.select("document_id"), "document_id", "left_anti")


def folded(events: DataFrame) -> DataFrame:
    """(document_id, active_version, pending_version, status) after a log of begin, stage, publish and fail events.

    events: document_id, seq, kind, version. Stage and publish count for the pending version only, and
    publish only once it is staged; a failure of the pending version keeps the active one. A document's
    events are folded as one array: a document has few.
    """
    log = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "version"))).alias("log"))
    start = F.struct(F.lit("").alias("active_version"), F.lit("").alias("pending_version"), F.lit("").alias("status"))

    def step(s: Column, e: Column) -> Column:
        mine = (s["pending_version"] == e["version"]) & (e["version"] != "")
        staged = mine & (e["kind"] == "stage") & (s["status"] == "parsing")
        done = mine & (e["kind"] == "publish") & (s["status"] == "embedding")
        failed = mine & (e["kind"] == "fail")
        begun = e["kind"] == "begin"
        return F.struct(
            F.when(done, e["version"]).otherwise(s["active_version"]).alias("active_version"),
            F.when(begun, e["version"]).when(done, F.lit("")).otherwise(s["pending_version"]).alias("pending_version"),
            F.when(begun, "parsing").when(staged, "embedding").when(done, "ready").when(failed, "failed").otherwise(s["status"]).alias("status"),
        )

    return log.select("document_id", F.aggregate("log", start, step).alias("s")).select("document_id", "s.*")


def readable(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of active versions."""
    active = states.where(F.col("active_version") != "").select("document_id", F.col("active_version").alias("version"))
    return chunks.join(active, ["document_id", "version"], "left_semi")


def stale(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """(document_id, version) stored but neither active nor pending."""
    live = states.select("document_id", F.explode(F.array("active_version", "pending_version")).alias("version"))
    return chunks.select("document_id", "version").distinct().join(live, ["document_id", "version"], "left_anti")


def discarded(chunks: DataFrame, states: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without those of the versions to discard (document_id, version), the active ones kept."""
    active = states.select("document_id", F.col("active_version").alias("version"))
    return chunks.join(gone.join(active, ["document_id", "version"], "left_anti"), ["document_id", "version"], "left_anti")


def without(rows: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """A table after deletion of documents; a cascade applies it to each table in order."""
    return rows.join(deleted.select(F.col("document_id").alias(key)).distinct(), key, "left_anti")


def deletable(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (document_id, by_user, role) that the owner or an administrator makes."""
    f = files.select(F.col("id").alias("document_id"), F.col("user_id").alias("owner"))
    return requests.join(f, "document_id").where((F.col("by_user") == F.col("owner")) | (F.col("role") == "ADMIN")).select("document_id", "by_user", "role")


def statuses(files: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """(id, status, in_progress) of complete files; ``not_processed`` where there is no state."""
    s = states.select(F.col("document_id").alias("id"), F.col("status").alias("processing"), "pending_version", "updated_at")
    rows = files.where(F.col("status") == COMPLETE).select("id").join(s, "id", "left")
    fresh = F.col("updated_at") > now - F.expr(f"interval {IN_PROGRESS_SECONDS} seconds")
    busy = (F.col("pending_version") != "") & fresh & F.col("processing").isin(list(IN_PROGRESS_STATUSES))
    return rows.select("id", F.coalesce("processing", F.lit("not_processed")).alias("status"), F.coalesce(busy, F.lit(False)).alias("in_progress"))


def compare_and_set(states: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, version, value) after writes (key, expected, value, seq) that apply only to the version they expect."""
    log = writes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "expected", "value"))).alias("log"))
    rows = states.join(log, "key", "left")
    start = F.struct(F.col("version").cast("long").alias("version"), F.col("value").alias("value"))

    def step(s: Column, w: Column) -> Column:
        ok = w["expected"] == s["version"]
        return F.struct(F.when(ok, s["version"] + 1).otherwise(s["version"]).alias("version"), F.when(ok, w["value"]).otherwise(s["value"]).alias("value"))

    return rows.select("key", F.aggregate(F.coalesce("log", F.expr("array()").cast("array<struct<seq:bigint,expected:bigint,value:string>>")), start, step).alias("s")).select("key", "s.version", "s.value")


def latest(events: DataFrame, key: str = "document_id", order: str = "seq") -> DataFrame:
    """An upsert log's current rows."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
