"""Tables in buckets by document, versions that are staged and then published, and deletion in order."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import document_ir_prefix, document_upload_prefix
from ..operators import lifecycle
from ..schemas import CHUNK, DELETING


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    files, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


def packed(rows: DataFrame):
    """A writer of what is stored: texts of people compress a third better than by Spark's own choice."""
    return rows.write.option("compression", "zstd")


#: Documents up to which their ids go to all tasks, so that rows with texts needn't move to be found.
SHOWN_TO_ALL = 1 << 20


def of_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the given documents (document_id); where those of few others go, these are what is looked up."""
    ids = documents.select("document_id").distinct()
    others = rows.select("document_id").distinct().join(ids, "document_id", "left_anti")
    if others.limit(SHOWN_TO_ALL + 1).count() <= SHOWN_TO_ALL:
        return rows.where("document_id is not null").join(F.broadcast(others), "document_id", "left_anti")
    few = ids.limit(SHOWN_TO_ALL + 1).count() <= SHOWN_TO_ALL
    return rows.join(F.broadcast(ids) if few else ids, "document_id", "left_semi")


class Tables:
    """Tables below one folder, in buckets by document, each bucket in generations; readers see the last one written whole.

    A change names the documents it is about: only their buckets are read and written, as the next generation beside what
    is there, so all other files stay as they are and a writer that dies leaves the table as it was. What a bucket held
    before stays until its change after next, for those who still read it. A document's rows may be any share of a table:
    a bucket is written by as many tasks as its size asks for. One writer at a time is taken for granted, and that every
    change is given the same number of buckets. The document is ``document_id``, else ``id``, else the third part of ``key``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket(self, document: Column) -> Column:
        return F.pmod(F.xxhash64(document.cast("long")), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        named = next((c for c in ("document_id", "id") if c in rows.columns), None)
        return rows.withColumn("_bucket", self.bucket(F.col(named) if named else F.split("key", "/")[2]))

    def generations(self, name: str) -> dict[int, list[int]]:
        """By bucket, the generations that hold it, the last one last."""
        held: dict[int, list[int]] = {}
        at = f"{self.root}/{name}"
        whole = sorted(int(g.removeprefix("g")) for g in names_in(self.spark, at) if g.startswith("g") and "_SUCCESS" in names_in(self.spark, f"{at}/{g}"))
        for g in whole:
            for b in names_in(self.spark, f"{at}/g{g}"):
                if b.startswith("_bucket="):
                    held.setdefault(int(b.removeprefix("_bucket=")), []).append(g)
        return held

    def exists(self, name: str) -> bool:
        return "schema" in names_in(self.spark, f"{self.root}/{name}")

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        schema = self.spark.read.parquet(f"{self.root}/{name}/schema").schema
        paths = [f"{self.root}/{name}/g{g[-1]}/_bucket={b}" for b, g in sorted(self.generations(name).items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table as a whole."""
        rows.limit(0).write.mode("overwrite").parquet(f"{self.root}/{name}/schema")
        self._put(name, rows, set(range(self.buckets)))

    def change(self, name: str, f: Callable[[DataFrame], DataFrame], touched: set[int]) -> None:
        """Replace rows of the buckets that are touched; ``f`` must leave rows of other documents than it is about alone."""
        if touched and self.exists(name):
            self._put(name, f(self.read(name, touched)), touched)

    def touched(self, documents: DataFrame) -> set[int]:
        """The buckets that documents (document_id) lie in."""
        return {r[0] for r in documents.select(self.bucket(F.col("document_id"))).distinct().collect()}  # at most as many as there are buckets

    def _put(self, name: str, rows: DataFrame, touched: set[int]) -> None:
        held = self.generations(name)
        at = f"{self.root}/{name}/g{max((g[-1] for g in held.values()), default=-1) + 1}"
        self._bucketed(rows).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        for b in touched - {int(n.removeprefix("_bucket=")) for n in names_in(self.spark, at) if n.startswith("_bucket=")}:
            files, empty = _folder(self.spark, f"{at}/_bucket={b}")
            files.mkdirs(empty)  # nothing is left in this one: until it stands here its old rows are read, and a change that is given again mends that
        for b in touched:
            for g in held.get(b, [])[:-1]:
                remove(self.spark, f"{self.root}/{name}/g{g}/_bucket={b}")


#: Tables that hold rows of a document, in the order they are cleared; the file's own row goes last.
CASCADE = ["objects", "index", "artifacts", "chunks", "states", "bitmaps", "parts", "outbox"]


def delete_documents(tables: Tables, requests: DataFrame) -> None:
    """Delete documents (document_id, by_user, role) that the owner or an administrator asks for.

    They are marked first, then what belongs to them goes from table to table, then they go themselves. What a run that
    failed has marked is finished by the next one, asked for or not. In each table only the documents' buckets are rewritten.
    """
    asked = lifecycle.deletable(tables.read("files"), requests).select("document_id").distinct()
    marks = asked.select(F.col("document_id").alias("id"), F.lit(True).alias("asked"))
    tables.change("files", lambda f: f.join(marks, "id", "left").withColumn("status", F.when(F.col("asked"), DELETING).otherwise(F.col("status"))).drop("asked").select(f.columns), tables.touched(asked))
    gone = tables.read("files").where(F.col("status") == DELETING).select(F.col("id").alias("document_id"), "user_id")
    touched = tables.touched(gone)
    for name in CASCADE:
        if name == "objects":
            tables.change(name, lambda rows: without_prefixes(rows, gone), touched)
        else:
            tables.change(name, lambda rows: lifecycle.without(rows, gone), touched)
    tables.change("files", lambda f: f.where(f"coalesce(status, 0) <> {DELETING}"), touched)


def without_prefixes(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """Objects (key, ...) below none of the deleted documents' prefixes; a key's first three parts are its prefix."""
    own = F.concat(F.substring_index("key", "/", 3), F.lit("/"))
    kinds = [document_upload_prefix("chunks", F.col("user_id"), F.col("document_id")), document_upload_prefix("merged", F.col("user_id"), F.col("document_id")), document_ir_prefix(F.col("user_id"), F.col("document_id"))]
    prefixes = gone.select(F.explode(F.array(*kinds)).alias("prefix"))
    return objects.withColumn("prefix", own).join(prefixes, "prefix", "left_anti").select(objects.columns)


class Versions:
    """Documents in versions: artifacts and chunks are staged where nobody reads them, then a pointer is moved.

    A document's parse is written once: what there is of it but chunks as artifact, its chunks as rows beside each other, where
    the texts that parents and children share compress. An embedding text that is a chunk's prefix and body isn't stored but made
    when it is read.

    Each call of ``process`` is a batch with folders of its own, so batches of one version, and reruns of one, never touch
    each other's rows. The log of events (document_id, seq, kind, version, batch) is the truth: a document's pointer names
    a version and the batch that staged it. Folders are written in generations; readers take the last whole one.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, documents: DataFrame, kind: str, version: str, batch: str) -> None:
        # writers may share a moment: what they log differs in the batch, and only a document's pending batch counts
        last = max((int(n.split("-")[0]) for n in names_in(self.spark, f"{self.root}/log")), default=0)
        seq = max(time.time_ns(), last + 1)
        rows = documents.select(F.col("document_id").cast("long").alias("document_id"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(batch).alias("batch"))
        rows.write.parquet(f"{self.root}/log/{seq:020}-{kind}-{batch}")

    def _events(self) -> DataFrame:
        """Of the log, the last snapshot and what came after it."""
        names = [n for n in names_in(self.spark, f"{self.root}/log") if "_SUCCESS" in names_in(self.spark, f"{self.root}/log/{n}")]
        since = max((k for k, n in enumerate(names) if "-snapshot-" in n), default=0)
        return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/log/{n}" for n in names[since:]])

    def states(self) -> DataFrame:
        """document_id, active_version, active_batch, pending_version, pending_batch, status."""
        folded = lifecycle.folded(self._events().withColumn("version", F.concat_ws("@", "version", "batch")))
        out = [F.col("document_id")]
        for c in ("active", "pending"):
            whole = F.col(f"{c}_version")
            named = F.when(whole == "", "").otherwise(F.substring_index(whole, "@", -1))
            out += [F.when(whole == "", "").otherwise(F.expr(f"left({c}_version, length({c}_version) - length(substring_index({c}_version, '@', -1)) - 1)")).alias(f"{c}_version"), named.alias(f"{c}_batch")]
        return folded.select(*out, "status")

    def snapshot(self) -> None:
        """Write the states as the few events that lead to them, and let the log before go: reading no longer folds all history."""
        before = names_in(self.spark, f"{self.root}/log")
        if not before:
            return
        s = self.states()

        def event(at: int, kind: str, which: str):
            return F.struct(F.lit(at).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.col(f"{which}_version").alias("version"), F.col(f"{which}_batch").alias("batch"))

        none = F.array().cast("array<struct<seq:bigint,kind:string,version:string,batch:string>>")
        active = F.when(F.col("active_version") != "", F.array(*[event(k, kind, "active") for k, kind in enumerate(("begin", "stage", "publish"))])).otherwise(none)
        staged = F.when(F.col("status") == "embedding", F.array(event(4, "stage", "pending"))).when(F.col("status") == "failed", F.array(event(4, "fail", "pending"))).otherwise(none)
        pending = F.when(F.col("pending_version") != "", F.concat(F.array(event(3, "begin", "pending")), staged)).otherwise(none)
        rows = s.select("document_id", F.explode(F.concat(active, pending)).alias("e")).select("document_id", "e.*")
        last = int(before[-1].split("-")[0])
        rows.write.parquet(f"{self.root}/log/{last:020}-snapshot-{uuid.uuid4().hex}")
        # readers may still hold the log before: it goes with the next snapshot
        for name in before[: max((k for k, n in enumerate(before) if "-snapshot-" in n), default=0)]:
            remove(self.spark, f"{self.root}/log/{name}")

    def process(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame], version: str) -> str:
        """Begin, stage, index and publish a version of the given files (document_id, file_name, content); gives the batch's name.

        Documents whose parse fails, or whose chunks the index doesn't acknowledge (``index`` gives the document_ids it
        has whole), are marked failed: their active version stays, and what was staged of them is discarded.
        """
        batch = uuid.uuid4().hex
        self._log(files, "begin", version, batch)
        self._stage(parse(files), version, batch)
        parsed = self.spark.read.schema(ARTIFACT).parquet(f"{self.root}/artifacts/{batch}").select("document.document_id", "document.error")
        good, bad = parsed.where("error is null"), parsed.where("error is not null")
        self._log(bad, "fail", version, batch)
        self._log(good, "stage", version, batch)
        whole = index(self._read([f"{self.root}/chunks/{batch}/g0"]).drop("batch")).select("document_id").distinct()
        self._log(good.join(whole, "document_id", "left_semi"), "publish", version, batch)
        self._log(good.join(whole, "document_id", "left_anti"), "fail", version, batch)
        return batch

    def _stage(self, parsed: DataFrame, version: str, batch: str) -> None:
        """Write documents, and chunks of those without an error, in one pass; the chunks' folder is then put where it belongs."""
        own = F.struct(*[c for c in parsed.columns if c not in ("parents", "children")])
        as_text = lambda c: F.concat(c["context_prefix"], c["body_text"])

        missing = F.lit(None).cast(parsed.select(own).schema[0].dataType).alias("document")

        def chunk(c: Column, is_parent: bool) -> Column:
            rendered = F.lit(not is_parent) & F.coalesce(c["embedding_text"] == as_text(c), F.lit(False))
            data = c.withField("embedding_text", F.when(~rendered, c["embedding_text"]))
            return F.struct(F.lit("chunk").alias("kind"), missing, c["chunk_id"].alias("chunk_id"), c["parent_id"].alias("parent_id"), F.lit(is_parent).alias("is_parent"), rendered.alias("rendered"), data.cast(CHUNK).alias("data"))

        def nothing(name: str, kind: str) -> Column:
            return F.lit(None).cast(kind).alias(name)

        document = F.struct(F.lit("document").alias("kind"), own.alias("document"), nothing("chunk_id", "string"), nothing("parent_id", "string"), nothing("is_parent", "boolean"), nothing("rendered", "boolean"), nothing("data", CHUNK))
        chunks = [F.when(F.col("error").isNull(), made) for made in (F.transform("parents", lambda c: chunk(c, True)), F.transform("children", lambda c: chunk(c, False)))]
        rows = parsed.select(F.col("document_id").cast("long").alias("document_id"), F.lit(version).alias("version"), F.lit(batch).alias("batch"), F.explode(F.concat(F.array(document), *[F.coalesce(c, F.array()) for c in chunks])).alias("x"))
        at = f"{self.root}/artifacts/{batch}"
        packed(rows.select("document_id", "version", "batch", "x.*")).partitionBy("kind").parquet(at)
        files, made = _folder(self.spark, f"{at}/kind=chunk")
        _, to = _folder(self.spark, f"{self.root}/chunks/{batch}/g0")
        if not files.exists(made):
            self.spark.createDataFrame([], STORED).write.parquet(f"{self.root}/chunks/{batch}/g0")
            return
        files.mkdirs(to.getParent())
        if not files.rename(made, to):
            raise OSError(f"the chunks of batch {batch} can't be put into their folder")
        files.create(to.suffix("/_SUCCESS")).close()

    def _read(self, paths: list[str]) -> DataFrame:
        """Stored chunks as they were given."""
        data = F.col("data")
        text = F.when(F.col("rendered"), F.concat(data["context_prefix"], data["body_text"])).otherwise(data["embedding_text"])
        return self._held(paths).withColumn("data", data.withField("embedding_text", text)).drop("rendered")

    def _held(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*paths)

    def _generations(self, batch: str) -> list[int]:
        at = f"{self.root}/chunks/{batch}"
        return sorted(int(g.removeprefix("g")) for g in names_in(self.spark, at) if "_SUCCESS" in names_in(self.spark, f"{at}/{g}"))

    def chunks(self) -> DataFrame:
        """All stored chunks, with version and batch as they were given."""
        held = {b: self._generations(b) for b in names_in(self.spark, f"{self.root}/chunks")}
        return self._read([f"{self.root}/chunks/{b}/g{g[-1]}" for b, g in held.items() if g])

    def readable(self) -> DataFrame:
        """Chunks that documents' pointers name."""
        active = self.states().where("active_version <> ''").select("document_id", F.col("active_version").alias("version"), F.col("active_batch").alias("batch"))
        return self.chunks().join(active, ["document_id", "version", "batch"], "left_semi")

    def discard(self) -> list[str]:
        """Let chunks go that no pointer and no run under way names; gives the names of the batches written anew.

        The rows that stay are written beside those there are, as the next generation. What that one replaces is read
        by nobody new, and is removed by the next call: a run that dies at any point leaves one whole generation.
        """
        for batch in names_in(self.spark, f"{self.root}/chunks"):
            for g in self._generations(batch)[:-1]:
                remove(self.spark, f"{self.root}/chunks/{batch}/g{g}")
        s = self.states()
        live = s.select("document_id", F.col("active_batch").alias("batch")).union(s.where("status <> 'failed'").select("document_id", "pending_batch")).where("batch <> ''")
        # as many as there are batches
        batches = [r["batch"] for r in self.chunks().select("document_id", "batch").distinct().join(live, ["document_id", "batch"], "left_anti").select("batch").distinct().collect()]
        for batch in sorted(batches):
            g = self._generations(batch)[-1]
            kept = of_documents(self._held([f"{self.root}/chunks/{batch}/g{g}"]), live.where(F.col("batch") == batch))
            packed(kept).mode("overwrite").parquet(f"{self.root}/chunks/{batch}/g{g + 1}")
        return sorted(batches)


#: Chunks as they are stored; ``rendered`` says that the embedding text is made of prefix and body.
STORED = f"document_id long, version string, chunk_id string, parent_id string, is_parent boolean, data {CHUNK}, batch string, rendered boolean"
#: What is read of stored documents.
ARTIFACT = "document struct<document_id:bigint,error:string>"
EVENT = "document_id long, seq long, kind string, version string, batch string"

__all__ = ["CASCADE", "Tables", "Versions", "delete_documents", "names_in", "packed", "remove", "without_prefixes"]
