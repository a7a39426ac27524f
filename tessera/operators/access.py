"""Who may see what: tag inheritance, the access filter, version and model gates, file lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tags as tag_list
from ..schemas import COMPLETE, MAX_REFS
from ..session import written


def visible(user_id: int, tags: Sequence[str], user: str = "user_id") -> Column:
    """Owner, or public, or of one of the tags (left out where there are none); a null tag never matches."""
    allowed = (F.col(user) == user_id) | F.col("is_public")
    return allowed | F.coalesce(F.col("org_tag").isin(list(tags)), F.lit(False)) if tags else allowed


def accessible_files(files: DataFrame, user_id: int, tags: Sequence[str]) -> DataFrame:
    return files.where((F.col("status") == COMPLETE) & visible(user_id, tags))


def accessible_for_users(files: DataFrame, user_tags: DataFrame) -> DataFrame:
    """(member_id, id) of files that each member sees by ownership or tag; public files aside, which all see.

    user_tags: (member_id, tag), the effective tags of each.
    """
    ready = files.where(F.col("status") == COMPLETE)
    members = user_tags.select("member_id").distinct()
    own = ready.join(members, ready["user_id"] == members["member_id"]).select("member_id", "id")
    shared = ready.join(user_tags, ready["org_tag"] == user_tags["tag"]).select("member_id", "id")
    return own.union(shared).distinct()


def gated(hits: DataFrame, files: DataFrame, states: DataFrame) -> DataFrame:
    """Hits of files that are there, in the version that is active: an equi-join on four columns."""
    active = active_states(states, files).select("document_id", F.col("active_version").alias("version"), F.col("owner").alias("user_id"), "file_md5")
    return hits.where((F.col("document_id") != 0) & (F.col("version") != "")).join(active, ["document_id", "version", "user_id", "file_md5"], "left_semi")


def active_states(states: DataFrame, files: DataFrame) -> DataFrame:
    """States with a version that can be read, of complete files of the same owner."""
    f = files.where(F.col("status") == COMPLETE).select(F.col("id").alias("document_id"), F.col("user_id").alias("owner"), "file_md5", "file_name")
    s = states.where(F.col("active_version") != "")
    return s.join(f, (s["document_id"] == f["document_id"]) & (s["user_id"] == f["owner"])).select(s["document_id"], "owner", "file_md5", "file_name", "active_version", "status")


def searchable(chunks: DataFrame, files: DataFrame, states: DataFrame, user_id: int, tags: Sequence[str], model: str) -> DataFrame:
    """Chunks that a user's search may find: of files they may see, in the active version, with the model's vectors."""
    return of_model(gated(chunks, accessible_files(files, user_id, tags), states), model)


def of_model(hits: DataFrame, model: str) -> DataFrame:
    return hits.where(F.col("model_version") == model)


def ancestors(tags: DataFrame) -> DataFrame:
    """(tag, ancestor) over the parent relation, each tag with a parent its own ancestor too, however deep.

    Rounds double the distance: what lies just as far as the last round reached is joined with all found so far, so each
    pair on a chain is made once. Rounds are the logarithm of the longest chain, and end where nothing new is found, cycles
    or not. A round writes what it finds; nothing is written again.
    """
    parent = tags.where(F.coalesce("parent_tag", F.lit("")) != "").select(F.col("tag_id").alias("tag"), F.col("parent_tag").alias("ancestor")).distinct()
    found = farthest = written(parent, "ancestors")
    own = found.select("tag", F.col("tag").alias("ancestor")).distinct()

    def above(rows: DataFrame) -> DataFrame:
        upper = rows.select(F.col("tag").alias("middle"), F.col("ancestor").alias("above"))
        return farthest.join(upper, farthest["ancestor"] == upper["middle"]).select("tag", F.col("above").alias("ancestor")).distinct()

    while True:
        fresh = written(above(found).join(found, ["tag", "ancestor"], "left_anti"), "ancestors-new")
        if fresh.isEmpty():
            return found.where("tag <> ancestor").union(own)
        farthest, found = written(above(farthest), "ancestors-farthest"), found.union(fresh)


def effective_tags(users: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag): the user's own tags and all above them, even those without a row of their own."""
    own = users.select(F.col("id").alias("user_id"), F.explode(tag_list(F.col("org_tags"))).alias("tag")).distinct()
    return own.join(ancestors(tags), "tag").select("user_id", F.col("ancestor").alias("tag")).union(own).distinct()


def tag_paths(tags: DataFrame) -> DataFrame:
    """(tag_id, root, path, depth) of tags reached from a root, however deep; tags under a missing parent or in a cycle are not.

    Each tag's way upwards is joined with the way of its highest tag so far, so rounds are the logarithm of the depth.
    """
    rooted = F.coalesce("parent_tag", F.lit("")) == ""
    ways = tags.select(F.col("tag_id").alias("tag"), rooted.alias("whole"), F.when(rooted, F.array("tag_id")).otherwise(F.array("parent_tag", "tag_id")).alias("way")).distinct()
    while True:
        ways = written(ways, "tag-paths")
        open_ = ways.where("not whole")
        if open_.isEmpty():
            break
        above = ways.select(F.col("tag").alias("top"), F.col("whole").alias("top_whole"), F.slice("way", F.lit(1), F.size("way") - 1).alias("rest"))
        longer = open_.join(above, F.get("way", F.lit(0)) == above["top"]).where(~F.arrays_overlap("rest", "way"))
        ways = ways.where("whole").union(longer.select("tag", F.col("top_whole").alias("whole"), F.concat("rest", "way").alias("way")))
    return ways.select(F.col("tag").alias("tag_id"), F.get("way", F.lit(0)).alias("root"), F.array_join("way", "/").alias("path"), (F.size("way") - 1).alias("depth"))


def tag_details(users: DataFrame, tags: DataFrame, trim: bool) -> DataFrame:
    """(user_id, pos, tag_id, name) of the tags that have a row, in the order of the user's list."""
    parts = F.split("org_tags", ",")
    parts = F.transform(parts, lambda t: F.trim(t)) if trim else parts
    rows = users.select(F.col("id").alias("user_id"), F.posexplode(parts).alias("pos", "tag_id"))
    return rows.join(tags.select("tag_id", "name"), "tag_id").select("user_id", "pos", "tag_id", "name")


def with_tag_names(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with the name of their tag, empty where there is none."""
    names = tags.select(F.col("tag_id").alias("org_tag"), F.col("name").alias("tag_name"))
    return files.join(names, "org_tag", "left").withColumn("tag_name", F.coalesce("tag_name", F.lit("")))


def uploaded(requests: DataFrame, files: DataFrame, there: bool = True) -> DataFrame:
    """Requests (file_md5, user_id) whose file the user has completed before, or hasn't."""
    ready = files.where(F.col("status") == COMPLETE).select("file_md5", "user_id")
    return requests.join(ready, ["file_md5", "user_id"], "left_semi" if there else "left_anti")


def parents(chunks: DataFrame, files: DataFrame, states: DataFrame, refs: DataFrame, user_id: int, tags: Sequence[str]) -> DataFrame:
    """Parent chunks that are asked for (distinct document_id, version, chunk_id), active for their owner and accessible."""
    allowed = accessible_files(files, user_id, tags).select(F.col("id").alias("document_id"), F.col("user_id").alias("owner"))
    active = states.where("active_version <> ''").select("document_id", F.col("active_version").alias("version"), "user_id")
    c = chunks.where("is_parent").join(refs.select("document_id", "version", "chunk_id").distinct(), ["document_id", "version", "chunk_id"], "left_semi")
    return c.join(active, ["document_id", "version", "user_id"], "left_semi").join(allowed, (c["document_id"] == allowed["document_id"]) & (c["user_id"] == allowed["owner"]), "left_semi")


def too_many_refs(refs: DataFrame) -> bool:
    return refs.select("document_id", "version", "chunk_id").distinct().limit(MAX_REFS + 1).count() > MAX_REFS


def published(files: DataFrame, states: DataFrame, user_id: int, tags: Sequence[str], version: str | None = None) -> DataFrame:
    """Readable documents (document_id, version, file_name); with a version only those where it is the active one."""
    rows = active_states(states, accessible_files(files, user_id, tags))
    rows = rows if version is None else rows.where(F.col("active_version") == version)
    return rows.select("document_id", F.col("active_version").alias("version"), "file_name")
