"""Mixing sources to target weights by capped water-filling and seeded repetition.

Every source gets a share of all words by weight; a source whose share exceeds ``max_epochs``
times its own words is clamped there and the excess is shared out again by weight until no source
is above. In closed form: in ascending order of cap over weight, sources are clamped as long as
the level that the rest would get lies above their cap.

A source's target of ``e`` epochs is met by ``floor(e)`` whole repetitions of every document and
by one more repetition of documents in a seeded order until the words run out; the document where
they run out gives a fraction of itself. The order is cut into 4096 seeded buckets: totals of
(source, bucket) say in which bucket the words run out, so only that bucket is ever sorted, and no
task holds a whole source.

Edge cases: null text has size 0 and is taken 0 times, or as often as whole repetitions where the mix
itself is made; a null source is a source of its own, last in order; null ids are kept and share one
place in the order; rows with the same id, repeated or not, are separate documents, in order of size;
very long texts are handled whole; an empty table gives an empty result; an all-empty table has targets
0. Columns of the input are ignored, whatever their names, unless ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import discard, materialize, sized_broadcast

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def mix_sources(docs: DataFrame, seed: int = 7, max_epochs: int = 3, weights: Sequence[float] = (1, 2, 3), doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, epochs (whole), part (words of the fraction).

    ``weights`` go to the sources in code point order, null last, repeating. ``carried``, if ``carry`` names
    columns, is a struct of these, as they are in that row.
    """
    more = ["carried"] if carry else []
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).isNull().alias("no_source"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("order_key"),
            *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
        ).withColumn("bucket", (F.conv(F.substring("order_key", 1, 3), 16, 10)).cast("int")),
        "mix-sizes",
    )
    of = ["no_source", "source_key"]
    buckets = materialize(sized.groupBy(*of, "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("docs")), "mix-buckets")
    plan = source_targets(buckets.groupBy(*of).agg(F.sum("bucket_size").alias("source_size")), max_epochs, weights)
    until = W.partitionBy(*of).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    spread = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(until), F.lit(0))).join(plan, of)
    spread = materialize(spread.drop("docs"), "mix-spread")
    rows = materialize(sized.join(sized_broadcast(spread), [*of, "bucket"]), "mix-rows")
    discard(sized, buckets)
    whole = rows.withColumn(
        "part",
        F.when(F.col("before") + F.col("bucket_size") <= F.col("extra"), F.col("size")).when(F.col("before") >= F.col("extra"), F.lit(0)),
    )
    order = W.partitionBy(*of).orderBy("order_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = whole.where("part is null").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead")))).drop("ahead")
    return whole.where("part is not null").unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", F.col("part").cast("long").alias("part"), *more
    )


def source_targets(sources: DataFrame, max_epochs: int, weights: Sequence[float]) -> DataFrame:
    """Water-filling over one row per source: adds target, epochs (whole) and extra (words beyond them)."""
    n = len(weights)
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("no_source", "source_key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    up = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("cap").over(up), F.lit(0)).alias("caps_below"),
        F.coalesce(F.sum("weight").over(up), F.lit(0.0)).alias("weights_below"),
    )
    share = (F.col("total") - F.col("caps_below")) / (F.col("weights") - F.col("weights_below"))
    level = level.withColumn("clamped", F.col("weight") * share > F.col("cap"))
    rest = level.select(
        "*",
        F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every).alias("caps_clamped"),
        F.sum(F.when(F.col("clamped"), F.col("weight")).otherwise(0.0)).over(every).alias("weights_clamped"),
    )
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("caps_clamped")) / (F.col("weights") - F.col("weights_clamped")))
    out = rest.withColumn("target", F.least(target, F.col("cap").cast("double")))
    out = out.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("target"), F.col("source_size")))).cast("long"))
    out = out.withColumn("extra", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    return out.select("no_source", "source_key", "source_size", "target", "epochs", "extra")


def repeated(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each row's whole repetitions, and one row with its first ``part`` words.

    ``how`` is what mix_sources takes. Every row is mixed by itself, whatever other rows share its id.
    """
    names = docs.columns
    mixed = mix_sources(docs, text=text, carry=names, **how)
    whole = (F.col("epochs") + (F.col("part") == F.col("size")).cast("long")).cast("int")
    some = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(some, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    rows = mixed.select("carried", F.explode(copies).alias("take"))
    own = {c: F.col("carried").getField(c) for c in names}
    cut = F.array_join(F.slice(F.regexp_extract_all(own[text], F.lit(WORD), 0), F.lit(1), F.col("take").cast("int")), " ")
    return rows.select(*[(F.when(F.col("take") < 0, own[c]).otherwise(cut) if c == text else own[c]).alias(c) for c in names])


def oracle_sql(seed: int = 7, max_epochs: int = 3) -> str:
    """The same in DuckDB SQL over the view ``documents``, weights 1, 2, 3."""
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{seed}:' || coalesce(doc_id::varchar, '')) as k
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as rk from src),
w as (select *, (rk % 3 + 1)::double as weight, source_size * {max_epochs} as cap from ranked),
lv as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
         coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0) as caps_below,
         coalesce(sum(weight) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0) as weights_below
       from w),
cl as (select *, weight * ((total - caps_below) / (weights - weights_below)) > cap as clamped from lv),
rs as (select *, sum(case when clamped then cap else 0 end) over () as cc, sum(case when clamped then weight else 0 end) over () as wc from cl),
tg as (select source, source_size, least(case when clamped then cap::double else weight * (total - cc) / (weights - wc) end, cap::double) as target from rs),
ex as (select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as epochs from tg),
pl as (select *, round(target)::bigint - epochs * source_size as extra from ex),
rows_ as (select s.doc_id, s.size, p.source_size, p.target, p.epochs, p.extra,
         coalesce(sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as ahead
       from sized s join pl p on s.source is not distinct from p.source)
select doc_id, size, source_size::bigint as source_size, target,
       (epochs * size + greatest(0, least(size, extra - ahead)))::bigint as taken,
       epochs::bigint as epochs, greatest(0, least(size, extra - ahead))::bigint as part
from rows_"""
