"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stage by stage the result is written as Parquet to the shared folder and read again.

Every stage decides about each row by itself, so rows that share an id, or have none, are neither lost
nor multiplied: a null id counts as the largest one, repeated rows are near duplicates of one another,
null texts count as empty and go with the first stage, as do all texts without letters; very long texts
are handled whole; an empty table gives an empty result. ``documents`` has five columns (doc_id, text,
lang, source, n_chars); further ones, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import chosenpath, langid, mixing, packing, substrings
from tessera.llm.common import discard, materialize, order_id, table
from tessera.llm.queries import vocabulary
from tessera.session import ship


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in languages the model knows, one or several: all but ``und``."""
    ship(spark)
    return langid.language_id(docs, carry=docs.columns).where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, and of one id the smallest hash of the text.

    Of repeated rows any one stays; texts without words are near duplicates of nothing but repeated rows.
    """
    ship(spark)
    first = chosenpath.similar_documents(docs).where("first").select(order_id().alias("first_id"), F.col("text_key").alias("first_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), order_id().alias("first_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("first_key"))
    kept = rows.join(first, ["first_id", "first_key"], "left_semi").dropDuplicates(["first_id", "first_key"])
    return kept.select("row.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; rows of which nothing is left go."""
    ship(spark)
    cut = substrings.remove_repeats(docs, with_text=True, carry=[c for c in docs.columns if c != "text"])
    cut = cut.where((F.col("n_words") > F.col("n_removed")) | (F.col("n_removed") == 0)).select("carried.*", F.col("kept_text").alias("text"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, cut or left out so that sources come near their target weights."""
    return mixing.repeated(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024; copies of a document share its doc_id."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources", mix_to_weights),
    ("packing", pack_sequences),
]

#: No SQL expresses a trained model, tokenization or chosen-path search; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k + 1}")
            discard(given)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
