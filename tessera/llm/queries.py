"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bestfit, chosenpath, cotraining, hardneg, hilbert, langid, matroska, mixing, packing, resample, substrings, toxicity, wordpiece
from .common import table

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str = BYTE_BPE) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.store(table(spark, sf_dir, "documents"))).drop("error")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.similar_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_token_counts, op3_media_columns, op4_toxicity, op5_jaccard_join,
        op6_substring_dedup, op7_quality, op8_mix_sources, op9_neighbours, op10_pack,
        op11_resample, op12_hard_negatives, op13_best_fit,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": mixing.oracle_sql(), "op11_resample": resample.oracle_sql(), "op12_hard_negatives": hardneg.oracle_sql()}
