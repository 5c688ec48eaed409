"""Queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import conversation_repair, decontamination, exact_dedup, language_model, mixing, packing, periodic_runs, quality, sharding, simhash, suffix_dedup, token_counts, url_rules

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir)).drop("spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.with_repeated_tails(documents(spark, sf_dir)))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), decontamination.read_items(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_url_rules": op5_url_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_model": op7_language_model,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE, "op13_decontamination": decontamination.ORACLE}
