"""The contract queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framesift.llm import byte_bpe, decontaminate, importance, licenses, oracles, ppm, quality, secrets, sharding, simhash, substrings, token_count, token_files, whitening
from framesift.llm.common import documents, read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.query(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(documents(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation_query(documents(spark, sf_dir))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.query(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(documents(spark, sf_dir), verdicts=True)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(read(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "quality_ablation": quality_ablation,
    "op3_token_count": op3_token_count,
    "op4_decontaminate": op4_decontaminate,
    "op5_ppm": op5_ppm,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_importance": op11_importance,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = oracles.ORACLES
