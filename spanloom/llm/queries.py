"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, license_texts, licenses, mixing, neardup, ogg, pu_quality, repetition, token_counts, warc
from .common import table

TOKEN_LIMIT = 512
NEAR = neardup.Shingling(words=4, percent=80)


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(chat.with_probe(spark, table(spark, sf_dir, "conversations"))).drop("shared_chars")


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), license_texts.SHORT_NOTICES)


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(table(spark, sf_dir, "documents"))


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_neardup, op2_chat_tree, op3_warc_chain, op4_license_scan, op4_short_notices, op5_ogg_media, op6_fair_mixing, op7_repetition_rules, op8_token_counts, op9_pu_quality, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_neardup": neardup.sql(NEAR),
        "op2_chat_tree": chat.SQL,
        "op3_warc_chain": warc.SQL,
        "op4_license_scan": licenses.SQL,
        "op4_short_notices": licenses.SHORT_SQL,
        "op6_fair_mixing": mixing.SQL,
        "op7_repetition_rules": repetition.SQL,
    }
