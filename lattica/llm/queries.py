"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import read
from lattica.llm.fingerprints import fingerprints
from lattica.llm import licenses as notices
from lattica.llm.near_dups import near_dups
from lattica.llm.packing import packed
from lattica.llm import preferences as chat
from lattica.llm import quality_rules as rules
from lattica.llm.quality_net import quality
from lattica.llm.pieces import encoded
from lattica.llm.token_counts import token_counts
from lattica.llm.toxicity import toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), BYTE_BPE)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(read(spark, sf_dir, "documents"), size=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), BYTE_BPE)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(read(spark, sf_dir, "conversations"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.licenses(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pieces, op2_quality, op3_token_counts, op4_near_dups, op5_quality_rules, op6_packing, op7_toxicity, op8_fingerprints, op9_preferences, op10_licenses)}
SQL: dict[str, str] = {"op5_quality_rules": rules.SQL, "op9_preferences": chat.SQL, "op10_licenses": notices.SQL}
