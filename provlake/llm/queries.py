"""The registered queries of this subpackage, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, katz, merkle, periodic, quality, reshard, simhash, suffixes, tokencounts, tokenfile, transcripts, urls
from .common import read


#: The place of the tokenizer that the queries use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(read(spark, sf_dir, "documents"), TOKENIZER)


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.query(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.query(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(read(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.query(read(spark, sf_dir, "documents"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.query(read(spark, sf_dir, "documents"), TOKENIZER)


def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.query(read(spark, sf_dir, "conversations"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(read(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.query(read(spark, sf_dir, "documents"))


def op13_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.query(read(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_reshard": op2_reshard,
    "op3_decontaminate": op3_decontaminate,
    "op4_katz": op4_katz,
    "op5_quality": op5_quality,
    "op6_urls": op6_urls,
    "op7_simhash": op7_simhash,
    "op8_suffixes": op8_suffixes,
    "op9_tokenfile": op9_tokenfile,
    "op10_transcripts": op10_transcripts,
    "op11_merkle": op11_merkle,
    "op12_periodic": op12_periodic,
    "op13_tokencounts": op13_tokencounts,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op5_quality": quality.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
}
