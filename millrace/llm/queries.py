"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, collocations, mixing, near_dup, periodic, pii, quality, spotsigs, substring, token_count, token_store, toxicity, warc
from millrace.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_passages(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": op1_personal_data,
        "op2_token_shards": op2_token_shards,
        "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing,
        "op5_warc_archive": op5_warc_archive,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_token_counts": op8_token_counts,
        "op9_spot_signatures": op9_spot_signatures,
        "op10_toxicity": op10_toxicity,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.SQL, "op4_mixing": mixing.SQL, "op5_warc_archive": warc.SQL, "op11_substring_dedup": substring.SQL, "op12_collocations": collocations.SQL}
