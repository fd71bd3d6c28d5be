"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm_bloom, lz_fingerprint, mixing, nn_descent, packing, sharding, simhash, suffix_dedup, warc
from .common import table, text_bytes


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_digest(warc.resolve(warc.page_records(spark, sf_dir)))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(
        table(spark, sf_dir, "documents"),
        key=F.xxhash64(F.coalesce("text", F.lit(""))),
        size=F.octet_length(F.coalesce("text", F.lit(""))) + 1,
        ident="doc_id",
        carry={"text_crc32": F.crc32(text_bytes())},
    )
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", none)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(table(spark, sf_dir, "documents"))


def op6_first_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op9_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op10_efraimidis_spirakis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_convnet": op1_byte_convnet,
        "op2_revisits": op2_revisits,
        "op3_sampled_splitters": op3_sampled_splitters,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_bloom_lm": op5_bloom_lm,
        "op6_first_fit_decreasing": op6_first_fit_decreasing,
        "op7_nn_descent": op7_nn_descent,
        "op8_simhash": op8_simhash,
        "op9_lempel_ziv": op9_lempel_ziv,
        "op10_efraimidis_spirakis": op10_efraimidis_spirakis,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_revisits": warc.REVISIT_SQL, "op10_efraimidis_spirakis": mixing.MIX_SQL}
