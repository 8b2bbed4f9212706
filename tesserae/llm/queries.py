"""The registered queries opN_<name> over the whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, sharding, toxicity, url_filter
from .common import shared_dir, table
from .decontaminate import ORACLE as DECONTAMINATION
from .decontaminate import decontaminate
from .forest import nearest
from .sentencepiece_codec import encode_decode
from .simhash import near_duplicates
from .token_store import read_verified, write_store
from .transducer import count_tokens
from .vocab import vocabulary


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.listed_table(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), ["doc_id"], keep=["doc_id"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "op8")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return read_verified(spark, path)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"))
    return license_scan.scan(docs, keep=["doc_id"])


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_token_store": op8_token_store,
    "op9_nearest": op9_nearest,
    "op10_license_scan": op10_license_scan,
}
ORACLES: dict[str, str] = {"op1_url_filters": url_filter.oracle_sql(), "op4_decontamination": DECONTAMINATION, "op5_sharding": sharding.oracle_sql(), "op10_license_scan": license_scan.oracle_sql()}
