"""The corpus pipeline: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Inside a stage the
columns of docs bear numbers, so that extra columns with any names pass through. An empty table
passes every stage. Stages with models or merges have no SQL form; their tests are brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import toxicity
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.near_copies import near_copies
from tesserae.llm.sentencepiece_codec import encode_decode
from tesserae.llm.vocab import vocabulary

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, list[str]]:
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")], names


def _named(df: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half, by a model of the labelled ones; all, without labels of both kinds unless most are toxic.

    A null or empty text is scored as a blank. Repeated rows share a fate; long texts are scored whole.
    """
    df, doc_id, text, names = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(doc_id), "toxic")
    model = toxicity.train(df, labels, id_col=doc_id, text_col=text)
    scored = toxicity.score(df, model, id_col=doc_id, text_col=text, keep=names)
    return _named(scored.where("predicted = 0"), names, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash or a similarity of five-word shingles of at least 0.8 links: that of the least doc_id.

    A document is a doc_id (of any type that can be ordered) with a text: of one doc_id with several
    texts each text is decided by itself, and repeated rows are one document. Of a group's documents
    with one doc_id that with the least hash of its text stays; those without a doc_id come after all
    others. Null texts, empty ones and those without words are one group. Long texts are read whole.
    """
    df, doc_id, text, names = _numbered(docs)
    own = F.struct(F.col(doc_id).isNull().alias("bare"), F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"))
    df = df.withColumn("k", own)
    first = near_copies(df, id_col="k", text_col=text).where("k = component_id").select("k").distinct()
    kept = df.join(first, "k", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.col(text).asc_nulls_first())))
    return _named(kept.where("r = 1"), names, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a window of a benchmark item.

    Null and empty texts stay. Repeated rows share a fate; long texts are searched whole.
    """
    df, doc_id, text, names = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    found = decontaminate(df, items, doc_id=doc_id, text=text, item_text="item", keep=names)
    return _named(found.where("not contaminated"), names, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left, with digests of the ids and of the decoded text.

    This last stage returns doc_id and what the encoding gives; other columns end here. Null and empty
    texts have no ids. Repeated rows give repeated rows; long texts are encoded whole.
    """
    return encode_decode(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
