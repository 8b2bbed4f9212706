"""JSON drafts in, audit receipts out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import ValidationError

DRAFT = ("schema_version string, source string, insights array<struct<content:string,category:string,importance:int,tags:array<string>,entities:array<string>,source:string,created_at:string>>, "
         "edges array<struct<source_index:int,target_index:int,edge_type:string,weight:double,reason:string>>")


def read_draft(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DRAFT).json(path, multiLine=True)


def draft_insights(draft: DataFrame, default_source: str = "import") -> DataFrame:
    """(seq, content, category, importance, tags, entities, source, created_at) with defaults filled in."""
    rows = draft.select(F.col("source").alias("s"), F.posexplode("insights").alias("seq", "i")).select("seq", "s", "i.*")
    return rows.withColumns({"source": F.coalesce("source", "s", F.lit(default_source)), "category": F.coalesce("category", F.lit("general")), "importance": F.coalesce("importance", F.lit(3)),
                             "tags": F.coalesce("tags", F.array().cast("array<string>")), "entities": F.coalesce("entities", F.array().cast("array<string>"))}).drop("s")


def draft_edges(draft: DataFrame) -> DataFrame:
    rows = draft.select(F.posexplode(F.coalesce("edges", F.array().cast(draft.schema["edges"].dataType))).alias("seq", "e")).select("seq", "e.*")
    return rows.withColumn("weight", F.coalesce("weight", F.lit(0.5)))


def check_draft(draft: dict) -> None:
    """Raise for the first fault of a parsed draft, before anything is written."""
    from tesserae.constants import EDGE_TYPES

    if draft.get("schema_version") != "1":
        raise ValidationError("schema_version", "schema_version must be \"1\"")
    n = len(draft.get("insights") or [])
    if not n:
        raise ValidationError("insights", "a draft needs insights")
    for e in draft.get("edges") or []:
        for end in ("source_index", "target_index"):
            if not isinstance(e.get(end), int) or not 0 <= e[end] < n:
                raise ValidationError("edges", f"{end} must name an insight")
        if e.get("edge_type") not in EDGE_TYPES:
            raise ValidationError("edges", "unknown edge_type")
        if not 0 <= e.get("weight", 0.5) <= 1:
            raise ValidationError("edges", "weight must be in [0, 1]")


def receipt_rows(log: DataFrame) -> DataFrame:
    """Op-log rows with ids and details replaced by hashes; an empty detail has none."""
    some = F.col("detail").isNotNull() & (F.col("detail") != "{}")
    return log.select("operation", F.sha2("insight_id", 256).alias("id_hash"), F.when(some, F.sha2("detail", 256)).alias("detail_hash"))
