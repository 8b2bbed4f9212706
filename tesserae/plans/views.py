"""The driver's tables seen as insights, with the same views in DuckDB's SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.constants import STOPWORDS
from tesserae.functions.text import tokenize

from .session import read

START = "2024-01-01 00:00:00"


def documents(spark: SparkSession, sf_dir: str, tokens: bool = True) -> DataFrame:
    """id, content, source, created_at (a minute for each id), importance, tokens."""
    d = read(spark, sf_dir, "documents")
    out = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang", F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + F.col("doc_id") * 60_000_000).alias("created_at"), (1 + F.col("doc_id") % 5).cast("int").alias("importance"))
    return out.withColumn("tokens", tokenize(F.col("content"))) if tokens else out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, namespace (the user), source (the type), created_at."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("namespace"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("created_at"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


QUERIES = ((1, "thly ering thatnd"), (2, "idiot and the clown"), (3, "de la que por el"), (4, "einung und mit der"))


def queries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
    return spark.sql(f"select * from values {rows} as t(query_id, query)").withColumn("tokens", tokenize(F.col("query")))


def vector_queries(spark: SparkSession, sf_dir: str, every: int = 100) -> DataFrame:
    """Rows whose id is divisible by `every`, as queries against all."""
    return vectors(spark, sf_dir).where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over documents by rule: the next of a source, the double id, and the id seven on."""
    d = documents(spark, sf_dir, tokens=False).select("id", "source", "created_at")
    from tesserae.operators.edges import backbone

    temporal = backbone(d, ("source",)).where("direction = 'precedes'").select("source_id", "target_id", F.lit("temporal").alias("edge_type"), F.lit(1.0).alias("weight"))
    ids = d.select("id")
    other = d.select(F.col("id").alias("source_id"), F.explode(F.array(F.struct((F.col("id") * 2).alias("target_id"), F.lit("causal").alias("edge_type"), F.lit(0.5).alias("weight")), F.struct((F.col("id") + 7).alias("target_id"), F.lit("semantic").alias("edge_type"), (0.25 + 0.1 * (F.col("id") % 5)).alias("weight")))).alias("e")).select("source_id", "e.*").where("source_id <> target_id")
    kept = other.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "edge_type", "weight")
    return temporal.union(kept)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tok_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda x: not list_contains({STOP_SQL}, x)))"


D = f"d as (select doc_id as id, text as content, source, lang, timestamp '{START}' + to_minutes(doc_id) as created_at, cast(1 + doc_id % 5 as integer) as importance, {tok_sql('text')} as tokens from documents)"
D0 = f"d as (select doc_id as id, text as content, source, lang, timestamp '{START}' + to_minutes(doc_id) as created_at, cast(1 + doc_id % 5 as integer) as importance from documents)"
E = "e as (select event_id as id, user_id as namespace, event_type as source, ts as created_at, value from events)"
V = "v as (select vec_id as id, cast(embedding as double[]) as x from embeddings)"
Q = "q as (select query_id, query, " + tok_sql("query") + " as tokens from (values " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ") as t(query_id, query))"
KW = "kw as (select q.query_id, d.id, len(list_intersect(d.tokens, q.tokens)) / len(q.tokens) as keyword from d, q where list_has_any(d.tokens, q.tokens))"
G = """g as (select prev as source_id, id as target_id, 'temporal' as edge_type, 1.0::double as weight from (select id, lag(id) over (partition by source order by created_at, id) as prev from d) where prev is not null
union all select d.id, d.id * 2, 'causal', 0.5 from d where d.id > 0 and d.id * 2 in (select id from d)
union all select d.id, d.id + 7, 'semantic', 0.25 + 0.1 * (d.id % 5) from d where d.id + 7 in (select id from d)),
u as (select source_id as a, target_id as b, edge_type, weight from g union all select target_id, source_id, edge_type, weight from g)"""
COS = "case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 0 then list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) else 0 end"
