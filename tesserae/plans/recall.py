"""Recall for batches of queries, without side effects."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.constants import MAX_CANDIDATES, RECALL_LIMIT
from tesserae.functions import scoring
from tesserae.functions.similarity import cosine
from tesserae.operators import graph, retrieval

from .session import settle


def recall(insights: DataFrame, edges: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, limit: int = RECALL_LIMIT, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(query_id, place, id, score, via, keyword, entity, similarity, graph) of the hits.

    insights: id, tokens, entities, importance, created_at, source (and category); edges: source_id,
    target_id, edge_type, weight; queries: query_id, tokens, entities, intent, and as needed vector,
    source (which restricts anchors only) and category (which restricts hits only, after the graph
    score is normalised). A WHY query's hits are put in causal order.
    """
    embedded = vectors is not None
    a = settle(retrieval.anchors(insights, queries, vectors=embedded) if not embedded else retrieval.anchors(insights.join(vectors, "id", "left"), queries, vectors=True))
    walked = graph.walk(a.select("query_id", "id", "score", "via"), edges, queries, vectors, max_candidates).withColumnRenamed("score", "graph_raw")
    kw = retrieval.keyword_scores(insights.join(walked.select("id").distinct(), "id", "left_semi"), queries)
    rows = walked.join(kw, ["query_id", "id"], "left").na.fill(0.0, ["keyword"])
    q = queries.select("query_id", F.col("entities").alias("q_entities"), "intent", *(F.col(c).alias(f"q_{c}") for c in ("vector", "category") if c in queries.columns))
    cols = ["id", "entities", "importance"] + (["category"] if "category" in insights.columns else [])
    rows = rows.join(insights.select(*cols), "id").join(retrieval.sized(q), "query_id")
    low = F.transform("q_entities", F.lower)
    rows = rows.withColumn("entity", F.size(F.filter("entities", lambda e: F.array_contains(low, F.lower(e)))) / F.greatest(F.lit(1), F.size("q_entities")))
    if embedded:
        rows = rows.join(vectors, "id", "left").withColumn("similarity", F.when(F.col("embedding").isNotNull() & F.col("q_vector").isNotNull(), F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("q_vector")))).otherwise(0.0))
    else:
        rows = rows.withColumn("similarity", F.lit(0.0))
    rows = scoring.normalize_elite(rows, embedded, ["query_id"])
    if "category" in queries.columns and "category" in insights.columns:
        rows = rows.where(F.col("q_category").isNull() | (F.col("category") == F.col("q_category")))
    rows = rows.withColumn("score", scoring.final_score(F.col("keyword"), F.col("entity"), F.col("similarity"), F.col("graph"), embedded))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("importance"), F.desc("graph_raw"), "id")
    hits = settle(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "id", "score", "via", "keyword", "entity", "similarity", "graph", "intent"))
    causal = graph.topological(hits.where("intent = 'WHY'"), edges).withColumnRenamed("place", "p")
    return hits.join(causal, ["query_id", "id"], "left").withColumn("place", F.coalesce("p", "place")).drop("p", "intent")
