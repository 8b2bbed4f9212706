"""Intent, retention and final scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.constants import ELITE_COSINE, ENTITY_TERMS, IMMUNE_ACCESS, IMMUNE_IMPORTANCE, INTENT_WEIGHTS, WHEN_TERMS, WHY_TERMS


def term_pattern(terms) -> str:
    """One alternation of all terms in their order, so that matches do not overlap; ASCII ones as whole words."""
    plain, other = [t for t in terms if t.isascii()], [t for t in terms if not t.isascii()]
    return "|".join([rf"(?<![A-Za-z0-9_])(?:{'|'.join(plain)})(?![A-Za-z0-9_])", *other] if plain else other)


def detect_intent(query: Column) -> Column:
    low = F.lower(query)
    why, when, what = (F.regexp_count(low, F.lit(term_pattern(t))) for t in (WHY_TERMS, WHEN_TERMS, ENTITY_TERMS))
    return F.when((why > when) & (why > what), "WHY").when((when > why) & (when > what), "WHEN").when(what > 0, "ENTITY").otherwise("GENERAL")


def intent_weight(intent: Column, edge_type: Column) -> Column:
    out = F.lit(0.0)
    for name, weights in INTENT_WEIGHTS.items():
        for kind, w in weights.items():
            out = F.when((intent == name) & (edge_type == kind), w).otherwise(out)
    return out


def immune(importance: Column, access: Column) -> Column:
    return (importance >= IMMUNE_IMPORTANCE) | (access >= IMMUNE_ACCESS)


def days_since(now: Column, last: Column, created: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.coalesce(last, created))) / F.lit(86_400_000_000.0))


def effective_importance(importance: Column, access: Column, days: Column, edges: Column) -> Column:
    base = F.when(importance >= 5, 1.0).when(importance == 4, 0.8).when(importance == 3, 0.5).when(importance == 2, 0.3).otherwise(0.15)
    return F.least(F.lit(1.0), base * F.greatest(F.lit(1.0), F.log1p(access.cast("double"))) * F.pow(F.lit(0.5), days / 30.0) * (1 + 0.1 * F.least(edges, F.lit(5))))


def final_score(keyword: Column, entity: Column, similarity: Column, graph: Column, embedded: bool) -> Column:
    if embedded:
        return 0.30 * keyword + 0.15 * entity + 0.35 * similarity + 0.20 * graph
    return 0.45 * keyword + 0.25 * entity + 0.30 * graph


def normalize_elite(df: DataFrame, embedded: bool, keys: list[str]) -> DataFrame:
    """Column graph: graph_raw by min and max among rows with a keyword or near vector; 0 for the others and for no range."""
    elite = (F.col("keyword") > 0) | ((F.col("similarity") >= ELITE_COSINE) if embedded else F.lit(False))
    w = W.partitionBy(*keys)
    raw = F.when(elite, F.col("graph_raw"))
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return df.withColumn("graph", F.when(elite & (high > low), F.try_divide(F.col("graph_raw") - low, high - low)).otherwise(0.0))
