"""Bulk builders of typed edges, for rows that arrive in ascending (created_at, id).

Each builder is a window, or an equality join on what the ends share; both directions are put out
by exploding two structs. Temporal links of a busy source or namespace are built day by day.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.constants import CAUSAL_LOOKBACK, CAUSAL_OVERLAP, CAUSAL_PHRASES, EDGE_TYPES, ENABLES_PHRASES, ENTITY_EDGES, ENTITY_LINKS, PREVENTS_PHRASES, PROXIMITY_LINKS, TEMPORAL_HOURS
from tesserae.functions import similarity as S
from tesserae.functions.text import contains_any


def _both(a: Column, b: Column, **fields) -> Column:
    pair = lambda s, t, d: F.struct(s.alias("source_id"), t.alias("target_id"), F.lit(d).alias("direction"), *(v.alias(k) for k, v in fields.items()))
    return F.explode(F.array(pair(a, b, "precedes"), pair(b, a, "succeeds")))


def _previous(insights: DataFrame, by: tuple) -> DataFrame:
    """(by, id, prev): each row's predecessor by (created_at, id), of a busy group day by day.

    Within a day it is the row before; a day's first row follows the last one of the day before it that
    has any. Only a row for each day of a group meets in one task.
    """
    own = insights.select(*by, "id", "created_at", F.floor(F.unix_micros("created_at") / F.lit(86_400_000_000)).alias("day"))
    inside = own.select(*by, "day", "id", F.lag("id").over(W.partitionBy(*by, "day").orderBy("created_at", "id")).alias("before"))
    days = own.groupBy(*by, "day").agg(F.max_by("id", F.struct("created_at", "id")).alias("last"), F.min_by("id", F.struct("created_at", "id")).alias("first"))
    days = days.select(*by, F.col("first").alias("id"), F.lag("last").over(W.partitionBy(*by).orderBy("day")).alias("over")).where("over is not null")
    return inside.join(days, [*by, "id"], "left").select(*by, "id", F.coalesce("before", "over").alias("prev"))


def backbone(insights: DataFrame, by: tuple = ("namespace", "source")) -> DataFrame:
    """Consecutive rows of a source, weight 1. Times must be different within a source."""
    prev = _previous(insights, by).where("prev is not null")
    return prev.select(_both(F.col("prev"), F.col("id"), weight=F.lit(1.0)).alias("e")).select("e.*").withColumn("edge_type", F.lit("temporal")).withColumn("sub_type", F.lit("backbone"))


def proximity(insights: DataFrame, by: tuple = ("namespace",), source: str = "source") -> DataFrame:
    """The 10 newest earlier rows of at most 24 hours before, less the backbone neighbour; weight 1 / (1 + hours).

    Rows are windowed by day: each also stands in the day after its own, where it only can be a
    neighbour, so that a busy namespace is as many tasks as it has days.
    """
    day = F.floor(F.unix_micros("created_at") / F.lit(TEMPORAL_HOURS * 3_600_000_000))
    both = insights.select("id", "created_at", *by, source, day.alias("own"), F.explode(F.array(day, day + 1)).alias("day"))
    w = W.partitionBy(*by, "day").orderBy("created_at", "id")
    prev = F.lag("id").over(W.partitionBy(*by, "day", source).orderBy("created_at", "id"))  # an older one is no candidate anyway
    near = both.select("id", "created_at", "own", "day", prev.alias("prev"), F.collect_list(F.struct("id", "created_at")).over(w.rowsBetween(-PROXIMITY_LINKS, -1)).alias("around")).where("own = day")
    pairs = near.select("id", "created_at", "prev", F.explode("around").alias("o"))
    hours = (F.unix_micros("created_at") - F.unix_micros("o.created_at")) / F.lit(3_600_000_000.0)
    pairs = pairs.where((hours <= TEMPORAL_HOURS) & ~F.col("o.id").eqNullSafe(F.col("prev"))).withColumn("h", hours)
    out = pairs.select(_both(F.col("o.id"), F.col("id"), weight=1 / (1 + F.col("h")), hours=F.col("h")).alias("e")).select("e.*")
    return out.withColumn("edge_type", F.lit("temporal")).withColumn("sub_type", F.lit("proximity"))


def entity_links(insights: DataFrame, links: int = ENTITY_LINKS, cap: int = ENTITY_EDGES) -> DataFrame:
    """Links to the 5 newest earlier rows that share an entity (case ignored), at most 25 pairs of a row,
    in the order of its entities; weight 1. insights: id, created_at, entities.

    Rows of one entity are windowed together; an entity admitted as known is rare by its
    definition, and a window holds 5 rows at a time.
    """
    each = insights.select("id", "created_at", F.posexplode(F.array_distinct(F.transform("entities", F.lower))).alias("at", "entity"))
    w = W.partitionBy("entity").orderBy("created_at", "id").rowsBetween(-links, -1)
    met = each.withColumn("before", F.collect_list("id").over(w)).select("id", "at", "entity", F.posexplode(F.reverse("before")).alias("nth", "other"))
    met = met.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("at", "nth"))).where(F.col("n") <= cap // 2)
    out = met.select(_both(F.col("other"), F.col("id"), weight=F.lit(1.0), entity=F.col("entity"), n=F.col("n")).alias("e")).select("e.*")
    last = F.row_number().over(W.partitionBy("source_id", "target_id").orderBy(F.desc("n")))  # of one pair the later entity stays
    return out.withColumn("r", last).where("r = 1").drop("r", "n").withColumn("edge_type", F.lit("entity"))


def sub_type(text: Column, prevents=PREVENTS_PHRASES, enables=ENABLES_PHRASES) -> Column:
    return F.when(contains_any(text, prevents), "prevents").when(contains_any(text, enables), "enables").otherwise("causes")


def causal(insights: DataFrame, by: tuple = ("namespace", "source"), phrases=CAUSAL_PHRASES) -> DataFrame:
    """Rows with a causal phrase in either text and enough common tokens among the last 10 of a source.

    insights: id, content, tokens, created_at and the columns of `by`.
    """
    flagged = insights.withColumn("has", contains_any(F.col("content"), phrases))
    w = W.partitionBy(*by).orderBy("created_at", "id").rowsBetween(-CAUSAL_LOOKBACK, -1)
    before = flagged.withColumn("before", F.collect_list(F.struct("id", "content", "tokens", "has")).over(w))
    pairs = before.select("id", "content", "tokens", "has", F.explode("before").alias("o")).where("has or o.has")
    pairs = pairs.withColumn("weight", S.causal_overlap(F.col("tokens"), F.col("o.tokens"))).where(F.col("weight") >= CAUSAL_OVERLAP)
    swap = ~F.col("has")
    return pairs.select(F.when(swap, F.col("id")).otherwise(F.col("o.id")).alias("source_id"), F.when(swap, F.col("o.id")).otherwise(F.col("id")).alias("target_id"), "weight", F.lit("causal").alias("edge_type"), sub_type(F.concat_ws(" ", "content", "o.content")).alias("sub_type"))


def judged_causal(new_id: Column, other_id: Column, relation: Column, weight: Column) -> Column:
    """Edge struct of a judged relation, or null if it is none, invalid or of the row to itself."""
    kind, way = F.regexp_extract(relation, "^(existing|new)_(causes|enables|prevents)_", 2), F.regexp_extract(relation, "^(existing|new)_(causes|enables|prevents)_", 1)
    good = (kind != "") & (weight > 0) & (weight <= 1) & (new_id != other_id)
    first = way == "existing"
    return F.when(good, F.struct(F.when(first, other_id).otherwise(new_id).alias("source_id"), F.when(first, new_id).otherwise(other_id).alias("target_id"), weight.alias("weight"), F.lit("causal").alias("edge_type"), kind.alias("sub_type")))


def semantic(neighbours: DataFrame, least: float) -> DataFrame:
    """Both directions of (query_id, id, cosine) with a cosine of at least `least`; weight is the cosine."""
    out = neighbours.where(F.col("cosine") >= least).select(_both(F.col("query_id"), F.col("id"), weight=F.col("cosine")).alias("e")).select("e.*")
    return out.drop("direction").distinct().withColumn("edge_type", F.lit("semantic"))


def count_by_type(edges: DataFrame, by: tuple = ()) -> DataFrame:
    """A column for each edge type, 0 where there is none."""
    cols = [F.count_if(F.col("edge_type") == t).alias(t) for t in EDGE_TYPES]
    return (edges.groupBy(*by) if by else edges).agg(*cols)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n): edge rows at either end, a row counting once for each end."""
    ends = edges.where("source_id <> target_id").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n"))


def merge_edges(old: DataFrame, new: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Upsert of derived edges: of a batch's rows for one key the last (seq) counts; explicit ones are never overwritten by derived ones.

    Both: source_id, target_id, edge_type, weight, derived, seq. With active (column id), edges with an
    end that is not active, and self links, fall out.
    """
    key = ("source_id", "target_id", "edge_type")
    batch = new.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("seq")))).where("r = 1").drop("r")
    both = old.withColumn("b", F.lit(0)).unionByName(batch.withColumn("b", F.lit(1)))
    if active is not None:
        both = both.where("source_id <> target_id")
        for end in ("source_id", "target_id"):
            both = both.join(active.select(F.col("id").alias(end)), end, "left_semi")
    kept = F.max_by(F.struct("weight", "seq"), F.when(~F.col("derived"), F.lit(2)).otherwise(0) + F.col("b"))
    return both.groupBy(*key).agg(kept.alias("w"), F.bool_and("derived").alias("derived")).select(*key, "w.weight", "derived")
