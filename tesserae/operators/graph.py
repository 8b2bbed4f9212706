"""Bounded walks over an edge table, for batches of queries.

A walk is a loop of at most five jobs on the driver; what it carries are frames, whose lineage each
hop cuts by a written table. Frontiers are bounded by beam and anchors, so the edge table is the only
large side of a hop, and it is read by an equality join on one column.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.constants import INTENT_WEIGHTS, LAMBDA_EDGE, LAMBDA_VECTOR, MAX_CANDIDATES, TRAVERSAL
from tesserae.functions.scoring import intent_weight
from tesserae.functions.similarity import cosine
from tesserae.operators.retrieval import sized
from tesserae.plans.session import settle


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, edge_type, weight) for both ends of each edge, read once."""
    cols = [F.col(c) for c in edges.columns if c not in ("source_id", "target_id")]
    ways = F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"))))
    return edges.select(ways.alias("w"), *cols).select("w.*", *cols)


def walk(anchors: DataFrame, edges: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(query_id, id, score, via): best scores over a beam walk from every anchor.

    anchors: query_id, id, score, via; queries: query_id, intent (and vector, if vectors: id,
    embedding are given). Scores of all rows of a hop count for `best`, even those of seen nodes; a
    node that a beam cuts stays seen by that anchor.
    """
    both = undirected(edges.select("source_id", "target_id", "edge_type", "weight"))
    limit = lambda i: F.coalesce(*[F.when(F.col("intent") == n, F.lit(t[i])) for n, t in TRAVERSAL.items()])
    q = queries.select("query_id", "intent", limit(0).alias("beam"), limit(1).alias("depth"), limit(2).alias("visited"), *(["vector"] if vectors is not None else []))
    q, asked = sized(q), sized(q.select("query_id", "vector")) if vectors is not None else None
    best = settle(anchors.select("query_id", "id", "score", "via"))
    frontier = best.select("query_id", F.col("id").alias("anchor"), "id", "score").join(q, "query_id")
    seen = frontier.select("query_id", "anchor", "id")
    deepest = queries.agg(F.max(limit(1))).first()[0] or 0
    for hop in range(deepest):
        live = frontier.where(F.col("depth") > hop)
        rows = live.join(both, live.id == both.a).select("query_id", "anchor", F.col("b").alias("id"), "edge_type", (F.col("score") + LAMBDA_EDGE * intent_weight(F.col("intent"), F.col("edge_type")) * F.col("weight")).alias("score"))
        if vectors is not None:
            rows = rows.join(vectors.select("id", "embedding"), "id", "left").join(asked, "query_id")
            near = F.when(F.col("embedding").isNotNull() & F.col("vector").isNotNull(), F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("vector")))).otherwise(0.0)
            rows = rows.withColumn("score", F.col("score") + LAMBDA_VECTOR * near).drop("embedding", "vector")
        rows = settle(rows)
        if rows.isEmpty():
            break
        top = rows.groupBy("query_id", "id").agg(F.min_by(F.struct("score", "edge_type"), F.struct(-F.col("score"), "anchor", "edge_type")).alias("t"))
        old = best.alias("old")
        joined = old.join(top.alias("new"), ["query_id", "id"], "full")
        better = F.col("t.score") > F.coalesce(F.col("old.score"), F.lit(float("-inf")))
        best = settle(joined.select("query_id", "id", F.when(better, F.col("t.score")).otherwise(F.col("old.score")).alias("score"), F.when(better, F.col("t.edge_type")).otherwise(F.col("old.via")).alias("via")))
        if hop + 1 == deepest:  # nothing is walked from here
            break
        fresh = rows.groupBy("query_id", "anchor", "id").agg(F.max("score").alias("score")).join(seen, ["query_id", "anchor", "id"], "left_anti")
        counted = seen.groupBy("query_id", "anchor").agg(F.count("*").alias("n"))
        order = W.partitionBy("query_id", "anchor").orderBy(F.desc("score"), "id")
        fresh = fresh.withColumn("r", F.row_number().over(order)).join(counted, ["query_id", "anchor"]).join(q, "query_id")
        fresh = settle(fresh.where(F.col("r") <= F.col("visited") - F.col("n")))
        seen = seen.union(fresh.select("query_id", "anchor", "id"))
        full = seen.groupBy("query_id", "anchor").agg(F.count("*").alias("m"))
        frontier = fresh.where(F.col("r") <= F.col("beam")).join(full, ["query_id", "anchor"]).where(F.col("m") < F.col("visited")).select("query_id", "anchor", "id", "score", *q.columns[1:])
    return best.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= max_candidates).drop("r")


def related(start: DataFrame, edges: DataFrame, depth: int, limit: int, edge_type: str | None = None) -> DataFrame:
    """(query_id, id, depth, weight, edge_type): breadth first from each start (query_id, id).

    Of several edges to a neighbour in a hop the one of least (created_at, edge_seq) counts; a hop
    keeps what is left of the limit by weight, then id. edges: source_id, target_id, edge_type,
    weight, created_at, edge_seq.
    """
    both = undirected(edges if edge_type is None else edges.where(F.col("edge_type") == edge_type))
    front = settle(start.select("query_id", "id"))
    seen, found = front, None
    for hop in range(1, depth + 1):
        met = front.join(both, front.id == both.a).select("query_id", F.col("b").alias("id"), "edge_type", "weight", "created_at", "edge_seq").join(seen, ["query_id", "id"], "left_anti")
        first = met.groupBy("query_id", "id").agg(F.min_by(F.struct("weight", "edge_type"), F.struct("created_at", "edge_seq")).alias("e")).select("query_id", "id", F.lit(hop).alias("depth"), "e.weight", "e.edge_type")
        used = (found.groupBy("query_id").agg(F.count("*").alias("used")) if found is not None else start.select("query_id", F.lit(0).cast("bigint").alias("used")).distinct())
        new = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "id"))).join(used, "query_id", "left").where(F.col("r") <= limit - F.coalesce("used", F.lit(0))).drop("r", "used")
        new = settle(new)
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
        front = new.select("query_id", "id")
        seen = seen.union(front)
    if found is None:
        return start.select("query_id", "id", F.lit(0).alias("depth"), F.lit(0.0).alias("weight"), F.lit("").alias("edge_type")).limit(0)
    return found


def causal_order(ids: list, scores: dict, edges: list[tuple]) -> list:
    """ids with causes before effects. Of those whose causes are all placed the one with the highest score
    comes next, then the least id; what is left on cycles keeps the order in which it came."""
    effects: dict = {i: set() for i in ids}
    for s, t in edges:
        if s in effects and t in effects and s != t:
            effects[s].add(t)
    open_ = dict.fromkeys(ids, 0)
    for ts in effects.values():
        for t in ts:
            open_[t] += 1
    queue = [(-scores[i], i) for i, n in open_.items() if n == 0]
    heapq.heapify(queue)
    place: dict = {}
    while queue:
        i = heapq.heappop(queue)[1]
        place[i] = len(place)
        for t in effects[i]:
            open_[t] -= 1
            if open_[t] == 0:
                heapq.heappush(queue, (-scores[t], t))
    return sorted(ids, key=lambda i: place.get(i, len(ids)))


def topological(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits (query_id, id, score and, if they are ordered otherwise than by score and id, place) with a place
    by causal_order within each query; a query has at most 100 hits."""
    causal = edges.where("edge_type = 'causal'").select("source_id", "target_id")
    pairs = hits.select("query_id", F.col("id").alias("source_id")).join(causal, "source_id").join(hits.select("query_id", F.col("id").alias("target_id")), ["query_id", "target_id"])
    links = pairs.groupBy("query_id").agg(F.collect_set(F.struct("source_id", "target_id")).alias("links"))
    order = ["place"] if "place" in hits.columns else ["score", "id"]
    base = hits.select("query_id", "id", "score", *(c for c in order if c == "place")).join(links, "query_id", "left")
    schema = f"query_id {hits.schema['query_id'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, place int"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, ascending=[True] if order == ["place"] else [False, True])
        got = pdf.links.iloc[0]
        pairs = [(r["source_id"], r["target_id"]) for r in got] if got is not None else []
        ids = causal_order(pdf.id.tolist(), dict(zip(pdf.id, pdf.score)), pairs)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "id": ids, "place": range(1, len(ids) + 1)})

    return base.groupBy("query_id").applyInPandas(run, schema)


assert set(INTENT_WEIGHTS) == set(TRAVERSAL)
