"""Keyword, full-text, vector and recency retrieval for batches of queries, and their fusion.

Queries come as a frame keyed by query_id. A few queries are scored in the scan of the insights, as one
broadcast row; more are joined by token, their side broadcast if it is counted to be small. Vector
queries go in blocks of MAX_QUERIES, each of which meets all rows. Ranks are cut to k in each task before
anything is shuffled. The insights' side is never collected.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.constants import ANCHORS, RRF_K, SEARCH_FTS, SEARCH_KEYWORD, VECTOR_ANCHOR_MIN

MAX_QUERIES = 4096
#: Queries, and tokens of them all, that are scored in the scan.
IN_SCAN, SCAN_TOKENS = 8, 400


def sized(small: DataFrame, rows: int = MAX_QUERIES) -> DataFrame:
    """Broadcast what has at most so many rows; leave the rest to the planner."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def keyword_scores(insights: DataFrame, queries: DataFrame, carry: tuple = ()) -> DataFrame:
    """(query_id, id, keyword): share of a query's tokens that a row holds, where not 0; and the carried columns of insights.

    insights: id, tokens; queries: query_id, tokens (sets). If queries have a `source` that is not
    null, only rows of that source count. In the scan nothing is shuffled; by the join, tokens of
    rows meet those of queries before the counts are shuffled.
    """
    by_source = "source" in queries.columns
    q = queries.select("query_id", "tokens", *(["source"] if by_source else [])).where(F.size("tokens") > 0)
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("t")).first()
    if size.n <= IN_SCAN and (size.t or 0) <= SCAN_TOKENS:
        block = q.agg(F.collect_list(F.struct(*q.columns)).alias("qs"))  # one row of bounded size
        own = F.array_distinct("tokens")
        rows = insights.select("id", *carry, own.alias("own"), *([F.col("source").alias("s")] if by_source else [])).join(F.broadcast(block))
        hit = F.transform("qs", lambda x: F.struct(x["query_id"].alias("query_id"), (F.size(F.array_intersect("own", x["tokens"])) / F.size(x["tokens"])).alias("keyword"), *([(x["source"].isNull() | (x["source"] == F.col("s"))).alias("fits")] if by_source else [])))
        met = rows.select("id", *carry, F.explode(F.filter(hit, lambda h: (h["keyword"] > 0) & h["fits"] if by_source else h["keyword"] > 0)).alias("h"))
        return met.select("h.query_id", "id", "h.keyword", *carry)
    each = q.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"), *([F.col("source").alias("qs")] if by_source else []))
    hit = insights.select("id", *carry, *(["source"] if by_source and "source" not in carry else []), F.explode(F.array_distinct("tokens")).alias("token")).join(sized(each, 64 * MAX_QUERIES), "token")
    if by_source:
        hit = hit.where(F.col("qs").isNull() | (F.col("qs") == F.col("source")))
    count = hit.groupBy("query_id", "id", "n").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in carry))
    return count.select("query_id", "id", (F.col("c") / F.col("n")).alias("keyword"), *carry)


def ranked(df: DataFrame, order: list, limit: int, column: str = "rank", by: tuple = ("query_id",)) -> DataFrame:
    """The first `limit` rows of each query, numbered from 1."""
    return df.withColumn(column, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(column) <= limit)


def keyword_topk(insights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """By score, importance, newness and id. insights: id, tokens, importance, created_at."""
    scored = keyword_scores(insights, queries, ("importance", "created_at"))
    return ranked(scored, [F.desc("keyword"), F.desc("importance"), F.desc("created_at"), "id"], k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, min_cosine: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank): exactly the k nearest by cosine, ids ascending among equals.

    vectors: id, embedding; queries: query_id, vector. Where both have a `source`, a query with one
    meets rows of that source only; where both have a `seq`, a query meets rows of a smaller one only.
    Every task scores its rows against a whole block of queries by one matrix product and keeps k of
    each query, so only tasks * queries * k rows are shuffled. Null vectors take no part; unequal
    lengths and zero norms have cosine 0.
    """
    spark = vectors.sparkSession
    more = [c for c in ("source", "seq") if c in vectors.columns and c in queries.columns]
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, cosine double"
    asked = queries.where("vector is not null").select("query_id", "vector", *more)
    n = -(-asked.count() // MAX_QUERIES)
    found = None
    for block in range(n):
        rows = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)).collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])  # about MAX_QUERIES queries
        part = vectors.where("embedding is not null").select("id", "embedding", *more).mapInPandas(_nearest(sent, k, min_cosine, exclude_self, more), out)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], out + ", rank int")
    return ranked(found, [F.desc("cosine"), "id"], k)


def _nearest(sent, k: int, min_cosine: float | None, exclude_self: bool, more: list[str]):
    def run(batches):
        import pandas as pd

        rows = sent.value
        names = np.array([r[0] for r in rows], dtype=object)
        asked: dict[int, tuple] = {}
        for d in {len(r[1]) for r in rows}:
            at = [j for j, r in enumerate(rows) if len(r[1]) == d]
            q = np.array([[0.0 if x is None else x for x in rows[j][1]] for j in at], float).reshape(len(at), d)
            asked[d] = (np.array(at), q, np.sqrt((q * q).sum(1)))
        bound = {c: np.array([r[2 + i] for r in rows], dtype=object) for i, c in enumerate(more)}
        best: list[list] = [[] for _ in rows]
        for pdf in batches:
            size = pdf.embedding.map(len).to_numpy()
            for d in np.unique(size).tolist():
                own = pdf[size == d]
                x = np.array(own.embedding.tolist(), float).reshape(len(own), d)
                ids, norm = own.id.to_numpy(), np.sqrt((x * x).sum(1))
                for e, (at, q, length) in asked.items():
                    if e == d and d:
                        with np.errstate(all="ignore"):
                            both = np.outer(length, norm)
                            near = np.where(both > 0, (q @ x.T) / both, 0.0)
                        near = np.where(np.isfinite(near), near, 0.0)
                    else:
                        near = np.zeros((len(at), len(own)))
                    for c in more:
                        mine, theirs = bound[c][at], own[c].to_numpy()
                        fits = np.equal(mine, None)[:, None] | (mine[:, None] == theirs[None]) if c == "source" else theirs[None] < mine[:, None]
                        near = np.where(fits.astype(bool), near, -np.inf)
                    if exclude_self:
                        near = np.where(names[at][:, None] == ids[None].astype(object), -np.inf, near)
                    top = min(k, near.shape[1])
                    edge = -np.partition(-near, top - 1, axis=1)[:, top - 1]
                    for j, i in enumerate(at.tolist()):
                        some = np.flatnonzero((near[j] >= edge[j] - 1e-9) & (near[j] > -np.inf))  # products may part equals by rounding
                        c = near[j][some]
                        if e == d and d:
                            with np.errstate(all="ignore"):
                                c = (x[some] * q[j]).sum(1) / (norm[some] * length[j])
                            c = np.where(np.isfinite(c), c, 0.0)
                        if min_cosine is not None:
                            some, c = some[c > min_cosine], c[c > min_cosine]
                        best[i] = sorted([*best[i], *zip((-c).tolist(), ids[some].tolist())])[:k]
        yield pd.DataFrame([(names[j], i, -c) for j, b in enumerate(best) for c, i in b], columns=["query_id", "id", "cosine"])

    return run


def recency(insights: DataFrame, queries: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(query_id, id, rank): the newest rows, ids ascending among equals; those of a query's `source` if it has one."""
    newest = insights.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(k)
    newest = newest.withColumn("rank", F.row_number().over(W.orderBy(F.desc("created_at"), "id"))).select("id", "rank")  # k rows
    if "source" not in queries.columns:
        return newest.crossJoin(sized(queries.select("query_id")))
    free = newest.crossJoin(sized(queries.where("source is null").select("query_id")))
    named = queries.where("source is not null").select("query_id", "source")
    own = insights.select("id", "created_at", "source").join(sized(named.select("source").distinct()), "source", "left_semi")
    own = ranked(own, [F.desc("created_at"), "id"], k, by=("source",)).select("source", "id", "rank")
    return free.unionByName(own.join(named, "source").select("id", "rank", "query_id"))


def anchors(insights: DataFrame, queries: DataFrame, k: int = ANCHORS, vectors: bool = False) -> DataFrame:
    """Reciprocal-rank fusion of the keyword, vector and recency lists.

    (query_id, id, score, via, signals): score is the sum of 1 / (60 + rank) over a query's lists,
    divided by its maximum; via is the one signal, or hybrid. A query with a `source` sees that
    source's rows only, however many sources there are.
    """
    lists = [ranked(keyword_scores(insights, queries), [F.desc("keyword"), "id"], k).select("query_id", "id", "rank", F.lit("keyword").alias("signal")),
             recency(insights, queries, k).select("query_id", "id", "rank", F.lit("recency").alias("signal"))]
    if vectors:
        cols = ["id", "embedding"] + (["source"] if "source" in queries.columns else [])
        lists.append(knn(insights.select(*cols), queries, k, VECTOR_ANCHOR_MIN).select("query_id", "id", "rank", F.lit("vector").alias("signal")))
    return fuse(lists)


def fuse(lists: list[DataFrame]) -> DataFrame:
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    raw = union.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("raw"), F.array_sort(F.collect_set("signal")).alias("signals"))
    top = F.max("raw").over(W.partitionBy("query_id"))
    return raw.select("query_id", "id", (F.col("raw") / top).alias("score"), F.when(F.size("signals") > 1, "hybrid").otherwise(F.col("signals")[0]).alias("via"), "signals")


def search(insights: DataFrame, queries: DataFrame, k: int, fts: DataFrame | None = None) -> DataFrame:
    """0.45 keyword + 0.55 full text, null scores last, ids ascending. fts: query_id, id, rank_cd.

    A query without keyword tokens has no keyword score, so its order is by id alone.
    """
    kw = keyword_scores(insights, queries)
    sizes = queries.select("query_id", F.size("tokens").alias("n"))
    both = kw if fts is None else kw.join(fts, ["query_id", "id"], "full")
    both = both.join(sized(sizes), "query_id")
    f = F.coalesce(F.col("rank_cd"), F.lit(0.0)) if fts is not None else F.lit(0.0)
    key = F.when(F.col("n") > 0, SEARCH_KEYWORD * F.coalesce("keyword", F.lit(0.0)) + SEARCH_FTS * f)
    via = F.when((F.coalesce("keyword", F.lit(0.0)) > 0) & (f > 0), "hybrid").when(f > 0, "fts").otherwise("keyword")
    out = both.select("query_id", "id", key.alias("key"), F.coalesce(key, SEARCH_FTS * f).alias("score"), via.alias("via"))
    return ranked(out, [F.desc_nulls_last("key"), "id"], k).drop("key")
