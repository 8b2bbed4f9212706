"""Nearest neighbours by a forest of random-projection trees.

Each tree cuts space by random directions at the medians of a bounded sample; there are as many levels
as leave LEAF vectors of the table in a leaf, or of the sample if that is less. Every vector is put in
its leaf of every tree. A query searches all trees through one priority queue ordered by the summed
squares of the distances to the cuts that were not followed, and takes leaves until they hold a share
of all distinct vectors; vectors of these leaves are ranked exactly, in double precision.

That share is measured, not set: for ASKED vectors of the sample it is found how far the queue must be
followed for each of their true neighbours, and the share is taken that finds TARGET of them. Where
vectors have structure it is small; vectors without any need nearly half (see the README). The same
share of a larger table finds more, as neighbours there are nearer.

The trees cut by distance, while the greatest inner product is asked for. Vectors are therefore placed
with one coordinate more, the root of what their squared norm lacks to that of the longest; queries
have zero there and the longest one's norm. Nearness then follows the inner product. The longest LONG
of the vectors are one leaf more, which every query visits; there is none where norms are equal.

Equal vectors are one entry with the least of their ids (as many as could be asked for), so that a
vector that is very common costs no more than a rare one. Leaves are stored as packs of at most PACK
vectors and visited by blocks of at most BLOCK queries; packs of a leaf are dealt to up to GROUPS tasks.
Each meeting of a pack and a block is one matrix product and puts out the nearest of each query only,
so no pair of vectors is ever a row of its own.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship

TREES, LEAF, SAMPLE, PACK, BLOCK, GROUPS = 16, 32, 16_384, 1024, 512, 16
#: Share of the true neighbours to be found, vectors of the sample that are asked for it, and the greatest share that is tried before all.
TARGET, ASKED, MOST = 0.95, 128, 0.85
LONG = 1 / 8


@dataclass
class Forest:
    """normals: (trees, nodes, dims) of unit length; cuts: (trees, nodes); nodes in breadth-first order."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    @staticmethod
    def fit(x: np.ndarray, trees: int = TREES, depth: int = 9, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        depth = max(0, min(depth, int(np.log2(max(1, len(x))))))
        nodes = 2**depth - 1
        normals = rng.standard_normal((trees, nodes, x.shape[1]))
        normals /= np.linalg.norm(normals, axis=2, keepdims=True) + 1e-300
        cuts = np.zeros((trees, nodes))
        for t in range(trees):
            members = [np.arange(len(x))]
            for k in range(nodes):
                own = members[k]
                p = x[own] @ normals[t, k]
                cuts[t, k] = np.median(p) if len(own) else 0.0
                members += [own[p < cuts[t, k]], own[p >= cuts[t, k]]]
        return Forest(normals, cuts, depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf numbers."""
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int, float]]:
        """(tree, leaf, share) in the order of the shared queue, until the leaves may hold `enough` of the different
        vectors; share is what those before it may hold.

        Trees are independent cuts, so leaves that hold shares s of everything are taken to hold
        1 - prod(1 - s) of it together.
        """
        inner, total = 2**self.depth - 1, max(1, int(sizes[0].sum()))
        margin = ((self.normals @ q - self.cuts)).tolist()
        queue, out, missing = [(0.0, t, 0) for t in range(len(self.cuts))], [], 1.0
        held, size = [0.0] * len(self.cuts), (sizes / total).tolist()
        while queue and missing > 1 - enough:
            far, t, node = heapq.heappop(queue)
            own = margin[t]
            while node < inner:
                d = own[node]
                near, other = (2 * node + 2, 2 * node + 1) if d >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (far + d * d, t, other))
                node = near
            leaf = node - inner
            if size[t][leaf]:
                out.append((t, leaf, 1 - missing))
                was, held[t] = 1 - held[t], held[t] + size[t][leaf]
                missing = missing * max(0.0, 1 - held[t]) / was if was > 0 else 0.0
        return out

    def share(self, placed: np.ndarray, always: np.ndarray, k: int, target: float = TARGET) -> float:
        """The share that finds `target` of the k nearest of ASKED of these vectors; `always` tells those that every query meets."""
        n = len(placed)
        if n < 2:
            return 1.0
        at = self.leaves(placed)
        sizes = np.stack([np.bincount(c, minlength=2**self.depth) for c in at.T])
        need = []
        plain = placed[:, :-1]
        for i in np.unique(np.linspace(0, n - 1, min(ASKED, n)).astype(int)).tolist():
            q = plain[i]
            if not q.any():
                continue
            score = plain @ q
            score[i] = -np.inf
            best = np.argsort(-score, kind="stable")[:min(k, n - 1)]
            first = np.full((len(self.cuts), 2**self.depth), np.inf)
            for t, leaf, share in self.search(_asked(q[None])[0], sizes, MOST):
                first[t, leaf] = share
            found = first[np.arange(len(self.cuts)), at[best]].min(axis=1)
            need += np.where(always[best], 0.0, found).tolist()
        need = np.sort(need)
        if not len(need):
            return 1.0
        worst = float(need[min(len(need) - 1, int(np.ceil(target * len(need))))])
        return worst + 1e-9 if np.isfinite(worst) else 1.0


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _placed(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors, scaled by the longest norm, with the coordinate that makes all of length one."""
    x = x / longest
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]


def _asked(x: np.ndarray) -> np.ndarray:
    """Queries of length one, with zero as the last coordinate."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]


def _bytes(x: np.ndarray, kind: str) -> list[bytes]:
    """Rows as bytes; kind is that of the column, so single precision stays single, exactly."""
    return [r.tobytes() for r in np.ascontiguousarray(x.astype(kind))]


def clean(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector that is neither null nor zero and has finite components only."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    out = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    return out if dims is None else out.where(F.size("v") == dims)


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, target: float = TARGET, sample: int = SAMPLE, pack: int = PACK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each query.

    is_query is a condition on the column id. Nearness is the inner product in double precision;
    ties go to the smaller vec_id. Rows of the query's own id are no candidates. Ids that are null
    and vectors that are null, zero, or hold null or non-finite components take no part, nor do
    vectors of another length than the commonest (the greater, of equally common ones). Rows that
    repeat a query's id and vector are one query; an id with several vectors is asked for each and
    keeps the best k of all. Fewer candidates than k are all returned. An empty table gives an
    empty result. The trees are fitted on about `sample` vectors, those with a hash under a bound;
    every row is indexed.
    """
    spark = df.sparkSession
    ship(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    kind = "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    base = clean(df, id_col, vec_col)
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.d
    base = base.where(F.size("v") == dims)
    # the least k + 1 ids of each distinct vector: first within parts of it, then of what these leave
    least = lambda part: F.row_number().over(part.orderBy("id"))
    from pyspark.sql import Window as W

    few = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    few = few.withColumn("r", least(W.partitionBy("v", "salt"))).where(F.col("r") <= k + 1).select("id", "v")
    few = few.withColumn("r", least(W.partitionBy("v"))).where(F.col("r") <= k + 1)
    entries = checkpoint(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "v"))
    n = entries.count()
    bound = min(1.0, sample / n) * 2.0**32
    picked = entries.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 32)) < F.lit(bound)).select("v").collect()  # about `sample` vectors
    picked = sorted(r.v for r in picked)
    peak = F.array_max(F.transform("v", F.abs))
    norm = peak * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))
    longest = entries.agg(F.max(norm)).first()[0]
    vectors = _placed(np.array(picked).reshape(len(picked), dims), longest)
    norms = np.linalg.norm(vectors[:, :-1], axis=1)
    long = float(np.quantile(norms, 1 - LONG)) * (1 + 1e-6) if len(norms) else 0.0
    forest = Forest.fit(vectors, trees, int(np.log2(max(1, min(n, len(vectors)) / LEAF))))
    enough = forest.share(vectors, norms > long, k, target)
    sent = spark.sparkContext.broadcast(forest)  # trees * 2^depth * dims numbers; the depth is bounded by the sample
    leaves = 2**forest.depth

    def place(batches):
        f = sent.value
        for b in batches:
            x = _matrix(b.column("v"))
            at = f.leaves(_placed(x, longest))
            slots = np.c_[at + np.arange(trees) * leaves, np.full(len(at), trees * leaves)].astype(np.int32)
            taken = np.ones(slots.shape, bool)
            taken[:, -1] = np.linalg.norm(x / longest, axis=1) > long
            slots, ends = slots[taken], np.r_[0, np.cumsum(taken.sum(axis=1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("ids"), pa.array(_bytes(x, kind), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(slots))], names=["ids", "v", "slots"])

    placed = checkpoint(entries.mapInArrow(place, "ids array<bigint>, v binary, slots array<int>"))
    sizes = np.zeros(trees * leaves + 1, np.int64)
    for r in placed.select(F.explode("slots").alias("s")).groupBy("s").count().collect():  # a row for each leaf
        sizes[r.s] = r["count"]
    last = [trees * leaves] if sizes[-1] else []
    many = F.get(F.split(F.lit(",".join(str(-(-c // pack) or 1) for c in sizes.tolist())), ","), F.col("s")).cast("int")  # packs of a leaf
    in_leaf = placed.select("ids", "v", F.explode("slots").alias("s"))
    sizes = sizes[:-1].reshape(trees, leaves)
    packs = in_leaf.groupBy("s", F.pmod(F.xxhash64("v"), many).alias("p")).agg(F.collect_list(F.struct("ids", "v")).alias("rows")).withColumn("g", F.col("p") % GROUPS)

    def visit(batches):
        f = sent.value
        for b in batches:
            x = _matrix(b.column("v"))
            slots = [last + [t * leaves + leaf for t, leaf, _ in f.search(q, sizes, enough)] for q in _asked(x)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_bytes(x, kind), pa.binary()), pa.array(slots, pa.list_(pa.int32()))], names=["id", "v", "slots"])

    queries = checkpoint(base.where(is_query).distinct())
    n_blocks = -(-queries.count() // BLOCK) or 1
    asked = queries.mapInArrow(visit, "id bigint, v binary, slots array<int>").select("id", "v", F.explode("slots").alias("s"))
    blocks = asked.groupBy("s", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("asks"))
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.least(many, F.lit(GROUPS)) - 1)))

    def rank(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, asks = b.column("rows")[i].values, b.column("asks")[i].values
                x = np.frombuffer(b"".join(rows.field("v").to_pylist()), kind).astype(np.float64).reshape(len(rows), dims)
                q = np.frombuffer(b"".join(asks.field("v").to_pylist()), kind).astype(np.float64).reshape(len(asks), dims)
                ids, own = rows.field("ids").to_pylist(), asks.field("id").to_pylist()
                score = np.einsum("qd,xd->qx", q, x, optimize=True)
                top = min(k + 1, len(x))
                edge = -np.partition(-score, top - 1, axis=1)[:, top - 1]
                out: list[tuple] = []
                wide, size = np.linalg.norm(x, axis=1).max(), np.linalg.norm(q, axis=1)
                for j, mine in enumerate(own):
                    # a rounding error may part scores that are equal once summed alike: keep what is near the edge
                    near = np.flatnonzero(score[j] >= edge[j] - 1e-12 * dims * wide * size[j])
                    exact = (x[near] * q[j]).sum(axis=1)
                    best = sorted(((-s, d) for s, r in zip(exact.tolist(), near.tolist()) for d in ids[r] if d != mine))[:k]
                    out.append((mine, [d for _, d in best], [-s for s, _ in best]))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    found = packs.join(blocks, ["s", "g"]).select("rows", "asks").mapInArrow(rank, "query_id bigint, ids array<bigint>, scores array<double>")

    def merge(t: pa.Table) -> pa.Table:
        ids, scores = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "scores"))
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        keep = np.sort(first)[:k]
        return pa.table({"query_id": pa.array([t.column("query_id")[0].as_py()] * len(keep), pa.int64()), "rank": pa.array(np.arange(1, len(keep) + 1, dtype=np.int32)), "vec_id": pa.array(ids[keep]), "score": pa.array(scores[keep])})

    return found.groupBy("query_id").applyInArrow(merge, schema)
