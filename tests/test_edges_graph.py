"""Edge builders, walks and reports on small inputs, against plain Python."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import edges as E
from tesserae.operators import graph, retrieval
from tesserae.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def test_walk_equals_plain_python(spark):
    rng = random.Random(4)
    nodes = list(range(30))
    raw = {(rng.choice(nodes), rng.choice(nodes), rng.choice(["causal", "temporal", "entity", "semantic"])): round(rng.random(), 1) for _ in range(90)}
    raw = {k: v for k, v in raw.items() if k[0] != k[1]}
    weights, (beam, depth, visited) = graph.INTENT_WEIGHTS["WHY"], graph.TRAVERSAL["WHY"]
    anchors = {3: 1.0, 8: 0.5, 20: 0.5}
    best = dict(anchors)
    seen = {a: {a} for a in anchors}
    front = {a: {a: s} for a, s in anchors.items()}
    for _ in range(depth):
        hop: dict = {}
        for a, rows in front.items():
            if len(seen[a]) >= visited:
                continue
            for (s, t, k), w in raw.items():
                for x, y in ((s, t), (t, s)):
                    if x in rows:
                        score = rows[x] + weights[k] * w
                        best[y] = max(best.get(y, -1), score)
                        hop.setdefault(a, {})[y] = max(hop.get(a, {}).get(y, -1), score)
        front = {}
        for a, rows in hop.items():
            new = sorted(((-s, n) for n, s in rows.items() if n not in seen[a]))[:visited - len(seen[a])]
            seen[a] |= {n for _, n in new}
            front[a] = {n: -s for s, n in new[:beam]}
    a = spark.createDataFrame([(1, n, s, "keyword") for n, s in anchors.items()], "query_id int, id int, score double, via string")
    e = spark.createDataFrame([(*k, w) for k, w in raw.items()], "source_id int, target_id int, edge_type string, weight double")
    q = spark.createDataFrame([(1, "WHY")], "query_id int, intent string")
    got = {r.id: r.score for r in graph.walk(a, e, q).collect()}
    assert got == pytest.approx(best)


def test_causal_order():
    assert graph.causal_order(["b", "a", "l1", "l2"], {"a": 1, "b": 2, "l1": 0.5, "l2": 0.4}, [("a", "b"), ("l1", "l2"), ("l2", "l1")]) == ["a", "b", "l1", "l2"]


def test_entity_links_cap(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), ["X", "y"]) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp, entities array<string>")
    got = {(r.source_id, r.target_id) for r in E.entity_links(df).collect()}
    assert got == {p for i in range(9) for j in range(max(0, i - 5), i) for p in ((i, j), (j, i))}


def test_merge_edges(spark):
    c = "source_id int, target_id int, edge_type string, weight double, derived boolean, seq int"
    old = spark.createDataFrame([(1, 2, "causal", 0.1, False, 1), (1, 3, "causal", 0.2, True, 2)], c)
    new = spark.createDataFrame([(1, 2, "causal", 0.9, True, 3), (1, 3, "causal", 0.5, True, 4), (1, 3, "causal", 0.6, True, 5), (2, 3, "causal", 0.7, False, 6)], c)
    assert sorted(tuple(r) for r in E.merge_edges(old, new).collect()) == [(1, 2, "causal", 0.1, False), (1, 3, "causal", 0.6, True), (2, 3, "causal", 0.7, False)]


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 3)
    rng = random.Random(1)
    vs = [(i, [rng.random() - 0.5 for _ in range(4)]) for i in range(40)] + [(99, None)]
    v = spark.createDataFrame(vs, "id int, embedding array<double>")
    q = v.where("id < 8").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.knn(v, q, 3, exclude_self=True).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i in range(8):
        want = sorted((-cos(vs[i][1], x), j) for j, x in vs[:40] if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in want]


def test_search_without_tokens_is_by_id(spark):
    d = spark.createDataFrame([(2, ["a"]), (1, ["b"])], "id int, tokens array<string>")
    q = spark.createDataFrame([(1, [])], "query_id int, tokens array<string>")
    fts = spark.createDataFrame([(1, 2, 0.9), (1, 1, 0.1)], "query_id int, id int, rank_cd double")
    got = retrieval.search(d, q, 5, fts).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[1].score > got[0].score and got[0].via == "fts"


def test_reports(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    log = spark.createDataFrame([("recall", "u", at(0)), ("recall", "u", at(10)), ("link", "u", at(50)), ("recall", "u", at(70))], "operation string, user_id string, created_at timestamp")
    assert sorted((r.operation, r.n) for r in ingest.operations_per_window(log).collect()) == [("link", 1), ("recall", 1), ("recall", 2)]
    assert sorted(r.n for r in ingest.sessions(log).collect()) == [2, 2]
