"""Anchors of queries with sources: as many as there are, each with its own rows alone, by the scan and by the join."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import retrieval


@pytest.mark.parametrize("in_scan", [0, 10**6])
def test_each_source_has_its_anchors(spark, monkeypatch, in_scan):
    monkeypatch.setattr(retrieval, "IN_SCAN", in_scan)
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 7)  # several blocks, and sides too large to broadcast
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, f"s{i % 20}", rng.sample(words, 4), t0 + dt.timedelta(minutes=rng.randrange(500)), [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    asked = [(q, rng.sample(words, 3), None if q % 5 == 0 else f"s{q % 22}", [rng.gauss(0, 1) for _ in range(4)]) for q in range(30)]
    df = spark.createDataFrame(rows, "id int, source string, tokens array<string>, created_at timestamp, embedding array<double>")
    qs = spark.createDataFrame(asked, "query_id int, tokens array<string>, source string, vector array<double>")
    got = {(r.query_id, r.id): r.score for r in retrieval.anchors(df, qs, 5, vectors=True).collect()}

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    want: dict = {}
    for q, tokens, source, vector in asked:
        own = [r for r in rows if source is None or r[1] == source]
        lists = [sorted(((-len({*tokens} & {*r[2]}), r[0]) for r in own if {*tokens} & {*r[2]}))[:5], sorted((-r[3].timestamp(), r[0]) for r in own)[:5], sorted((-c, r[0]) for r in own if (c := cosine(vector, r[4])) > 0.1)[:5]]
        raw: dict = {}
        for found in lists:
            for rank, (_, i) in enumerate(found, 1):
                raw[i] = raw.get(i, 0) + 1 / (60 + rank)
        want |= {(q, i): x / max(raw.values()) for i, x in raw.items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert retrieval.anchors(df, qs.where(F.col("source") == "none")).count() == 0
