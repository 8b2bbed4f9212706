"""The k rows that share most tokens with each query, against plain Python; and what the pairs of documents read for it."""
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import overlap
from tesserae.plans import catalog

DATA = "/root/testdata/sf0.001"


def table():
    """Long, short, empty, copied and tied rows; frequent words and rare ones."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(400):
        n = r.choice((0, 1, 3, 20, 60, 200))
        rows.append((i, sorted({words[min(599, int(r.expovariate(1 / 60)))] for _ in range(n)}), r.choice((None, 1, 2)), r.choice((0, 7))))
    copied = sorted(set(words[100:140]))
    rows += [(400 + i, copied, 1, 3) for i in range(40)]
    rows += [(440, ["alone"], 1, 1), (None, words[:50], 1, 1), (441, words, 2, None)]
    return rows


def want(rows, k):
    out = []
    for q, a, _, _ in rows:
        if q is None:
            continue
        near = [(-len(set(a) & set(b)), -(p if p is not None else -99), -(t if t is not None else -99), i) for i, b, p, t in rows if i not in (None, q) and set(a) & set(b)]
        out += [(q, i, -c, rank) for rank, (c, _, _, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"BLOCK_TOKENS": 2000, "HELD": 16}, {"SEEDS": 0}, {"SEED_TOKENS": 300, "SPARE": 1}])
def test_most_shared(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(overlap, name, value)
    rows = table()
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, importance int, t bigint").select("id", overlap.prints(F.col("tokens")).alias("own"), "importance", F.timestamp_seconds("t").alias("created_at"))
    got = overlap.most_shared(df, df.select(F.col("id").alias("query_id"), "own"), 5)
    assert sorted(map(tuple, got.collect())) == want(rows, 5)


def test_no_queries(spark):
    df = spark.createDataFrame([(1, [5], 1, None)], "id bigint, own array<bigint>, importance int, created_at timestamp")
    assert overlap.most_shared(df, df.limit(0).select(F.col("id").alias("query_id"), "own"), 5).count() == 0
    assert overlap.most_shared(df.limit(0), df.select(F.col("id").alias("query_id"), "own"), 5).count() == 0


@pytest.mark.parametrize("name", ["jaccard_pairs", "near_dups", "judged_pairs", "duplicate_candidates", "jaccard_pairs_all", "near_dups_all"])
def test_pairs_shuffle_neither_tokens_nor_texts(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "content" not in plan and "tokens" not in plan and "text#" not in plan


def two_kinds():
    """Rows of two kinds that have no word in common, one id twice."""
    r = random.Random(3)
    rows = [(i, sorted({f"{'ab'[i % 2]}{min(199, int(r.expovariate(1 / 40)))}" for _ in range(120)}), i % 3, i) for i in range(200)]
    return rows + [(7, rows[9][1], 1, 7)]


def test_blocks_are_of_one_kind(spark, monkeypatch):
    """Each block has queries of one kind: rows of the other are not looked at one by one."""
    made, index = [], overlap._index
    monkeypatch.setattr(overlap, "_index", lambda block: made.append([q % 2 for q in block.column("query_id").to_pylist()]) or index(block))
    df = spark.createDataFrame(two_kinds(), "id bigint, tokens array<string>, importance int, t bigint").select("id", overlap.prints(F.col("tokens")).alias("own"), "importance", F.timestamp_seconds("t").alias("created_at"))
    asked = df.select(F.col("id").alias("query_id"), "own")
    whole = sorted(map(tuple, overlap.most_shared(df, asked, 5).collect()))
    made.clear()
    monkeypatch.setattr(overlap, "BLOCK_TOKENS", 2500)
    assert sorted(map(tuple, overlap.most_shared(df, asked, 5).collect())) == whole
    assert sum(map(len, made)) == 201 and len(made) > 2
    assert sum(len(set(kinds)) > 1 for kinds in made) <= 1
