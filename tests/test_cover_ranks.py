"""Ranks straight from the text against those from stored stems; the full-text query stores no stems."""
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.plans import catalog


def test_ranks_of_texts(spark):
    texts = [None, "", "deploy", "The deploy of the checkout service failed, deploys fail", "fail " * 50 + "deployed", "failed x y z deploying and failing", "Überall fails_deploys 42"]
    queries = [(1, ["deploi", "fail"]), (2, ["fail"]), (3, []), (4, ["absent"]), (5, ["42", "fail"])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r.q): r.k for r in df.select("id", F.explode(T.cover_ranks(F.col("t"), queries)).alias("r")).select("id", F.col("r.query_id").alias("q"), F.col("r.rank_cd").alias("k")).collect()}
    want = {}
    for q, stems in queries:
        for r in df.select("id", T.cover_density(T.stems(F.col("t")), stems).alias("k")).where("k is not null").collect():
            want[r.id, q] = r.k
    assert got == want and len(want) > 6


def test_query_stores_no_stems(spark):
    plan = catalog.QUERIES["search_fts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and plan.count("cover") + plan.count("run(") == 1
