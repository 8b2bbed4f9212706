"""A filter comes to the driver in few jobs, however many shuffle partitions the session has."""
from pyspark.sql import functions as F

from tesserae.llm import url_filter


def test_filter_of_few_keys_is_few_jobs(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    keys = spark.range(500).select(F.concat(F.lit("host"), "id").alias("k"))
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("filter", "filter")
        bits, _, words = url_filter._filter(keys, 0, 500, 1 / 64)
        jobs = len(sc.statusTracker().getJobIdsForGroup("filter"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(words) == bits // 64 and words.any()
    assert jobs <= 4
