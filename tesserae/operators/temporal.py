"""Joins on time: intervals by buckets, and the nearest row before or after."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, width_us: int, how_far: int = 1) -> DataFrame:
    """Pairs with equal `by` and |left_ts - right_ts| <= width_us, bounds included; other names must differ.

    An equality join on buckets of the width: the right side stands in its bucket and the `how_far`
    ones beside it, so each pair meets exactly once, in the left row's bucket.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width_us)).cast("bigint")
    a = left.withColumn("__b", bucket(left_ts))
    b = right.withColumn("__b", F.explode(F.sequence(bucket(right_ts) - how_far, bucket(right_ts) + how_far)))
    return a.join(b, [*by, "__b"]).where(F.abs(F.unix_micros(left_ts) - F.unix_micros(right_ts)) <= width_us).drop("__b")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_id: str, out: str, forward: bool = False) -> DataFrame:
    """left with the id of the newest right row at or before its time (forward: the oldest after it).

    One union, one sort and one frame; ties go to the smallest id. Skewed keys are sorted, not
    multiplied.
    """
    cols = left.columns
    row = F.struct(*cols)
    kind = left.select(row.alias("r")).schema["r"].dataType
    both = left.select(*by, F.col(left_ts).alias("__t"), F.lit(None).cast(right.schema[right_id].dataType).alias("__i"), row.alias("__l")).union(right.select(*by, F.col(right_ts).alias("__t"), F.col(right_id).alias("__i"), F.lit(None).cast(kind).alias("__l")))
    w = W.partitionBy(*by).orderBy(F.col("__t").cast("timestamp"))
    hit = F.when(F.col("__i").isNotNull(), F.col("__t"))
    first = F.min("__i").over(W.partitionBy(*by, "__t"))  # of rows of one time the smallest id
    tagged = both.withColumn("__f", F.when(F.col("__i").isNotNull(), F.struct(F.col("__t"), first.alias("i"))))
    if forward:
        frame = W.partitionBy(*by).orderBy(F.unix_micros("__t")).rangeBetween(1, W.unboundedFollowing)
        got = F.min_by("__f", hit).over(frame)
    else:
        got = F.max_by("__f", hit).over(w.rangeBetween(W.unboundedPreceding, 0))
    return tagged.withColumn("__g", got).where("__l is not null").select("__l.*", F.col("__g.i").alias(out))
