"""Nearest earlier row, as an equi-join on buckets of the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_at(left: DataFrame, right: DataFrame, at: str, frame: str, within: int) -> DataFrame:
    """Each row of left with the last frame of right that isn't after it and less than within before it.

    Right rows lie in the bucket of their frame and in the next, so that one equality finds all that can match.
    """
    names = {c: f"l{i}" for i, c in enumerate(left.columns)}  # so that no column can clash
    own, asked = left.toDF(*names.values()), F.col(names[at])
    bucket = F.floor(F.col(frame) / within).cast("bigint")
    spread = right.select(F.col(frame).alias("r"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    best = own.withColumn("bucket", F.floor(asked / within).cast("bigint")).join(spread, "bucket").where((F.col("r") <= asked) & (F.col("r") > asked - within))
    return best.groupBy(*names.values()).agg(F.max("r").alias("r")).toDF(*left.columns, frame)
