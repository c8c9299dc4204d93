"""Masks by run and by frame: which of them a region uses, which of a run's is best, and what the stored ones take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_masks(regions: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Regions with the mask of their run, as keys say (such as clip_id, run and the box); regions without one go."""
    return regions.join(masks, keys)


def ready(regions: DataFrame, of_run: DataFrame, of_frame: DataFrame, run_keys: list[str], frame_keys: list[str]) -> DataFrame:
    """regions (with run) and ready: whether the run's mask is there, or where there is no run the frame's."""
    there = lambda masks, keys, name: masks.select(*keys).distinct().withColumn(name, F.lit(True))
    joined = regions.join(there(of_run, run_keys, "run_ready"), run_keys, "left").join(there(of_frame, frame_keys, "frame_ready"), frame_keys, "left")
    found = F.when(F.col("run") >= 0, F.col("run_ready")).otherwise(F.col("frame_ready"))
    return joined.select(*regions.columns, F.coalesce(found, F.lit(False)).alias("ready"))


def resolve(regions: DataFrame, of_run: DataFrame | None, of_frame: DataFrame, run_keys: list[str], frame_keys: list[str], segment: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """regions and mask: the run's if runs have masks and this one does, else the frame's, else what segment makes.

    segment gets the regions without a mask, and gives them with one; without it they have null. of_run and of_frame have
    their keys and a mask, at most one for each key.
    """
    asked = regions if of_run is None else regions.join(of_run.withColumnRenamed("mask", "run_mask"), run_keys, "left")
    joined = asked.join(of_frame.withColumnRenamed("mask", "frame_mask"), frame_keys, "left")
    mask = F.col("frame_mask") if of_run is None else F.coalesce("run_mask", "frame_mask")
    found = joined.select(*regions.columns, mask.alias("mask"))
    if segment is None:
        return found
    return found.where("mask is not null").unionByName(segment(found.where("mask is null").drop("mask")))


def strength(prob: Column) -> Column:
    """How many samples are a stroke rather than not."""
    return F.size(F.filter(prob, lambda p: p > 0.5)).cast("bigint")


def best_of_runs(samples: DataFrame, by: list[str], frame: str = "frame", prob: str = "prob") -> DataFrame:
    """by, and best: the frame with the strongest mask of each run's samples, the earliest of equals."""
    return samples.groupBy(*by).agg(F.max_by(frame, F.struct(strength(F.col(prob)), -F.col(frame))).alias("best"))


def stored_size(blobs: DataFrame, blob: str, *by: str) -> DataFrame:
    """by, and bytes: what the blobs of each group take, be they binary or text."""
    return blobs.groupBy(*by).agg(F.coalesce(F.sum(F.octet_length(blob)), F.lit(0)).cast("bigint").alias("bytes"))


def cleared(spark: SparkSession, path: str, clip_id: int) -> int:
    """Deletes a clip's masks from a table of put_masks(), and nothing else; the bytes of the files that went."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/clip_id={clip_id}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return 0
    freed = fs.getContentSummary(place).getLength()
    fs.delete(place, True)
    return freed


def hit_rate(hit: Column) -> Column:
    """An aggregate: the share of lookups that were hits; of none it is 0."""
    return F.count_if(hit) / F.greatest(F.lit(1), F.count(hit))
