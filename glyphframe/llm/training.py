"""What the two classifiers share: folds, bounded samples, training in one task, scoring of all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Scratch, blocks, map_text, small

#: Bytes of text that the task which fits a classifier holds. The sample's documents come by the least hashes of their
#: ids; the first that would go beyond, and those after it, aren't learnt from.
TRAIN_BYTES = 256 << 20
#: A document with this score or more is predicted to be of class 1.
PREDICTED_FROM = 0.7


def fold(id: Column, of: int) -> Column:
    """Remainder of the CRC-32 of an id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % of


def chosen(ids: DataFrame, most: int) -> DataFrame:
    """At most so many of the rows of ids (which has doc_id), those with the least hashes, so that reruns agree."""
    return ids.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(17))).orderBy("order", "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def trained(docs: DataFrame, id: str, text: str, sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray], most_bytes: int | None = None) -> np.ndarray:
    """fit(texts, marks) on the documents named in sample (doc_id, mark, order), run in one task of an executor.

    The sample is bounded in rows by its maker, and here in bytes (TRAIN_BYTES); of rows that repeat an id, the text of the
    least hash is learnt, a null one as empty. It reaches the task in the order of its hashes, whatever the partitions
    were; the weights, of a fixed size, are all that comes to the driver.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.save(sample.select("doc_id", "mark", "order")).read()
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).join(small(named), "doc_id")
    once = rows.groupBy("order", "doc_id", "mark").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ordered = once.repartition(1).sortWithinPartitions("order", "doc_id", "mark").select("mark", "text")
    bound = TRAIN_BYTES if most_bytes is None else most_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        marks: list[int] = []
        total = 0
        for batch, got in blocks(batches, "text"):
            for x, mark in zip(got, batch.column(0).to_pylist(), strict=True):
                total += len(x)
                if total <= bound:
                    texts.append(x)
                    marks.append(mark)
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(marks, np.int64)).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    rows = ordered.mapInArrow(run, T.StructType([T.StructField("weights", T.BinaryType())])).collect()
    return np.frombuffer(rows[0]["weights"], "<f4") if rows else fit([], np.zeros(0, np.int64))


def scored(docs: DataFrame, id: str, text: str, held_out: Column, weights: np.ndarray, score: Callable[[list[bytes | None], np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; the weights, of a fixed size, go to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    made = T.StructType([T.StructField("score", T.DoubleType())])
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = map_text(own, "text", ["doc_id", "held_out"], made, lambda: lambda texts: {"score": score(texts, shared.value)})
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
