"""Slots for models, which are plain functions on arrays; a slot loads its model once in a task.

detector(frame) -> list of (polygon, score); recogniser(crop) -> (text, score); segmenter(crop) -> logits of its shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYGON = "array<struct<x:double,y:double>>"


def ramp(size: int, edge: int) -> np.ndarray:
    """Weights of one side of a tile: up over edge samples, or half of them if these are fewer, ones, and down again."""
    up = (np.arange(size) + 1) / (min(edge, size // 2) + 1)
    return np.minimum(np.minimum(up, up[::-1]), 1.0)


def starts(extent: int, tile: int, stride: int) -> list[int]:
    return [0] if extent <= tile else sorted({*range(0, extent - tile + 1, stride), extent - tile})


def segment(crop: np.ndarray, segmenter: Callable[[np.ndarray], np.ndarray], tile: int = 1024, overlap: float = 0.25, edge: int = 32) -> np.ndarray:
    """Probabilities of a crop: one inference if it fits a tile, else the weighted mean of the logits of tiles that overlap."""
    h, w = crop.shape[:2]
    if max(h, w) <= tile:
        logits = segmenter(crop)
    else:
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        stride = max(1, int(tile * (1 - overlap)))
        for y in starts(h, tile, stride):
            for x in starts(w, tile, stride):
                part = np.s_[y : y + tile, x : x + tile]
                shape = crop[part].shape[:2]
                own = np.outer(ramp(shape[0], edge), ramp(shape[1], edge))
                total[part] += segmenter(crop[part]) * own
                weight[part] += own
        logits = total / np.maximum(weight, 1e-6)
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def segment_crops(crops: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], tile: int = 1024, overlap: float = 0.25, edge: int = 32) -> DataFrame:
    """crops (h, w, gray, and other columns) with prob."""
    schema = T.StructType([*crops.schema.fields, T.StructField("prob", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pdf.assign(prob=[segment(np.asarray(g, float).reshape(h, w), model, tile, overlap, edge).ravel() for g, h, w in zip(pdf["gray"], pdf["h"], pdf["w"], strict=True)])

    return crops.mapInPandas(run, schema)


def detect(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], list]]) -> DataFrame:
    """clip_id, frame, det_ord, poly, score for frames with clip_id, frame, h, w, gray; polygons of two points go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                found = [(p, s) for p, s in model(np.asarray(r.gray, float).reshape(r.h, r.w)) if len(p) >= 3]
                out += [(r.clip_id, r.frame, n, [{"x": float(x), "y": float(y)} for x, y in p], float(s)) for n, (p, s) in enumerate(found)]
            yield pd.DataFrame(out, columns=["clip_id", "frame", "det_ord", "poly", "score"])

    return frames.select("clip_id", "frame", "h", "w", "gray").mapInPandas(run, f"clip_id bigint, frame bigint, det_ord int, poly {POLYGON}, score double")


def recognise(crops: DataFrame, load: Callable[[], Callable[[np.ndarray], tuple[str, float]]], least: int = 8) -> DataFrame:
    """crops without gray but with text and score; crops of fewer than least pixels a side aren't read."""
    kept = [f for f in crops.schema.fields if f.name != "gray"]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            read = [model(np.asarray(g, float).reshape(h, w)) for g, h, w in zip(pdf["gray"], pdf["h"], pdf["w"], strict=True)]
            yield pdf.drop(columns="gray").assign(text=[t for t, _ in read], score=[float(s) for _, s in read])

    return crops.where((F.col("h") >= least) & (F.col("w") >= least)).mapInPandas(run, schema)
