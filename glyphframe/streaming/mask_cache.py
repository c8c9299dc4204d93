"""Masks that are used again while the pixels around their strokes stay as they are."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphframe.operators.pixels import spread

Box = tuple[int, int, int, int]


class Limits(NamedTuple):
    """The mean difference up to which pictures are alike, for how many frames an unused record stays, and how far around
    strokes pictures are compared."""

    tolerance: float = 2.0
    ttl: int = 8
    margin: int = 4


class Record(NamedTuple):
    """Of a box: the picture its mask was made from, where pictures are compared, the mask, and when it was last of use."""

    gray: np.ndarray
    zone: np.ndarray
    mask: np.ndarray
    used: int


def zone_of(mask: np.ndarray, margin: int) -> np.ndarray:
    """The strokes and what lies within margin of them; all of a mask without strokes."""
    zone = spread((mask > 0.5).astype(float), margin) > 0
    return zone if zone.any() else np.ones(mask.shape, bool)


def difference(now: np.ndarray, was: np.ndarray) -> float:
    """Mean difference of two samples, each less its own median, as a change of light moves all pixels alike."""
    return float(np.abs((now - np.median(now)) - (was - np.median(was))).mean())


def step(records: dict[Box, Record], box: Box, gray: np.ndarray, mask: np.ndarray, frame: int, limits: Limits) -> tuple[dict[Box, Record], bool]:
    """The records after a crop was asked for, and whether it found one; if not, its mask is put, and makes one.

    A hit keeps a record in use, but its picture stays the first. Records that were of no use for longer than ttl go when
    a mask is put, and not before.
    """
    own = records.get(box)
    if own and own.gray.shape == gray.shape and difference(gray[own.zone], own.gray[own.zone]) <= limits.tolerance:
        return records | {box: own._replace(used=frame)}, True
    put = records | {box: Record(gray, zone_of(mask, limits.margin), mask, frame)}
    return {b: r for b, r in put.items() if frame - r.used <= limits.ttl}, False


def cache_hits(crops: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """clip_id, frame, item_ord, hit for crops with clip_id, frame, item_ord, the box, h, w, gray and mask (arrays).

    A clip's crops stream by in order, so that a task holds its records and a batch, and never a whole clip.
    """
    rows = crops.select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1", "h", "w", "gray", "mask").repartition("clip_id").sortWithinPartitions("clip_id", "frame", "item_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, records = None, {}
        for batch in batches:
            hits = []
            scalars = zip(*[c.to_pylist() for c in batch.columns[:9]], strict=True)
            for n, (own, frame, _, x0, y0, x1, y1, h, w) in enumerate(scalars):
                if own != clip:
                    clip, records = own, {}
                gray, mask = (batch.column(k)[n].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w) for k in (9, 10))
                records, hit = step(records, (x0, y0, x1, y1), gray, mask, frame, limits)
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hits, pa.bool_())], names=["clip_id", "frame", "item_ord", "hit"])

    return rows.mapInArrow(run, "clip_id bigint, frame bigint, item_ord int, hit boolean")
