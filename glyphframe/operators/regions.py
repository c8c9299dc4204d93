"""From detections to regions: filters as predicates, merging as a fold over the rows of each frame.

Detections have clip_id, frame, det_ord, x0, y0, x1, y1, score and tilt. Regions have clip_id, frame, item_ord, the box,
dets (an array of boxes), score and run (-1: none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.config import FrameSize, RegionConfig
from glyphframe.functions import boxes

Box = tuple[int, int, int, int]
CORNERS = ("x0", "y0", "x1", "y1")
REGIONS = "clip_id bigint, frame bigint, item_ord int, x0 bigint, y0 bigint, x1 bigint, y1 bigint, dets array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>, score double, run int"


def box_of_row() -> Column:
    return F.struct("x0", "y0", "x1", "y1")


def filter_tilt(dets: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    return dets if cfg.max_tilt is None else dets.where(F.col("tilt") <= cfg.max_tilt)


def filter_size(dets: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    return dets.where(boxes.large_enough(box_of_row(), cfg))


def filter_roi(dets: DataFrame, cfg: RegionConfig = RegionConfig(), frame: FrameSize = FrameSize()) -> DataFrame:
    return dets if cfg.roi is None else dets.where(boxes.in_roi(box_of_row(), cfg.roi, frame))


def filter_detections(dets: DataFrame, cfg: RegionConfig = RegionConfig(), frame: FrameSize = FrameSize()) -> DataFrame:
    return filter_roi(filter_size(filter_tilt(dets, cfg), cfg), cfg, frame)


def polygons(dt_polys: Column, polys: Column, boxes_: Column, dt_scores: Column, scores: Column) -> Column:
    """An array of poly and score: the first list of polygons that a detector gave, null if none, and the first of scores.

    Without as many scores as polygons all are 1. Polygons of fewer than three points go.
    """
    found = F.coalesce(dt_polys, polys, boxes_)
    given = F.coalesce(dt_scores, scores)
    sure = F.when(F.size(given) == F.size(found), given.cast("array<double>")).otherwise(F.transform(found, lambda p: F.lit(1.0)))
    paired = F.zip_with(found, sure, lambda p, s: F.struct(p.alias("poly"), s.alias("score")))
    return F.filter(paired, lambda d: F.size(d["poly"]) >= 3)


def detections(frames: DataFrame, box: str = "boxes", poly: str = "polys", score: str | None = "scores") -> DataFrame:
    """frames without these arrays but with det_ord, the box, poly and score, put together by place; a missing score is 1."""
    scores = F.col(score).cast("array<double>") if score else F.lit(None).cast("array<double>")
    zipped = F.transform(F.col(box), lambda b, i: F.struct(b.alias("box"), F.get(F.col(poly), i).alias("poly"), F.coalesce(F.get(scores, i), F.lit(1.0)).alias("score")))
    rest = [c for c in frames.columns if c not in (box, poly, score)]
    return frames.select(*rest, F.posexplode(zipped).alias("det_ord", "d")).select(*rest, "det_ord", "d.box.*", "d.poly", "d.score")


def as_region(b: Column) -> Column:
    """A bare box as a region's dets, score and run, beside its corners."""
    return F.struct(*[b[c].alias(c) for c in CORNERS], F.array(b).alias("dets"), F.lit(1.0).alias("score"), F.lit(-1).alias("run"))


def non_empty(rows: DataFrame) -> DataFrame:
    """Rows whose box has an area."""
    return rows.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def near(a: Box, b: Box, gap: int) -> bool:
    return b[0] - gap <= a[2] and a[0] - gap <= b[2] and b[1] - gap <= a[3] and a[1] - gap <= b[3]


def hull(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def merge(items: Iterable[tuple], gap: int) -> list[tuple]:
    """Merges items (ordinal, box, dets, score, run) until no two boxes come within gap of each other.

    Every item is put to those that are settled: it takes in all it touches, and with its grown box tries again, until it
    touches none. Growth only ever adds contacts, so the groups don't depend on the order. A merged item has the least
    ordinal, the greatest score, the least run that isn't -1, and each of its detections once.
    """
    settled: list[tuple] = []
    for item in items:
        while True:
            touched = [s for s in settled if near(s[1], item[1], gap)]
            if not touched:
                break
            settled = [s for s in settled if not near(s[1], item[1], gap)]
            for s in touched:
                runs = [r for r in (s[4], item[4]) if r >= 0]
                item = (min(s[0], item[0]), hull(s[1], item[1]), s[2] + item[2], max(s[3], item[3]), min(runs, default=-1))
        settled.append(item)
    return sorted((o, b, tuple(sorted(set(d), key=lambda q: (q[1], q[0], q[3], q[2]))), s, r) for o, b, d, s, r in settled)


def snap(b: Box, cfg: RegionConfig, frame: FrameSize) -> Box:
    g = max(1, cfg.grid)
    return max(0, (b[0] - cfg.pad) // g * g), max(0, (b[1] - cfg.pad) // g * g), min(frame.width, -((-b[2] - cfg.pad) // g) * g), min(frame.height, -((-b[3] - cfg.pad) // g) * g)


Item = tuple[int, Box, tuple[Box, ...], float, int]


def fold_frames(rows: DataFrame, order: str, fold: Callable[[list[Item]], list[Item]]) -> DataFrame:
    """fold(items of one frame) for every (clip_id, frame): REGIONS, numbered in the order that fold gives.

    rows have clip_id, frame, order, the box and score, and may have run and dets (else a box is its own detection). They
    are dealt by frame and sorted, and then stream through Python in Arrow batches: there is one shuffle, no group is set up
    on its own, and of a frame that a batch ends in only the rows so far are held.
    """
    given = [c for c in ("run", "dets") if c in rows.columns]
    sorted_rows = rows.select("clip_id", "frame", order, *CORNERS, "score", *given).repartition("clip_id", "frame").sortWithinPartitions("clip_id", "frame", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            scalars = zip(*[c.to_pylist() for c in batch.columns[: 8 + ("run" in given)]], strict=True)
            dets = _boxes(batch.column(batch.num_columns - 1)) if "dets" in given else None
            for n, (clip, frame, ordinal, x0, y0, x1, y1, score, *rest) in enumerate(scalars):
                if (clip, frame) != key:
                    if held:
                        out += [(*key, k, *item[1:]) for k, item in enumerate(fold(held))]
                    key, held = (clip, frame), []
                box = (x0, y0, x1, y1)
                held.append((ordinal, box, dets[n] if dets else (box,), score, rest[0] if rest else -1))
            if out:
                yield _region_batch(out)
        if held:
            yield _region_batch([(*key, k, *item[1:]) for k, item in enumerate(fold(held))])

    return sorted_rows.mapInArrow(run, REGIONS)


def _boxes(column: pa.ListArray) -> list[tuple[Box, ...]]:
    """The boxes of each list of structs."""
    inner = column.flatten()
    flat = list(zip(*[inner.field(c).to_pylist() for c in CORNERS], strict=True))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [tuple(flat[a:z]) for a, z in zip([0, *ends], ends, strict=False)]


def _region_batch(rows: list[tuple]) -> pa.RecordBatch:
    clips, frames, places, boxes_, dets, scores, runs = zip(*rows, strict=True)
    flat = [b for d in dets for b in d]
    corners = pa.StructArray.from_arrays([pa.array([b[k] for b in flat], pa.int64()) for k in range(4)], names=CORNERS)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, dets)]), pa.int32()), corners)
    columns = [pa.array(clips, pa.int64()), pa.array(frames, pa.int64()), pa.array(places, pa.int32()), *[pa.array([b[k] for b in boxes_], pa.int64()) for k in range(4)], lists, pa.array(scores, pa.float64()), pa.array(runs, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["clip_id", "frame", "item_ord", *CORNERS, "dets", "score", "run"])


def merge_regions(regions: DataFrame, gap: int) -> DataFrame:
    """Regions of each frame merged to a fixpoint of growing boxes; they are numbered by their first member's place."""
    return fold_frames(regions.select("clip_id", "frame", "item_ord", *CORNERS, "dets", "score", "run"), "item_ord", lambda items: merge(items, gap))


def frame_regions(dets: DataFrame, cfg: RegionConfig = RegionConfig(), frame: FrameSize = FrameSize()) -> DataFrame:
    """Detections that pass the filters, merged to lines, snapped to the grid, and merged again where they then touch."""

    def fold(items: list[Item]) -> list[Item]:
        lines = merge(items, cfg.merge_gap)
        return merge([(n, snap(b, cfg, frame), d, s, r) for n, (_, b, d, s, r) in enumerate(lines)], 0)

    return fold_frames(filter_detections(dets, cfg, frame), "det_ord", fold)
