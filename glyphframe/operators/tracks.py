"""Tracks of regions over time, and the timeline of runs that they leave.

A track can't bridge more than the link horizon, so a clip falls into islands of frames with regions, further apart than
that, that have no track in common. Linking runs per island, which splits even one long clip over many tasks; all that
doesn't depend on order is joins, windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.config import FrameSize, RegionConfig, resolve_min_track
from glyphframe.functions import boxes
from glyphframe.operators.regions import Box, hull, merge_regions

TRACK = ("clip_id", "first_frame", "first_ord")
BOX_TYPE = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"


def islands(regions: DataFrame, horizon: int = 12) -> DataFrame:
    """regions with island; a new island of a clip begins where no region lies within horizon frames before."""
    by_frame = Window.partitionBy("clip_id").orderBy("frame", "item_ord")
    begins = F.when(F.col("frame") - F.lag("frame").over(by_frame) > horizon, 1).otherwise(0)
    return regions.withColumn("begins", begins).withColumn("island", F.sum("begins").over(by_frame.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def shared(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


class Linker:
    """Greedy linking, frame by frame, and the sticky run of each track at once.

    A region goes to the open track whose last box it shares most with, more than least, the earliest of equals; a track
    that has a region of this frame already isn't given another, and the region begins a track of its own. Tracks that
    begin in a frame aren't open to it. A sticky run goes on while its union shares sticky or more with the next box.
    """

    def __init__(self, least: float, horizon: int, sticky: float):
        self.least, self.horizon, self.sticky = least, horizon, sticky
        self.open: list[list] = []  # [first frame, first ordinal, last frame, last box, run's union, run]
        self.begun: list[list] = []
        self.now: int | None = None

    def begin(self, frame: int) -> None:
        self.open = [t for t in (*self.open, *self.begun) if frame - t[2] <= self.horizon]
        self.begun, self.now = [], frame

    def link(self, ordinal: int, box: Box) -> tuple[int, int, int]:
        """For the next region of the frame: first frame and ordinal of its track, and the number of its sticky run."""
        most, best = self.least, None
        for track in self.open:
            if (share := shared(track[3], box)) > most:
                most, best = share, track
        if best is None or best[2] == self.now:
            best = [self.now, ordinal, self.now, box, box, 0]
            self.begun.append(best)
        else:
            stays = shared(best[4], box) >= self.sticky
            best[2:] = [self.now, box, hull(best[4], box) if stays else box, best[5] + (not stays)]
        return best[0], best[1], best[5]

    def frame(self, frame: int, items: list[tuple[int, Box]]) -> list[tuple[int, int, int]]:
        """The links of all (ordinal, box) of a frame, whose tracks are open from now on."""
        self.begin(frame)
        links = [self.link(ordinal, box) for ordinal, box in items]
        self.open, self.begun = self.open + self.begun, []
        return links


LINKED = "clip_id bigint, frame bigint, item_ord int, x0 bigint, y0 bigint, x1 bigint, y1 bigint, dets array<" + BOX_TYPE + ">, score double, first_frame bigint, first_ord int, sticky int"


def build_tracks(regions: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    """Regions with first_frame and first_ord, which name their track within a clip, and sticky, their run within it.

    Islands are dealt to tasks and stream through the linker in Arrow batches; dets and scores pass by untouched.
    """
    rows = islands(regions, cfg.link_horizon).select("island", "clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1", "dets", "score")
    dealt = rows.repartition("clip_id", "island").sortWithinPartitions("clip_id", "island", "frame", "item_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, linker = None, Linker(cfg.link_iou, cfg.link_horizon, cfg.sticky_iou)
        for batch in batches:
            links = []
            for part, clip, frame, ordinal, *box in zip(*[c.to_pylist() for c in batch.columns[:8]], strict=True):
                if (clip, part) != island:
                    island, linker = (clip, part), Linker(cfg.link_iou, cfg.link_horizon, cfg.sticky_iou)
                if frame != linker.now:
                    linker.begin(frame)
                links.append(linker.link(ordinal, tuple(box)))
            made = zip(*links, strict=True) if links else ((), (), ())
            arrays = [pa.array(values, kind) for values, kind in zip(made, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*batch.schema.names[1:], "first_frame", "first_ord", "sticky"])

    return dealt.mapInArrow(run, LINKED)


def frame_delta(tracked: DataFrame) -> DataFrame:
    """tracked with step: how far a box moved since its track's previous observed frame, by the edges that moved least;
    null in a track's first frame. It isn't divided by the frames between."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    moved = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    return tracked.withColumn("step", F.hypot(F.least(moved("x0"), moved("x1")).cast("double"), F.least(moved("y0"), moved("y1")).cast("double")))


def track_stats(tracked: DataFrame) -> DataFrame:
    """A row for each track: span (observed frames), peak, motion (median step by median height), best_frame (of the
    greatest score, the earliest of equals)."""
    return (
        frame_delta(tracked)
        .groupBy(*TRACK)
        .agg(
            F.count("*").alias("span"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("peak"),
            F.median("step").alias("step"),
            F.median((F.col("y1") - F.col("y0")).cast("double")).alias("height"),
            F.max_by("frame", F.struct("score", -F.col("frame"))).alias("best_frame"),
            F.min("frame").alias("start"),
            F.max("frame").alias("end"),
        )
        .withColumn("motion", F.when((F.col("span") < 2) | (F.col("height") <= 0), F.lit(0.0)).otherwise(F.col("step") / F.col("height")))
        .drop("step", "height")
    )


def surviving_tracks(stats: DataFrame, cfg: RegionConfig, min_track: int, track_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tracks that are long, sure and still enough, and then pass the caller's filter; run numbers them in their order."""
    kept = stats.where(F.col("span") >= min_track)
    if cfg.track_score:
        kept = kept.where(F.col("peak") >= cfg.track_score)
    if cfg.max_motion is not None:
        kept = kept.where(F.col("motion") <= cfg.max_motion)
    if track_filter is not None:
        kept = track_filter(kept)
    return kept.withColumn("run", (F.row_number().over(Window.partitionBy("clip_id").orderBy("first_frame", "first_ord")) - 1).cast("int"))


def canonical_boxes(tracked: DataFrame) -> DataFrame:
    """Each sticky run's union in place of the boxes of its frames."""
    w = Window.partitionBy(*TRACK, "sticky")
    return tracked.withColumns({c: f(c).over(w) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))})


def bridge_gaps(tracked: DataFrame, max_gap: int) -> DataFrame:
    """The frames that are missing between two of a track, if there are no more than max_gap, hold the earlier region."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    gap = F.lead("frame").over(w) - F.col("frame") - 1
    until = F.when(gap.between(1, max_gap), F.col("frame") + gap).otherwise(F.col("frame"))
    return tracked.withColumn("until", until).withColumn("frame", F.explode(F.sequence("frame", "until"))).drop("until")


def smooth_timeline(regions: DataFrame, cfg: RegionConfig = RegionConfig(), min_track: int | None = None, track_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The timeline: regions of the surviving tracks, numbered by run, still and without short holes."""
    least = min_track if min_track is not None else cfg.min_track if cfg.min_track is not None else 2
    tracked = build_tracks(regions, cfg)
    if track_filter is not None:
        runs = surviving_tracks(track_stats(tracked), cfg, least, track_filter).select(*TRACK, "run")
        kept = tracked.join(runs, list(TRACK))
    else:
        kept = _numbered(tracked, cfg, least)
    held = bridge_gaps(canonical_boxes(kept), cfg.max_gap)
    by_run = Window.partitionBy("clip_id", "frame").orderBy("run")
    ordered = held.withColumn("item_ord", (F.row_number().over(by_run) - 1).cast("int"))
    return merge_regions(ordered, 0).select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1", "dets", "score", "run")


def _numbered(tracked: DataFrame, cfg: RegionConfig, min_track: int) -> DataFrame:
    """What a join with surviving_tracks() gives, without a second pass over the linker's input: a track's figures come
    from windows over its own rows, and tracks are numbered by rank."""
    of_track = Window.partitionBy(*TRACK)
    rows = frame_delta(tracked).withColumn("span", F.count("*").over(of_track)).where(F.col("span") >= min_track)
    if cfg.track_score:
        rows = rows.withColumn("peak", F.coalesce(F.max("score").over(of_track), F.lit(0.0))).where(F.col("peak") >= cfg.track_score)
    if cfg.max_motion is not None:
        height = F.median((F.col("y1") - F.col("y0")).cast("double")).over(of_track)
        rows = rows.withColumn("median_step", F.median("step").over(of_track)).withColumn("height", height)
        rows = rows.where((F.col("span") < 2) | (F.col("height") <= 0) | (F.col("median_step") / F.col("height") <= cfg.max_motion))
    run = F.dense_rank().over(Window.partitionBy("clip_id").orderBy("first_frame", "first_ord"))
    return rows.withColumn("run", (run - 1).cast("int")).select(*tracked.columns, "run")


def timeline(dets: DataFrame, cfg: RegionConfig = RegionConfig(), frame: FrameSize = FrameSize(), track_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """From detections to the timeline, with the least track length that the frame rate gives."""
    from glyphframe.operators.regions import frame_regions

    return smooth_timeline(frame_regions(dets, cfg, frame), cfg, resolve_min_track(cfg, frame.fps), track_filter)


def best_readings(recognitions: DataFrame, by: list[str]) -> DataFrame:
    """by, and best (text, score): the surest reading of each track's crops, the first of equals."""
    return recognitions.groupBy(*by).agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("det_ord"), "text")).alias("best"))


def recognised(tracks: DataFrame, recognitions: DataFrame, cfg: RegionConfig = RegionConfig()) -> DataFrame:
    """Tracks whose best reading, at their best frame, is long and sure enough; those without a reading stay.

    recognitions: clip_id, first_frame, first_ord, det_ord, text, score, of crops that are large enough to be read.
    """
    if not cfg.rec_score:
        return tracks
    best = best_readings(recognitions, list(TRACK))
    legible = (F.length(F.trim(F.col("best.text"))) >= cfg.rec_min_chars) & (F.col("best.score") >= cfg.rec_score)
    return tracks.join(best, list(TRACK), "left").where(F.col("best").isNull() | legible).drop("best")


def iou_of_rows(a: str, b: str) -> Column:
    return boxes.iou(F.col(a), F.col(b))
