"""Relations on a timeline: regions (clip_id, frame, item_ord, box, dets, score, run), and a spine of all frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphframe.functions.boxes import BOX

VERSION = 1


def every(rows: DataFrame, stride: int) -> DataFrame:
    return rows.where(F.col("frame") % stride == 0)


def first_frames(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.where(F.col("frame") < most)


def exclude_runs(regions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Regions whose run isn't excluded: by run alone, or by clip_id and run, as excluded has columns."""
    return regions.join(excluded.distinct(), [c for c in ("clip_id", "run") if c in excluded.columns], "left_anti")


def run_spans(regions: DataFrame, excluded: DataFrame | None) -> DataFrame:
    spans = regions.where("run >= 0").groupBy("clip_id", "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    if excluded is None:
        return spans.withColumn("excluded", F.lit(False))
    marks = excluded.select("clip_id", "run").distinct().withColumn("excluded", F.lit(True))
    return spans.join(marks, ["clip_id", "run"], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def run_frames(regions: DataFrame) -> DataFrame:
    """A run's frames: bounded by one clip's."""
    frames = regions.where("run >= 0").groupBy("clip_id", "run").agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    return frames.withColumn("n_frames", F.size("frames").cast("long"))


def text_frame_counts(spine: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    marks = lambda rows, name: rows.select("clip_id", "frame").distinct().withColumn(name, F.lit(1))
    joined = spine.join(marks(raw, "raw"), ["clip_id", "frame"], "left").join(marks(kept, "kept"), ["clip_id", "frame"], "left")
    return joined.groupBy("clip_id").agg(F.count("*").alias("n_frames"), F.count("raw").alias("raw_text_frames"), F.count("kept").alias("text_frames"))


def text_islands(regions: DataFrame) -> DataFrame:
    """Spans of consecutive frames with text."""
    frames = regions.select("clip_id", "frame").distinct()
    gap = F.col("frame") - F.row_number().over(Window.partitionBy("clip_id").orderBy("frame"))
    return frames.withColumn("gap", gap).groupBy("clip_id", "gap").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).select("clip_id", "start", "end")


def next_island(islands: DataFrame, frame: int) -> DataFrame:
    """Of each clip the start of the first island after a frame, or else of its first island."""
    return islands.groupBy("clip_id").agg(F.coalesce(F.min(F.when(F.col("start") > frame, F.col("start"))), F.min("start")).alias("next"))


def run_at(regions: DataFrame, excluded: DataFrame) -> DataFrame:
    """On each frame the first run that isn't excluded, or else the first."""
    marks = excluded.select("clip_id", "run").distinct().withColumn("out", F.lit(1))
    rows = regions.where("run >= 0").join(marks, ["clip_id", "run"], "left")
    return rows.groupBy("clip_id", "frame").agg(F.min_by("run", F.struct(F.coalesce("out", F.lit(0)), "item_ord", "run")).alias("run"))


REGION = ("item_ord", "x0", "y0", "x1", "y1", "dets", "score", "run")


def lists(regions: DataFrame) -> DataFrame:
    """clip_id, frame, regions: those of one frame as an array."""
    return regions.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*REGION))).alias("regions"))


def lookup(spine: DataFrame, regions: DataFrame) -> DataFrame:
    """The list of regions of every frame, empty where there are none."""
    found = lists(regions)
    empty = F.array().cast(found.schema["regions"].dataType)
    return spine.join(found, ["clip_id", "frame"], "left").withColumn("regions", F.coalesce("regions", empty))


def hold_stride(spine: DataFrame, read: DataFrame, stride: int) -> DataFrame:
    """Lists for all frames where only every stride-th was read: the others take over the last list, an empty one too."""
    listed = lookup(every(spine, stride), read)
    w = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(listed, ["clip_id", "frame"], "left").withColumn("regions", F.last("regions", ignorenulls=True).over(w))


def debug_frames(regions: DataFrame, most: int) -> DataFrame:
    frames = regions.select("clip_id", "frame").distinct()
    return frames.withColumn("n", F.row_number().over(Window.partitionBy("clip_id").orderBy("frame"))).where(F.col("n") <= most).drop("n")


def with_tail(edited: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The edited frames, and those of the source that weren't."""
    return edited.withColumn("edited", F.lit(True)).unionByName(source.join(edited, keys, "left_anti").withColumn("edited", F.lit(False)))


def zip_frames(rgb: DataFrame, depth: DataFrame) -> DataFrame:
    """Frames of both streams side by side; depth frames without an RGB frame follow, with nulls."""
    return depth.join(rgb, ["clip_id", "frame"], "left")


def lane_pack(spans: DataFrame) -> DataFrame:
    """A lane for each span of a clip: the first whose last span ends before this one starts."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "run"], kind="stable")
        ends: list[int] = []
        lanes = []
        for start, end in zip(pdf["start"], pdf["end"], strict=True):
            lane = next((i for i, e in enumerate(ends) if e < start), len(ends))
            ends[lane : lane + 1] = [end]
            lanes.append(lane)
        return pdf.assign(lane=lanes)[["clip_id", "run", "start", "end", "lane"]]

    return spans.select("clip_id", "run", "start", "end").groupBy("clip_id").applyInPandas(pack, "clip_id bigint, run int, start bigint, end bigint, lane int")


def documents(regions: DataFrame, spine: DataFrame, excluded: tuple[int, ...] | DataFrame = (), raw: DataFrame | None = None, min_track: int | None = None, recognised: DataFrame | None = None) -> DataFrame:
    """clip_id and document: one JSON document a clip, a list of regions for every frame; scores have four decimals.

    excluded: runs of all clips, or rows of clip_id and run. raw: the regions before smoothing, whose frames are counted.
    recognised: rows of clip_id and verdict, a text for each reading.
    """
    as_list = lambda b: F.array(*[b[k] for k in ("x0", "y0", "x1", "y1")])
    entry = lambda r: F.struct(as_list(r).alias("box"), F.transform(r["dets"], as_list).alias("dets"), F.round(r["score"], 4).alias("score"), r["run"].alias("run"))
    frames = lookup(spine, regions).select("clip_id", "frame", F.transform("regions", entry).alias("entries"))
    listed = frames.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "entries"))), lambda f: f["entries"]).alias("regions"))
    if isinstance(excluded, DataFrame):
        marks = excluded.groupBy("clip_id").agg(F.array_sort(F.collect_set(F.col("run").cast("int"))).alias("excluded"))
        listed = listed.join(marks, "clip_id", "left").withColumn("excluded", F.coalesce("excluded", F.array().cast("array<int>")))
    else:
        listed = listed.withColumn("excluded", F.array(*map(F.lit, sorted(set(excluded)))).cast("array<int>"))
    seen = (raw if raw is not None else regions).groupBy("clip_id").agg(F.countDistinct("frame").cast("int").alias("raw_text_frames"))
    listed = listed.join(seen, "clip_id", "left")
    said = F.array().cast("array<string>")
    if recognised is not None:
        listed = listed.join(recognised.groupBy("clip_id").agg(F.array_sort(F.collect_list("verdict")).alias("recognised")), "clip_id", "left")
        said = F.coalesce("recognised", said)
    n_text = F.size(F.filter("regions", lambda r: F.size(r) > 0))
    document = F.struct(
        F.lit(VERSION).alias("version"), F.size("regions").alias("n_frames"), F.coalesce("raw_text_frames", F.lit(0)).alias("raw_text_frames"), n_text.alias("text_frames"),
        F.lit(min_track).cast("int").alias("min_track"), said.alias("recognised"), F.col("excluded"), F.col("regions"),
    )
    return listed.select("clip_id", F.to_json(document).alias("document"))


def document_states(docs: DataFrame) -> DataFrame:
    """clip_id, version, excluded (empty unless the document is current) and note: why a document isn't read, or null."""
    parsed = docs.select("clip_id", F.from_json("document", "struct<version:int,regions:array<string>,excluded:array<int>>").alias("d"))
    unreadable = F.col("d").isNull() | F.col("d.regions").isNull()
    current = F.coalesce("d.version", F.lit(0)) == VERSION
    note = F.when(unreadable, "the document can't be read: detect again").when(~current, "the document is of another version: detect again")
    none = F.array().cast("array<int>")
    return parsed.select("clip_id", F.coalesce("d.version", F.lit(0)).alias("version"), F.when(note.isNull(), F.coalesce("d.excluded", none)).otherwise(none).alias("excluded"), note.alias("note"))


def read_documents(docs: DataFrame) -> DataFrame:
    """Regions of documents of the current version; others, and what can't be read, give none.

    An entry is an object, or in old documents a bare box. Without detections the box stands for them, without a score 1.0,
    without a run -1.
    """
    parsed = docs.select("clip_id", F.from_json("document", "struct<version:int,regions:array<array<string>>>").alias("d"))
    current = parsed.where(F.coalesce("d.version", F.lit(0)) == VERSION)
    frames = current.select("clip_id", F.posexplode("d.regions").alias("frame", "entries"))
    entries = frames.select("clip_id", F.col("frame").cast("long"), F.posexplode("entries").alias("item_ord", "e"))
    bare = F.col("e").startswith("[")
    full = F.from_json(F.when(~bare, F.col("e")), "struct<box:array<bigint>,dets:array<array<bigint>>,score:double,run:int>")
    row = entries.select("clip_id", "frame", "item_ord", full.alias("r"), F.coalesce(full["box"], F.from_json(F.when(bare, F.col("e")), "array<bigint>")).alias("b")).where("size(b) = 4")
    as_box = lambda a: F.struct(*[F.get(a, i).alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))])
    dets = F.when(F.size("r.dets") > 0, F.transform("r.dets", as_box)).otherwise(F.array(as_box(F.col("b")))).cast(f"array<{BOX}>")
    return row.select("clip_id", "frame", "item_ord", as_box(F.col("b")).alias("box"), dets.alias("dets"), F.coalesce("r.score", F.lit(1.0)).alias("score"), F.coalesce("r.run", F.lit(-1)).alias("run")).select("clip_id", "frame", "item_ord", "box.*", "dets", "score", "run")
