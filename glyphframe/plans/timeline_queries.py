"""Queries over the planted captions: filters, regions, tracks, runs, timeline relations.

The oracles know each caption's id; the Spark side tracks without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphframe.config import FrameSize, RegionConfig, resolve_min_track
from glyphframe.functions import boxes
from glyphframe.operators import regions, timeline, tracks
from glyphframe.plans.registry import query, table
from glyphframe.sources.fixtures import PLANTED, detections
from glyphframe.sources.frames import removed, shared_folder, stored

CFG, FRAME = RegionConfig(), FrameSize()
ROI = (0.0, 0.5, 0.5, 1.0)
DETS = f"planted AS ({PLANTED}), dets AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id, frame ORDER BY y0, x0) - 1 AS INT) AS det_ord FROM planted)"
SNAP = """greatest(0, CAST(floor((x0 - 12) / 16.0) * 16 AS BIGINT)) AS x0, greatest(0, CAST(floor((y0 - 12) / 16.0) * 16 AS BIGINT)) AS y0,
  least(1920, CAST(ceil((x1 + 12) / 16.0) * 16 AS BIGINT)) AS x1, least(1080, CAST(ceil((y1 + 12) / 16.0) * 16 AS BIGINT)) AS y1"""
#: A region for each caption and frame, as its words give it; lines with a caption's id.
TRUTH = f"""{DETS},
lines AS (SELECT clip_id, frame, cap_id, kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score, count(*) AS n_dets, min(det_ord) AS first_det
          FROM dets WHERE tilt <= 4 GROUP BY ALL),
regs AS (SELECT clip_id, frame, cap_id, kind, score, n_dets, CAST(row_number() OVER (PARTITION BY clip_id, frame ORDER BY first_det) - 1 AS INT) AS item_ord, {SNAP} FROM lines),
steps AS (SELECT *, sqrt(power(least(abs(x0 - lag(x0) OVER w), abs(x1 - lag(x1) OVER w)), 2) + power(least(abs(y0 - lag(y0) OVER w), abs(y1 - lag(y1) OVER w)), 2)) AS step
          FROM regs WINDOW w AS (PARTITION BY clip_id, cap_id ORDER BY frame)),
stats AS (SELECT clip_id, cap_id, count(*) AS span, max(score) AS peak, min(frame) AS first_frame, arg_min(item_ord, frame) AS first_ord, max(frame) AS last_frame,
                 CASE WHEN count(*) < 2 THEN 0.0 ELSE median(step) / median(y1 - y0) END AS motion,
                 min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
          FROM steps GROUP BY ALL),
runs AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY first_frame, first_ord) - 1 AS INT) AS run FROM stats WHERE span >= 12 AND peak >= 0.6 AND motion <= 0.02),
line AS (SELECT clip_id, run, unnest(range(first_frame, last_frame + 1)) AS frame, x0, y0, x1, y1 FROM runs)"""


def dets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir)


def timeline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.timeline(detections(spark, sf_dir), CFG, FRAME)


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.frame_regions(detections(spark, sf_dir), CFG, FRAME)


def tracked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.build_tracks(regions_of(spark, sf_dir), CFG)


def spine_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every clip: frames 0 to the last one with a detection."""
    last = detections(spark, sf_dir).groupBy("clip_id").agg(F.max("frame").alias("last"))
    return last.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame"))


SPINE = "spine AS (SELECT clip_id, unnest(range(0, max(frame) + 1)) AS frame FROM planted GROUP BY clip_id)"
DET_COLS = "clip_id, frame, det_ord, x0, y0, x1, y1"


@query("f01_filter_tilt", f"WITH {DETS} SELECT {DET_COLS} FROM dets WHERE tilt <= 4.0")
def f01(spark, sf_dir):
    return regions.filter_tilt(dets_of(spark, sf_dir), CFG).select(*DET_COLS.split(", "))


SMALL = RegionConfig(min_height=48, min_area=7000)


@query("f02_filter_size", f"WITH {DETS} SELECT {DET_COLS} FROM dets WHERE y1 - y0 >= 48 AND (x1 - x0) * (y1 - y0) >= 7000")
def f02(spark, sf_dir):
    return regions.filter_size(dets_of(spark, sf_dir), SMALL).select(*DET_COLS.split(", "))


@query("f03_filter_roi", f"WITH {DETS} SELECT {DET_COLS} FROM dets WHERE (x0 + x1) / 2.0 BETWEEN 0 AND 960 AND (y0 + y1) / 2.0 BETWEEN 540 AND 1080")
def f03(spark, sf_dir):
    return regions.filter_roi(dets_of(spark, sf_dir), RegionConfig(roi=ROI), FRAME).select(*DET_COLS.split(", "))


@query("j04_frame_regions", f"WITH {TRUTH} SELECT clip_id, frame, item_ord, x0, y0, x1, y1, score, n_dets FROM regs")
def j04(spark, sf_dir):
    return regions_of(spark, sf_dir).select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1", "score", F.size("dets").cast("long").alias("n_dets"))


def _merged(gap: int, rounds: int = 6) -> str:
    """Regions whose boxes, as merged so far, come within gap of each other, merged again and again; a frame has few."""
    apart = " AND ".join(f"b.{c}0 <= a.{c}1 + {gap} AND a.{c}0 <= b.{c}1 + {gap}" for c in "xy")
    hull = "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score"
    steps = "r0 AS MATERIALIZED (SELECT clip_id, frame, item_ord AS g, x0, y0, x1, y1, score FROM regs)"
    for n in range(rounds):
        steps += f""", g{n} AS MATERIALIZED (SELECT clip_id, frame, g, {hull} FROM r{n} GROUP BY clip_id, frame, g),
        m{n} AS (SELECT a.clip_id, a.frame, a.g, min(b.g) AS h FROM g{n} a JOIN g{n} b ON a.clip_id = b.clip_id AND a.frame = b.frame AND {apart} GROUP BY ALL),
        r{n + 1} AS MATERIALIZED (SELECT clip_id, frame, h AS g, x0, y0, x1, y1, score FROM g{n} JOIN m{n} USING (clip_id, frame, g))"""
    return f"WITH {TRUTH}, {steps} SELECT clip_id, frame, {hull} FROM r{rounds} GROUP BY clip_id, frame, g"


@query("j03_merge_regions", _merged(160))
def j03(spark, sf_dir):
    """A gap at which lanes above each other merge, and then what their common box comes near."""
    return regions.merge_regions(regions_of(spark, sf_dir), 160).select("clip_id", "frame", "x0", "y0", "x1", "y1", "score")


@query("a23_region_score", f"WITH {TRUTH} SELECT clip_id, frame, item_ord, score FROM regs")
def a23(spark, sf_dir):
    return regions_of(spark, sf_dir).select("clip_id", "frame", "item_ord", "score")


TRACK_OF = "(SELECT s.clip_id, s.cap_id, s.first_frame, s.first_ord FROM stats s)"


@query("j05_build_tracks", f"WITH {TRUTH} SELECT r.clip_id, r.frame, r.item_ord, t.first_frame, t.first_ord FROM regs r JOIN {TRACK_OF} t USING (clip_id, cap_id)")
def j05(spark, sf_dir):
    return tracked_of(spark, sf_dir).select("clip_id", "frame", "item_ord", "first_frame", "first_ord")


@query("a01_track_span", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord, span FROM stats")
def a01(spark, sf_dir):
    return tracks.track_stats(tracked_of(spark, sf_dir)).select("clip_id", "first_frame", "first_ord", "span")


@query("a02_track_peak", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord, peak FROM stats")
def a02(spark, sf_dir):
    return tracks.track_stats(tracked_of(spark, sf_dir)).select("clip_id", "first_frame", "first_ord", "peak")


@query("a03_track_motion", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord, round(motion, 9) AS motion FROM stats")
def a03(spark, sf_dir):
    return tracks.track_stats(tracked_of(spark, sf_dir)).select("clip_id", "first_frame", "first_ord", F.round("motion", 9).alias("motion"))


@query("a04_run_union", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord, x0, y0, x1, y1 FROM stats")
def a04(spark, sf_dir):
    return tracked_of(spark, sf_dir).groupBy(*tracks.TRACK).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("w01_frame_delta", f"WITH {TRUTH} SELECT clip_id, frame, item_ord, round(step, 9) AS step FROM steps")
def w01(spark, sf_dir):
    return tracks.frame_delta(tracked_of(spark, sf_dir)).select("clip_id", "frame", "item_ord", F.round("step", 9).alias("step"))


def _survivors(condition: str) -> str:
    return f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord FROM stats WHERE {condition}"


def _tracks_with(spark, sf_dir, **limits) -> DataFrame:
    cfg = RegionConfig(**{"track_score": 0, "max_motion": None} | {k: v for k, v in limits.items() if k != "least"})
    return tracks.surviving_tracks(tracks.track_stats(tracked_of(spark, sf_dir)), cfg, limits.get("least", 1)).select(*tracks.TRACK)


@query("f04_filter_min_track", _survivors("span >= 12"))
def f04(spark, sf_dir):
    return _tracks_with(spark, sf_dir, least=resolve_min_track(CFG, FRAME.fps))


@query("f05_filter_track_score", _survivors("peak >= 0.6"))
def f05(spark, sf_dir):
    return _tracks_with(spark, sf_dir, track_score=0.6)


@query("f06_filter_motion", _survivors("motion <= 0.02"))
def f06(spark, sf_dir):
    return _tracks_with(spark, sf_dir, max_motion=0.02)


@query("f07_track_filter", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord FROM runs WHERE span % 2 = 0")
def f07(spark, sf_dir):
    return tracks.surviving_tracks(tracks.track_stats(tracked_of(spark, sf_dir)), CFG, 12, lambda t: t.where("span % 2 = 0")).select(*tracks.TRACK)


@query("w05_number_runs", f"WITH {TRUTH} SELECT clip_id, run, first_frame, first_ord FROM runs")
def w05(spark, sf_dir):
    return tracks.surviving_tracks(tracks.track_stats(tracked_of(spark, sf_dir)), CFG, 12).select("clip_id", "run", "first_frame", "first_ord")


@query("l02_top1_frame", f"WITH {TRUTH}, ranked AS (SELECT clip_id, cap_id, frame FROM regs QUALIFY row_number() OVER (PARTITION BY clip_id, cap_id ORDER BY score DESC, frame) = 1) SELECT s.clip_id, s.first_frame, s.first_ord, r.frame AS best_frame FROM stats s JOIN ranked r USING (clip_id, cap_id)")
def l02(spark, sf_dir):
    return tracks.track_stats(tracked_of(spark, sf_dir)).select("clip_id", "first_frame", "first_ord", "best_frame")


@query("j10_track_best_frame_lookup", f"WITH {TRUTH}, ranked AS (SELECT * FROM regs QUALIFY row_number() OVER (PARTITION BY clip_id, cap_id ORDER BY score DESC, frame) = 1) SELECT s.clip_id, s.first_frame, s.first_ord, r.frame, r.x0, r.y0, r.x1, r.y1 FROM stats s JOIN ranked r USING (clip_id, cap_id)")
def j10(spark, sf_dir):
    tracked = tracked_of(spark, sf_dir)
    best = tracks.track_stats(tracked).select(*tracks.TRACK, F.col("best_frame").alias("frame"))
    return tracked.join(best, [*tracks.TRACK, "frame"]).select(*tracks.TRACK, "frame", "x0", "y0", "x1", "y1")


@query("l01_order_frames", f"WITH {TRUTH} SELECT s.clip_id, s.first_frame, s.first_ord, string_agg(CAST(r.frame AS VARCHAR), ',' ORDER BY r.frame) AS frames FROM stats s JOIN regs r USING (clip_id, cap_id) GROUP BY ALL")
def l01(spark, sf_dir):
    return tracked_of(spark, sf_dir).groupBy(*tracks.TRACK).agg(F.array_join(F.array_sort(F.collect_list("frame")), ",").alias("frames"))


#: What TRUTH says, worked out once, and each caption's sticky runs: a run goes on while its union shares 0.8 or more with
#: the next box.
def _sticky(select: str) -> str:
    share = "(least(u.x1, r.x1) - greatest(u.x0, r.x0)) * (least(u.y1, r.y1) - greatest(u.y0, r.y0))"
    meet = "least(u.x1, r.x1) > greatest(u.x0, r.x0) AND least(u.y1, r.y1) > greatest(u.y0, r.y0)"
    stays = f"({meet} AND CAST({share} AS DOUBLE) / ((u.x1 - u.x0) * (u.y1 - u.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - {share}) >= 0.8)"
    kept = lambda pick, c: f"CASE WHEN {stays} THEN {pick}(u.{c}, r.{c}) ELSE r.{c} END"
    return f"""WITH RECURSIVE {TRUTH.replace("regs AS (", "regs AS MATERIALIZED (").replace("lines AS (", "lines AS MATERIALIZED (")},
seen AS MATERIALIZED (SELECT clip_id, cap_id, frame, item_ord, x0, y0, x1, y1, row_number() OVER (PARTITION BY clip_id, cap_id ORDER BY frame) AS n FROM regs),
u AS (SELECT clip_id, cap_id, frame, item_ord, n, x0, y0, x1, y1, 0 AS sticky FROM seen WHERE n = 1
      UNION ALL SELECT r.clip_id, r.cap_id, r.frame, r.item_ord, r.n, {kept("least", "x0")}, {kept("least", "y0")}, {kept("greatest", "x1")}, {kept("greatest", "y1")}, u.sticky + CASE WHEN {stays} THEN 0 ELSE 1 END
      FROM u JOIN seen r ON r.clip_id = u.clip_id AND r.cap_id = u.cap_id AND r.n = u.n + 1)
{select}"""


@query("w02_sticky_runs", _sticky("SELECT clip_id, frame, item_ord, sticky FROM u"))
def w02(spark, sf_dir):
    """Captions that don't move have one sticky run, those that do have many."""
    return tracked_of(spark, sf_dir).select("clip_id", "frame", "item_ord", "sticky")


@query("w03_canonical_box", _sticky("SELECT s.clip_id, s.frame, s.item_ord, min(s.x0) OVER w AS x0, min(s.y0) OVER w AS y0, max(s.x1) OVER w AS x1, max(s.y1) OVER w AS y1 FROM u JOIN seen s ON s.clip_id = u.clip_id AND s.cap_id = u.cap_id AND s.n = u.n WINDOW w AS (PARTITION BY u.clip_id, u.cap_id, u.sticky)"))
def w03(spark, sf_dir):
    return tracks.canonical_boxes(tracked_of(spark, sf_dir)).select("clip_id", "frame", "item_ord", "x0", "y0", "x1", "y1")


@query("w04_bridge_gaps", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord, unnest(range(first_frame, last_frame + 1)) AS frame FROM stats")
def w04(spark, sf_dir):
    return tracks.bridge_gaps(tracked_of(spark, sf_dir), CFG.max_gap).select("clip_id", "first_frame", "first_ord", "frame")


@query("w11_smooth_timeline", f"WITH {TRUTH} SELECT clip_id, frame, run, x0, y0, x1, y1 FROM line")
def w11(spark, sf_dir):
    return timeline_of(spark, sf_dir).select("clip_id", "frame", "run", "x0", "y0", "x1", "y1")


def _every_run(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """Runs by number, of every clip: more than any clip has."""
    clips = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 64").alias("clip_id")).distinct()
    return clips.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("run")).where(condition)


@query("a07_run_spans", f"WITH {TRUTH} SELECT clip_id, run, first_frame AS start, last_frame AS \"end\", run % 3 = 1 AS excluded FROM runs")
def a07(spark, sf_dir):
    """Every third run is excluded."""
    return timeline.run_spans(timeline_of(spark, sf_dir), _every_run(spark, sf_dir, "run % 3 = 1"))


@query("a08_run_frames", f"WITH {TRUTH} SELECT clip_id, run, count(*) AS n_frames, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM line GROUP BY ALL")
def a08(spark, sf_dir):
    return timeline.run_frames(timeline_of(spark, sf_dir)).select("clip_id", "run", "n_frames", F.array_join("frames", ",").alias("frames"))


@query("a06_text_frame_counts", f"WITH {TRUTH}, {SPINE} SELECT clip_id, (SELECT count(*) FROM spine s WHERE s.clip_id = c.clip_id) AS n_frames, (SELECT count(DISTINCT frame) FROM regs r WHERE r.clip_id = c.clip_id) AS raw_text_frames, (SELECT count(DISTINCT frame) FROM line l WHERE l.clip_id = c.clip_id) AS text_frames FROM (SELECT DISTINCT clip_id FROM spine) c")
def a06(spark, sf_dir):
    found = regions_of(spark, sf_dir)
    return timeline.text_frame_counts(spine_of(spark, sf_dir), found, tracks.smooth_timeline(found, CFG, 12))


@query("f09_exclude_runs", f"WITH {TRUTH} SELECT clip_id, frame, run FROM line WHERE run NOT IN (0, 2)")
def f09(spark, sf_dir):
    return timeline.exclude_runs(timeline_of(spark, sf_dir), spark.createDataFrame([(0,), (2,)], "run int")).select("clip_id", "frame", "run")


@query("f13_visible_regions", f"WITH {TRUTH} SELECT clip_id, frame, run FROM line WHERE run <> 1")
def f13(spark, sf_dir):
    return timeline.exclude_runs(timeline_of(spark, sf_dir), spark.createDataFrame([(1,)], "run int")).select("clip_id", "frame", "run")


@query("w06_text_islands", f"WITH {TRUTH}, f AS (SELECT DISTINCT clip_id, frame FROM line), g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM f) SELECT clip_id, min(frame) AS start, max(frame) AS \"end\" FROM g GROUP BY clip_id, g")
def w06(spark, sf_dir):
    return timeline.text_islands(timeline_of(spark, sf_dir))


@query("w09_next_text_run", f"WITH {TRUTH}, f AS (SELECT DISTINCT clip_id, frame FROM line), g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM f), i AS (SELECT clip_id, min(frame) AS start FROM g GROUP BY clip_id, g) SELECT clip_id, coalesce(min(CASE WHEN start > 100 THEN start END), min(start)) AS next FROM i GROUP BY clip_id")
def w09(spark, sf_dir):
    return timeline.next_island(timeline.text_islands(timeline_of(spark, sf_dir)), 100)


@query("w10_run_at", f"WITH {TRUTH} SELECT clip_id, frame, arg_min(run, (CASE WHEN run % 2 = 0 THEN 1000000 ELSE 0 END) + run) AS run FROM line GROUP BY clip_id, frame")
def w10(spark, sf_dir):
    """Even runs are excluded."""
    return timeline.run_at(timeline_of(spark, sf_dir), _every_run(spark, sf_dir, "run % 2 = 0"))


@query("w07_hold_stride", f"WITH {TRUTH}, {SPINE} SELECT s.clip_id, s.frame, (SELECT count(*) FROM regs r WHERE r.clip_id = s.clip_id AND r.frame = s.frame - s.frame % 3) AS n_regions FROM spine s")
def w07(spark, sf_dir):
    """Every third frame is read; the others take over its list, an empty one too."""
    return timeline.hold_stride(spine_of(spark, sf_dir), timeline.every(regions_of(spark, sf_dir), 3), 3).select("clip_id", "frame", F.size("regions").cast("long").alias("n_regions"))


@query("f10_ocr_stride", f"WITH {DETS} SELECT clip_id, frame, count(*) AS n FROM dets WHERE frame % 4 = 0 GROUP BY ALL")
def f10(spark, sf_dir):
    return timeline.every(dets_of(spark, sf_dir), 4).groupBy("clip_id", "frame").agg(F.count("*").alias("n"))


@query("f11_max_frames", f"WITH {DETS} SELECT clip_id, count(*) AS n FROM dets WHERE frame < 200 GROUP BY ALL")
def f11(spark, sf_dir):
    return timeline.first_frames(dets_of(spark, sf_dir), 200).groupBy("clip_id").agg(F.count("*").alias("n"))


@query("j02_timeline_lookup", f"WITH {TRUTH}, {SPINE} SELECT s.clip_id, s.frame, count(l.run) AS n_regions FROM spine s LEFT JOIN line l USING (clip_id, frame) GROUP BY ALL")
def j02(spark, sf_dir):
    return timeline.lookup(spine_of(spark, sf_dir), timeline_of(spark, sf_dir)).select("clip_id", "frame", F.size("regions").cast("long").alias("n_regions"))


@query("l03_debug_limit", f"WITH {TRUTH}, f AS (SELECT DISTINCT clip_id, frame FROM line) SELECT clip_id, frame FROM f QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame) <= 5")
def l03(spark, sf_dir):
    return timeline.debug_frames(timeline_of(spark, sf_dir), 5)


@query("a05_dets_dedupe", f"WITH {DETS} SELECT clip_id, frame, count(DISTINCT (x0, y0, x1, y1)) AS n FROM dets GROUP BY ALL")
def a05(spark, sf_dir):
    rows = dets_of(spark, sf_dir).groupBy("clip_id", "frame").agg(F.collect_list(regions.box_of_row()).alias("d"))
    return rows.select("clip_id", "frame", F.size(F.array_distinct(F.concat("d", "d"))).cast("long").alias("n"))


@query("f08_recognised_filter", f"WITH {TRUTH} SELECT clip_id, first_frame, first_ord FROM runs WHERE (first_frame // 60) % 3 <> 0")
def f08(spark, sf_dir):
    """Readings are made up: one third of the tracks is read as gibberish, one well, the others not at all."""
    kept = tracks.surviving_tracks(tracks.track_stats(tracked_of(spark, sf_dir)), CFG, 12)
    reading = kept.where("first_frame div 60 % 3 < 2").select(*tracks.TRACK, F.lit(0).alias("det_ord"), F.when(F.expr("first_frame div 60 % 3 = 0"), " x ").otherwise("text").alias("text"), F.lit(0.9).alias("score"))
    return tracks.recognised(kept, reading, CFG).select(*tracks.TRACK)


@query("a20_best_recognition", "SELECT l_orderkey AS track, l_linestatus || l_returnflag AS text, l_quantity / 100 AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_linestatus || l_returnflag DESC) = 1")
def a20(spark, sf_dir):
    """Lines of an order stand for the crops of a track; the first of equal scores counts."""
    crops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("det_ord"), F.concat("l_linestatus", "l_returnflag").alias("text"), (F.col("l_quantity") / 100).alias("score"))
    return tracks.best_readings(crops, ["track"]).select("track", "best.text", "best.score")


#: About so many detections, of whole clips, are worked on at once, and only their regions and shuffles are on the disks.
AT_ONCE = 5_000_000


def write_documents(spark: SparkSession, sf_dir: str, folder: str, of_clips: Column) -> DataFrame:
    """Adds the documents of some clips to those in the folder; all that are there now."""
    raw = stored(regions.frame_regions(dets_of(spark, sf_dir).where(of_clips), CFG, FRAME), f"{folder}/regions")
    found = tracks.smooth_timeline(raw, CFG, 12)
    docs = stored(timeline.documents(found, spine_of(spark, sf_dir).where(of_clips), (4, 1), raw, 12), f"{folder}/documents", "append")
    removed(spark, f"{folder}/regions")
    return docs


@query("s13_timeline_write", f"WITH {TRUTH}, {SPINE}, k AS (SELECT clip_id, count(*) AS n_regions, min(run) AS lo, max(run) AS hi, count(DISTINCT frame) AS text_frames FROM line GROUP BY clip_id) SELECT c.clip_id, coalesce(n_regions, 0) AS n_regions, lo, hi, coalesce(k.text_frames, 0) AS text_frames, (SELECT count(DISTINCT frame) FROM regs r WHERE r.clip_id = c.clip_id) AS raw_text_frames, 12 AS min_track, '1,4' AS excluded FROM (SELECT DISTINCT clip_id FROM spine) c LEFT JOIN k USING (clip_id)")
def s13(spark, sf_dir):
    """Documents are written and read again; a region is lost nowhere, nor is what else they say."""
    folder = shared_folder(spark, "timelines")
    parts = 1 + dets_of(spark, sf_dir).count() // AT_ONCE
    for part in range(parts):
        docs = write_documents(spark, sf_dir, folder, F.pmod(F.xxhash64("clip_id"), F.lit(parts)) == part)
    saved = docs.select("clip_id", "document", F.from_json("document", "struct<raw_text_frames:bigint,text_frames:bigint,min_track:int>").alias("d"))
    read = timeline.read_documents(docs).groupBy("clip_id").agg(F.count("*").alias("n_regions"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    states = timeline.document_states(docs).where("note is null").select("clip_id", F.array_join("excluded", ",").alias("excluded"))
    joined = saved.join(states, "clip_id").join(read, "clip_id", "left")
    return joined.select("clip_id", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), "lo", "hi", "d.text_frames", "d.raw_text_frames", "d.min_track", "excluded")


@query("u03_depth_tail", "SELECT o_orderkey AS frame, o_orderkey < 500 AS edited FROM orders")
def u03(spark, sf_dir):
    depth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    return timeline.with_tail(depth.where("frame < 500"), depth, ["frame"])


@query("w08_lane_pack")
def w08(spark, sf_dir):
    return timeline.lane_pack(timeline.run_spans(timeline_of(spark, sf_dir), None))


#: Each detection with the next of its frame, found in one scan.
NEXT = f"WITH {DETS}, n AS (SELECT clip_id, frame, det_ord, x0, y0, x1, y1, lead(x0) OVER w AS bx0, lead(y0) OVER w AS by0, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1 FROM dets WINDOW w AS (PARTITION BY clip_id, frame ORDER BY det_ord)), p AS (SELECT * FROM n WHERE bx0 IS NOT NULL)"


@query("p08_iou", f"{NEXT}, m AS (SELECT clip_id, frame, det_ord, least(x1, bx1 - 100) - greatest(x0, bx0 - 100) AS w, least(y1, by1) - greatest(y0, by0) AS h, (x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) AS areas FROM p) SELECT clip_id, frame, det_ord, CASE WHEN w > 0 AND h > 0 THEN round(CAST(w * h AS DOUBLE) / (areas - w * h), 9) ELSE 0.0 END AS iou FROM m")
def p08(spark, sf_dir):
    """Each detection with the next of its frame, moved 100 pixels to the left."""
    w = Window.partitionBy("clip_id", "frame").orderBy("det_ord")
    rows = dets_of(spark, sf_dir).withColumn("a", regions.box_of_row()).withColumn("b", F.lead("a").over(w)).where("b is not null")
    moved = boxes.box(F.col("b.x0") - 100, F.col("b.y0"), F.col("b.x1") - 100, F.col("b.y1"))
    return rows.select("clip_id", "frame", "det_ord", F.round(boxes.iou(F.col("a"), moved), 9).alias("iou"))


@query("p05_stabilise", f"WITH {DETS} SELECT clip_id, frame, det_ord, {SNAP} FROM dets")
def p05(spark, sf_dir):
    return dets_of(spark, sf_dir).select("clip_id", "frame", "det_ord", boxes.stabilise(regions.box_of_row(), CFG, FRAME).alias("b")).select("clip_id", "frame", "det_ord", "b.*")


@query("p06_overlaps", f"{NEXT} SELECT clip_id, frame, det_ord, bx0 <= x1 + 10 AND x0 <= bx1 + 10 AND by0 <= y1 + 10 AND y0 <= by1 + 10 AS touch FROM p")
def p06(spark, sf_dir):
    w = Window.partitionBy("clip_id", "frame").orderBy("det_ord")
    rows = dets_of(spark, sf_dir).withColumn("a", regions.box_of_row()).withColumn("b", F.lead("a").over(w)).where("b is not null")
    return rows.select("clip_id", "frame", "det_ord", boxes.overlaps(F.col("a"), F.col("b"), 10).alias("touch"))


@query("p07_box_union", f"{NEXT} SELECT clip_id, frame, det_ord, least(x0, bx0) AS x0, least(y0, by0) AS y0, greatest(x1, bx1) AS x1, greatest(y1, by1) AS y1 FROM p")
def p07(spark, sf_dir):
    w = Window.partitionBy("clip_id", "frame").orderBy("det_ord")
    rows = dets_of(spark, sf_dir).withColumn("a", regions.box_of_row()).withColumn("b", F.lead("a").over(w)).where("b is not null")
    return rows.select("clip_id", "frame", "det_ord", boxes.union(F.col("a"), F.col("b")).alias("u")).select("clip_id", "frame", "det_ord", "u.*")


@query("p12_map_box", f"WITH {DETS} SELECT clip_id, frame, det_ord, CAST(least(greatest(floor(x0 * 1024 / 1920.0), 0), 1024) AS BIGINT) AS x0, CAST(least(greatest(floor(y0 * 1024 / 1920.0 + 96), 0), 768) AS BIGINT) AS y0, CAST(least(greatest(floor(x0 * 1024 / 1920.0) + 1, ceil(x1 * 1024 / 1920.0), 0), 1024) AS BIGINT) AS x1, CAST(least(greatest(floor(y0 * 1024 / 1920.0 + 96) + 1, ceil(y1 * 1024 / 1920.0 + 96), 0), 768) AS BIGINT) AS y1 FROM dets")
def p12(spark, sf_dir):
    """1920 x 1080 fitted into 1024 x 768."""
    al = boxes.alignment(F.lit(1920), F.lit(1080), F.lit(1024), F.lit(768), F.lit("fit"))
    rows = dets_of(spark, sf_dir).withColumn("al", al)
    return rows.select("clip_id", "frame", "det_ord", boxes.map_box(regions.box_of_row(), F.col("al"), F.lit(1024), F.lit(768)).alias("m")).select("clip_id", "frame", "det_ord", "m.*")


@query("s14_timeline_read", "SELECT p_partkey AS clip_id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 200 END::BIGINT AS x1, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS score, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE -1 END AS run FROM part WHERE p_partkey % 3 < 2")
def s14(spark, sf_dir):
    """A third of the documents is as they are now, a third has bare boxes, a third has no version and is refused."""
    now = F.concat(F.lit('{"version":1,"regions":[[],[{"box":[0,0,'), "p_size", F.lit(',9],"score":0.5,"run":4}]]}'))
    kind = F.col("p_partkey") % 3
    document = F.when(kind == 0, now).when(kind == 1, '{"version":1,"regions":[[[0,0,200,100]]]}').otherwise('{"regions":[[[0,0,1,1]]]}')
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip_id"), document.alias("document"))
    return timeline.read_documents(docs).select("clip_id", "x1", "score", "run")


@query("t01_track_state", f"WITH {TRUTH} SELECT r.clip_id, r.frame, r.item_ord, t.first_frame, t.first_ord FROM regs r JOIN {TRACK_OF} t USING (clip_id, cap_id)")
def t01(spark, sf_dir):
    """All clips as a stream of files; each file is a micro-batch of later frames."""
    from glyphframe.streaming.tracking import replayed_links

    return replayed_links(regions_of(spark, sf_dir), 400, CFG).select("clip_id", "frame", "item_ord", "first_frame", "first_ord")
