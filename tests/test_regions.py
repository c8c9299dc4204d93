import random

import pytest
from pyspark.sql import functions as F

from glyphframe.config import FrameSize, RegionConfig, resolve_min_track
from glyphframe.functions import boxes
from glyphframe.operators import regions, timeline, tracks

DETS = "clip_id long, frame long, det_ord int, x0 long, y0 long, x1 long, y1 long, score double, tilt double"


def boxed(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], "x0 long, y0 long, x1 long, y1 long").select(F.struct("*").alias("b"))


def timeline_of(spark, frames, **cfg):
    """frames: a list of lists of (box, score)."""
    rows = [(0, f, o, *b, [b], s, -1) for f, items in enumerate(frames) for o, (b, s) in enumerate(items)]
    found = tracks.smooth_timeline(spark.createDataFrame(rows, regions.REGIONS), RegionConfig(**cfg))
    out = {}
    for r in found.collect():
        out.setdefault(r.frame, []).append(((r.x0, r.y0, r.x1, r.y1), r.run))
    return out


def test_merge_takes_words_of_a_line_together():
    near = regions.merge([(0, (0, 0, 50, 20), (), 0.4, -1), (1, (60, 0, 100, 20), (), 0.8, -1)], 24)
    assert [(m[1], m[3]) for m in near] == [((0, 0, 100, 20), 0.8)]
    assert len(regions.merge([(0, (0, 0, 50, 20), (), 1.0, -1), (1, (400, 0, 450, 20), (), 1.0, -1)], 24)) == 2
    assert len(regions.merge([(0, (0, 0, 50, 20), (), 1.0, -1), (1, (50, 0, 90, 20), (), 1.0, -1)], 0)) == 1, "touching boxes merge"


def test_merge_does_not_depend_on_order():
    rng = random.Random(3)
    for _ in range(200):
        items = []
        for o in range(rng.randint(1, 9)):
            x, y = rng.randrange(120), rng.randrange(60)
            items.append((o, (x, y, x + rng.randint(1, 40), y + rng.randint(1, 20)), (), rng.random(), rng.randint(-1, 3)))
        expected = sorted(m[1:2] + m[3:] for m in regions.merge(items, 4))
        rng.shuffle(items)
        assert sorted(m[1:2] + m[3:] for m in regions.merge(items, 4)) == expected


@pytest.mark.parametrize(("box", "cfg", "frame", "expected"), [((100, 100, 200, 140), RegionConfig(pad=10), FrameSize(), (80, 80, 224, 160)), ((5, 5, 100, 60), RegionConfig(pad=40), FrameSize(320, 180), (0, 0, 144, 112))])
def test_stabilise(spark, box, cfg, frame, expected):
    assert tuple(boxed(spark, box).select(boxes.stabilise(F.col("b"), cfg, frame).alias("s")).first().s) == expected
    assert regions.snap(box, cfg, frame) == expected


def test_roi_keeps_what_lies_inside(spark):
    rows = boxed(spark, (100, 100, 300, 140), (100, 900, 300, 940)).where(boxes.in_roi(F.col("b"), (0, 0.7, 1, 1))).collect()
    assert [r.b.y0 for r in rows] == [900]


def test_tilt_of_turned_quads(spark):
    import math

    for turn, expected in [(0, 0), (3, 3), (12, 12), (30, 30), (-8, 8), (90, 90), (180, 0), (271, 89)]:
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        poly = [(x * c - y * s, x * s + y * c) for x, y in ((0, 0), (100, 0), (100, 20), (0, 20))]
        got = spark.createDataFrame([(poly,)], "p array<struct<x:double,y:double>>").select(boxes.poly_tilt(F.col("p")).alias("t")).first().t
        assert got == pytest.approx(expected, abs=1e-6), turn


def test_alignment_fits_and_maps(spark):
    al = boxes.alignment(F.lit(1920), F.lit(1080), F.lit(1024), F.lit(768), F.lit("fit"))
    mapped = boxed(spark, (0, 0, 1920, 1080), (-500, 10, -400, 20)).select(boxes.map_box(F.col("b"), al, F.lit(1024), F.lit(768)).alias("m")).collect()
    assert tuple(mapped[0].m) == (0, 96, 1024, 672)
    assert mapped[1].m.x0 == mapped[1].m.x1, "a box outside is empty"


def test_half_a_second():
    assert [resolve_min_track(RegionConfig(), f) for f in (24, 25, 60, 1)] == [12, 12, 30, 2]
    assert resolve_min_track(RegionConfig(min_track=0), 24) == 1


B = (100, 100, 400, 160)


def test_single_frames_go_and_short_holes_are_bridged(spark):
    assert timeline_of(spark, [[], [(B, 1.0)], []]) == {}
    assert sorted(timeline_of(spark, [[(B, 1.0)], [], [(B, 1.0)]])) == [0, 1, 2]
    far = timeline_of(spark, [[(B, 1.0)], *[[]] * 8, [(B, 1.0)]])
    assert sorted(far) == [0, 9]


def test_jitter_gives_one_box(spark):
    frames = [[((400, 896, 1152, 992 + 16 * (f % 2)), 1.0)] for f in range(12)]
    assert {b for items in timeline_of(spark, frames).values() for b, _ in items} == {(400, 896, 1152, 1008)}


def test_scores_judge_a_track_by_its_best(spark):
    fade = [[(B, s)] for s in (0.35, 0.35, 0.93, 0.93, 0.35, 0.35)]
    assert len(timeline_of(spark, fade)) == 6
    weak = [[(B, 0.42)]] * 20
    assert timeline_of(spark, weak) == {}
    assert len(timeline_of(spark, weak, track_score=0)) == 20


def test_two_tracks_have_two_runs(spark):
    other = (1400, 600, 1700, 660)
    found = timeline_of(spark, [[(B, 1.0), (other, 1.0)]] * 20)
    assert {(b, r) for items in found.values() for b, r in items} == {(B, 0), (other, 1)}


@pytest.mark.parametrize(("step", "kept"), [(0, 20), (12, 0)])
def test_what_moves_goes(spark, step, kept):
    frames = [[((100 + step * f, 100, 400 + step * f, 160), 1.0)] for f in range(20)]
    assert len(timeline_of(spark, frames)) == kept


def test_islands_split_without_a_change(spark):
    frames = [[(B, 1.0)]] * 12 + [[]] * 13 + [[(B, 1.0)]] * 12
    assert {r for items in timeline_of(spark, frames).values() for _, r in items} == {0, 1}


def test_documents_round_trip_and_old_entries(spark):
    rows = [(0, 1, 0, *B, [B], 0.93456, 2)]
    found = spark.createDataFrame(rows, regions.REGIONS)
    spine = spark.createDataFrame([(0, f) for f in range(3)], "clip_id long, frame long")
    read = timeline.read_documents(timeline.documents(found, spine)).collect()
    assert [(r.frame, (r.x0, r.y0, r.x1, r.y1), r.score, r.run) for r in read] == [(1, B, 0.9346, 2)]
    old = spark.createDataFrame([(1, '{"version": 1, "regions": [[[0, 0, 200, 100]], []]}'), (2, '{"regions": [[[0, 0, 2, 1]]]}'), (3, "broken")], "clip_id long, document string")
    read = timeline.read_documents(old).collect()
    assert [(r.clip_id, r.x1, len(r.dets), r.score, r.run) for r in read] == [(1, 200, 1, 1.0, -1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DETS)
    assert tracks.timeline(none).count() == 0
