import numpy as np
import pytest

from glyphframe.config import CompositeConfig
from glyphframe.operators import pixels
from glyphframe.streaming.mask_cache import Limits, step


def test_grow_is_monotonic_and_fractional():
    plane = np.zeros((21, 21))
    plane[8:13, 8:13] = 1
    sizes = [pixels.grow(plane, a).sum() for a in (-1.0, -0.5, 0.0, 0.3, 0.7, 1.0, 1.5, 2.0)]
    assert sizes == sorted(sizes)
    assert sizes[2] == 25


def test_feather_keeps_mass_and_range():
    plane = np.zeros((31, 31))
    plane[10:20, 10:20] = 1
    soft = pixels.feather(plane, 1.5)
    assert soft.sum() == pytest.approx(plane.sum(), rel=1e-6)
    assert 0 <= soft.min() and soft.max() <= 1 + 1e-12


def test_labels_join_diagonals():
    mask = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    got = pixels.labels(mask)
    assert got[0, 0] == got[1, 1] == got[0, 2] != 0
    assert len(set(got[mask])) == 3
    assert set(pixels.labels(np.ones((2, 2), bool)).ravel()) == {1}


def test_gate_keeps_strokes_at_detections():
    prob = np.zeros((100, 200))
    prob[20:40, 20:60] = prob[60:80, 150:180] = 1
    kept = pixels.gate(prob, (500, 300, 700, 400), [(515, 315, 565, 345)])
    assert kept[20:40, 20:60].all() and not kept[60:80, 150:180].any()
    assert (pixels.gate(prob, (0, 0, 200, 100), []) == prob).all()


@pytest.mark.parametrize(("text", "ground", "expected"), [(220, 100, 220), (30, 200, 30)])
def test_level_is_read_from_the_map(text, ground, expected):
    depth = np.full((40, 120), ground * 257)
    alpha = np.zeros((40, 120))
    alpha[15:25, 20:100] = 1
    depth[15:25, 20:100] = text * 257
    assert pixels.text_level(depth, alpha, CompositeConfig(), 65535) == expected * 257


def test_composite_leaves_the_rest_alone():
    rng = np.random.default_rng(0)
    depth = rng.integers(0, 65536, (60, 80))
    prob = np.zeros((60, 80))
    prob[20:30, 20:60] = 1
    out = pixels.composite(depth, prob, [(10, 10, 70, 40)])
    untouched = pixels.alpha_of(prob) == 0
    assert (out[untouched] == depth[untouched]).all() and (out != depth).any()
    assert (pixels.composite(depth, np.zeros_like(prob), []) == depth).all()


def test_bars_of_a_letterbox():
    frame = np.zeros((768, 100))
    frame[96:672] = 200
    assert pixels.bar_extent([frame, frame, np.zeros_like(frame)], 0) == (96, 96)
    assert pixels.bar_extent([np.zeros((4, 4))], 0) == (0, 0)


def test_warp_keeps_mass_in_place():
    mask = np.zeros((10, 10))
    mask[4:6, 4:6] = 1
    out = pixels.warp(mask, 2, 2, 0, 0, 20, 20)
    assert out[8:11, 8:11].min() == 1 and out[:6].max() == 0


def test_cache_entries_go_only_when_something_is_put():
    gray, mask, box, other = np.arange(64.0).reshape(8, 8), np.ones((8, 8)), (0, 0, 8, 8), (1, 0, 9, 8)
    records, hit = step({}, box, gray, mask, 0, Limits())
    assert not hit and set(records) == {box}
    records, hit = step(records, box, gray + 7, mask, 20, Limits())
    assert hit, "brighter as a whole, and stale but still there"
    assert records[box].gray is gray and records[box].used == 20
    assert not step(records, box, gray[::-1] * 3, mask, 21, Limits())[1]
    records, _ = step(records, other, gray, mask, 60, Limits())
    assert set(records) == {other} and not step(records, box, gray, mask, 61, Limits())[1]


def test_cache_compares_near_strokes_or_all_without_any():
    gray, mask, box = np.zeros((20, 20)), np.zeros((20, 20)), (0, 0, 20, 20)
    mask[8:12, 8:12] = 1
    records, _ = step({}, box, gray, mask, 0, Limits(margin=2))
    far, at = gray.copy(), gray.copy()
    far[:3] = 200
    at[9, 9:11] = 200
    assert step(records, box, far, mask, 1, Limits(margin=2))[1], "what moves away from the strokes is nothing"
    assert not step(records, box, at, mask, 1, Limits(margin=2))[1]
    empty, _ = step({}, box, gray, mask * 0, 0, Limits(margin=2))
    assert not step(empty, box, far, mask, 1, Limits(margin=2))[1], "without strokes all is compared"
    # Each sample is levelled by its own median, which isn't the median of the difference.
    records, _ = step({}, box, np.tile([0.0, 0.0, 10.0, 10.0], (20, 5)), mask * 0, 0, Limits(tolerance=5.5))
    assert step(records, box, np.tile([0.0, 0.0, 0.0, 30.0], (20, 5)), mask, 1, Limits(tolerance=9.0))[1] is False


def flooded(mask):
    """Parts by flood fill, 8-connected, as sets of pixels."""
    left, parts = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for q in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        parts.append(part)
    return parts


def test_labels_and_gate_against_flood_fill():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.3, 0.5, 0.9):
        prob = (rng.random((15, 22)) < share) * rng.uniform(0.6, 1, (15, 22))
        parts = flooded(prob > 0.5)
        got = pixels.labels(prob > 0.5)
        assert got.max() == len(parts) and (got[prob <= 0.5] == 0).all()
        assert all(len({got[p] for p in part}) == 1 for part in parts)
        det, reach = (105, 53, 112, 60), 2
        inside = {(y, x) for y in range(15) for x in range(22) if any(det[0] - 100 <= x + dx < det[2] - 100 and det[1] - 50 <= y + dy < det[3] - 50 for dy, dx in pixels.disc(reach))}
        want = np.zeros_like(prob)
        for part in parts:
            if len(part & inside) >= 0.5 * len(part):
                for p in part:
                    want[p] = prob[p]
        assert (pixels.gate(prob, (100, 50, 122, 65), [det], dilate=reach) == want).all()


def test_healing_ring_by_ring():
    rng = np.random.default_rng(2)
    depth, alpha = rng.uniform(0, 100, (12, 14)), np.zeros((12, 14))
    alpha[5:7, 5:9] = 1
    ring = {(y, x) for y in range(12) for x in range(14) if any(0 <= y + dy < 12 and 0 <= x + dx < 14 and alpha[y + dy, x + dx] > 0.15 for dy, dx in pixels.disc(2))}
    want = {(y, x): depth[y, x] for y in range(12) for x in range(14) if (y, x) not in ring}
    while ring:
        fresh = {}
        for y, x in ring:
            around = [(want[y + dy, x + dx], np.hypot(dy, dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (y + dy, x + dx) in want]
            if around:
                fresh[y, x] = sum(v / d for v, d in around) / sum(1 / d for _, d in around)
        want |= fresh
        ring -= set(fresh)
    assert pixels.heal(depth, alpha, 2) == pytest.approx(np.array([[want[y, x] for x in range(14)] for y in range(12)]))


def test_compositing_pixel_by_pixel_and_with_healing():
    rng = np.random.default_rng(3)
    depth, prob = rng.integers(0, 60000, (30, 50)), np.zeros((30, 50))
    prob[8:14, 5:20] = prob[18:26, 28:44] = 0.9
    boxes, plain = [(2, 4, 24, 17), (25, 15, 48, 29)], CompositeConfig(dilate=0, feather=0)
    got = pixels.composite(depth, prob, boxes, plain)
    alpha = np.clip((prob - plain.mask_low) / (plain.mask_high - plain.mask_low), 0, 1)
    want = depth.copy()
    for x0, y0, x1, y1 in boxes:
        level = pixels.text_level(depth[y0:y1, x0:x1].astype(float), alpha[y0:y1, x0:x1], plain, 65535)
        for y in range(y0, y1):
            for x in range(x0, x1):
                want[y, x] = int(min(max(depth[y, x] * (1 - alpha[y, x]) + level * alpha[y, x], 0), 65535))
    assert (got == want).all()
    halo = CompositeConfig(dilate=0, feather=0, heal=True, heal_radius=3, text_value=200)
    healed = pixels.composite(depth, prob, boxes, halo)
    ring = pixels.spread((alpha > 0.15).astype(float), 3) > 0
    assert (healed[~ring] == depth[~ring]).all() and (healed[alpha == 1] == int(200 / 255 * 65535)).all()
    assert (healed[ring & (alpha == 0)] != depth[ring & (alpha == 0)]).mean() > 0.9


def test_tiles_of_few_samples_taper_to_their_middle(spark):
    from pyspark.sql import functions as F

    from glyphframe.functions import media
    from glyphframe.operators import models

    for n, edge in ((1, 8), (4, 8), (5, 8), (40, 8), (6, 0)):
        steps = min(edge, n // 2)
        want = [(k + 1) / (steps + 1) for k in range(steps)]
        want = [*want, *[1.0] * (n - 2 * steps), *want[::-1]]
        assert models.ramp(n, edge) == pytest.approx(want)
        assert spark.range(1).select(media.taper(F.lit(n), edge).alias("w")).first().w == pytest.approx(want)


def test_lanes_are_first_fit(spark):
    from glyphframe.operators import timeline

    rng = np.random.default_rng(4)
    spans = [(c, r, int(a), int(a + n)) for c in range(3) for r, (a, n) in enumerate(zip(np.sort(rng.integers(0, 60, 25)), rng.integers(0, 15, 25), strict=True))]
    got = {(r.clip_id, r.run): r.lane for r in timeline.lane_pack(spark.createDataFrame(spans, "clip_id long, run int, start long, end long")).collect()}
    taken = {}
    for clip, run, start, end in spans:
        lane = next(k for k in range(99) if not any(b >= start for a, b in taken.get((clip, k), ())))
        taken.setdefault((clip, lane), []).append((start, end))
        assert got[clip, run] == lane
