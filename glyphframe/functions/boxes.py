"""Boxes and polygons as column expressions. A box is a struct of x0, y0, x1, y1; x1 and y1 lie outside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphframe.config import FrameSize, RegionConfig

#: Fixed value: how far the hue moves from one run to the next.
GOLDEN = 0.61803398875
BOX = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[_col(c).cast("bigint").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]).cast("bigint") * (b["y1"] - b["y0"]).cast("bigint")


def overlaps(a: Column, b: Column, gap: int = 0) -> Column:
    """Whether two boxes come within gap of each other; boxes that touch do."""
    return (b["x0"] <= a["x1"] + gap) & (a["x0"] <= b["x1"] + gap) & (b["y0"] <= a["y1"] + gap) & (a["y0"] <= b["y1"] + gap)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Shared area over the area of both; 0 for boxes that are apart or only touch."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    shared = (w * h).cast("double")
    return F.when((w > 0) & (h > 0), shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def stabilise(b: Column, cfg: RegionConfig = RegionConfig(), frame: FrameSize = FrameSize()) -> Column:
    """The box with a margin, snapped outwards to the grid and clamped to the frame."""
    g = max(1, cfg.grid)
    down = lambda c: F.floor((c - cfg.pad) / g) * g
    up = lambda c: F.ceil((c + cfg.pad) / g) * g
    return box(F.greatest(F.lit(0), down(b["x0"])), F.greatest(F.lit(0), down(b["y0"])), F.least(F.lit(frame.width), up(b["x1"])), F.least(F.lit(frame.height), up(b["y1"])))


def poly_box(poly: Column) -> Column:
    """The least box of whole pixels around a polygon, an array of structs x, y."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return box(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys)))


def poly_tilt(poly: Column) -> Column:
    """Degrees from 0 to 90 between the horizontal and a polygon's direction: a quad's first edge, or else the longest
    edge, the first of equals."""
    n = F.size(poly)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (F.get(poly, (i + 1) % n)["x"] - F.get(poly, i)["x"]).cast("double").alias("dx"),
            (F.get(poly, (i + 1) % n)["y"] - F.get(poly, i)["y"]).cast("double").alias("dy"),
            i.alias("i"),
        ),
    )
    longest = F.array_max(F.transform(edges, lambda e: F.struct((e["dx"] * e["dx"] + e["dy"] * e["dy"]).alias("l"), (-e["i"]).alias("i"), e["dx"].alias("dx"), e["dy"].alias("dy"))))
    dx, dy = F.when(n == 4, F.get(edges, F.lit(0))["dx"]).otherwise(longest["dx"]), F.when(n == 4, F.get(edges, F.lit(0))["dy"]).otherwise(longest["dy"])
    return F.abs(F.pmod(F.degrees(F.atan2(dy, dx)) + 90, F.lit(180.0)) - 90)


def in_roi(b: Column, roi: tuple[float, float, float, float] | None, frame: FrameSize = FrameSize()) -> Column:
    """Whether a box's centre lies in a part of the frame, given by shares of it; the edges belong to it."""
    if roi is None:
        return F.lit(True)
    x, y = (b["x0"] + b["x1"]) / 2.0, (b["y0"] + b["y1"]) / 2.0
    return x.between(roi[0] * frame.width, roi[2] * frame.width) & y.between(roi[1] * frame.height, roi[3] * frame.height)


def roi_of(text: Column) -> Column:
    """Four shares x0,y0,x1,y1 that a text names, as a struct; null unless there are four and each pair is in order."""
    shares = F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))
    x0, y0, x1, y1 = (F.get(shares, F.lit(k)) for k in range(4))
    right = (F.size(shares) == 4) & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)
    return F.when(right, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def large_enough(b: Column, cfg: RegionConfig = RegionConfig()) -> Column:
    return (b["y1"] - b["y0"] >= cfg.min_height) & (area(b) >= cfg.min_area)


def alignment(rgb_w, rgb_h, depth_w, depth_h, mode: Column) -> Column:
    """struct sx, sy, tx, ty that maps RGB pixels to depth pixels: stretched, fitted inside or filling, centred."""
    rw, rh, dw, dh = (_col(c).cast("double") for c in (rgb_w, rgb_h, depth_w, depth_h))
    sx, sy = dw / rw, dh / rh
    unknown = F.raise_error(F.concat(F.lit("unknown alignment: "), mode)).cast("double")
    pick = lambda stretch: F.when(mode == "stretch", stretch).when(mode == "fit", F.least(sx, sy)).when(mode == "fill", F.greatest(sx, sy)).otherwise(unknown)
    kx, ky = pick(sx), pick(sy)
    return F.struct(kx.alias("sx"), ky.alias("sy"), ((dw - rw * kx) / 2).alias("tx"), ((dh - rh * ky) / 2).alias("ty"))


def map_box(b: Column, al: Column, depth_w, depth_h) -> Column:
    """A box in depth pixels: at least one pixel before it is clamped, at both ends, to the frame. A box outside is empty."""
    dw, dh = _col(depth_w).cast("bigint"), _col(depth_h).cast("bigint")
    x0, y0 = F.floor(b["x0"] * al["sx"] + al["tx"]), F.floor(b["y0"] * al["sy"] + al["ty"])
    x1 = F.greatest(x0 + 1, F.ceil(b["x1"] * al["sx"] + al["tx"]))
    y1 = F.greatest(y0 + 1, F.ceil(b["y1"] * al["sy"] + al["ty"]))
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return box(clamp(x0, dw), clamp(y0, dh), clamp(x1, dw), clamp(y1, dh))


def run_colour(run: Column) -> Column:
    """struct h, s, v: hues a golden ratio apart."""
    return F.struct(F.pmod(run * F.lit(GOLDEN), F.lit(1.0)).alias("h"), F.lit(0.62).alias("s"), F.lit(0.92).alias("v"))
