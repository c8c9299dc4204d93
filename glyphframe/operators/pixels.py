"""Kernels over planes. A plane is a row with h, w and its samples in row order as an array; kernels are numpy on one
plane, and run in Arrow batches of rows. What numpy has no element for (ellipses, labels) is written out here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.config import CompositeConfig

Box = tuple[int, int, int, int]


def disc(radius: int) -> np.ndarray:
    """Offsets (dy, dx) of an elliptical element of 2 * radius + 1 pixels: each row as wide as the circle there."""
    rows = np.arange(-radius, radius + 1)
    half = np.round(np.sqrt(np.maximum(radius * radius - rows * rows, 0))).astype(int)
    return np.array([(y, x) for y, h in zip(rows, half, strict=True) for x in range(-h, h + 1)])


def spread(plane: np.ndarray, radius: int, largest: bool = True) -> np.ndarray:
    """The largest (or least) value under the element at each pixel; what lies outside the plane has no part."""
    if radius <= 0:
        return plane
    edge = -np.inf if largest else np.inf
    padded = np.pad(plane.astype(float), radius, constant_values=edge)
    h, w = plane.shape
    out = np.full((h, w), edge)
    pick = np.maximum if largest else np.minimum
    for dy, dx in disc(radius):
        out = pick(out, padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w])
    return out


def grow(alpha: np.ndarray, amount: float) -> np.ndarray:
    """Thicker (or thinner) by a part of a pixel: a blend of the two whole amounts around it."""
    whole = int(np.ceil(abs(amount)))
    if not whole:
        return alpha
    share = abs(amount) - (whole - 1)
    return (1 - share) * spread(alpha, whole - 1, amount > 0) + share * spread(alpha, whole, amount > 0)


def feather(alpha: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur of radius 3 sigma, mirrored at the edges without repeating them."""
    if sigma <= 0:
        return alpha
    radius = max(1, round(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = alpha.astype(float)
    for axis in (0, 1):
        width = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        mode = "reflect" if out.shape[axis] > radius else "edge"
        padded = np.pad(out, width, mode=mode)
        n = out.shape[axis]
        out = sum(wt * np.take(padded, np.arange(k, k + n), axis=axis) for k, wt in enumerate(weights))
    return out


def alpha_of(prob: np.ndarray, cfg: CompositeConfig = CompositeConfig()) -> np.ndarray:
    if cfg.binary:
        alpha = (prob >= cfg.mask_high).astype(float)
    else:
        top = max(cfg.mask_high, cfg.mask_low + 1e-3)
        alpha = np.clip((prob - cfg.mask_low) / (top - cfg.mask_low), 0, 1)
    alpha = feather(grow(alpha, cfg.dilate), cfg.feather)
    return np.clip(alpha * np.clip(cfg.opacity, 0, 1), 0, 1)


def text_level(depth: np.ndarray, alpha: np.ndarray, cfg: CompositeConfig, top: int) -> float:
    """The value to paint with: as set, or the end of the core's range that lies away from its surround."""
    if cfg.text_value is not None:
        return cfg.text_value / 255 * top
    core = alpha > 0.5
    if core.sum() < 8:
        core = alpha > 0.25
    if core.sum() < 4:
        return float(np.percentile(depth, 99))
    around = (spread(core.astype(float), max(3, cfg.heal_radius)) > 0) & (alpha <= 0.05)
    darker = around.sum() >= 8 and depth[core].mean() < depth[around].mean()
    return float(np.percentile(depth[core], 15 if darker else 85))


def composite(depth: np.ndarray, prob: np.ndarray, boxes: list[Box], cfg: CompositeConfig = CompositeConfig(), top: int = 65535) -> np.ndarray:
    """Glyphs painted on a depth plane: each box at a level of its own, read from the plane as it was; cut off, not rounded.

    With heal they are painted on the plane without the ring around them, which the boxes bound.
    """
    alpha = alpha_of(prob, cfg)
    if not alpha.any():
        return depth
    base = depth.astype(float)
    if cfg.heal and cfg.heal_radius > 0:
        base = heal(base, alpha, cfg.heal_radius, stack_masks(depth.shape[1], depth.shape[0], boxes) if boxes else None)
    out = base.copy()
    for x0, y0, x1, y1 in boxes or [(0, 0, depth.shape[1], depth.shape[0])]:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), max(0, x1), max(0, y1)
        own = (slice(y0, y1), slice(x0, x1))
        if base[own].size and alpha[own].any():
            level = text_level(depth[own].astype(float), alpha[own], cfg, top)
            out[own] = base[own] * (1 - alpha[own]) + level * alpha[own]
    return np.clip(out, 0, top).astype(np.int64)


def labels(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected parts of a mask, from 1; 0 elsewhere. Runs of a row that touch one above are united."""
    out = np.zeros(mask.shape, np.int64)
    root: list[int] = [0]

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, z in edges.reshape(-1, 2).tolist():
            mine = 0
            for b, e, k in above:
                if b <= z and a <= e:
                    other = find(k)
                    if mine:
                        root[max(mine, other)] = min(mine, other)
                    mine = min(mine or other, other)
            if not mine:
                mine = len(root)
                root.append(mine)
            out[y, a:z] = mine
            now.append((a, z, mine))
        above = now
    final = np.array([find(k) for k in range(len(root))])
    return np.unique(final[out], return_inverse=True)[1].reshape(mask.shape) + (0 if (out == 0).any() else 1)


def gate(prob: np.ndarray, box: Box, dets: list[Box], dilate: int = 8, least_inside: float = 0.5) -> np.ndarray:
    """Strokes whose parts lie mostly within a margin of the detections; once there is a stroke, all else is 0."""
    part = labels(prob > 0.5)
    if not dets or least_inside <= 0 or not part.any():
        return prob
    inside = np.zeros(prob.shape)
    for x0, y0, x1, y1 in dets:
        inside[max(0, y0 - box[1]) : max(0, y1 - box[1]), max(0, x0 - box[0]) : max(0, x1 - box[0])] = 1
    inside = spread(inside, dilate) > 0
    share = np.bincount(part[inside], minlength=part.max() + 1) / np.maximum(np.bincount(part.ravel()), 1)
    keep = share >= least_inside
    keep[0] = False
    return prob * keep[part]


def warp(mask: np.ndarray, sx: float, sy: float, tx: float, ty: float, width: int, height: int) -> np.ndarray:
    """A plane moved into another frame by an axis-aligned map, between pixels linearly, 0 outside."""

    def along(n_in: int, n_out: int, scale: float, shift: float) -> np.ndarray:
        at = (np.arange(n_out) - shift) / scale
        low = np.floor(at).astype(int)
        weights = np.zeros((n_out, n_in))
        for k, wt in ((low, 1 - (at - low)), (low + 1, at - low)):
            ok = (k >= 0) & (k < n_in)
            weights[np.flatnonzero(ok), k[ok]] += wt[ok]
        return weights

    return along(mask.shape[0], height, sy, ty) @ mask @ along(mask.shape[1], width, sx, tx).T


def stack_masks(width: int, height: int, boxes: list[Box]) -> np.ndarray:
    out = np.zeros((height, width), np.int64)
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 1
    return out


def heal(depth: np.ndarray, alpha: np.ndarray, radius: int = 6, region: np.ndarray | None = None) -> np.ndarray:
    """The ring around strokes filled from outside it, by distance-weighted means that grow inwards ring by ring.

    A plain stand-in for fast-marching inpainting: values agree at the ring's edge, not pixel by pixel inside.
    """
    ring = spread((alpha > 0.15).astype(float), radius) > 0
    ring &= region.astype(bool) if region is not None else True
    out, known = depth.astype(float), ~ring
    while not known.all() and known.any():
        total, weight = np.zeros(out.shape), np.zeros(out.shape)
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)):
            moved, there = np.roll(out, (dy, dx), (0, 1)), np.roll(known, (dy, dx), (0, 1)).astype(float)
            there[0 if dy > 0 else -1 if dy < 0 else slice(0, 0)] = 0
            there[:, 0 if dx > 0 else -1 if dx < 0 else slice(0, 0)] = 0
            there /= np.hypot(dy, dx)
            total, weight = total + moved * there, weight + there
        fresh = ~known & (weight > 0)
        out[fresh], known = (total[fresh] / weight[fresh]), known | fresh
    return out


def bar_extent(frames: list[np.ndarray], axis: int, tolerance: int = 6) -> tuple[int, int]:
    """Median thickness of the dark bars before and after the picture; frames that are all dark say nothing."""
    found = []
    for frame in frames:
        lit = np.flatnonzero(frame.max(axis=1 - axis) > tolerance)
        if len(lit):
            found.append((lit[0], frame.shape[axis] - 1 - lit[-1]))
    return tuple(int(np.median([f[k] for f in found])) for k in (0, 1)) if found else (0, 0)


def blend(base: Column, alpha: Column, value: Column) -> Column:
    """Two arrays of samples and a level, blended and cut off: the pointwise part of compositing, without Python."""
    return F.transform(F.arrays_zip(base.alias("b"), alpha.alias("a")), lambda p: F.floor(p["b"] * (1 - p["a"]) + value * p["a"]).cast("bigint"))


def crop(plane: Column, w: int, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The samples of a plane of width w inside a box, in row order; none of an empty box."""
    rows = F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice(plane, (y * w + x0 + 1).cast("int"), (x1 - x0).cast("int")))
    return F.when((x1 > x0) & (y1 > y0), F.flatten(rows)).otherwise(F.slice(plane, 1, 0))


def near_strokes(mask: Column, h: int, w: int, radius: int, least: float = 0.5) -> Column:
    """For each sample of a mask in row order whether a stroke lies under the element around it."""
    offsets = F.array(*[F.struct(F.lit(int(dy)).alias("dy"), F.lit(int(dx)).alias("dx")) for dy, dx in disc(radius)])

    def near(i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        stroke = lambda o: (y + o["dy"]).between(0, h - 1) & (x + o["dx"]).between(0, w - 1) & (F.get(mask, ((y + o["dy"]) * w + x + o["dx"]).cast("int")) > least)
        return F.exists(offsets, stroke)

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), near)


def glyph_difference(now: Column, was: Column, zone: Column) -> Column:
    """Mean difference of two planes inside a zone, each less its own median there; without a zone over all samples."""
    picked = lambda plane: F.filter(plane, lambda x, i: F.get(zone, i))
    inside = lambda plane: F.when(F.exists(zone, lambda z: z), picked(plane)).otherwise(plane)

    def median(values: Column) -> Column:
        ordered, n = F.array_sort(values), F.size(values)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    # Arrays of one element bind what holds for all samples, or it would be worked out for each.
    both = F.array(F.struct(inside(now).alias("a"), inside(was).alias("b")))
    levelled = F.transform(both, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), median(s["a"]).alias("ma"), median(s["b"]).alias("mb")))
    apart = F.transform(levelled, lambda s: F.aggregate(F.zip_with(s["a"], s["b"], lambda x, y: F.abs((x - s["ma"]) - (y - s["mb"]))), F.lit(0.0), lambda t, v: t + v) / F.size(s["a"]))
    return F.get(apart, F.lit(0))


def shared_stretch(before: Column, after: Column) -> tuple[Column, Column]:
    """Two planes as bytes, stretched over the range that both take together."""
    low = F.least(F.array_min(before), F.array_min(after))
    high = F.greatest(F.array_max(before), F.array_max(after))
    shown = lambda plane: F.transform(plane, lambda p: F.floor(F.least(F.greatest((p - low) / F.greatest(high - low, F.lit(1.0)) * 255, F.lit(0.0)), F.lit(255.0))).cast("int"))
    return shown(before), shown(after)


def debug_panel(gray: Column, before: Column, prob: Column, after: Column, h: int, w: int) -> Column:
    """Four planes side by side, as bytes in row order: picture, depth before, mask, depth after."""
    first, last = shared_stretch(before, after)
    mask = F.transform(prob, lambda p: F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    planes = (gray.cast("array<int>"), first, mask, last)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.concat(*[F.slice(p, y * w + 1, F.lit(w)) for p in planes])))


def map_planes(planes: DataFrame, kernel: Callable[..., np.ndarray], columns: tuple[str, ...], out: str = "out") -> DataFrame:
    """planes with out: kernel(plane, columns of the row...) for each row, whose samples are in the first column, h and w."""
    schema = T.StructType([*planes.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False):
                plane = np.asarray(getattr(row, columns[0]), float).reshape(row.h, row.w)
                made.append(kernel(plane, *[getattr(row, c) for c in columns[1:]]).astype(float).ravel())
            yield pdf.assign(**{out: made})

    return planes.mapInPandas(run, schema)
