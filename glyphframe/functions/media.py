"""Clips, planes and display values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphframe.functions.boxes import _col

#: The planar formats that are written as they were read.
PASS_THROUGH = ("gray", "gray10le", "gray12le", "gray16le", "yuv420p", "yuv422p", "yuv444p", "yuv420p10le", "yuv422p10le", "yuv444p10le", "yuv420p12le", "yuv422p12le", "yuv444p12le")


def bit_depth(fmt: Column) -> Column:
    """The first of 16, 14, 12, 10 whose digits are in a format's name, or else 8."""
    found = F.when(fmt.contains("16"), 16)
    for bits in (14, 12, 10):
        found = found.when(fmt.contains(str(bits)), bits)
    return found.otherwise(8)


def depth_format(fmt: Column) -> Column:
    return F.when(fmt.isin(*PASS_THROUGH), fmt).when(bit_depth(fmt) > 8, "yuv420p10le").otherwise("yuv420p")


def max_value(bits: Column) -> Column:
    return F.pow(F.lit(2), bits).cast("int") - 1


def luma(plane: Column, h: Column, w: Column) -> Column:
    """The first h rows of w samples."""
    return F.slice(plane, F.lit(1), (h * w).cast("int"))


def chroma_is_neutral(chroma: Column, bits: Column, tolerance: int = 2) -> Column:
    """Whether no sample is further than tolerance from the middle of its range; without samples it is."""
    middle = F.pow(F.lit(2), bits - 1).cast("int")
    return F.forall(chroma, lambda c: F.abs(c - middle) <= tolerance)


def frame_of_pts(pts, start, tick: float, rate: float) -> Column:
    """The frame nearest to a time stamp; halves go to the even frame."""
    return F.bround((_col(pts) - _col(start)) * F.lit(tick) * F.lit(rate), 0).cast("bigint")


def pts_of_frame(frame, start, tick: float, rate: float) -> Column:
    return (_col(frame) / F.lit(rate) / F.lit(tick)).cast("bigint") + _col(start)


def frame_count(frames: Column, seconds: Column, rate: Column) -> Column:
    """Frames as stored, or as the length and the rate give them, or 0."""
    return F.when(frames > 0, frames).when(seconds > 0, (seconds * rate).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def sample_indices(total: Column, count: int) -> Column:
    """So many frames spread evenly, in the middle of equal parts; of an unknown total every thirtieth."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(total > 0, (total * (i + 0.5) / count).cast("bigint")).otherwise((i * 30).cast("bigint")))
    return F.array_distinct(spread)


def even_sample(length: Column, most: int) -> Column:
    """At most so many places of a list, the first and the last among them, rounded half to even."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), length))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (length - 1) / F.greatest(n - 1, F.lit(1)), 0).cast("bigint")))


def usable_frames(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0))), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def alpha(p: Column, low: float = 0.35, high: float = 0.65, binary: bool = False) -> Column:
    """Coverage of a stroke probability: a ramp between low and high, or all or nothing from high on."""
    if binary:
        return F.when(p >= high, F.lit(1.0)).otherwise(F.lit(0.0))
    top = max(high, low + 1e-3)
    return F.least(F.greatest((p - low) / (top - low), F.lit(0.0)), F.lit(1.0))


def with_opacity(a: Column, opacity: float) -> Column:
    return F.least(F.greatest(a * min(max(opacity, 0.0), 1.0), F.lit(0.0)), F.lit(1.0))


def text_value(v: Column, top: Column) -> Column:
    return v / 255.0 * top


def to_display(p: Column, low: Column, high: Column) -> Column:
    """A sample as a byte of a range, cut off, not rounded."""
    return F.floor(F.least(F.greatest((p - low) / F.greatest(high - low, F.lit(1.0)) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def quantised(p: Column) -> Column:
    return F.floor(F.least(F.greatest(p * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def format_bytes(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1f MB", n / 1e6)).when(n >= 1_000, F.format_string("%.1f KB", n / 1e3)).otherwise(F.format_string("%d bytes", n.cast("bigint")))


def cache_key(stem: Column, rgb: Column, depth: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", rgb, depth)), 1, 12))


def describe_clip(w: Column, h: Column, fps: Column, frames: Column, fmt: Column) -> Column:
    """A line about a clip; an unknown number of frames, null or 0, is a question mark."""
    known = F.when(F.coalesce(frames, F.lit(0)) > 0, frames.cast("string")).otherwise("?")
    return F.format_string("%dx%d @ %.3ffps, %s frames, %s (%d-bit)", w, h, fps, known, fmt, bit_depth(fmt))


def timeline_is_current(version: Column) -> Column:
    return F.coalesce(version, F.lit(0)) == 1


def text_preview(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 40)


def x_of_frame(frame: Column, n: Column, w: Column) -> Column:
    return frame / F.greatest(n - 1, F.lit(1)) * (w - 1)


def frame_of_x(x: Column, n: Column, w: Column) -> Column:
    return F.least(F.greatest(F.bround(x / F.greatest(w - 1, F.lit(1)) * (n - 1), 0), F.lit(0.0)), (n - 1).cast("double")).cast("bigint")


def taper(size: Column, edge: int) -> Column:
    """Weights of one side of a tile: a ramp up over edge samples, or half of them if these are fewer, ones, and a ramp down."""
    steps = F.least(F.lit(edge), F.floor(size / 2))
    ramp = lambda i: F.least((i + 1) / (steps + 1), F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.least(ramp(i), ramp(size - 1 - i)))


#: The shares of red and green in grey, in parts of 2 ** 15; the rest is blue.
RED, GREEN = 9798, 19235


def gray(red: Column, green: Column, blue: Column) -> Column:
    """The grey level of a pixel of three bytes, rounded."""
    weighted = red.cast("int") * RED + green.cast("int") * GREEN + blue.cast("int") * ((1 << 15) - RED - GREEN)
    return F.shiftright(weighted + (1 << 14), 15)


def windows(extent: Column, tile: int, stride: int) -> Column:
    """Where tiles begin: every stride, the last one flush with the end."""
    regular = F.sequence(F.lit(0), F.greatest(extent - tile, F.lit(0)), F.lit(stride))
    return F.when(extent <= tile, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(extent - tile)))
