"""What is known of clips and models before any frame is worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions import boxes, media


def first_existing(wanted: DataFrame, candidates: list[str], there: DataFrame) -> DataFrame:
    """wanted with found: the first of its candidate columns whose path is among there's; null if none is."""
    found = wanted
    paths = there.select(F.col(there.columns[0]).alias("path")).distinct()
    for n, c in enumerate(candidates):
        found = found.join(paths.select(F.col("path").alias(f"path{n}")), F.col(c) == F.col(f"path{n}"), "left")
    return found.select(*wanted.columns, F.coalesce(*[f"path{n}" for n in range(len(candidates))]).alias("found"))


def checkpoints(files: DataFrame, prefix: str, by: list[str], name: str = "name", suffix: str = "") -> DataFrame:
    """by, and file: the first by name of the files that begin and end so."""
    return files.where(F.col(name).startswith(prefix) & F.col(name).endswith(suffix)).groupBy(*by).agg(F.min(name).alias("file"))


def checkpoint(files: DataFrame, prefix: str, name: str = "name", suffix: str = "") -> str:
    found = checkpoints(files, prefix, [], name, suffix).first()["file"]
    if found is None:
        raise FileNotFoundError(f"no checkpoint {prefix}*{suffix}")
    return found


def merged_weights(first: DataFrame, second: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The weights of both, the first's where both have a key."""
    joined = first.select(key, F.col(value).alias("own")).join(second.select(key, F.col(value).alias("other")), key, "full")
    return joined.select(key, F.coalesce("own", "other").alias(value))


def check_weights(weights: DataFrame, expected: DataFrame, key: str = "key", optional: str = "hi_decoder") -> None:
    """ValueError if an expected key has no weight, but for keys that begin as the optional part's do."""
    missing = [r[0] for r in expected.select(key).join(weights, key, "left_anti").where(~F.col(key).cast("string").startswith(optional)).orderBy(key).limit(3).collect()]
    if missing:
        raise ValueError(f"weights are missing, such as {', '.join(map(str, missing))}")


def setup_report(clips: DataFrame) -> DataFrame:
    """clips (fmt, neutral, rgb_frames, depth_frames and others) with converted, coloured, uneven and warnings.

    Counts of 0 are unknown and so not uneven; neutral says whether the first depth frame is grey.
    """
    converted = media.depth_format(F.col("fmt")) != F.col("fmt")
    coloured = ~F.col("neutral")
    uneven = (F.col("rgb_frames") > 0) & (F.col("depth_frames") > 0) & (F.col("rgb_frames") != F.col("depth_frames"))
    flagged = clips.withColumns({"converted": converted, "coloured": coloured, "uneven": uneven})
    said = [
        F.when(F.col("converted"), F.concat(F.col("fmt"), F.lit(" is worked on as "), media.depth_format(F.col("fmt")))),
        F.when(F.col("coloured"), F.lit("the depth plane has colour, which is kept but not read")),
        F.when(F.col("uneven"), F.lit("frame counts differ: what both have is worked on, the rest of the depth is passed on")),
    ]
    return flagged.withColumn("warnings", F.array_compact(F.array(*said)))


def alignment_mode(rgb_w: Column, rgb_h: Column, depth_w: Column, depth_h: Column, measured_v: Column, measured_h: Column, forced: str | None = None, tolerance: float = 0.01) -> Column:
    """struct mode, note: how the RGB frame lies in the depth frame.

    Equal shapes are stretched. Others are fitted if bars as thick as a fit's are measured on the axis where it has them,
    and else stretched, which may be wrong. measured_v and measured_h are mean thicknesses, null without samples. A forced
    mode is taken as it is.
    """
    if forced is not None:
        return F.struct(F.lit(forced).alias("mode"), F.lit("forced").alias("note"))
    shape, other = rgb_w / rgb_h, depth_w / depth_h
    fit = boxes.alignment(rgb_w, rgb_h, depth_w, depth_h, F.lit("fit"))
    expected_v, expected_h = (depth_h - fit["sy"] * rgb_h) / 2, (depth_w - fit["sx"] * rgb_w) / 2
    expected = F.greatest(expected_v, expected_h)
    measured = F.when(expected_v > expected_h, measured_v).otherwise(measured_h)
    barred = (expected >= 2) & (F.abs(measured - expected) <= F.greatest(F.lit(2.0), 0.15 * expected))
    same = F.abs(shape - other) / shape <= tolerance
    mode = F.when(same, "stretch").when(barred, "fit").otherwise("stretch")
    note = F.when(same, "same shape").when(barred, F.format_string("bars of %.0f pixels", measured)).otherwise("shapes differ and there are no bars: stretched, unless told otherwise")
    return F.struct(mode.alias("mode"), note.alias("note"))


def bars(plane: Column, h: int, w: int, tolerance: int = 6) -> Column:
    """struct first, last: dark rows above and below a picture, an array in row order; null if all is dark."""
    lit = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.array_max(F.slice(plane, y * w + 1, F.lit(w))) > tolerance)
    place = lambda rows: (F.array_position(rows, True) - 1).cast("int")
    return F.when(F.array_contains(lit, True), F.struct(place(lit).alias("first"), place(F.reverse(lit)).alias("last")))


def bar_extent(bars_of_frames: DataFrame, bars: str = "bars") -> DataFrame:
    """One row of first and last: the medians over frames, cut off; 0 if no frame says anything."""
    median = lambda end: F.coalesce(F.median(F.col(bars)[end]).cast("int"), F.lit(0))
    return bars_of_frames.agg(median("first").alias("first"), median("last").alias("last"))
