"""Queries of planes and masks. A vector of embeddings, 64 numbers, is a plane of 8 x 8 logits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glyphframe.config import CompositeConfig
from glyphframe.functions import media
from glyphframe.operators import clips, masks, pixels
from glyphframe.plans.registry import query, table

CELLS = "cells AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), p AS (SELECT *, 1 / (1 + exp(-least(greatest(logit, -30), 30))) AS prob FROM cells), a AS (SELECT *, least(greatest((prob - 0.35::DOUBLE) / (0.65::DOUBLE - 0.35::DOUBLE), 0), 1) AS alpha FROM p)"


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logit"))


def probs(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", F.transform("logit", media.sigmoid).alias("prob"))


def alphas(spark, sf_dir):
    return probs(spark, sf_dir).select("vec_id", "prob", F.transform("prob", lambda p: media.alpha(p)).alias("alpha"))


def planes(spark, sf_dir):
    return probs(spark, sf_dir).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), "prob")


@query("p15_sigmoid", f"WITH {CELLS} SELECT vec_id, round(sum(prob), 6) AS total FROM p GROUP BY 1")
def p15(spark, sf_dir):
    return probs(spark, sf_dir).select("vec_id", F.round(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("p16_prob_to_alpha", f"WITH {CELLS} SELECT vec_id, round(sum(alpha), 6) AS soft, CAST(count_if(prob >= 0.65) AS BIGINT) AS hard FROM a GROUP BY 1")
def p16(spark, sf_dir):
    rows = alphas(spark, sf_dir)
    hard = F.aggregate(F.transform("prob", lambda p: media.alpha(p, binary=True)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(F.aggregate("alpha", F.lit(0.0), lambda a, x: a + x), 6).alias("soft"), hard.cast("bigint").alias("hard"))


@query("p17_opacity", f"WITH {CELLS} SELECT vec_id, round(sum(least(greatest(alpha * 0.4, 0), 1)), 6) AS total FROM a GROUP BY 1")
def p17(spark, sf_dir):
    return alphas(spark, sf_dir).select("vec_id", F.round(F.aggregate(F.transform("alpha", lambda a: media.with_opacity(a, 0.4)), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("p20_to_display", f"WITH {CELLS} SELECT vec_id, CAST(sum(floor(least(greatest((logit + 2) / 4 * 255, 0), 255))) AS BIGINT) AS total FROM cells GROUP BY 1")
def p20(spark, sf_dir):
    shown = F.transform("logit", lambda x: media.to_display(x, F.lit(-2.0), F.lit(2.0)))
    return logits(spark, sf_dir).select("vec_id", F.aggregate(shown, F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"))


@query("s15_mask_store_put", f"WITH {CELLS} SELECT vec_id, CAST(sum(floor(least(greatest(prob * 255, 0), 255))) AS BIGINT) AS total, max(abs(prob - floor(prob * 255) / 255)) < 1 / 255.0 + 1e-6 AS near FROM p GROUP BY 1")
def s15(spark, sf_dir):
    rows = probs(spark, sf_dir).withColumn("q", F.transform("prob", media.quantised))
    error = F.array_max(F.zip_with("prob", "q", lambda p, q: F.abs(p - q / 255)))
    return rows.select("vec_id", F.aggregate("q", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"), (error < 1 / 255 + 1e-6).alias("near"))


@query("a12_mask_strength", f"WITH {CELLS} SELECT vec_id, CAST(count_if(prob > 0.5) AS BIGINT) AS n FROM p GROUP BY 1")
def a12(spark, sf_dir):
    return probs(spark, sf_dir).select("vec_id", masks.strength(F.col("prob")).alias("n"))


@query("a13_best_run_mask", f"WITH {CELLS}, s AS (SELECT vec_id, count_if(prob > 0.5) AS n FROM p GROUP BY 1) SELECT vec_id // 10 AS run, arg_max(vec_id, n * 1000000 - vec_id) AS best FROM s WHERE vec_id % 10 % 2 = 0 GROUP BY 1")
def a13(spark, sf_dir):
    """Ten vectors are a run, every second of them a sample; the strongest wins, the first of equals."""
    return masks.best_of_runs(probs(spark, sf_dir).where("vec_id % 10 % 2 = 0").withColumn("run", F.expr("vec_id div 10")), ["run"], frame="vec_id")


@query("a09_prob_union", f"WITH {CELLS} SELECT g, CAST(i AS INT) AS i, round(max(prob), 9) AS prob FROM (SELECT vec_id // 4 AS g, i, prob FROM p) GROUP BY 1, 2")
def a09(spark, sf_dir):
    """Four vectors are the regions of one frame."""
    cells = probs(spark, sf_dir).select(F.expr("vec_id div 4").alias("g"), F.posexplode("prob").alias("i", "p"))
    return cells.groupBy("g", "i").agg(F.round(F.max("p"), 9).alias("prob"))


@query("a18_tile_blend", f"WITH {CELLS} SELECT g, CAST(i AS INT) AS i, round(1 / (1 + exp(-sum(logit * w) / greatest(sum(w), 1e-6))), 6) AS prob FROM (SELECT vec_id // 4 AS g, i, logit, (vec_id % 4 + 1) / 4.0::DOUBLE AS w FROM cells) GROUP BY 1, 2")
def a18(spark, sf_dir):
    cells = logits(spark, sf_dir).select(F.expr("vec_id div 4").alias("g"), ((F.col("vec_id") % 4 + 1) / 4.0).alias("w"), F.posexplode("logit").alias("i", "l"))
    return cells.groupBy("g", "i").agg(F.round(media.sigmoid(F.sum(F.col("l") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))), 6).alias("prob"))


#: The core's 85th percentile, or its 15th where it is darker than at least eight samples around it that have no stroke.
LEVELS = f"""WITH {CELLS}, d AS (SELECT vec_id, i, alpha, i * (1 + vec_id % 5) * 37 % 64 * 100 AS depth FROM a), core AS (SELECT * FROM d WHERE alpha > 0.5),
c AS (SELECT vec_id, avg(depth) AS mean, quantile_cont(depth, 0.85) AS high, quantile_cont(depth, 0.15) AS low FROM core GROUP BY 1 HAVING count(*) >= 8),
o AS (SELECT DISTINCT d.vec_id, d.i, d.depth FROM d JOIN core n ON n.vec_id = d.vec_id AND abs(n.i // 8 - d.i // 8) <= 6 AND abs(n.i % 8 - d.i % 8) <= round_even(sqrt(36 - power(n.i // 8 - d.i // 8, 2)), 0) WHERE d.alpha <= 0.05),
s AS (SELECT vec_id, count(*) AS n, avg(depth) AS mean FROM o GROUP BY 1)
SELECT c.vec_id, round(CASE WHEN coalesce(s.n, 0) >= 8 AND c.mean < s.mean THEN low ELSE high END, 6) AS level FROM c LEFT JOIN s USING (vec_id)"""


@query("a10_text_level", LEVELS)
def a10(spark, sf_dir):
    """Strokes are the vector's, depths a pattern that some strokes are brighter in than what is around them, some darker."""
    k = F.col("vec_id") % 5
    rows = alphas(spark, sf_dir).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), "alpha", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * (1 + k) * 37 % 64 * 100).cast("double")).alias("depth"))
    rows = rows.where(F.size(F.filter("alpha", lambda a: a > 0.5)) >= 8)
    made = pixels.map_planes(rows, lambda depth, alpha: np.array([pixels.text_level(depth, np.asarray(alpha).reshape(depth.shape), CompositeConfig(), 65535)]), ("depth", "alpha"))
    return made.select("vec_id", F.round(F.get("out", F.lit(0)), 6).alias("level"))


@query("a11_value_range", f"WITH {CELLS} SELECT vec_id, round(least(min(logit), min(prob)), 9) AS lo, round(greatest(max(logit), max(prob)), 9) AS hi FROM p GROUP BY 1")
def a11(spark, sf_dir):
    rows = logits(spark, sf_dir).join(probs(spark, sf_dir), "vec_id")
    return rows.select("vec_id", F.round(F.least(F.array_min("logit"), F.array_min("prob")), 9).alias("lo"), F.round(F.greatest(F.array_max("logit"), F.array_max("prob")), 9).alias("hi"))


@query("s06_luma", "SELECT vec_id, round(list_sum(list_transform(embedding[1:48], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def s06(spark, sf_dir):
    """Six rows of eight are luma, the rest chroma."""
    plane = media.luma(F.col("embedding"), F.lit(6), F.lit(8))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(plane, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("s07_chroma_neutral", "SELECT vec_id, list_max(list_transform(embedding[49:64], lambda x: abs(CAST(floor(CAST(x AS DOUBLE) * 10) AS INT)))) <= 2 AS neutral FROM embeddings")
def s07(spark, sf_dir):
    chroma = F.transform(F.slice("embedding", 49, 16), lambda x: F.floor(x.cast("double") * 10).cast("int") + 128)
    return table(spark, sf_dir, "embeddings").select("vec_id", media.chroma_is_neutral(chroma, F.lit(8)).alias("neutral"))


@query("k01_crop", "SELECT vec_id, round(list_sum(list_transform(list_filter(range(1, 65), lambda i: (i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 1 AND 3), lambda i: CAST(embedding[i] AS DOUBLE))), 6) AS total FROM embeddings")
def k01(spark, sf_dir):
    rows = pixels.crop(F.col("embedding"), 8, F.lit(1), F.lit(2), F.lit(4), F.lit(6))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("k06_composite", f"WITH {CELLS} SELECT vec_id, CAST(sum(floor((i * 100) * (1 - round(alpha, 9)) + 5000 * round(alpha, 9))) AS BIGINT) AS total FROM a GROUP BY 1")
def k06(spark, sf_dir):
    """The blend, on a ramp of depths and at a level that is given."""
    base = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 100)
    out = pixels.blend(base, F.transform("alpha", lambda a: F.round(a, 9)), F.lit(5000))
    return alphas(spark, sf_dir).select("vec_id", F.aggregate(out, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


GLYPHS = """WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT DISTINCT vec_id, (i // 8 + dy) * 8 + i % 8 + dx AS i FROM c, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) WHERE x > 0.2 AND i // 8 + dy BETWEEN 0 AND 7 AND i % 8 + dx BETWEEN 0 AND 7),
s AS (SELECT a.vec_id, a.x AS now, b.x AS was FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND b.i = a.i
      WHERE (a.vec_id, a.i) IN (SELECT (vec_id, i) FROM z) OR a.vec_id NOT IN (SELECT vec_id FROM z)),
m AS (SELECT vec_id, median(now) AS mn, median(was) AS mw FROM s GROUP BY vec_id)
SELECT s.vec_id, round(avg(abs((now - mn) - (was - mw))), 6) AS diff FROM s JOIN m USING (vec_id) GROUP BY s.vec_id"""


@query("k12_glyph_diff", GLYPHS)
def k12(spark, sf_dir):
    """A plane and the next, compared at the strokes of the first and a pixel around them."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    both = a.join(b, "vec_id").withColumn("zone", pixels.near_strokes(F.col("x"), 8, 8, 1, 0.2))
    return both.select("vec_id", F.round(pixels.glyph_difference(F.col("x"), F.col("y"), F.col("zone")), 6).alias("diff"))


@query("k07_stack_region_masks", "SELECT p_partkey, CAST((least(p_size, 40) * 10 + 50 - (CASE WHEN p_size > 30 THEN (least(p_size, 40) - 30) * 5 ELSE 0 END)) AS BIGINT) AS n FROM part")
def k07(spark, sf_dir):
    """Boxes (0, 0, size, 10) and (30, 5, 40, 10) on a plane of 40 x 10."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(10).alias("h"), F.lit(40).alias("w"), F.array_repeat(F.lit(0.0), 400).alias("plane"), "p_size")
    made = pixels.map_planes(p, lambda plane, size: pixels.stack_masks(40, 10, [(0, 0, min(size, 40), 10), (30, 5, 40, 10)]), ("plane", "p_size"))
    return made.select("p_partkey", F.aggregate("out", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n"))


@query("f15_changed_frames", f"WITH {CELLS} SELECT vec_id FROM a GROUP BY 1 HAVING max(alpha) > 0")
def f15(spark, sf_dir):
    rows = alphas(spark, sf_dir).withColumn("after", F.zip_with("prob", "alpha", lambda p, a: p * (1 - a)))
    return rows.where(~F.col("prob").eqNullSafe(F.col("after"))).select("vec_id")


@query("a16_bar_extent", "SELECT 3 AS top, 2 AS bottom")
def a16(spark, sf_dir):
    """Bars of three rows above and two below, around every vector as a picture; the middle of all frames counts."""
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.abs(x.cast("double")) * 100 + 7).alias("x"))
    dark = lambda n: F.array_repeat(F.lit(0.0), n * 8)
    framed = rows.select(F.concat(dark(3), "x", dark(2)).alias("plane")).unionByName(rows.limit(3).select(dark(13).alias("plane")))
    return clips.bar_extent(framed.select(clips.bars(F.col("plane"), 13, 8).alias("bars"))).select(F.col("first").alias("top"), F.col("last").alias("bottom"))


@query("a17_detect_alignment", "SELECT p_partkey, CASE WHEN abs(r - 4 / 3.0::DOUBLE) / r <= 0.01 THEN 'stretch' WHEN e >= 2 AND abs(p_partkey % 200 - e) <= greatest(2, 0.15::DOUBLE * e) THEN 'fit' ELSE 'stretch' END AS mode FROM (SELECT p_partkey, r, greatest((768 - least(1024 / (1080 * r), 768 / 1080.0::DOUBLE) * 1080) / 2, (1024 - least(1024 / (1080 * r), 768 / 1080.0::DOUBLE) * 1080 * r) / 2) AS e FROM (SELECT p_partkey, 1 + p_size / 50.0::DOUBLE AS r FROM part))")
def a17(spark, sf_dir):
    """The picture's shape comes from the size, the bars that are measured from the key."""
    wide = 1080 * (1 + F.col("p_size") / 50.0)
    measured = F.col("p_partkey") % 200
    mode = clips.alignment_mode(wide, F.lit(1080.0), F.lit(1024.0), F.lit(768.0), measured, measured)
    return table(spark, sf_dir, "part").select("p_partkey", mode["mode"].alias("mode"))


def _kernel(name, kernel, oracle=None):
    @query(name, oracle)
    def run(spark, sf_dir):
        return pixels.map_planes(planes(spark, sf_dir), kernel, ("prob",)).select("vec_id", F.round(F.aggregate("out", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))

    return run


#: Each of 16 x 16 pixels lies at (y - 0.5) / 2, (x - 0.5) / 2 of the plane, between four samples that may lie outside.
WARPED = f"""WITH {CELLS}, o AS (SELECT (y - 0.5::DOUBLE) / 2 AS y, (x - 0.5::DOUBLE) / 2 AS x FROM range(16) a(y), range(16) b(x)),
n AS (SELECT floor(y) + dy AS cy, floor(x) + dx AS cx, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS wt FROM o, range(2) c(dy), range(2) d(dx))
SELECT vec_id, round(sum(prob * wt), 6) AS total FROM p JOIN n ON i = cy * 8 + cx AND cy BETWEEN 0 AND 7 AND cx BETWEEN 0 AND 7 GROUP BY vec_id"""
#: 0.3 of the plane itself, and 0.7 of the greatest of a sample and the four beside it.
GROWN = f"""WITH {CELLS}, g AS (SELECT a.vec_id, a.i, max(b.prob) AS most FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) <= 1 GROUP BY ALL)
SELECT vec_id, round(sum(0.3::DOUBLE * prob + 0.7::DOUBLE * most), 6) AS total FROM p JOIN g USING (vec_id, i) GROUP BY vec_id"""
#: Five weights along either axis, mirrored at the edges without repeating them: each sample counts as often as it is hit.
BLURRED = f"""WITH {CELLS}, k AS (SELECT d, exp(-0.5 * power(d / 0.7::DOUBLE, 2)) AS w FROM range(-2, 3) r(d)), n AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
t AS (SELECT CASE WHEN c + d < 0 THEN -c - d WHEN c + d > 7 THEN 14 - c - d ELSE c + d END AS at, sum(w) AS w FROM range(8) r(c), n GROUP BY 1)
SELECT vec_id, round(sum(prob * a.w * b.w), 6) AS total FROM p JOIN t a ON a.at = i // 8 JOIN t b ON b.at = i % 8 GROUP BY vec_id"""

_kernel("k02_warp", lambda p: pixels.warp(p, 2.0, 2.0, 0.5, 0.5, 16, 16), WARPED)
_kernel("k03_grow", lambda p: pixels.grow(p, 0.7), GROWN)
_kernel("k04_feather", lambda p: pixels.feather(p, 0.7), BLURRED)
_kernel("k05_heal_halo", lambda p: pixels.heal(p * 1000, np.pad(np.ones((2, 2)), 3), 1))
_kernel("k08_gate", lambda p: pixels.gate(p, (0, 0, 8, 8), [(0, 0, 4, 8)], dilate=1))
_kernel("a19_component_stats", lambda p: pixels.labels(p > 0.5))
_kernel("k13_render_frame", lambda p: pixels.composite(np.arange(64).reshape(8, 8) * 1000, p, [(0, 0, 4, 8), (4, 0, 8, 8)], CompositeConfig()))


def _crops(spark, sf_dir):
    """Ten vectors are a clip; even frames show one box, odd ones another."""
    k = F.col("vec_id")
    gray = F.transform("embedding", lambda x: F.round(x.cast("double") * 4, 0))
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("clip_id"), (k % 10).alias("frame"), F.lit(0).alias("item_ord"), (k % 2).alias("x0"), F.lit(0).alias("y0"), (k % 2 + 8).alias("x1"), F.lit(8).alias("y1"), F.lit(8).alias("h"), F.lit(8).alias("w"), gray.alias("gray"))
    return rows.withColumn("mask", F.transform("gray", lambda g: (g > 0).cast("double")))


#: Crops in order, ten to a clip, box by box: a crop is held against the last that wasn't found, in whose zone both are
#: levelled by their medians. No record is ever out of use for long enough to go.
FOUND = """WITH RECURSIVE c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round_even(CAST(unnest(embedding) AS DOUBLE) * 4, 0) AS x FROM embeddings),
z0 AS (SELECT DISTINCT c.vec_id, n.i FROM c JOIN (SELECT DISTINCT i FROM c) n ON (c.i // 8 - n.i // 8) BETWEEN -4 AND 4 AND abs(c.i % 8 - n.i % 8) <= round_even(sqrt(16 - power(c.i // 8 - n.i // 8, 2)), 0) WHERE c.x > 0),
z AS (SELECT * FROM z0 UNION ALL SELECT vec_id, i FROM c WHERE vec_id NOT IN (SELECT vec_id FROM z0)),
s AS MATERIALIZED (SELECT a.vec_id AS was, b.vec_id AS now, a.x AS old, b.x AS new FROM c a JOIN z ON z.vec_id = a.vec_id AND z.i = a.i JOIN c b ON b.i = a.i AND b.vec_id > a.vec_id AND b.vec_id // 10 = a.vec_id // 10 AND b.vec_id % 2 = a.vec_id % 2),
m AS (SELECT was, now, median(old) AS mo, median(new) AS mn FROM s GROUP BY ALL),
d AS MATERIALIZED (SELECT was, now, avg(abs((new - mn) - (old - mo))) <= 0.4 AS alike FROM s JOIN m USING (was, now) GROUP BY ALL),
f AS (SELECT vec_id AS now, vec_id AS was, false AS hit FROM embeddings WHERE vec_id % 10 < 2
      UNION ALL SELECT d.now, CASE WHEN d.alike THEN f.was ELSE d.now END, d.alike FROM f JOIN d ON d.was = f.was AND d.now = f.now + 2)"""


@query("t02_mask_cache_state", f"{FOUND} SELECT now // 10 AS clip_id, now % 10 AS frame, 0 AS item_ord, hit FROM f")
def t02(spark, sf_dir):
    from glyphframe.streaming.mask_cache import Limits, cache_hits

    return cache_hits(_crops(spark, sf_dir), Limits(tolerance=0.4))


@query("j07_mask_cache", f"{FOUND} SELECT now // 10 AS clip_id, count_if(hit) AS hits, count(*) AS asked FROM f GROUP BY 1")
def j07(spark, sf_dir):
    from glyphframe.streaming.mask_cache import Limits, cache_hits

    return cache_hits(_crops(spark, sf_dir), Limits(tolerance=0.4)).groupBy("clip_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("asked"))


@query("p21_gray", "SELECT p_partkey, (9798 * (p_size * 5) + 19235 * (p_partkey % 256) + 3735 * (p_partkey * 7 % 256) + 16384) >> 15 AS gray FROM part")
def p21(spark, sf_dir):
    """Sizes and keys stand for the bytes of a pixel."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", media.gray(F.col("p_size") * 5, k % 256, k * 7 % 256).cast("bigint").alias("gray"))


@query("s17_debug_sink", f"WITH {CELLS}, s AS (SELECT vec_id, i * 100 AS before, i * 100 + floor(prob * 5000) AS after, prob FROM p), r AS (SELECT vec_id, least(min(before), min(after)) AS lo, greatest(max(before), max(after)) AS hi FROM s GROUP BY 1) SELECT s.vec_id, CAST(sum(7 + floor((before - lo) / (hi - lo) * 255) + floor(prob * 255) + floor((after - lo) / (hi - lo) * 255)) AS BIGINT) AS total, 256 AS samples FROM s JOIN r USING (vec_id) WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 20) GROUP BY 1")
def s17(spark, sf_dir):
    """Panels of the first twenty frames with text: a grey picture, a ramp of depths, the mask, and the ramp lifted by it."""
    first = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(20).select("vec_id")
    before = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 100.0)
    rows = probs(spark, sf_dir).join(F.broadcast(first), "vec_id").withColumn("before", before).withColumn("after", F.zip_with("before", "prob", lambda b, p: b + F.floor(p * 5000)))
    panel = pixels.debug_panel(F.array_repeat(F.lit(7), 64), F.col("before"), F.col("prob"), F.col("after"), 8, 8)
    return rows.select("vec_id", panel.alias("panel")).select("vec_id", F.aggregate("panel", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"), F.size("panel").alias("samples"))


BYTES = "CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256"


def _clips(spark, sf_dir):
    """Ten vectors are a clip of 8 x 8 bytes."""
    k = F.col("vec_id")
    levels = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    plane = F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("clip_id"), (k % 10).alias("frame"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(24.0).alias("fps"), F.lit(8).alias("bit_depth"), plane.alias("luma"), F.unhex(F.lit("")).alias("chroma"))


def _levels(frames_):
    from glyphframe.sources.frames import as_gray16

    return frames_.select("clip_id", "frame", F.aggregate(as_gray16(F.col("luma"), F.col("bit_depth")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("s11_depth_sink", f"SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame, CAST(list_sum(list_transform(embedding, lambda x: ({BYTES}) * 257)) AS BIGINT) AS total FROM embeddings")
def s11(spark, sf_dir):
    """Planes of bytes are written as frames and read again; nothing changes on the way."""
    from glyphframe.sources import frames

    path = frames.shared_folder(spark, "frames")
    frames.put_frames(_clips(spark, sf_dir), path)
    return _levels(frames.get_frames(spark, path))


def _scanned(spark, sf_dir):
    """Five clips as files, read again by spans of four frames."""
    from glyphframe.sources import frames

    folder = frames.shared_folder(spark, "clips")
    frames.put_clips(_clips(spark, sf_dir).where("clip_id < 5"), folder)
    return frames.scan_clips(spark, [f"{folder}/clip-{n}.y4m" for n in range(5)], 4)


@query("s02_scan_frames", "SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame, 8 AS w, 8 AS h, 24.0::DOUBLE AS fps, 8 AS bit_depth, 64 AS size FROM embeddings WHERE vec_id < 50")
def s02(spark, sf_dir):
    return _scanned(spark, sf_dir).select("clip_id", "frame", "w", "h", "fps", "bit_depth", F.octet_length("luma").alias("size"))


@query("s03_scan_depth", f"SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame, CAST(list_sum(list_transform(embedding, lambda x: ({BYTES}) * 257)) AS BIGINT) AS total FROM embeddings WHERE vec_id < 50")
def s03(spark, sf_dir):
    return _levels(_scanned(spark, sf_dir))


def _planes_of_clips(spark, sf_dir):
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("clip_id"), (k % 10).alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("gray"))


@query("x01_detector", "WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame, 0 AS det_ord, min(i % 8)::DOUBLE AS x0, min(i // 8)::DOUBLE AS y0, max(i % 8 + 1)::DOUBLE AS x1, max(i // 8 + 1)::DOUBLE AS y1, round(max(x), 6) AS score FROM c WHERE x > 0.15 GROUP BY vec_id")
def x01(spark, sf_dir):
    """A model that finds one polygon around all that is bright, and a line of two points that goes."""
    from glyphframe.operators import models

    def load():
        def model(plane):
            y, x = np.nonzero(plane > 0.15)
            if not len(y):
                return []
            a, b, c, d = x.min(), y.min(), x.max() + 1, y.max() + 1
            return [([(a, b), (c, b), (c, d), (a, d)], plane.max()), ([(0, 0), (1, 1)], 1.0)]

        return model

    found = models.detect(_planes_of_clips(spark, sf_dir), load)
    corner = lambda i, c: F.get("poly", F.lit(i))[c]
    return found.select("clip_id", "frame", "det_ord", corner(0, "x").alias("x0"), corner(0, "y").alias("y0"), corner(2, "x").alias("x1"), corner(2, "y").alias("y1"), F.round("score", 6).alias("score"))


@query("x02_recogniser", "SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame, 'n' || len(list_filter(embedding, lambda x: x > 0)) AS text, round(CAST(list_max(embedding) AS DOUBLE), 6) AS score FROM embeddings WHERE vec_id % 10 <> 3")
def x02(spark, sf_dir):
    """A model that reads how many samples are positive; every tenth crop is too low to be read."""
    from glyphframe.operators import models

    crops = _planes_of_clips(spark, sf_dir).withColumn("h", F.when(F.col("frame") == 3, 4).otherwise(8)).withColumn("w", F.when(F.col("frame") == 3, 16).otherwise(8))
    read = models.recognise(crops, lambda: lambda crop: (f"n{(crop > 0).sum()}", crop.max()))
    return read.select("clip_id", "frame", "text", F.round("score", 6).alias("score"))


@query("k11_segment", f"WITH {CELLS} SELECT vec_id, round(sum(prob), 6) AS total FROM p GROUP BY 1")
def k11(spark, sf_dir):
    """Tiles of six pixels over planes of eight, and a model whose logits are its input: the tiles must blend to it."""
    from glyphframe.operators import models

    crops = logits(spark, sf_dir).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("logit").alias("gray"))
    made = models.segment_crops(crops, lambda: lambda crop: crop, tile=6, overlap=0.25, edge=2)
    return made.select("vec_id", F.round(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("j09_region_frame_crop", "SELECT vec_id, p_partkey, round(list_sum(list_transform(list_filter(range(1, 65), lambda i: (i - 1) // 8 < 1 + p_size % 7 AND (i - 1) % 8 < 4), lambda i: CAST(embedding[i] AS DOUBLE))), 6) AS total FROM embeddings JOIN part ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id")
def j09(spark, sf_dir):
    """Parts are regions: the first rows of a frame, as many as the size says, four pixels wide."""
    vectors = table(spark, sf_dir, "embeddings")
    frames = vectors.select("vec_id", "embedding")
    found = table(spark, sf_dir, "part").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))  # one row
    found = found.select("p_partkey", (F.col("p_partkey") % F.col("n")).alias("vec_id"), (F.col("p_size") % 7).alias("last"))
    rows = pixels.crop(F.col("embedding"), 8, F.lit(0), F.lit(0), F.lit(4), F.col("last") + 1)
    return frames.join(found, "vec_id").select("vec_id", "p_partkey", F.round(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))
