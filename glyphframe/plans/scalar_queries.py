"""Queries of scalar functions and small relations. Where the domain has no table, columns of the star schema stand in for
its numbers and names; each query's docstring or SQL says which."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphframe.functions import boxes, media
from glyphframe.operators import clips, exclusions, masks, regions
from glyphframe.plans.registry import query, table

FORMATS = "CASE p_partkey % 6 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'gray16le' WHEN 2 THEN 'yuv420p10le' WHEN 3 THEN 'rgb24' WHEN 4 THEN 'p010le' ELSE 'yuv444p12le' END"


def formats(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(FORMATS).alias("fmt"), "p_size")


BITS = "CASE WHEN fmt LIKE '%16%' THEN 16 WHEN fmt LIKE '%14%' THEN 14 WHEN fmt LIKE '%12%' THEN 12 WHEN fmt LIKE '%10%' THEN 10 ELSE 8 END"
PARTS = f"WITH f AS (SELECT p_partkey, {FORMATS} AS fmt, p_size FROM part)"


@query("s05_bit_depth", f"{PARTS} SELECT p_partkey, {BITS} AS bits FROM f")
def s05(spark, sf_dir):
    return formats(spark, sf_dir).select("p_partkey", media.bit_depth(F.col("fmt")).alias("bits"))


@query("s04_depth_format", f"{PARTS} SELECT p_partkey, CASE WHEN fmt IN ('yuv420p', 'gray16le', 'yuv420p10le', 'yuv444p12le') THEN fmt WHEN {BITS} > 8 THEN 'yuv420p10le' ELSE 'yuv420p' END AS fmt FROM f")
def s04(spark, sf_dir):
    return formats(spark, sf_dir).select("p_partkey", media.depth_format(F.col("fmt")).alias("fmt"))


@query("p19_max_value", f"{PARTS} SELECT p_partkey, CAST(power(2, {BITS}) AS INT) - 1 AS top FROM f")
def p19(spark, sf_dir):
    return formats(spark, sf_dir).select("p_partkey", media.max_value(media.bit_depth(F.col("fmt"))).alias("top"))


@query("p18_explicit_text_value", f"{PARTS} SELECT p_partkey, round(p_size / 255.0::DOUBLE * (power(2, {BITS}) - 1), 6) AS v FROM f")
def p18(spark, sf_dir):
    return formats(spark, sf_dir).select("p_partkey", F.round(media.text_value(F.col("p_size").cast("double"), media.max_value(media.bit_depth(F.col("fmt")))), 6).alias("v"))


@query("s01_probe", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN CAST(trunc((o_custkey % 100) * 23.976::DOUBLE) AS BIGINT) ELSE 0 END AS n_frames FROM orders")
def s01(spark, sf_dir):
    """Customers stand for stored frame counts and lengths in seconds; a third of the clips has neither."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 3)
    frames, seconds = F.when(F.col("k") == 0, F.col("o_custkey")).otherwise(0), F.when(F.col("k") == 1, F.col("o_custkey") % 100).otherwise(0)
    # A stored count of 0 is as good as none.
    return o.select("o_orderkey", media.frame_count(frames, F.when(F.col("k") == 0, 0).otherwise(seconds), F.lit(23.976)).cast("bigint").alias("n_frames"))


@query("s10_pts_index", "SELECT o_orderkey, CAST(round_even((o_custkey * 512 - 1024) * (1 / 12288.0::DOUBLE) * 24.0, 0) AS BIGINT) AS idx, CAST(trunc(o_custkey / 24.0::DOUBLE / (1 / 12288.0::DOUBLE)) AS BIGINT) + 1024 AS pts FROM orders")
def s10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", media.frame_of_pts(F.col("o_custkey") * 512, F.lit(1024), 1 / 12288.0, 24.0).alias("idx"), media.pts_of_frame(F.col("o_custkey"), F.lit(1024), 1 / 12288.0, 24.0).alias("pts"))


@query("s08_sample_frames", "SELECT DISTINCT o_orderkey, CAST(CASE WHEN total > 0 THEN trunc(total * (i + 0.5::DOUBLE) / 8) ELSE i * 30 END AS BIGINT) AS frame FROM (SELECT o_orderkey, o_custkey % 50 AS total, unnest(range(0, 8)) AS i FROM orders)")
def s08(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.explode(media.sample_indices(F.col("o_custkey") % 50, 8)).alias("frame"))


@query("a14_even_sample", "SELECT DISTINCT o_orderkey, CAST(round_even(i * (len - 1) / greatest(n - 1, 1)::DOUBLE, 0) AS BIGINT) AS place FROM (SELECT o_orderkey, len, n, unnest(range(0, n)) AS i FROM (SELECT o_orderkey, 1 + o_custkey % 40 AS len, greatest(1, least(5, 1 + o_custkey % 40)) AS n FROM orders))")
def a14(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.explode(media.even_sample((1 + F.col("o_custkey") % 40).cast("int"), 5)).alias("place"))


@query("a22_usable_frames", "SELECT o_orderkey, coalesce(least(nullif(o_custkey % 7, 0), nullif(o_orderkey % 5, 0)), 0) AS n FROM orders")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", media.usable_frames(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("n"))


@query("s09_frame_lookup", "SELECT e.event_id, max(o.o_orderkey) AS frame FROM (SELECT event_id, user_id * 3 AS wanted FROM events) e JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) o ON o.o_orderkey <= e.wanted AND o.o_orderkey > e.wanted - 10 GROUP BY e.event_id")
def s09(spark, sf_dir):
    """Events ask for frames; every fifth frame is missing and the one before it stands in."""
    from glyphframe.operators.asof import latest_at

    frames = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("frame"))
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 3).alias("wanted"))
    return latest_at(asked, frames, "wanted", "frame", within=10).select("event_id", "frame")


@query("p10_resolve_min_track", "SELECT p_partkey, CAST(greatest(2, round_even(0.5::DOUBLE * (p_size + 0.5::DOUBLE * (p_partkey % 2)), 0)) AS INT) AS least FROM part")
def p10(spark, sf_dir):
    rate = F.col("p_size") + 0.5 * (F.col("p_partkey") % 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(2), F.bround(0.5 * rate, 0).cast("int")).alias("least"))


@query("p11_build_alignment", """WITH a AS (SELECT p_partkey, CAST(640 + p_size * 16 AS DOUBLE) AS rw, CAST(480 + p_partkey % 50 * 8 AS DOUBLE) AS rh, ['stretch', 'fit', 'fill'][(p_partkey % 3 + 1)::INT] AS mode FROM part),
k AS (SELECT p_partkey, rw, rh, CASE mode WHEN 'stretch' THEN 1024 / rw WHEN 'fit' THEN least(1024 / rw, 768 / rh) ELSE greatest(1024 / rw, 768 / rh) END AS sx, CASE mode WHEN 'stretch' THEN 768 / rh WHEN 'fit' THEN least(1024 / rw, 768 / rh) ELSE greatest(1024 / rw, 768 / rh) END AS sy FROM a)
SELECT p_partkey, round(sx, 9) AS sx, round(sy, 9) AS sy, round((1024 - rw * sx) / 2, 6) + 0.0 AS tx, round((768 - rh * sy) / 2, 6) + 0.0 AS ty FROM k""")
def p11(spark, sf_dir):
    mode = F.get(F.array(*map(F.lit, ("stretch", "fit", "fill"))), (F.col("p_partkey") % 3).cast("int"))
    al = boxes.alignment(640 + F.col("p_size") * 16, 480 + F.col("p_partkey") % 50 * 8, F.lit(1024), F.lit(768), mode)
    rows = table(spark, sf_dir, "part").select("p_partkey", al.alias("al"))
    return rows.select("p_partkey", F.round("al.sx", 9).alias("sx"), F.round("al.sy", 9).alias("sy"), (F.round("al.tx", 6) + 0.0).alias("tx"), (F.round("al.ty", 6) + 0.0).alias("ty"))


@query("p13_affine_matrix", "SELECT p_partkey, printf('[[%.3f, 0.000, %.3f], [0.000, %.3f, %.3f]]', 1024 / (640.0 + p_size * 16), 0.0, 768 / 1080.0, 0.0) AS m FROM part")
def p13(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("al", boxes.alignment(640 + F.col("p_size") * 16, F.lit(1080), F.lit(1024), F.lit(768), F.lit("stretch")))
    return rows.select("p_partkey", F.format_string("[[%.3f, 0.000, %.3f], [0.000, %.3f, %.3f]]", "al.sx", "al.tx", "al.sy", "al.ty").alias("m"))


@query("p14_video_info_str", f"{PARTS} SELECT p_partkey, printf('%dx%d @ %.3ffps, %s frames, %s (%d-bit)', p_size * 16, p_size * 9, p_size + 0.5::DOUBLE, CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE CAST(p_partkey AS VARCHAR) END, fmt, {BITS}) AS s, CAST(p_size * 16 AS DOUBLE) / (p_size * 9) AS aspect FROM f")
def p14(spark, sf_dir):
    """Of every seventh clip the number of frames isn't known."""
    w, h, k = F.col("p_size") * 16, F.col("p_size") * 9, F.col("p_partkey")
    return formats(spark, sf_dir).select("p_partkey", media.describe_clip(w, h, F.col("p_size") + 0.5, F.when(k % 7 == 0, 0).otherwise(k), F.col("fmt")).alias("s"), (w / h).alias("aspect"))


@query("p23_run_colour", "SELECT p_partkey, round((p_partkey * 0.61803398875::DOUBLE) % 1.0::DOUBLE, 6) AS h, 0.62::DOUBLE AS s, 0.92::DOUBLE AS v FROM part")
def p23(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", boxes.run_colour(F.col("p_partkey")).alias("c")).select("p_partkey", F.round("c.h", 6).alias("h"), "c.s", "c.v")


@query("p24_format_bytes", "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.1f KB', n / 1e3) ELSE printf('%d bytes', n) END AS s FROM (SELECT o_orderkey, o_custkey * o_custkey * 7 AS n FROM orders)")
def p24(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", media.format_bytes(F.col("o_custkey") * F.col("o_custkey") * 7).alias("s"))


@query("p22_timeline_is_current", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 END, 0) = 1 AS current FROM part")
def p22(spark, sf_dir):
    version = F.when(F.col("p_partkey") % 3 < 2, F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", media.timeline_is_current(version).alias("current"))


@query("p27_text_preview", "SELECT p_partkey, substring(trim('  ' || p_name || ' ' || p_type || ' ' || p_brand || ' '), 1, 40) AS s, round(p_retailprice / 7, 3) AS score FROM part")
def p27(spark, sf_dir):
    text = F.concat(F.lit("  "), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", media.text_preview(text).alias("s"), F.round(F.col("p_retailprice") / 7, 3).alias("score"))


@query("p28_x_of_frame", "SELECT o_orderkey, round(o_custkey / greatest(1499, 1)::DOUBLE * 639, 6) AS x, CAST(least(greatest(round_even((o_custkey % 700 - 30) / 639.0::DOUBLE * 1499, 0), 0), 1499) AS BIGINT) AS frame FROM orders")
def p28(spark, sf_dir):
    n, w = F.lit(1500), F.lit(640)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(media.x_of_frame(F.col("o_custkey"), n, w), 6).alias("x"), media.frame_of_x(F.col("o_custkey") % 700 - 30, n, w).alias("frame"))


@query("s19_cache_dir_key", "SELECT c_custkey, 'd' || c_nationkey || '-' || substring(sha1(c_name || '|' || c_mktsegment), 1, 12) AS key FROM customer")
def s19(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", media.cache_key(F.concat(F.lit("d"), F.col("c_nationkey")), F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("s20_guess_depth", "SELECT s_suppkey, coalesce((SELECT c_name FROM customer WHERE c_custkey = s_suppkey * 11), (SELECT c_name FROM customer WHERE c_custkey = s_suppkey * 3)) AS found FROM supplier")
def s20(spark, sf_dir):
    """Customers stand for files; the first candidate has eleven times a supplier's number, the second three times."""
    path = lambda n: F.format_string("Customer#%09d", F.col("s_suppkey") * n)
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", path(11).alias("first"), path(3).alias("second"))
    return clips.first_existing(wanted, ["first", "second"], table(spark, sf_dir, "customer").select("c_name")).select("s_suppkey", "found")


@query("s21_checkpoint_resolve", "SELECT p_type, min(p_name) AS file FROM part WHERE p_name LIKE 'Part%' AND p_name LIKE '%7' GROUP BY p_type")
def s21(spark, sf_dir):
    return clips.checkpoints(table(spark, sf_dir, "part"), "Part", ["p_type"], "p_name", "7")


@query("s22_weights_merge", "SELECT coalesce(a.p_partkey, b.p_partkey) AS key, coalesce(a.p_size, b.p_size) AS v FROM (SELECT * FROM part WHERE p_partkey % 3 = 0) a FULL JOIN (SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0) b ON a.p_partkey = b.p_partkey")
def s22(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    return clips.merged_weights(p.where("key % 3 = 0"), p.where("key % 2 = 0").select("key", (F.col("v") + 100).alias("v")), value="v")


@query("l05_sorted_exclusions", "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_custkey % 17))), ',') AS ids FROM customer GROUP BY 1")
def l05(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(exclusions.sorted_ids(F.col("c_custkey") % 17), ",").alias("ids"))


@query("u01_exclusions_union", "SELECT DISTINCT c_nationkey AS clip, c_custkey % 5 AS run FROM customer UNION SELECT s_nationkey, s_suppkey % 7 FROM supplier")
def u01(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("clip"), (F.col("c_custkey") % 5).alias("run"))
    return exclusions.union(stored, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("clip"), (F.col("s_suppkey") % 7).alias("run")))


@query("u02_toggle_run", "SELECT c_custkey, CASE WHEN list_contains(l, 3) THEN array_to_string(list_filter(l, lambda x: x <> 3), ',') ELSE array_to_string(list_append(l, 3), ',') END AS ids FROM (SELECT c_custkey, [c_custkey % 4, 4 + c_custkey % 5] AS l FROM customer)")
def u02(spark, sf_dir):
    held = F.array(F.col("c_custkey") % 4, 4 + F.col("c_custkey") % 5)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(exclusions.toggled(held, F.lit(3).cast("bigint")), ",").alias("ids"))


@query("u04_persist_exclusions", "SELECT c_custkey AS clip, CASE WHEN c_custkey % 2 = 0 THEN '3,7' ELSE CAST(c_nationkey AS VARCHAR) END AS excluded, c_name AS path FROM customer")
def u04(spark, sf_dir):
    """Read, modify and write: the documents of even clips get another list, all else stays."""
    doc = F.to_json(F.struct(F.lit(1).alias("version"), F.col("c_name").alias("path"), F.array("c_nationkey").alias("excluded")))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), doc.alias("document"))
    written = docs.select("clip", F.when(F.col("clip") % 2 == 0, exclusions.persisted(F.col("document"), F.array(F.lit(7), F.lit(3)))).otherwise(F.col("document")).alias("document"))
    return written.select("clip", F.array_join(exclusions.read(F.col("document")), ",").alias("excluded"), F.get_json_object("document", "$.path").alias("path"))


@query("f12_skip_empty_crop", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_tax > 0.02")
def f12(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", boxes.box(F.lit(10), F.lit(2), F.col("l_quantity"), F.round(F.col("l_tax") * 100, 0)).alias("b"))
    return regions.non_empty(rows.select("l_orderkey", "l_linenumber", "b.*")).select("l_orderkey", "l_linenumber")


def mask_tables(spark, sf_dir):
    """Parts are regions, three of four with a run; suppliers are masks of runs, customers of frames."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4 - 1).alias("run"), (F.col("p_partkey") % 30).alias("run_id"), (F.col("p_partkey") * 2).alias("frame"))
    of_run = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").alias("mask"))
    return p, of_run, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame"), F.col("c_acctbal").alias("mask"))


@query("f14_mask_ready", "SELECT p_partkey, CASE WHEN p_partkey % 4 - 1 >= 0 THEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey % 30) ELSE EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey * 2) END AS ready FROM part")
def f14(spark, sf_dir):
    p, of_run, of_frame = mask_tables(spark, sf_dir)
    return masks.ready(p, of_run, of_frame, ["run_id"], ["frame"]).select("p_partkey", "ready")


@query("j11_mask_resolve", "SELECT p_partkey, coalesce(s.s_acctbal, c.c_acctbal, CASE WHEN p_partkey % 3 = 0 THEN -1.0 * p_partkey END) AS mask FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey % 30 LEFT JOIN customer c ON c.c_custkey = p_partkey * 2")
def j11(spark, sf_dir):
    """A model that makes masks of every third region does the rest."""
    p, of_run, of_frame = mask_tables(spark, sf_dir)
    model = lambda rest: rest.withColumn("mask", F.when(F.col("p_partkey") % 3 == 0, -F.col("p_partkey").cast("double")))
    return masks.resolve(p, of_run, of_frame, ["run_id"], ["frame"], model).select("p_partkey", "mask")


@query("j06_run_mask_lookup", "SELECT l_orderkey, l_linenumber, s_acctbal AS mask FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def j06(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("mask"))
    return masks.run_masks(table(spark, sf_dir, "lineitem"), stored, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "mask")


@query("j01_zip_frames", "SELECT o_orderkey AS frame, c_acctbal AS rgb FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def j01(spark, sf_dir):
    """Customers stand for the RGB stream, orders for the longer depth stream."""
    from glyphframe.operators.timeline import zip_frames

    rgb = table(spark, sf_dir, "customer").select(F.lit(0).alias("clip_id"), F.col("c_custkey").alias("frame"), F.col("c_acctbal").alias("rgb"))
    depth = table(spark, sf_dir, "orders").select(F.lit(0).alias("clip_id"), F.col("o_orderkey").alias("frame"))
    return zip_frames(rgb, depth).select("frame", "rgb")


@query("s16_mask_store_size", "SELECT source AS clip, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def s16(spark, sf_dir):
    return masks.stored_size(table(spark, sf_dir, "documents").withColumnRenamed("source", "clip"), "text", "clip")


@query("a21_cache_size", "SELECT CAST((SELECT sum(octet_length(encode(text))) FROM documents) + (SELECT sum(octet_length(encode(html))) FROM pages) AS BIGINT) AS bytes")
def a21(spark, sf_dir):
    blobs = table(spark, sf_dir, "documents").select(F.col("text").alias("blob")).union(table(spark, sf_dir, "pages").select("html"))
    return masks.stored_size(blobs, "blob")


@query("a24_setup_report", f"{PARTS}, w AS (SELECT p_partkey, fmt NOT IN ('yuv420p', 'gray16le', 'yuv420p10le', 'yuv444p12le') AS converted, p_partkey % 5 = 0 AS coloured, p_size % 3 > 0 AND p_partkey % 3 > 0 AND p_size % 3 <> p_partkey % 3 AS uneven FROM f) SELECT *, CAST(converted AS INT) + CAST(coloured AS INT) + CAST(uneven AS INT) AS warnings FROM w")
def a24(spark, sf_dir):
    clip = formats(spark, sf_dir).select("p_partkey", "fmt", (F.col("p_partkey") % 5 != 0).alias("neutral"), (F.col("p_size") % 3).alias("rgb_frames"), (F.col("p_partkey") % 3).alias("depth_frames"))
    return clips.setup_report(clip).select("p_partkey", "converted", "coloured", "uneven", F.size("warnings").alias("warnings"))


@query("a15_cache_hit_rate", "SELECT l_returnflag, count_if(l_quantity < 10) / greatest(1, count(*))::DOUBLE AS rate FROM lineitem GROUP BY 1")
def a15(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(masks.hit_rate(F.col("l_quantity") < 10).alias("rate"))


QUADS = "CASE WHEN p_partkey % 2 = 0 THEN [{'x': 0.5, 'y': 1.25}, {'x': p_size + 0.5, 'y': p_partkey % 23 + 1.25}, {'x': p_size - 3.5, 'y': p_partkey % 23 + 9.25}, {'x': -3.5, 'y': 9.25}] ELSE [{'x': 0.0, 'y': 0.0}, {'x': 5.0, 'y': -1.0 * (p_partkey % 7)}, {'x': p_size * 2.0, 'y': 30.0}] END"


def polygons(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(point(F.lit(0.5), F.lit(1.25)), point(s + 0.5, k % 23 + 1.25), point(s - 3.5, k % 23 + 9.25), point(F.lit(-3.5), F.lit(9.25)))
    triangle = F.array(point(F.lit(0), F.lit(0)), point(F.lit(5), -(k % 7)), point(s * 2, F.lit(30)))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, quad).otherwise(triangle).alias("poly"))


@query("p01_poly_tilt", """WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [CAST(p_size AS DOUBLE), CAST(p_partkey % 23 AS DOUBLE)] ELSE
  CASE WHEN pow(p_size * 2, 2) + 900 >= greatest(25 + pow(p_partkey % 7, 2), pow(p_size * 2 - 5, 2) + pow(30 + p_partkey % 7, 2)) AND pow(p_size * 2, 2) + 900 > greatest(25 + pow(p_partkey % 7, 2), pow(p_size * 2 - 5, 2) + pow(30 + p_partkey % 7, 2)) THEN [-2.0 * p_size, -30.0]
       WHEN pow(p_size * 2 - 5, 2) + pow(30 + p_partkey % 7, 2) > 25 + pow(p_partkey % 7, 2) THEN [p_size * 2.0 - 5, 30.0 + p_partkey % 7] ELSE [5.0, -1.0 * (p_partkey % 7)] END END AS d FROM part)
SELECT p_partkey, round(abs((((degrees(atan2(d[2], d[1])) + 90) % 180) + 180) % 180 - 90), 6) AS tilt FROM e""")
def p01(spark, sf_dir):
    return polygons(spark, sf_dir).select("p_partkey", F.round(boxes.poly_tilt(F.col("poly")), 6).alias("tilt"))


@query("p02_poly_box", f"WITH q AS (SELECT p_partkey, {QUADS} AS poly FROM part), u AS (SELECT p_partkey, unnest(poly) AS p FROM q) SELECT p_partkey, CAST(floor(min(CAST(p.x AS DOUBLE))) AS BIGINT) AS x0, CAST(floor(min(CAST(p.y AS DOUBLE))) AS BIGINT) AS y0, CAST(ceil(max(CAST(p.x AS DOUBLE))) AS BIGINT) AS x1, CAST(ceil(max(CAST(p.y AS DOUBLE))) AS BIGINT) AS y1 FROM u GROUP BY 1")
def p02(spark, sf_dir):
    return polygons(spark, sf_dir).select("p_partkey", boxes.poly_box(F.col("poly")).alias("b")).select("p_partkey", "b.*")


@query("p04_extract_polys", f"WITH q AS (SELECT p_partkey, {QUADS} AS poly FROM part) SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(len(poly) AS INT) END AS points, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS score FROM q WHERE p_partkey % 5 <> 0")
def p04(spark, sf_dir):
    """A polygon and one cut short, by another name for each of three clips in five; of one the scores are too few, of one there is nothing."""
    k = F.col("p_partkey") % 5
    rows = polygons(spark, sf_dir).withColumn("both", F.array("poly", F.slice("poly", 1, 2)))
    scores = F.when(k == 1, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    found = regions.polygons(F.when(k == 2, F.col("both")), F.when(k == 3, F.col("both")), F.when(k != 0, F.col("both")), F.when(k == 2, scores), scores)
    return rows.select("p_partkey", F.explode(found).alias("d")).select("p_partkey", F.size("d.poly").alias("points"), "d.score")


@query("p03_detections_from_polys", f"WITH q AS (SELECT p_partkey, {QUADS} AS poly FROM part), u AS (SELECT p_partkey, unnest(poly) AS p FROM q), b AS (SELECT p_partkey, CAST(floor(min(CAST(p.x AS DOUBLE))) AS BIGINT) AS x0 FROM u GROUP BY 1) SELECT p_partkey, CAST(o AS INT) AS det_ord, x0, CASE WHEN o = 0 AND p_partkey % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM b, range(2) r(o) WHERE o = 0 OR p_partkey % 2 = 0")
def p03(spark, sf_dir):
    """Boxes, polygons and scores put together by place; a missing score is 1."""
    k = F.col("p_partkey")
    n = F.when(k % 2 == 0, 2).otherwise(1)
    box = boxes.poly_box(F.col("poly"))
    rows = polygons(spark, sf_dir).select("p_partkey", F.array_repeat(box, n).alias("boxes"), F.array_repeat("poly", n).alias("polys"), F.array(F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise(0.5), F.lit(0.5)).alias("scores"))
    return regions.detections(rows).select("p_partkey", "det_ord", "x0", "score")


@query("p09_as_region", f"WITH q AS (SELECT p_partkey, {QUADS} AS poly FROM part), u AS (SELECT p_partkey, unnest(poly) AS p FROM q) SELECT p_partkey, CAST(ceil(max(CAST(p.x AS DOUBLE))) AS BIGINT) AS x1, 1 AS n_dets, -1 AS run, 1.0::DOUBLE AS score FROM u GROUP BY 1")
def p09(spark, sf_dir):
    return polygons(spark, sf_dir).select("p_partkey", regions.as_region(boxes.poly_box(F.col("poly"))).alias("r")).select("p_partkey", "r.x1", F.size("r.dets").alias("n_dets"), "r.run", "r.score")


@query("k09_tile_windows", "SELECT DISTINCT p_partkey, w AS start FROM (SELECT p_partkey, e, unnest(CASE WHEN e <= 1024 THEN [0] ELSE list_append(range(0, e - 1024 + 1, 768), e - 1024) END) AS w FROM (SELECT p_partkey, (p_size * 97)::BIGINT AS e FROM part))")
def k09(spark, sf_dir):
    e = (F.col("p_size") * 97).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(media.windows(e, 1024, 768)).alias("start")).select("p_partkey", F.col("start").cast("bigint"))


@query("k10_taper", "SELECT p_partkey, i, round(CASE WHEN i < e THEN (i + 1) / (e + 1.0::DOUBLE) WHEN i >= p_size - e THEN (p_size - i) / (e + 1.0::DOUBLE) ELSE 1.0 END, 9) AS w FROM (SELECT p_partkey, p_size, least(8, p_size // 2) AS e, unnest(range(0, p_size)) AS i FROM part)")
def k10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(media.taper(F.col("p_size"), 8)).alias("i", "w"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), F.round("w", 9).alias("w"))


@query("p25_parse_roi", "SELECT p_partkey, least(p_size / 100.0, 1.0)::DOUBLE AS x0, 1.0::DOUBLE AS x1 FROM part WHERE p_size < 40 AND p_partkey % 7 > 1")
def p25(spark, sf_dir):
    """Those out of order go (here from a size of 40 on), and those of three parts or with a word for a number."""
    x0 = F.format_string("%.2f", F.col("p_size") / 100.0)
    x1 = F.when(F.col("p_size") < 40, "1.0").otherwise("0.1")
    y1 = F.when(F.col("p_partkey") % 7 == 0, "all").when(F.col("p_partkey") % 7 > 1, " 0.5")  # null: left out
    rows = table(spark, sf_dir, "part").select("p_partkey", boxes.roi_of(F.concat_ws(",", x0, F.lit("0"), x1, y1)).alias("r"))
    return rows.where("r is not null").select("p_partkey", "r.x0", "r.x1")


@query("p26_fit_transform", "SELECT p_partkey, round(k, 9) AS k, round((800 - w * k) / 2, 6) + 0.0 AS dx, round((450 - h * k) / 2, 6) + 0.0 AS dy FROM (SELECT p_partkey, w, h, least(800 / w, 450 / h) AS k FROM (SELECT p_partkey, CAST(p_size * 16 AS DOUBLE) AS w, CAST(300 + p_partkey % 90 AS DOUBLE) AS h FROM part))")
def p26(spark, sf_dir):
    """A picture fitted into a pane of 800 x 450 and centred."""
    al = boxes.alignment(F.col("p_size") * 16, 300 + F.col("p_partkey") % 90, F.lit(800), F.lit(450), F.lit("fit"))
    rows = table(spark, sf_dir, "part").select("p_partkey", al.alias("al"))
    return rows.select("p_partkey", F.round("al.sx", 9).alias("k"), (F.round("al.tx", 6) + 0.0).alias("dx"), (F.round("al.ty", 6) + 0.0).alias("dy"))
