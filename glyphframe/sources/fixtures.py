"""Detections of planted captions, derived from the orders and part tables by integer arithmetic only.

A caption is an order: two words, shown for some frames of a clip, on one of four lanes. Its kind says how it behaves:
0 still, 1 an edge flickers, 2 it moves, 3 it has holes, 4 it never scores well, 5 it is tilted. The caption's id is for
oracles only and isn't among the columns that detections() returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs unchanged on Spark and DuckDB.
PLANTED = """
WITH cap AS (
  SELECT o_orderkey AS cap_id, CAST(floor(o_orderkey / 64.0) AS BIGINT) AS clip_id, o_orderkey % 4 AS lane,
         CAST(floor(o_orderkey / 4.0) AS BIGINT) % 16 AS slot, o_orderkey % 6 AS kind, 1 + o_custkey % 30 AS len,
         200 + 16 * (o_custkey % 40) AS bx, 120 + 10 * (o_orderkey % 7) AS ww, 40 + 4 * (o_orderkey % 5) AS hh
  FROM orders),
fr AS (
  SELECT c.*, p.p_partkey AS k, c.slot * 60 + p.p_partkey AS frame
  FROM cap c JOIN part p ON p.p_partkey < c.len
  WHERE p.p_partkey < 30 AND NOT (c.kind = 3 AND p.p_partkey % 7 IN (3, 4) AND p.p_partkey < c.len - 1)),
wd AS (SELECT 0 AS w UNION ALL SELECT 1 AS w)
SELECT clip_id, frame, cap_id, w.w AS word, kind,
       bx + CASE WHEN kind = 2 THEN 24 * k ELSE 0 END + w.w * (ww + 10) AS x0, 80 + 240 * lane AS y0,
       bx + CASE WHEN kind = 2 THEN 24 * k ELSE 0 END + w.w * (ww + 10) + ww AS x1,
       80 + 240 * lane + hh + CASE WHEN kind = 1 AND k % 2 = 1 THEN 16 ELSE 0 END AS y1,
       CAST(CASE WHEN kind = 4 THEN 0.42 WHEN k < 2 THEN 0.35 ELSE 0.93 END AS DOUBLE) AS score,
       CAST(CASE WHEN kind = 5 THEN 15.0 ELSE 0.5 END AS DOUBLE) AS tilt
FROM fr CROSS JOIN wd w
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame, det_ord, x0, y0, x1, y1, score, tilt; det_ord is the place by (y0, x0) within a frame."""
    tables(spark, sf_dir, "orders", "part")
    return spark.sql(f"SELECT clip_id, frame, CAST(row_number() OVER (PARTITION BY clip_id, frame ORDER BY y0, x0) - 1 AS INT) AS det_ord, x0, y0, x1, y1, score, tilt FROM ({PLANTED})")
