"""Mixing sources to target weights, with DataFrame functions only.

Sources share the words of all documents by weight; a source's target stops at so many times its own words, and what it
can't take is shared among the others by weight. Within a source, documents come in the order of a hash of their id. A
source is taken whole as often as its target holds it (epochs), and then in that order up to the exact word at which the
target is reached.

The order is found without bringing a source together: the first hex digits of the hash are a document's bin, words are
added up by source and bin, the sums before each bin come from at most 65,536 rows of a source, and only the documents
of one bin of one source are sorted together.

A null text has no words; a null source is a source of its own, the last. Documents without words are taken no words of.
Rows that repeat an id are taken one after the other (by size, then by text hash). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, Scratch, small, unclashed

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Hex digits of the hash that make a bin: a source has at most 16 ** BIN_DIGITS bins, however many documents it has.
BIN_DIGITS = 4


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Of (source, source_size), a row for each source: also target.

    With every excess reshared by weight until no source is above its limit, a source gets min(limit, level * weight)
    for one level. Sorted by limit / weight, the sources up to some place are at their limits; the level follows from
    what they leave to the rest, at the first place where it doesn't exceed the next one's own ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most_epochs
    given = sources.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", limit / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = given.withColumn("level", left / open_weight)
    lowest = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return level.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("limit", F.col("weight") * F.coalesce(lowest, F.col("ratio"))))).select("source", "source_size", "target")


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), part (words of one more copy) and taken."""
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), F.coalesce(F.md5(F.col(f"`{id}`").cast("string")), F.lit("")).alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    rows = Scratch(docs.sparkSession).save(rows.withColumn("bin", F.substring("key", 1, BIN_DIGITS))).read()  # so that texts are read once
    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    of_source = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.select("source", "bin", F.coalesce(F.sum("bin_size").over(of_source), F.lit(0)).alias("bin_start"))
    goals = targets(binned.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most_epochs)
    bins = starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "bin", "bin_start", "source_size", "target")
    within = Window.partitionBy("source", "bin").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("p").join(bins.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bin") == F.col("b.bin")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("bin_start") - F.col("before"))).cast("long")
    return (
        joined.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", "bin_start", "before", epochs.alias("epochs"))
        .withColumn("part", part)
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    Whole texts only: the document that its source's target cuts is taken once more if half of it or more lies inside.
    Rows that share an id follow the decision of the one that is taken most; rows without words never come.
    """
    decided = mix(docs, id, source, text, weights, most_epochs)
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    # Repeated ids share one decision, or the join would multiply them.
    decided = decided.where("size > 0").select(F.col("doc_id").alias("mixed_id"), copies.cast("int").alias("copies")).groupBy("mixed_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    decided = small(Scratch(docs.sparkSession).save(decided).read())
    own, names = unclashed(docs)
    with_words = own.where(F.col(names[text]).rlike(r"[^\x20\x09-\x0D]"))
    taken = with_words.join(decided, F.col(names[id]).eqNullSafe(F.col("mixed_id"))).select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*names.values()).toDF(*docs.columns)


def oracle(weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> str:
    """DuckDB SQL for mix() over documents: doc_id, size, source_size, target, taken."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, list_extract([{", ".join(f"CAST({w} AS DOUBLE)" for w in weights)}], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1)::INT) AS weight,
         CAST(source_size AS DOUBLE) * {most_epochs} AS lim
  FROM s),
r AS (SELECT *, lim / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(lim) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(lim, weight * coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), ratio)) END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS taken FROM p
"""
