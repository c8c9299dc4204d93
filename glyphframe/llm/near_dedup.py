"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. Sketch. A text's set of five-word shingles fills a sketch of COORDINATES bins. In round i every shingle is hashed to
   a bin and a value, and a bin that no earlier round filled keeps its least value. Rounds go on while a bin is empty;
   after COORDINATES of them, round COORDINATES + j hashes all shingles to bin j, so that every bin is filled. Two sets
   agree on a coordinate with probability equal to their similarity.
2. Collapse. Texts with the same set (128-bit sum of hashes) are one class; its representative is its smallest id.
3. Banding. Each run of ROWS coordinates is a band's key. Two sets of similarity 0.75 share no band with probability
   (1 - 0.75 ** ROWS) ** (COORDINATES / ROWS), for 128 and 4 that is 5 in a million.
4. Links. Every member of a band is compared with the band's smallest member, on the full sets, and verified links join
   representatives to components. What that leaves open are members of one band in different components; only those
   are compared too (as pairs in a small band, block by block in a large one), after which no pair that shares a band and
   could still join two components is unverified. So a large group of copies costs a comparison for each member, not for
   each pair, and no link is lost.

A null text or one without words is linked with nothing. Rows that share an id are one document with several texts: its
links are those of all of them, n_shingles is each row's own. A null id is linked with nothing, and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, joined_components
from .runtime import Scratch, blocks, give_back, map_text, small, unclashed
from .shingles import mix, shingle_sets

COORDINATES = 128
ROWS = 4
#: A link is a similarity of at least PERCENT / 100.
PERCENT = 75
#: Bands of up to so many sets are compared in pairs; those of more in blocks of about BLOCK sets.
PAIRED, BLOCK = 32, 400
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(shingles: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set; rows of empty sets mean nothing."""
    n = len(bounds) - 1
    out = np.full(n * t, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * t):
        if not len(owner):
            break
        h = mix(shingles, seed=i + 1)
        where = owner * t + ((h & np.uint64(t - 1)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, where, np.uint64(i << 54) | (h >> np.uint64(10)))
        open_sets = (out.reshape(n, t) == _EMPTY).any(axis=1)
        live = open_sets[owner]
        if not live.all():
            shingles, owner = shingles[live], owner[live]
    return out.reshape(n, t)


def sketch_documents(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (which name the set), bands (a key for each)."""
    made = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def block(texts: list[bytes | None]) -> dict:
        shingles, bounds = shingle_sets(texts)
        sums = [np.append(np.uint64(0), np.cumsum(mix(shingles, seed))) for seed in (301, 302)]
        s1, s2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
        rows = sketches(shingles, bounds).reshape(len(texts), COORDINATES // ROWS, ROWS)
        keys = np.arange(COORDINATES // ROWS, dtype=np.uint64) + np.zeros((len(texts), 1), np.uint64)
        for k in range(ROWS):
            keys = mix(keys ^ rows[:, :, k], seed=k + 401)
        return {"n_shingles": np.diff(bounds), "s1": s1, "s2": s2, "bands": list(keys.view(np.int64))}

    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_text(own, "text", ["doc_id"], made, lambda: block)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough; texts: (id, text)."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    joined = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    schema = T.StructType([T.StructField("a", pairs.schema["a"].dataType), T.StructField("b", pairs.schema["b"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch, other in blocks(batches, "tb"):
            keep = np.zeros(batch.num_rows, bool)
            flat, bounds = shingle_sets(other)
            for i, own in enumerate(batch.column(2)):
                whole = own.as_buffer()
                if (one := whole and whole.to_pybytes()) != last[0]:
                    last = one, shingle_sets([one])[0]
                x, y = last[1], flat[bounds[i] : bounds[i + 1]]
                if len(x) and len(y) and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
        give_back()

    return joined.mapInArrow(run, schema)


def _within_small(placed: DataFrame, keys: DataFrame, done: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members, of different components, of bands that few sets share; pairs that are done are left out."""
    rest = placed.where("rep > first").join(keys, "key").select("key", "rep", "n_shingles", "component")
    x, y = rest.alias("x"), rest.alias("y")
    alike = F.expr(f"100 * least(x.n_shingles, y.n_shingles) >= {PERCENT} * greatest(x.n_shingles, y.n_shingles)")
    pairs = x.join(y, F.expr("x.key = y.key and x.rep < y.rep and x.component <> y.component") & alike)
    return verified(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), texts)


def _within_large(scratch: Scratch, placed: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members, of different components, of bands that many sets share.

    A band's members are dealt to blocks of about BLOCK. Two blocks meet in one task, which counts all common shingles
    as a product of matrices, and gives only links that join components that it hasn't joined: no pair becomes a row.
    """
    blocks_of = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = placed.join(keys, "key").select("key", "rep", "component", blocks_of.alias("of"), F.pmod(F.xxhash64("rep", "key"), blocks_of).cast("int").alias("own"))
    rows = scratch.save(rows.join(texts.withColumnRenamed("id", "rep"), "rep"))
    left = rows.read().select("key", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("of") - 1)).alias("j"), "rep", "component", "text")
    right = rows.read().select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), "rep", "component", "text")
    schema = T.StructType([T.StructField("a", placed.schema["rep"].dataType), T.StructField("b", placed.schema["rep"].dataType)])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = links_between([t.encode() for t in x["text"]], [t.encode() for t in y["text"]], x["component"].to_numpy(), y["component"].to_numpy())
        return pd.DataFrame({"a": x["rep"].to_numpy()[found[:, 0]], "b": y["rep"].to_numpy()[found[:, 1]]})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInPandas(meet, schema)


def links_between(xs: list[bytes], ys: list[bytes], x_groups: np.ndarray, y_groups: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Rows (place in xs, place in ys) of links that join all groups that links between the two lists join."""
    if not xs or not ys:
        return np.zeros((0, 2), np.int64)
    (sx, bx), (sy, by) = shingle_sets(xs), shingle_sets(ys)
    shared = np.intersect1d(sx, sy)
    size_x, size_y = np.diff(bx), np.diff(by)
    cells = []
    for flat, size in ((sx, size_x), (sy, size_y)):
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], np.repeat(np.arange(len(size)), size)[hit][order]))
    common = np.zeros((len(xs), len(ys)), np.float32)  # counts below 2 ** 24 are exact
    for start in range(0, len(shared), columns):
        sides = []
        for (at, row), n in zip(cells, (len(xs), len(ys)), strict=True):
            part = slice(*np.searchsorted(at, [start, start + columns]))
            side = np.zeros((n, columns), np.float32)
            side[row[part], at[part] - start] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    linked = (100 * common >= PERCENT * (size_x[:, None] + size_y[None, :] - common)) & (common > 0) & (x_groups[:, None] != y_groups[None, :])
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while (up := root.setdefault(g, g)) != g:
            root[g] = g = root[up]
        return g

    found = []
    for i, j in np.argwhere(linked).tolist():
        if (g := find(x_groups[i])) != (h := find(y_groups[j])):
            root[g] = h
            found.append((i, j))
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id and kept. Other columns of docs may have any name."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.save(sketch_documents(docs, id, text))
    sets = sketched.read().where("n_shingles > 0 and doc_id is not null")
    owners = sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    of_text = scratch.save(sets.select("doc_id", "n_shingles", "s1", "s2").join(owners, ["s1", "s2"]).select("doc_id", "n_shingles", "rep"))
    first = sets.join(owners.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"), "n_shingles")
    shared = first.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    members = scratch.save(first.join(shared, "key").select("key", "first", "rep", "n_shingles").distinct())
    rows = scratch.save(sketched.read().select("doc_id", "n_shingles"))
    scratch.drop(sketched)
    stars = scratch.save(members.read().where("first < rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())

    named = scratch.save(members.read().select(F.col("rep").alias("id")).distinct())
    # An id with several texts takes part with each of them.
    texts = scratch.save(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(small(named.read()), "id", "left_semi").distinct())
    scratch.drop(named)
    links = scratch.save(verified(stars.read(), texts.read()))
    # Ids with several texts tie the classes of these together.
    tied = of_text.read().groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    ties = scratch.save(of_text.read().join(tied, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    labels = components(scratch, links.read().union(ties.read()))
    scratch.drop(links, ties)

    placed = scratch.save(members.read().join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    scratch.drop(members)
    mixed = scratch.save(placed.read().groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("key", "n")).read()
    more = scratch.save(_within_small(placed.read(), mixed.where(F.col("n") <= PAIRED), stars.read(), texts.read()).union(_within_large(scratch, placed.read(), mixed.where(F.col("n") > PAIRED), texts.read())))
    scratch.drop(placed, stars, texts)
    if more.read().limit(1).count():
        labels = joined_components(scratch, labels, more.read())
    label_of = labels.withColumnRenamed("node", "rep")
    component = of_text.read().select("doc_id", "rep").distinct().join(label_of, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    found = rows.read().join(component, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component; of rows that repeat an id and a text, one."""
    found = Scratch(docs.sparkSession).save(near_duplicates(docs, id, text).select("doc_id", "kept")).read()
    own, names = unclashed(docs)
    removed = found.where("not kept").select(F.col("doc_id").alias("removed_id")).distinct()
    stay = own.join(small(removed), F.col(names[id]) == F.col("removed_id"), "left_anti")
    repeated = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("repeated_id")).count().where("count > 1").select("repeated_id")
    if repeated.limit(1).count():
        repeated = small(repeated)
        again = F.col(names[id]) == F.col("repeated_id")
        stay = stay.join(repeated, again, "left_anti").union(stay.join(repeated, again, "left_semi").dropDuplicates([names[id], names[text]]))
    return stay.toDF(*docs.columns)
