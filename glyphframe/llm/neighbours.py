"""Approximate nearest neighbours by cosine: low-dimensional stable projections, indexed by kd-trees.

Vectors are scaled to length 1, so that the largest cosine is the least Euclidean distance. A projection on PROJECTED
random Gaussian directions (a 2-stable law) turns a distance d into d times the root of a chi-square variable with
PROJECTED degrees of freedom. A query takes vectors in the order of their projected distance and verifies them on the
original ones. Once every projected neighbour nearer than r is verified and the k-th best distance found is d, a vector
nearer than d that is still unseen would have a projected distance of r or more, which has a chance of
1 - chi2_cdf(r * r / (d * d)): the search stops when that is at most MISSED.

The upper levels of the tree are cut on the projections of at most SAMPLED vectors (the least hashes of id and vector),
and deal all vectors to cells; a cell of more than SHARD_ROWS vectors, be they all alike, is dealt on to several shards by
hash. Every vector is in one shard, whose own kd-tree holds the lower levels. A query first searches the cell it lies in,
which gives a k-th best distance, and then the cells that this distance and the chi-square test don't rule out. Each time a
shard's tree is built once, and the queries stream by it.

Scores are worked out in double precision on the original vectors; ties go to the smaller id. Vectors that are null,
zero, of another length than most, or that hold null or non-finite components take no part, nor does a null id. Rows that
repeat an id are candidates each; a query's own id is never a candidate. Queries that repeat an id with other vectors are
answered each, with the same vector once. With fewer than k candidates all are returned; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, small

PROJECTED = 16
LEAF = 64
MISSED = 0.15
SHARD_ROWS = 8_192
#: Vectors, of the whole table, whose projections decide where the cells are cut.
SAMPLED = 20_000
SEED = 7


def chi2_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees: 1 - exp(-x/2) * sum of (x/2)^i / i! for i < degrees/2."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(np.array(middle), degrees) < p else (low, middle)
    return high


def directions(dimensions: int, projected: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, projected))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # or the squares of very large components would be infinite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class KdTree:
    """Boxes of at most leaf points, made by halving at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, z = todo.pop()
            if z - a <= leaf:
                bounds.append((a, z))
                continue
            own = points[self.order[a:z]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            middle = (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(own[:, axis], middle, kind="introselect")]
            todo += [(a, a + middle), (a + middle, z)]
        bounds.sort()
        self.starts, self.ends = (np.array(x, np.int64) for x in zip(*bounds, strict=True))
        boxed = points[self.order]
        self.low, self.high = np.minimum.reduceat(boxed, self.starts), np.maximum.reduceat(boxed, self.starts)

    def least_distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distance from a query to the box of each leaf."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Cells:
    """The upper levels of the tree: boxes without outer bounds, so that every point lies in one."""

    def __init__(self, points: np.ndarray, n: int):
        """n cells at most, cut at medians of a sample of projections."""
        self.cuts: list[tuple[int, float, int, int]] = []  # of inner nodes: axis, value, and the nodes below it and from it on (a cell c is ~c)
        self.root, leaves = self._cut(points, n, []), []
        self._collect(self.root, (np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf)), leaves)
        self.low, self.high = (np.stack(x) for x in zip(*leaves, strict=True))

    def _cut(self, points: np.ndarray, n: int, made: list) -> int:
        if n < 2 or len(points) < 2 or (points.max(0) == points.min(0)).all():
            made.append(None)
            return ~(len(made) - 1)
        axis = int(np.argmax(points.max(0) - points.min(0)))
        value = float(np.median(points[:, axis]))
        below = points[:, axis] < value
        if not below.any():  # the median is the least value
            value = float(points[points[:, axis] > value, axis].min())
            below = points[:, axis] < value
        at = len(self.cuts)
        self.cuts.append((axis, value, 0, 0))
        self.cuts[at] = (axis, value, self._cut(points[below], n // 2, made), self._cut(points[~below], n - n // 2, made))
        return at

    def _collect(self, node: int, box: tuple, leaves: list) -> None:
        if node < 0:
            leaves.append(box)
            return
        axis, value, below, above = self.cuts[node]
        low, high = box
        left, right = high.copy(), low.copy()
        left[axis], right[axis] = value, value
        self._collect(below, (low, left), leaves)
        self._collect(above, (right, high), leaves)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, value, below, above = self.cuts[node]
                left = points[rows, axis] < value
                todo += [(below, rows[left]), (above, rows[~left])]
        return out

    def within(self, point: np.ndarray, squared: float) -> np.ndarray:
        """The cells whose boxes are nearer to a point than that."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero(np.einsum("ij,ij->i", gap, gap) < squared)


class Index:
    """A shard: ids, unit vectors in the order of its kd-tree, and the tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.directions = directions(vectors.shape[1])
        unit = units(vectors)
        points = unit @ self.directions
        self.tree = KdTree(points)
        order = self.tree.order
        self.ids, self.unit, self.vectors, self.points = ids[order], unit[order], vectors[order], points[order]
        self.enough = chi2_quantile(1 - MISSED, self.directions.shape[1])

    def search(self, own: int, vector: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and cosines of the k nearest found, best first, and how many vectors were verified.

        bound is a k-th best squared distance that is known already.
        """
        unit = units(vector[None])[0]
        query = unit @ self.directions
        least = self.tree.least_distances(query)
        nearest_leaves = np.argsort(least, kind="stable")
        rows, cosines, verified = np.zeros(0, np.int64), np.zeros(0), 0
        waiting, apart = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(nearest_leaves) or len(waiting):
            # Leaves give up their points in the order of the boxes; a point is next once no unopened box is nearer.
            leaves = nearest_leaves[at : at + step]
            at, step = at + step, step * 2
            if len(leaves):
                fresh = np.concatenate([np.arange(self.tree.starts[x], self.tree.ends[x]) for x in leaves])
                fresh = fresh[self.ids[fresh] != own]
                gap = self.points[fresh] - query
                waiting, apart = np.concatenate([waiting, fresh]), np.concatenate([apart, np.einsum("ij,ij->i", gap, gap)])
            edge = least[nearest_leaves[at]] if at < len(nearest_leaves) else math.inf
            order = np.argsort(apart, kind="stable")
            waiting, apart = waiting[order], apart[order]
            ready, done = int(np.searchsorted(apart, edge, side="right")), 0
            while done < ready:
                if apart[done] >= self.enough * bound:
                    return (*self._best(rows, vector, k), verified)
                take = slice(done, min(ready, done + 4 * LEAF, max(done + 1, int(np.searchsorted(apart, self.enough * bound)))))
                done = take.stop
                verified += take.stop - take.start
                rows, cosines = np.concatenate([rows, waiting[take]]), np.concatenate([cosines, self.unit[waiting[take]] @ unit])
                if len(rows) >= k:
                    # All that may tie with the k-th stay until the exact scores decide.
                    kth = np.partition(cosines, -k)[-k]
                    best = cosines >= kth - 1e-9
                    rows, cosines = rows[best], cosines[best]
                    bound = min(bound, max(2 - 2 * kth, 0.0) + 1e-12)
            waiting, apart = waiting[ready:], apart[ready:]
            if edge >= self.enough * bound:
                break
        return (*self._best(rows, vector, k), verified)

    def _best(self, rows: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = units(self.vectors[rows]) @ units(vector[None])[0] if len(rows) else np.zeros(0)
        plain = (self.vectors[rows] @ vector) / (np.linalg.norm(self.vectors[rows], axis=1) * np.linalg.norm(vector))
        exact = np.where(np.isfinite(plain), plain, exact)
        first = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][first], exact[first]


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): doubles, without the vectors that take no part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if n else np.zeros((0, 0))


def _searched(routed: DataFrame, k: int, partitions: int) -> DataFrame:
    """routed: (cell, shard, own, id, v, bound), a shard's vectors with a null bound, and its queries. Gives the nearest found
    in each shard: query (own), vec_id, score, and verified at its best hit or, without a hit, at a null vec_id.

    A shard's vectors come first, and its queries stream by its index: memory holds a shard and a batch, whatever
    the number of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, index = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            bounds, whose = batch.column(5).to_pylist(), batch.column(3).to_numpy()
            owns, all_v = batch.column(2).to_pylist(), matrix(batch.column(4), batch.num_rows)
            out: list[tuple] = []
            for i, key in enumerate(keys):
                if key != now:
                    now, ids, vectors, index = key, [], [], None
                if bounds[i] is None:
                    ids.append(whose[i])
                    vectors.append(all_v[i])
                elif ids:
                    index = index or Index(np.array(ids, np.int64), np.stack(vectors))
                    found, scores, verified = index.search(int(whose[i]), all_v[i], k, bounds[i])
                    hits = list(zip(found.tolist(), scores.tolist(), strict=True)) or [(None, None)]
                    out += [(int(whose[i]), owns[i], v, s, verified if r == 0 else 0) for r, (v, s) in enumerate(hits)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "own", "vec_id", "score", "verified"])

    # The bound sorts a shard's vectors, which have none, before its queries.
    dealt = routed.repartition(partitions, "cell", "shard").sortWithinPartitions(F.col("cell"), F.col("shard"), F.col("bound").asc_nulls_first())
    return dealt.mapInArrow(run, "query_id long, own long, vec_id long, score double, verified long")


def nearest(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, verified (how many vectors the query's search took): of each query its k nearest
    among vectors; both tables have the columns named."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, asked = scratch.save(usable(vectors, id, vector)).read(), scratch.save(usable(queries, id, vector).distinct()).read()
    sizes = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
    dimensions = sizes[0] if sizes else 1
    rows, asked = rows.where(F.size("v") == dimensions), asked.where(F.size("v") == dimensions)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLED).select("v").toArrow()["v"].combine_chunks()
    points = units(matrix(sample, len(sample))) @ directions(dimensions) if len(sample) else np.zeros((0, PROJECTED))
    cells = Cells(points, -(-total // (SHARD_ROWS // 2)))
    enough = chi2_quantile(1 - MISSED, PROJECTED)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), batch.num_rows)
            at = cells.of(units(v) @ directions(dimensions)) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1)], names=["cell", "id", "v"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy()
            hits = [cells.within(p, enough * b) for p, b in zip(units(v) @ directions(dimensions), batch.column(3).to_numpy(), strict=True)] if len(v) else []
            hits = [h[h != own] for h, own in zip(hits, at.tolist(), strict=True)]
            n = [len(h) for h in hits]
            rows_of = batch.take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hits) if hits else np.zeros(0, np.int64), pa.int64()), rows_of.column(0), rows_of.column(1), rows_of.column(3)], names=["cell", "id", "v", "bound"])

    placed = scratch.save(rows.mapInArrow(home, "cell long, id long, v array<double>")).read()
    shards = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))
    shards = small(scratch.save(shards).read())
    columns = lambda df, shard, bound: df.select("cell", shard.alias("shard"), F.xxhash64("id", "v").alias("own"), "id", "v", bound.cast("double").alias("bound"))
    candidates = columns(placed.join(shards, "cell"), F.pmod(F.xxhash64("v", "id"), F.col("shards")), F.lit(None))
    every_shard = lambda df: columns(df.join(shards, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), F.col("shard").cast("long"), F.col("bound"))
    at_home = scratch.save(asked.mapInArrow(home, "cell long, id long, v array<double>")).read()
    first = scratch.save(_searched(candidates.union(every_shard(at_home.withColumn("bound", F.lit(math.inf)))), k, partitions)).read()

    by_score = Window.partitionBy("query_id", "own").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    # Without k neighbours at home there is no bound yet, and a little is added as the scores are rounded.
    ranked = first.where("vec_id is not null").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    bounds = ranked.select(F.col("query_id").alias("id"), "own", (2 - 2 * F.col("score") + 1e-9).alias("bound"))
    bounded = at_home.withColumn("own", F.xxhash64("id", "v")).join(bounds, ["id", "own"], "left").select("id", "v", "cell", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    further = scratch.save(bounded.mapInArrow(reached, "cell long, id long, v array<double>, bound double")).read()
    second = _searched(candidates.union(every_shard(further)), k, partitions)

    # Every shard has given k at most; the limit on the rank is applied before the shuffle as well as after it.
    found = scratch.save(first.union(second)).read()
    work = found.groupBy("query_id", "own").agg(F.sum("verified").alias("verified"))
    best = found.drop("verified").where("vec_id is not null").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.join(work, ["query_id", "own"]).select("query_id", "rank", "vec_id", "score", "verified")
