"""Nearest neighbours by inner product over 2-stable projections in kd-trees.

Inner products become distances by one more coordinate: with M the largest norm,
``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)`` give
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.  A Gaussian projection to ``DIM``
dimensions turns a distance d into one whose square is d^2 times a chi-square
variable.  Every cell of vectors holds a kd-tree of its projections.  A query
descends it best first: the nearest open node is opened, or if it is a leaf, its
vectors are verified with the exact inner product, until the chi-square test says
that a vector nearer than the current k-th one would have come earlier with
probability ``1 - MISS``.

Cells: a kd-tree over a bounded sample of projections splits the space (``SAMPLE``
points at least, ``PER_CELL`` for each cell, ``MOST_SAMPLE`` at most); a cell that
holds more than ``CELL`` vectors (copies of one vector, say) is dealt by id.  A
query first searches its own cell; with the k-th distance from there, the same
test decides which other cells it visits at all, by descent from the root.  A
cell is sent to as many groups as it has blocks of queries.  Every vector is indexed.

Defined cases: null ids, and vectors that are null, zero, hold null or
non-finite components, or have another length than most, take no part; ties go
to the smaller id; a query is never its own neighbour; with fewer candidates all
are returned; equal ids never match each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.storage import written

DIM = 8
MISS = 0.02
LEAF = 64
#: Children of a node of a tree.
FAN = 16
#: Vectors of one tree.
CELL = 8192
#: Projections that the cells are fitted on: at least, for each cell, and at most (64 bytes each on the driver).
SAMPLE, PER_CELL, MOST_SAMPLE = 20_000, 64, 2_000_000
#: Queries of one group.
BLOCK = 512
#: Leaves verified between two tests.
STRIDE = 4
SEED = 7

FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dim: int = DIM) -> float:
    """For an even dimension, by bisection of the closed form of its distribution."""
    lo, hi = 0.0, 1e3
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dim // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


STOP = chi_square_quantile(1 - MISS)


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, DIM))


def _projected(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm * norm - (x * x).sum(1)))
    return np.column_stack([x, last]) @ projection(x.shape[1])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Tree:
    """A kd-tree of projected points: a permutation in leaf order, and for each node its bounds and either children or rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.rows: list[tuple[int, int]] = [(0, len(points))]  # of every node
        self.children: list[tuple[int, int]] = [(0, 0)]  # numbers of the first child and behind the last; none for a leaf
        node = 0
        while node < len(self.rows):
            parts = [self.rows[node]]
            while len(parts) < FAN and any(b - a > leaf for a, b in parts):
                parts = [x for a, b in parts for x in (self._halves(points, a, b) if b - a > leaf else [(a, b)])]
            if len(parts) > 1:
                self.children[node] = (len(self.rows), len(self.rows) + len(parts))
                self.rows += parts
                self.children += [(0, 0)] * len(parts)
            node += 1
        sorted_ = points[self.order]
        self.low = np.array([sorted_[a:b].min(0) if b > a else np.full(DIM, np.inf) for a, b in self.rows])
        self.high = np.array([sorted_[a:b].max(0) if b > a else np.full(DIM, -np.inf) for a, b in self.rows])

    def _halves(self, points: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        part = self.order[a:b]
        own = points[part]
        mid = (b - a) // 2
        self.order[a:b] = part[np.argpartition(own[:, int(np.argmax(np.ptp(own, axis=0)))], mid)]
        return [(a, a + mid), (a + mid, b)]

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Best-first descent: squared projected distance and rows of one leaf after another, nearest first."""
        open_ = [(0.0, 0)]
        while open_:
            gap, node = heappop(open_)
            first, end = self.children[node]
            if first == end:
                yield gap, *self.rows[node]
                continue
            away = np.maximum(0, np.maximum(self.low[first:end] - q, q - self.high[first:end]))
            for child, g in enumerate((away * away).sum(1).tolist(), first):
                heappush(open_, (g, child))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, norm: float, k: int, bound: np.ndarray) -> list[tuple[int, int, float]]:
    """Per query its best k vectors of one cell with scores not under ``bound``; equal vectors get equal scores."""
    tree = Tree(_projected(x, norm, False))
    x, ids = x[tree.order], ids[tree.order]
    found = []
    for vector, projected, own, least in zip(q, _projected(q, norm, True), q_ids.tolist(), bound.tolist(), strict=True):
        square = float(vector @ vector) + norm * norm
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        leaves = tree.leaves(projected)
        while True:
            reach = max(0.0, square - 2 * least) * STOP
            near = [rows for gap, *rows in islice(leaves, STRIDE) if gap <= reach]
            if near:
                rows = np.concatenate([np.arange(a, b) for a, b in near])
                score = (x[rows] * vector).sum(1)
                keep = (score >= least) & (ids[rows] != own)
                best_s, best_i = np.concatenate([best_s, score[keep]]), np.concatenate([best_i, ids[rows[keep]]])
                if len(best_s) > k:
                    top = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[top], best_i[top]
                if len(best_s) == k:
                    least = max(least, float(best_s.min()))
            if len(near) < STRIDE:  # leaves come in order: the rest is farther, or there is none
                break
        found += zip([own] * len(best_s), best_i.tolist(), best_s.tolist(), strict=True)
    return found


class Cells:
    """Splits of the projected space, fitted on a sample; node 0 is the root, ``cell`` numbers the nodes that are not split."""

    def __init__(self, points: np.ndarray, count: int):
        self.dim, self.value, self.left, self.right, self.cell = [0], [0.0], [-1], [-1], [-1]
        self.low, self.high = [np.full(DIM, -np.inf)], [np.full(DIM, np.inf)]
        self.count = 0
        self._grow(0, points, max(1, count))
        self.dim, self.left, self.right, self.cell = (np.array(c, np.int64) for c in (self.dim, self.left, self.right, self.cell))
        self.value, self.low, self.high = np.array(self.value), np.array(self.low), np.array(self.high)

    def _grow(self, node: int, points: np.ndarray, count: int) -> None:
        if count <= 1 or len(points) < PER_CELL or (spread := np.ptp(points, axis=0)).max() == 0:
            self.cell[node] = self.count
            self.count += 1
            return
        d = int(np.argmax(spread))
        value = float(np.median(points[:, d]))
        right = points[:, d] >= value
        if right.all():
            value = float(points[points[:, d] > value, d].min())
            right = points[:, d] >= value
        self.dim[node], self.value[node] = d, value
        for side, held, share in ((self.left, points[~right], count // 2), (self.right, points[right], count - count // 2)):
            side[node] = child = len(self.dim)
            low, high = self.low[node].copy(), self.high[node].copy()
            (high if side is self.left else low)[d] = value
            for column, x in zip((self.dim, self.value, self.left, self.right, self.cell, self.low, self.high), (0, 0.0, -1, -1, -1, low, high), strict=True):
                column.append(x)
            self._grow(child, held, share)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.cell[at] < 0)):
            k = at[inner]
            at[inner] = np.where(points[inner, self.dim[k]] >= self.value[k], self.right[k], self.left[k])
        return self.cell[at]

    def within(self, points: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """For each query the cells whose squared projected distance is at most its reach, by descent from the root."""
        found: list[list[int]] = [[] for _ in points]
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        while len(query):
            p = points[query]
            keep = (np.maximum(0, np.maximum(self.low[node] - p, p - self.high[node])) ** 2).sum(1) <= reach[query]
            query, node = query[keep], node[keep]
            done = self.cell[node] >= 0
            for q, c in zip(query[done].tolist(), self.cell[node[done]].tolist(), strict=True):
                found[q].append(c)
            query, node = np.repeat(query[~done], 2), np.column_stack([self.left[node[~done]], self.right[node[~done]]]).ravel()
        return found


def able(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part."""
    v = F.col("v")
    x = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(~bad & F.exists(v, lambda c: c != 0))
    size = x.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return x.where(F.size("v") == (size.s if size else 0))


def _sampled(x: DataFrame, norm: float, total: int, size: int) -> np.ndarray:
    """Projections of some ``size`` of the vectors, those with the smallest hashes of their id, in the order of the hashes."""

    def run(batches):
        for batch in batches:
            if len(batch):
                p = _projected(_matrix(pa.chunked_array([batch.column(1)])), norm, False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), pa.list_(pa.float64()))], ["h", "p"])

    h = F.xxhash64("id")
    few = x.where(F.shiftrightunsigned(h, 1) / F.lit(2.0**63) < size / total).select(h.alias("h"), "v")
    got = few.mapInArrow(run, "h long, p array<double>").toPandas()  # bounded by MOST_SAMPLE
    return np.stack(got.sort_values("h", kind="stable")["p"]) if len(got) else np.zeros((0, DIM))


def _grouped(search: Callable, cells: DataFrame, queries: DataFrame) -> DataFrame:
    return cells.groupBy("cell", "part", "block").cogroup(queries.groupBy("cell", "part", "block")).applyInArrow(search, FOUND)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row that ``is_query`` (over ``id``) selects, against all rows."""
    spark = vectors.sparkSession
    x = able(vectors, id_column, vector_column)
    total, square = x.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = math.sqrt(square) * (1 + 1e-12)
    wanted = min(-(-total // cell), MOST_SAMPLE // PER_CELL)
    cells = Cells(_sampled(x, norm, total, max(SAMPLE, wanted * PER_CELL)) if wanted > 1 else np.zeros((0, DIM)), wanted)

    def assign(query: bool):
        def run(batches):
            for batch in batches:
                c = cells.of(_projected(_matrix(pa.chunked_array([batch.column(1)])), norm, query)) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.int64())], ["id", "v", "cell"])

        return run

    held = written(x.mapInArrow(assign(False), "id long, v array<double>, cell long"), "vectors")
    queries = written(x.where(is_query).mapInArrow(assign(True), "id long, v array<double>, cell long"), "queries")
    sizes = {r.cell: r["count"] for r in held.groupBy("cell").count().toLocalIterator()}  # one number for each cell
    parts = {c: -(-n // cell) for c, n in sizes.items()}
    part_table = F.broadcast(spark.createDataFrame(list(parts.items()), "cell long, parts long"))  # at most MOST_SAMPLE / PER_CELL rows
    held = held.join(part_table, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            ids, q_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            rows = nearest(_matrix(left.column("v")), ids, _matrix(right.column("v")), q_ids, norm, k, right.column("bound").to_numpy())
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    def run(routed: DataFrame) -> DataFrame:
        """Searches the routed queries (id, v, cell, bound) in all parts of their cells; a cell goes to each block of its own queries."""
        blocks = F.broadcast(routed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks")))  # a row for each cell at most
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        q = routed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(part_table, "cell").withColumn("part", numbers("parts")).drop("parts", "blocks")
        c = held.join(blocks, "cell").withColumn("block", numbers("blocks")).drop("blocks")
        return _grouped(search, c, q)

    lowest = F.lit(-1e300)
    found = run(queries.withColumn("bound", lowest))
    if cells.count > 1:
        found = written(found, "own_cells")
        kth = found.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), k - 1).alias("kth"), F.count("*").alias("n"))
        known = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.col("cell").alias("own"), F.when(F.col("n") >= k, F.col("kth")).otherwise(lowest).alias("bound"))

        def route(batches):
            for batch in batches:
                q = _matrix(pa.chunked_array([batch.column(1)])) if len(batch) else np.zeros((0, 1))
                bound = batch.column(3).to_numpy()
                reach = np.maximum(0, (q * q).sum(1) + norm * norm - 2 * bound) * STOP
                far = cells.within(_projected(q, norm, True), reach) if len(batch) else []
                far = [[c for c in cs if c != own] for cs, own in zip(far, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(far, pa.list_(pa.int64()))], ["id", "v", "bound", "cells"])

        routed = known.mapInArrow(route, "id long, v array<double>, bound double, cells array<long>").select("id", "v", "bound", F.explode("cells").alias("cell"))
        found = found.unionByName(run(written(routed, "routes")))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's query set: ids divisible by 20, 20 neighbours each."""
    return neighbours(vectors, F.pmod(F.col("id"), F.lit(20)) == 0)


#: DuckDB SQL for the exact answer over the table embeddings; the operator must reach at least nine tenths of it.
BRUTE_FORCE_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: cast(e AS double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM x AS q JOIN x AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
