"""Connected components of an edge table.

Many edges: alternating large-star and small-star rounds.  Each round sends every
edge towards the smallest neighbour, by a minimum per node (partial sums first)
and a join that adaptive execution can split; no group is ever gathered, and
every round ends in a written table.

Few edges, by count: one task of an executor joins them in memory, which a
hundred small shuffles would only delay.  Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.storage import written

#: Edges that one task may hold (some 100 bytes each).
ONE_TASK = 400_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the partition; the root of a tree is its smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
    ids = list(up)
    for k in range(0, len(ids), 10_000):
        part = ids[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["id", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Edges (a, b) to (id, component): every node that has an edge, with the smallest node it reaches."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")), "edges")
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_joined, "id long, component long")
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = written(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
