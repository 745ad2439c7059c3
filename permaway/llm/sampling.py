"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows are first thinned to so many times the sample, by a bound on their hash that follows from their number.
SPARE = 4


def least_hashed(rows: DataFrame, k: int, labels: int) -> DataFrame:
    """Of rows (d, y) the k of each label y with the smallest hashes of d, for the ``labels`` most frequent labels.

    The bound on the hash leaves some ``SPARE`` k rows of a label, whatever their
    number, before any row is ranked; fewer than k with a probability below 1e-20.
    """
    some = rows.where("d is not null and y is not null")
    often = some.groupBy("y").agg(F.approx_count_distinct("d", 0.02).alias("n")).orderBy(F.desc("n"), "y").limit(labels)
    h = some.select("d", "y", F.xxhash64("d").alias("h")).join(F.broadcast(often), "y")
    few = h.where(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) * F.col("n") < SPARE * k + 50).select("d", "y", "h").distinct()
    return few.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "d"))).where(F.col("k") <= k).select("d", "y")
