"""The shared scratch folder: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from permaway.paths import new_dir
from permaway.shipping import ship

#: Arrow batches of this many rows and bytes at most, so that a batch of long texts fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """What every operator with Python workers needs: the package there, and batches that fit."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower())
        if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= most:  # the session's own smaller bound stays
            spark.conf.set(key, str(most))
