"""Centerline tables that arrive as files: every micro-batch is drawn like a batch of files.

A file is the unit: a line is complete when its file is, so no state is kept
between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from permaway.options import DrawingOptions
from permaway.paths import decoded
from permaway.plans import pipelines
from permaway.sinks import text
from permaway.sources import centerline_csv


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (file, file_ord, line_no, line) of the files that appear in ``folder``."""
    whole = spark.readStream.option("wholetext", True).text(folder).select("value", F.element_at(F.split(decoded(F.col("_metadata.file_path")), "/"), -1).alias("file"))
    return whole.select("file", F.lit(0).alias("file_ord"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def draw_arriving(spark: SparkSession, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None], options: DrawingOptions = DrawingOptions()) -> StreamingQuery:
    """Calls ``write(fragments, batch)`` with one full-detail Placemark per arrived line; a repeated batch has the same number."""

    def batch(lines: DataFrame, number: int) -> None:
        points = pipelines.drawn_points(centerline_csv.parse_lines(lines))
        write(text.line_fragments(points, options.altitude_mode, options.offset, options.exaggeration), number)

    return arriving_lines(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
