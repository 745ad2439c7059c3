"""Tabular centerlines: lines of section, latitude, longitude[, altitude[, kilometrage]].

The delimiter is chosen per line (tab, else comma); there is no quoting; blank
lines, ``#`` lines and rows without numeric coordinates are skipped; numbers are
read by their longest prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.functions import jsnum
from permaway.paths import files_of, whole_texts


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_ord, line_no, line) of whole files, in the order of ``paths``."""
    return whole_texts(spark, paths).select("file", "file_ord", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Points of lines: all columns but ``line`` stay; kilometrage is null where it is absent or no number."""
    rest = [c for c in lines.columns if c != "line"]
    # a generator keeps the filters above it: they would repeat whatever the line was made of
    t = lines.withColumn("_l", F.explode(F.array(jsnum.trim(F.col("line"))))).where((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    t = t.withColumn("_p", F.when(F.col("_l").contains("\t"), F.split("_l", "\t")).otherwise(F.split("_l", ","))).where(F.size("_p") >= 3)
    part = lambda k: F.get("_p", F.lit(k))
    alt = F.when(F.size("_p") > 3, F.coalesce(jsnum.parse_float(part(3)), F.lit(float("nan")))).otherwise(F.lit(0.0))
    out = t.select(*rest, jsnum.trim(part(0)).alias("section"), jsnum.parse_float(part(1)).alias("latitude"), jsnum.parse_float(part(2)).alias("longitude"), alt.alias("altitude"), jsnum.parse_float(part(4)).alias("kilometrage"))
    return out.where("latitude is not null and longitude is not null")


def read_centerlines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_lines(read_lines(spark, paths))


def read_table(spark: SparkSession, paths: list[str], typed: bool = True) -> DataFrame:
    """Any CSV with a header; typed by inference, or all text; empty lines are skipped."""
    return spark.read.csv(files_of(spark, paths), header=True, inferSchema=typed, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header by commas alone: all text, no quoting, names trimmed, values as they stand, null where a line is too short; blank lines are skipped.

    Of a name that stands twice the last column counts.
    """
    lines = whole_texts(spark, [path]).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    first = lines.where("line_no = 0").first()
    names = [n.strip() for n in first.line.split(",")] if first else []
    at = {n: k for k, n in enumerate(names)}
    body = lines.where((F.col("line_no") > 0) & (jsnum.trim(F.col("line")) != "")).withColumn("_p", F.split("line", ","))
    return body.select(*(F.get("_p", F.lit(k)).alias(n) for n, k in at.items()))
