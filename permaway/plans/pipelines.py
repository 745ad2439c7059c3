"""The two pipelines: drawn paths to centerlines, and centerlines to drawn lines.

A file is known by its place among the paths, never by its name alone: files of
one name in different folders stay apart until the outputs, where the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permaway.functions.jsnum import section_order
from permaway.operators import sections as chain
from permaway.operators import track
from permaway.options import CenterlineOptions, DrawingOptions
from permaway.paths import files_of, name_of
from permaway.sinks import archive, text
from permaway.sources import centerline_csv, kml

KEYS = ("file_ord", "file", "section_key")
_EMPTY = "no points in "
#: Archives of tables are packed quickly rather than tightly.
LEVEL = 1


def sections(points: DataFrame) -> DataFrame:
    """Scanned points (file, file_ord, section, placemark_idx, tuple_idx, ...) as ordered sections.

    Placemarks of one name form one section; ``section_ord`` sorts the sections of a file.
    """
    keyed = points.withColumn("section_key", track.section_key(F.col("section")))
    keyed = keyed.withColumn("idx", F.struct("placemark_idx", "tuple_idx"))
    keyed = keyed.withColumn("section_ord", section_order(F.col("section_key"), F.min("idx").over(Window.partitionBy(*KEYS))))
    return track.numbered(keyed, KEYS, "idx").drop("placemark_idx", "tuple_idx")


def _chained(options: CenterlineOptions) -> dict:
    curves = (options.curve_arc, options.straight_threshold) if options.find_curves else None
    return {"interval": options.output_spacing, "detail": options.spline_detail, "densify": (options.max_segment, options.densify_spacing), "curves": curves}


def centerline(points: DataFrame, options: CenterlineOptions = CenterlineOptions(), keys: track.Keys = KEYS, more_than: int = 0) -> DataFrame:
    """Densify, fit, flatten, resample, radius and chainage of ordered sections of so many points: one exchange, one pass."""
    line = chain.fitted(points, keys, **_chained(options), chainage=True, more_than=more_than)
    return line if options.find_curves else line.withColumn("curve_radius", F.lit(None).cast("double"))


class EmptyFileError(ValueError):
    """An input file holds no usable point; nothing is written."""


def build_centerlines(spark: SparkSession, paths: list[str], options: CenterlineOptions = CenterlineOptions(), output: str | None = None) -> DataFrame:
    """(file_name, content) of one centerline CSV per drawn file; with ``output`` also one archive of them.

    Every file is parsed once.  A file without points fails whatever reads the rows; with
    ``output`` that is an ``EmptyFileError`` here, and no archive is left.
    """
    files = files_of(spark, paths)
    points = kml.points(kml.read_placemarks(spark, files)).select("file_ord", "file", "section", "placemark_idx", "tuple_idx", "latitude", "longitude", "altitude")
    points = sections(points)
    # every file has a row of its own beside its sections: a file without any other holds no point
    names = [name_of(p).replace(".kml", ".csv", 1) for p in files]
    last = {n: k for k, n in enumerate(names)}
    marks = spark.createDataFrame([(k, n, last[n] == k) for k, n in enumerate(names)], "file_ord int, file_name string, wins boolean")

    def tables(head: Column, columns: list[str], whole: Callable[[Column], Column], level: int | None) -> DataFrame:
        """Of each file the head and what its sections' lines, printed where they are made, give in their order."""
        rows = chain.printed(points, KEYS, **_chained(options), more_than=track.LEAST_POINTS, level=level).drop("file", "section_key")
        parts = F.array_sort(F.collect_list(F.when(F.col(columns[0]).isNotNull(), F.struct("section_ord", F.struct(*columns).alias("_t")))))
        body = rows.unionByName(marks, allowMissingColumns=True).groupBy("file_ord").agg(parts.alias("_a"), F.max("file_name").alias("file_name"), F.max("wins").alias("wins"), F.count("section_ord").alias("n"))
        content = whole(F.concat(F.array(head), F.transform("_a", lambda x: x["_t"])))
        missing = F.raise_error(F.concat(F.lit(_EMPTY), F.col("file_name"))).cast("boolean")
        # of equal names the last file counts, but none may be empty
        return body.where(F.when(F.col("n") == 0, missing).otherwise(F.col("wins"))).select("file_name", content.alias("content"))

    header = text.CSV_HEADER + "\n"
    if output:
        data, crc, size = archive.deflated([header], LEVEL)
        piece = F.struct(F.lit(bytearray(data)).alias("data"), F.lit(crc).cast("bigint").alias("crc"), F.lit(size).cast("bigint").alias("size"))
        try:
            archive.write_archive(tables(piece, ["data", "crc", "size"], lambda pieces: pieces, LEVEL), output)
        except PySparkException as e:
            if _EMPTY in str(e):
                raise EmptyFileError(str(e)[str(e).index(_EMPTY) :].splitlines()[0]) from e
            raise
    return tables(F.struct(F.lit(header).alias("text")), ["text"], lambda texts: F.array_join(F.transform(texts, lambda x: x["text"]), ""), None)


def last_of_each(points: DataFrame) -> DataFrame:
    """Per base name (``.csv`` removed) the points of the last file only, at the place of the first."""
    named = points.withColumn("line", text.renamed(F.col("file"), ".csv", ""))
    w = Window.partitionBy("line")
    return named.withColumns({"_last": F.max("file_ord").over(w), "line_ord": F.min("file_ord").over(w)}).where("file_ord = _last").drop("_last")


def drawn_points(points: DataFrame) -> DataFrame:
    """Points of centerline tables as lines: one geometry per file."""
    return track.numbered(last_of_each(points), ["line"], "line_no").drop("line_no")


def build_lines(spark: SparkSession, paths: list[str], options: DrawingOptions = DrawingOptions(), output: str | None = None) -> DataFrame:
    """One row with the drawn lines of centerline CSVs; with ``output`` also an archive that holds it as doc.kml.

    A row ends at 2 GB of text; the archive is written from the lines and has no such end.
    """
    points = drawn_points(centerline_csv.read_centerlines(spark, paths))
    drawing = (options.altitude_mode, options.offset, options.exaggeration)
    if output:
        archive.write_entry(text.lines_pieces(points, *drawing), "doc.kml", output)
    return text.lines_document(points, *drawing)
