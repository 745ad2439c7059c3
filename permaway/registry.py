"""Queries of the track operators; ``oracles`` has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway import oracles
from permaway.functions import curves, geodesy, jsnum, styling
from permaway.operators import sections, track
from permaway.options import CenterlineOptions
from permaway.plans import pipelines
from permaway.paths import files_of, new_dir
from permaway.sinks import archive, text
from permaway.sources import centerline_csv, kml

KEYS = ("section",)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture: one track per user of the table events, as ordered points."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(oracles.TRACKS).select("section", (F.col("seq") - 1).cast("bigint").alias("idx"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"))


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)


def _deg(c: str) -> Column:
    return F.round(c, 7).alias(c)


def _at(*extra: Column | str) -> list:
    return ["section", "idx", _deg("latitude"), _deg("longitude"), *extra]


def _sums(df: DataFrame, *extra: Column) -> DataFrame:
    mean = lambda c, name: F.round(F.sum(c) / F.count("*"), 7).alias(name)
    return df.groupBy("section").agg(F.count("*").alias("n_points"), mean("latitude", "mean_lat"), mean("longitude", "mean_lon"), *extra)


def _sum_alt() -> Column:
    return F.round(F.sum("altitude"), 2).alias("sum_alt")


def leg_metrics(spark, sf_dir):
    d = track.legs(tracks(spark, sf_dir), KEYS)
    return d.groupBy("section").agg(F.count("leg_m").alias("n_legs"), F.round(F.sum("leg_m"), 2).alias("length_m"), F.round(F.max("leg_m"), 2).alias("longest_m"))


def _ahead(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("section").orderBy("idx")
    t = tracks(spark, sf_dir)
    return t.withColumns({"lat2": F.lead("latitude").over(w), "lon2": F.lead("longitude").over(w), "alt2": F.lead("altitude").over(w)}).where("lat2 is not null")


def geodesic_inverse(spark, sf_dir):
    d = geodesy.with_inverse(_ahead(spark, sf_dir), "latitude", "longitude", "lat2", "lon2")
    return d.select("section", "idx", F.round("distance_m", 2).alias("distance_m"), F.round("azimuth", 7).alias("azimuth"), F.round("final_azimuth", 7).alias("final_azimuth"))


def geodesic_distance(spark, sf_dir):
    d = geodesy.distance(F.lit(-33.0), F.lit(151.0), F.col("latitude"), F.col("longitude"), geodesy.GRS80)
    return tracks(spark, sf_dir).select("section", "idx", F.round(d, 2).alias("distance_m"))


def geodesic_bearing(spark, sf_dir):
    return tracks(spark, sf_dir).select("section", "idx", F.round(geodesy.bearing(F.lit(40.0), F.lit(-75.0), F.col("latitude"), F.col("longitude")), 7).alias("azimuth"))


def _projected(spark, sf_dir) -> DataFrame:
    t = tracks(spark, sf_dir).withColumns({"az": F.col("idx") % 12 / F.lit(2.0) - 3.0, "s": F.lit(100.0) + 50.0 * F.col("idx")})
    return geodesy.with_direct(t, "latitude", "longitude", "az", "s")


def geodesic_direct(spark, sf_dir):
    t = tracks(spark, sf_dir)
    end = geodesy.direct(F.col("latitude"), F.col("longitude"), F.col("idx") % 12 / F.lit(2.0) - 3.0, F.lit(100.0) + 50.0 * F.col("idx"))
    return t.select("section", "idx", end.alias("e")).select("section", "idx", F.round("e.latitude", 7).alias("latitude"), F.round("e.longitude", 7).alias("longitude"))


def geodesic_project(spark, sf_dir):
    return _projected(spark, sf_dir).select(*_at("altitude"))


def ellipsoid_consts(spark, sf_dir):
    rows = [(n, e.semi_major, e.semi_minor, round(e.inverse_flattening, 6)) for n, e in (("WGS84", geodesy.WGS84), ("GRS80", geodesy.GRS80))]
    return spark.createDataFrame(rows, "name string, semi_major double, semi_minor double, inverse_flattening double")


def chainage(spark, sf_dir):
    return track.chainage(tracks(spark, sf_dir), KEYS).select("section", "idx", F.round("chainage_m", 2).alias("chainage_m"))


def having_min_points(spark, sf_dir):
    short = tracks(spark, sf_dir).where(F.col("idx") <= F.substring("section", 2, 12).cast("bigint") % 6)
    return track.at_least(short, KEYS).groupBy("section").agg(F.count("*").alias("n_points"))


def section_key(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "event_type")
    named = e.select(track.section_key(F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type"))).alias("section_key"))
    return named.groupBy("section_key").agg(F.count("*").alias("n"))


def section_order(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "event_type", "user_id")
    named = e.select(F.lit("f").alias("file"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 2 == 0, (F.col("user_id") % 40).cast("string")).otherwise(F.col("event_type")).alias("section_key"))
    return track.with_section_order(named).select(F.col("section_key").alias("name"), "section_ord").distinct()


def densify(spark, sf_dir):
    return _sums(track.densify(tracks(spark, sf_dir), KEYS, 800.0, 600.0), _sum_alt())


def spline_control_points(spark, sf_dir):
    return track.control_points(tracks(spark, sf_dir), KEYS).select(*_at())


def _lerped(spark, sf_dir, altitude: Column) -> DataFrame:
    t = 0.25
    a = _ahead(spark, sf_dir)
    return a.select("section", "idx", F.round(curves.lerp(F.col("latitude"), F.col("lat2"), t), 7).alias("latitude"), F.round(curves.lerp(F.col("longitude"), F.col("lon2"), t), 7).alias("longitude"), altitude.alias("altitude"))


def lerp2d(spark, sf_dir):
    return _lerped(spark, sf_dir, F.lit(0.0))


def lerp3d(spark, sf_dir):
    return _lerped(spark, sf_dir, F.round(curves.lerp(F.col("altitude"), F.col("alt2"), 0.25), 4))


def bezier_point(spark, sf_dir):
    """The curve's points at j = 30 of every segment (t = 30/61)."""
    return track.flatten(tracks(spark, sf_dir), KEYS, 60).where("idx % 61 = 30").select(*_at())


def bezier_flatten(spark, sf_dir):
    return _sums(track.flatten(tracks(spark, sf_dir), KEYS, 60), _sum_alt())


def cardinal_spline(spark, sf_dir):
    return _sums(track.cardinal_spline(tracks(spark, sf_dir), KEYS), F.round(F.sum("altitude") / F.count("*"), 4).alias("mean_alt"))


def catmull_rom(spark, sf_dir):
    return _sums(track.catmull_rom(tracks(spark, sf_dir), KEYS), F.round(F.sum("altitude") / F.count("*"), 4).alias("mean_alt"))


def resample(spark, sf_dir):
    return _sums(sections.fitted(tracks(spark, sf_dir), KEYS, 25.0), _sum_alt())


def decimate(spark, sf_dir):
    return track.decimate(tracks(spark, sf_dir), KEYS).select(*_at())


def curve_radius(spark, sf_dir):
    d = sections.fitted(tracks(spark, sf_dir), KEYS, 25.0, curves=(100.0, 5000.0))
    return d.groupBy("section").agg(F.count("*").alias("n_points"), F.count_if(F.col("curve_radius") > 0).alias("n_curved"), F.round(F.sum("curve_radius") / F.count("*"), 2).alias("mean_radius"))


def curvature3(spark, sf_dir):
    d = track.curvature(tracks(spark, sf_dir), KEYS)
    return d.select("section", "idx", F.when(F.col("radius_m") == float("inf"), F.lit(-1.0)).otherwise(F.round("radius_m", 2)).alias("radius_m"))


def smooth(spark, sf_dir):
    return track.smooth(tracks(spark, sf_dir), KEYS).select(*_at(F.round("altitude", 4).alias("altitude")))


def altitude_transform(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "value")
    return e.select("event_id", F.round(styling.altitude(F.col("value"), "absolute", 3.0, 1.5), 4).alias("absolute_alt"), styling.altitude(F.col("value"), styling.altitude_mode("other"), 3.0, 1.5).alias("ground_alt"))


def _lines(spark, sf_dir) -> DataFrame:
    """Tracks as drawn lines, with a kilometrage at every tenth point."""
    t = tracks(spark, sf_dir)
    return t.select(F.col("section").alias("line"), F.lit(0).alias("line_ord"), "idx", "latitude", "longitude", "altitude", F.when(F.col("idx") % 10 == 0, F.col("idx") / 8.0).alias("kilometrage"))


def style_index(spark, sf_dir):
    return text.with_style(_lines(spark, sf_dir)).select(F.col("line").alias("section"), "style").distinct()


def palette(spark, sf_dir):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(styling.LINE_COLORS, styling.DISPLAY_COLORS, strict=True))], "k int, line_color string, display_color string")


def escape_xml(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(styling.escape_xml(F.col("html"))).alias("escaped_md5"))


def csv_scan(spark, sf_dir):
    """Tracks printed as lines, every third with tabs, and read again."""
    t = tracks(spark, sf_dir)
    cells = [F.col("section"), jsnum.to_fixed(F.col("latitude"), 8), jsnum.to_fixed(F.col("longitude"), 8), jsnum.to_fixed(F.col("altitude"), 3), (F.col("idx") / 8.0).cast("string")]
    lines = t.select("idx", F.when(F.col("idx") % 3 == 0, F.concat_ws("\t", *cells)).otherwise(F.concat_ws(" , ", *cells)).alias("line"))
    return centerline_csv.parse_lines(lines).select(*_at(F.round("altitude", 3).alias("altitude"), "kilometrage"))


def filter_csv(spark, sf_dir):
    """Of five kinds of lines two are points: blank, comment and two-column lines go."""
    e = _events(spark, sf_dir, "event_id", "value")
    kinds = F.array(F.lit("  \t "), F.lit("# x,1,2,3"), F.lit("x,1"), F.concat(F.lit("a,1.5x, 2e0 ,"), F.col("value").cast("string")), F.lit("a\t1\t2"))
    return centerline_csv.parse_lines(e.select(F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("line"))).agg(F.count("*").alias("n_points"))


def filter_coords(spark, sf_dir):
    """Of four kinds of tuples two have numeric coordinates."""
    e = _events(spark, sf_dir, "event_id", "value")
    kinds = F.array(F.lit("151.2"), F.lit("x,-33"), F.concat(F.lit("151.2,-33.5,"), F.col("value").cast("string")), F.concat(F.lit(" \n 151.2,-33.5,"), F.col("value").cast("string"), F.lit(" ")))
    marks = e.select(F.lit("f").alias("file"), F.lit(0).alias("file_ord"), F.lit("s").alias("section"), F.lit("").alias("description"), F.col("event_id").alias("placemark_idx"), F.array(F.get(kinds, (F.col("event_id") % 4).cast("int"))).alias("coordinates"))
    return kml.points(marks).agg(F.count("*").alias("n_points"), F.round(F.sum("altitude"), 2).alias("sum_alt"))


def to_fixed(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id")
    x = F.col("event_id").cast("double")
    return e.select("event_id", jsnum.to_fixed(x, 1).alias("one"), jsnum.to_fixed(x + 0.5, 3).alias("three"), jsnum.to_fixed(-x, 0).alias("whole"))


def point_to_string(spark, sf_dir):
    return tracks(spark, sf_dir).select("section", "idx", styling.point_text(F.col("latitude"), F.col("longitude"), F.lit(0.25)).alias("shown"))


def base_name(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id")
    name = F.concat(F.lit("a"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.lit(".kml")).otherwise(F.lit(".kml.kml.csv")))
    table = text.renamed(name, ".kml", ".csv")
    table = F.when(F.col("event_id") % 3 == 0, table).otherwise(F.concat(F.lit("a"), F.col("event_id"), F.lit(".kml.csv")))
    line = text.renamed(F.concat(F.lit("a"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.lit(".csv")).otherwise(F.lit(".csv.csv"))), ".csv", "")
    return e.select("event_id", table.alias("table_name"), line.alias("line_name"))


# ---- documents, files and whole pipelines


def _documents(spark, sf_dir) -> DataFrame:
    """Every track drawn as one document of two Placemarks."""
    t = tracks(spark, sf_dir).withColumn("c", styling.coordinate(F.col("longitude"), F.col("latitude"), F.col("altitude")))
    body = text.joined(t, ["section"], ["idx"], "c", " ")
    name = F.col("section")
    mark = lambda tag, coords: F.concat(F.lit("<Placemark>"), tag, F.lit("<LineString><coordinates>"), coords, F.lit("</coordinates></LineString></Placemark>"))
    whole = F.concat(F.lit('<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), mark(F.concat(F.lit("<name>"), name, F.lit("</name>")), F.col("content")), mark(F.lit(""), F.lit("151,-33 151.1,-33")), F.lit("</Document></kml>"))
    return body.select(F.concat(name, F.lit(".kml")).alias("file"), F.lit(0).alias("file_ord"), whole.alias("content"))


def _folder_of(spark, files: DataFrame) -> str:
    """A fresh folder with the files (file_name, content)."""
    folder = new_dir(spark, "files")
    archive.write_files(files, folder)
    return folder


def _placemark_digest(marks: DataFrame) -> DataFrame:
    return kml.points(marks).groupBy("file", "section").agg(F.count("*").alias("n_points"), F.round(F.avg("latitude"), 7).alias("mean_lat"))


def kml_scan(spark, sf_dir):
    return _placemark_digest(kml.parse_documents(_documents(spark, sf_dir)))


def placemark_files(spark, sf_dir):
    """The documents written as files and read by the data source."""
    folder = _folder_of(spark, _documents(spark, sf_dir).withColumnRenamed("file", "file_name"))
    return _placemark_digest(kml.read_placemarks(spark, [folder]))


def csv_generic(spark, sf_dir):
    """A table written as CSV text with a header, and read by name with inferred types."""
    folder = new_dir(spark, "table")
    tracks(spark, sf_dir).select("section", "idx", "altitude").write.option("header", True).csv(folder)
    return centerline_csv.read_table(spark, [folder]).select("section", F.col("idx").cast("bigint").alias("idx"), "altitude")


def csv_plain(spark, sf_dir):
    """One CSV file by commas alone: all text, as it stands."""
    lines = tracks(spark, sf_dir).select(F.lit("t.csv").alias("file_name"), "section", "idx", F.concat_ws(",", "section", "idx", F.concat(F.lit(" "), jsnum.to_fixed(F.col("altitude"), 3))).alias("line"))
    body = text.joined(lines, ["file_name"], ["section", "idx"], "line", "\n")
    folder = _folder_of(spark, body.select("file_name", F.concat(F.lit("section, idx ,altitude\n"), "content", F.lit("\n \n")).alias("content")))
    return centerline_csv.read_plain(spark, f"{folder}/t.csv")


def _centerline(spark, sf_dir) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("file", F.concat("section", F.lit(".kml")))
    return pipelines.centerline(t, CenterlineOptions(), ("file", "section")).withColumn("section_ord", F.lit(1))


def csv_lines(spark, sf_dir):
    """The lines of centerline tables, read again."""
    read = centerline_csv.parse_lines(text.csv_lines(_centerline(spark, sf_dir)))
    mean = lambda c, name: F.round(F.sum(c) / F.count("*"), 6).alias(name)
    return read.groupBy("file").agg(F.count("*").alias("n_lines"), mean("latitude", "mean_lat"), mean("longitude", "mean_lon"), F.round(F.max("kilometrage"), 3).alias("length_km"))


def _table_digest(files: DataFrame) -> DataFrame:
    """Lines of each table, the first of them and the kilometrage of the last."""
    lines = F.split("content", "\n")
    return files.select("file_name", (F.size(lines) - 2).cast("bigint").alias("n_lines"), F.get(lines, 1).alias("first_line"), F.get(F.split(F.get(lines, F.size(lines) - 2), ","), 4).alias("last_km"))


def csv_files(spark, sf_dir):
    return _table_digest(text.csv_files(_centerline(spark, sf_dir)))


def centerline_archive(spark, sf_dir):
    """Drawn files to one archive of centerline tables, and what the archive holds."""
    folder = _folder_of(spark, _documents(spark, sf_dir).withColumnRenamed("file", "file_name"))
    path = f"{new_dir(spark, 'archive')}/tables.zip"
    pipelines.build_centerlines(spark, files_of(spark, [folder]), output=path)
    return _table_digest(archive.read_archives(spark, [path]))


def lines_archive(spark, sf_dir):
    """Centerline tables to one archive with the drawn lines, and what it holds."""
    t = tracks(spark, sf_dir)
    cells = [F.col("section"), jsnum.to_fixed(F.col("latitude"), 8), jsnum.to_fixed(F.col("longitude"), 8), jsnum.to_fixed(F.col("altitude"), 3), (F.col("idx") / 8.0).cast("string")]
    body = text.joined(t.withColumn("line", F.concat_ws(",", *cells)), ["section"], ["idx"], "line", "\n")
    folder = _folder_of(spark, body.select(F.concat("section", F.lit(".csv")).alias("file_name"), F.concat(F.lit(text.CSV_HEADER + "\n"), "content", F.lit("\n")).alias("content")))
    path = f"{new_dir(spark, 'archive')}/lines.kmz"
    pipelines.build_lines(spark, [folder], output=path)
    return archive.read_digests(spark, [path])


def kml_lines(spark, sf_dir):
    return text.line_fragments(_lines(spark, sf_dir))


def kml_lowdetail(spark, sf_dir):
    return text.line_fragments(_lines(spark, sf_dir), low=True)


def kml_posts(spark, sf_dir):
    return text.post_fragments(_lines(spark, sf_dir))


def kml_document(spark, sf_dir):
    return text.lines_document(_lines(spark, sf_dir))


def kml_simple(spark, sf_dir):
    return text.simple_document(_lines(spark, sf_dir), "absolute")


def kml_index(spark, sf_dir):
    return spark.createDataFrame([(text.index_document(),)], "content string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks to centerlines: densify, spline, flatten, resample, radius and chainage."""
    line = _centerline(spark, sf_dir)
    return line.groupBy("section").agg(F.count("*").alias("n_points"), F.round(F.max("chainage_m"), 2).alias("length_m"), F.count_if(F.col("curve_radius") > 0).alias("n_curved"))


_QUERIES = (
    leg_metrics, geodesic_inverse, geodesic_distance, geodesic_bearing, geodesic_direct, geodesic_project, ellipsoid_consts, chainage, having_min_points, section_key, section_order, densify,
    spline_control_points, lerp2d, lerp3d, bezier_point, bezier_flatten, cardinal_spline, catmull_rom, resample, decimate, curve_radius, curvature3, smooth, altitude_transform, style_index,
    palette, escape_xml, csv_scan, filter_csv, filter_coords, to_fixed, point_to_string, base_name, kml_scan, placemark_files, csv_generic, csv_plain, csv_lines, csv_files, centerline_archive, lines_archive, kml_lines, kml_lowdetail, kml_posts, kml_document, kml_simple, kml_index,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"centerlines": flagship}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
