"""Centerline CSV and drawn-line documents, assembled from per-row text in one ordered aggregate per file or line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permaway.functions import styling
from permaway.functions.jsnum import to_fixed
from permaway.operators import track

#: Fixed value: the first line of a centerline CSV.
CSV_HEADER = "#Section,Latitude,Longitude,Altitude,Kilometrage,CurveRadius"
DOCUMENT = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n'
END = "</Document>\n</kml>"
#: Descriptions of the documents, and what the name of a low-detail copy ends in.
DESCRIPTION, INDEX_DESCRIPTION = "Generated from CSV files", "Index file linking all centerline KMZ files"
LOW_DETAIL = " - Low Detail"


def csv_line(section: Column, lat: Column, lon: Column, alt: Column, chainage_m: Column, radius: Column) -> Column:
    """One row: 8, 8, 3, 3 and 1 decimals, chainage as kilometres; missing chainage and radius print as 0."""
    km = F.coalesce(F.nanvl(chainage_m, F.lit(0.0)), F.lit(0.0)) / 1000.0
    r = F.coalesce(F.nanvl(radius, F.lit(0.0)), F.lit(0.0))
    return F.concat_ws(",", section, to_fixed(lat, 8), to_fixed(lon, 8), to_fixed(alt, 3), to_fixed(km, 3), to_fixed(r, 1))


def csv_lines(points: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, section_ord, idx, line) of points with section, chainage_m and curve_radius; no line where idx is -1."""
    line = csv_line(F.col("section"), F.col("latitude"), F.col("longitude"), F.col("altitude"), F.col("chainage_m"), F.col("curve_radius"))
    return points.select(*keys, "section_ord", "idx", F.when(F.col("idx") >= 0, line).alias("line"))


def joined(rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "", *more: Column) -> DataFrame:
    """Per key the texts in order, as ``content``, and further aggregates."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("_t")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), separator).alias("content"), *more)


def csv_files(points: DataFrame) -> DataFrame:
    """(file_name, content) of one CSV per input file; ``.kml`` in the name becomes ``.csv`` where it first stands."""
    body = joined(csv_lines(points), ["file"], ["section_ord", "idx"], "line", "\n")
    return body.select(renamed(F.col("file"), ".kml", ".csv").alias("file_name"), F.concat(F.lit(CSV_HEADER + "\n"), F.col("content"), F.lit("\n")).alias("content"))


def renamed(name: Column, old: str, new: str) -> Column:
    """The first occurrence of ``old`` replaced, wherever it stands."""
    at = F.instr(name, old)
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.lit(new), F.substring(name, at + len(old), F.length(name)))).otherwise(name)


# ---- drawn lines: points have line, line_ord (order of lines), idx, coordinates, kilometrage


def styles() -> str:
    out = []
    for k, color in enumerate(styling.LINE_COLORS):
        out.append(f'  <Style id="style_{k}">\n    <LineStyle>\n      <color>{color}</color>\n      <width>3</width>\n    </LineStyle>\n    <PolyStyle>\n      <color>{color}</color>\n    </PolyStyle>\n  </Style>\n')
    out.append(
        f'  <Style id="post_style">\n    <IconStyle>\n      <color>ffffffff</color>\n      <scale>0.4</scale>\n      <Icon>\n        <href>{styling.POST_ICON}</href>\n      </Icon>\n    </IconStyle>\n    <LabelStyle>\n      <scale>0.7</scale>\n    </LabelStyle>\n  </Style>\n'
    )
    return "".join(out)


def with_style(points: DataFrame) -> DataFrame:
    """``style`` and ``style_ord``: lines counted in their order from 1."""
    lines = points.select("line", "line_ord").distinct().withColumn("_o", F.row_number().over(Window.orderBy("line_ord", "line")))
    return points.join(lines.select("line", styling.style_id(F.col("_o")).alias("style"), F.col("_o").alias("style_ord")), "line")


def _coordinate(mode: str, offset: float, exaggeration: float) -> Column:
    return styling.coordinate(F.col("longitude"), F.col("latitude"), styling.altitude(F.col("altitude"), mode, offset, exaggeration))


def _placemark(name: Column, style: Column, coordinates: Column, mode: str, indent: str, visible: int | None) -> Column:
    i = indent
    seen = "" if visible is None else f"{i}  <visibility>{visible}</visibility>\n"
    return F.concat(
        F.lit(f"{i}<Placemark>\n{i}  <name>"), name, F.lit(f"</name>\n{seen}{i}  <styleUrl>#"), style,
        F.lit(f"</styleUrl>\n{i}  <LineString>\n{i}    <extrude>0</extrude>\n{i}    <tessellate>1</tessellate>\n{i}    <altitudeMode>{styling.altitude_mode(mode)}</altitudeMode>\n{i}    <coordinates>\n"),
        coordinates, F.lit(f"{i}    </coordinates>\n{i}  </LineString>\n{i}</Placemark>\n"),
    )


def _post(mode: str) -> Column:
    """The post of a point with a kilometrage, else an empty text; the point's coordinate is ``_c``."""
    km, i = F.col("kilometrage"), "      "
    post = F.concat(
        F.lit(f"{i}<Placemark>\n{i}  <name>"), styling.kilometre_label(km),
        F.lit(f"</name>\n{i}  <visibility>0</visibility>\n{i}  <styleUrl>#post_style</styleUrl>\n{i}  <Point>\n{i}    <altitudeMode>{styling.altitude_mode(mode)}</altitudeMode>\n{i}    <coordinates>"),
        F.col("_c"), F.lit(f"</coordinates>\n{i}  </Point>\n{i}</Placemark>\n"),
    )
    return F.when(km.isNotNull() & ~F.isnan(km), post).otherwise(F.lit(""))


def drawn_lines(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0, indent: str = "      ", folders: bool = True) -> DataFrame:
    """One row per line: line, style_ord, full (its Placemark), low (the low-detail copy, null for short lines) and posts.

    One ordered aggregate of the points; lines are numbered after it, so nothing but finished rows is joined.
    """
    made = points.withColumn("_c", _coordinate(mode, offset, exaggeration)).withColumn("_post", _post(mode) if "kilometrage" in points.columns else F.lit(""))
    each = made.groupBy("line", "line_ord").agg(F.array_sort(F.collect_list(F.struct("idx", "_c", "_post"))).alias("_a"))
    n = F.size("_a")
    every = F.filter("_a", lambda x, k: (k % track.DECIMATE_STEP == 0) | (k == n - 1))
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit(indent + "      "), x["_c"], F.lit("\n"))), "")
    each = each.select("line", "line_ord", shown(F.col("_a")).alias("_full"), F.when(n > track.DECIMATE_OVER, shown(every)).alias("_low"), F.array_join(F.transform("_a", lambda x: x["_post"]), "").alias("posts"))
    # as many rows as lines: their numbers need all of them in order
    numbers = points.select("line", "line_ord").distinct().withColumn("style_ord", F.row_number().over(Window.orderBy("line_ord", "line")))
    styled = each.join(numbers, ["line", "line_ord"]).withColumn("style", styling.style_id(F.col("style_ord")))
    name = styling.escape_xml(F.col("line"))
    full = _placemark(name, F.col("style"), F.col("_full"), mode, indent, 1 if folders else None)
    low = _placemark(F.concat(name, F.lit(LOW_DETAIL)), F.col("style"), F.col("_low"), mode, indent, 0 if folders else None)
    return styled.select("line", "style_ord", full.alias("full"), low.alias("low"), "posts")


def line_fragments(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0, low: bool = False, indent: str = "      ", folders: bool = True) -> DataFrame:
    """(line, style_ord, content): the full-detail Placemark of every line, or its low-detail copy."""
    drawn = drawn_lines(points, mode, offset, exaggeration, indent, folders)
    return drawn.select("line", "style_ord", F.col("low" if low else "full").alias("content")).where("content is not null")


def post_fragments(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0) -> DataFrame:
    """(line, style_ord, content): the posts of every line, empty where no point has a kilometrage."""
    return drawn_lines(points, mode, offset, exaggeration).select("line", "style_ord", F.col("posts").alias("content"))


def _head(title: str) -> str:
    return DOCUMENT + f"  <name>{title}</name>\n  <description>{DESCRIPTION}</description>\n" + styles()


def _folders(points: DataFrame, mode: str, offset: float, exaggeration: float) -> DataFrame:
    """(style_ord, _l, _p): the folders of every line's drawings and of its posts."""
    every = drawn_lines(points, mode, offset, exaggeration)
    folder = lambda inner: F.concat(F.lit("    <Folder>\n      <name>"), styling.escape_xml(F.col("line")), F.lit("</name>\n"), inner, F.lit("    </Folder>\n"))
    return every.select("style_ord", folder(F.concat("full", F.coalesce("low", F.lit("")))).alias("_l"), folder(F.col("posts")).alias("_p"))


def _frame(title: str) -> tuple[str, str, str]:
    """What stands before the folders of lines, before those of posts, and behind both."""
    return _head(title) + "  <Folder>\n    <name>Lines</name>\n", "  </Folder>\n  <Folder>\n    <name>Posts</name>\n    <visibility>0</visibility>\n", "  </Folder>\n" + END


def lines_document(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0, title: str = "Centerlines") -> DataFrame:
    """One row ``content``: styles, a folder of lines (full and low detail) and a folder of kilometre posts.

    A single document is one row by nature: its last step is one ordered aggregate of one row per line.
    """
    parts = F.array_sort(F.collect_list(F.struct("style_ord", "_l", "_p")))
    text = lambda f: F.array_join(F.transform("_a", lambda x: x[f]), "")
    before, between, behind = map(F.lit, _frame(title))
    return _folders(points, mode, offset, exaggeration).agg(parts.alias("_a")).select(F.concat(before, text("_l"), between, text("_p"), behind).alias("content"))


#: Lines of one bucket of a document's pieces.
BUCKET = 64


def lines_pieces(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0, title: str = "Centerlines") -> DataFrame:
    """(bucket, place, content): the same document as texts, ordered by bucket and place; no row holds more than a line."""
    kind = lambda k: F.lit(k << 40).cast("bigint")
    piece = lambda k, c: F.struct((kind(k) + F.floor(F.col("style_ord") / BUCKET)).alias("bucket"), F.col("style_ord").cast("bigint").alias("place"), F.col(c).alias("content"))
    folders = _folders(points, mode, offset, exaggeration).select(F.inline(F.array(piece(1, "_l"), piece(3, "_p"))))
    frame = points.sparkSession.createDataFrame([(2 * k << 40, 0, t) for k, t in enumerate(_frame(title))], "bucket bigint, place bigint, content string")
    return folders.unionByName(frame)


def simple_document(points: DataFrame, mode: str = "clampToGround", offset: float = 3.0, exaggeration: float = 1.0, title: str = "Centerlines") -> DataFrame:
    """One row ``content``: a flat list of full-detail lines."""
    body = line_fragments(points, mode, offset, exaggeration, indent="  ", folders=False)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("style_ord", "content"))), lambda x: x["content"]), "")
    return body.agg(F.concat(F.lit(_head(title)), parts, F.lit(END)).alias("content"))


def index_document(archive: str = "lines.kmz", title: str = "Centerlines Index") -> str:
    """A document that links to the archive of lines."""
    return DOCUMENT + f"  <name>{title}</name>\n  <description>{INDEX_DESCRIPTION}</description>\n  <NetworkLink>\n    <name>Lines</name>\n    <visibility>1</visibility>\n    <Link>\n      <href>{archive}</href>\n    </Link>\n  </NetworkLink>\n{END}"
