"""Markup text and line styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from permaway.functions.jsnum import signed_fixed, to_fixed

#: Line colours in the order alpha, blue, green, red, and the same ten as display colours.
LINE_COLORS = ("ff00ff00", "ff0000ff", "ffffff00", "ff00a5ff", "ff00ffff", "ffff00ff", "ff9e9e5f", "ff008cff", "ff800000", "ff800080")
DISPLAY_COLORS = ("#00FF00", "#FF0000", "#00FFFF", "#FFA500", "#FFFF00", "#FF00FF", "#5F9EA0", "#FF8C00", "#000080", "#800080")
#: Fixed value: the icon of kilometre posts.
POST_ICON = "http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png"


def escape_xml(text: Column) -> Column:
    """The five characters of markup as entities, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def style_id(ordinal: Column) -> Column:
    """Style of the n-th non-empty line, counted from 1: the tenth takes style_0."""
    return F.concat(F.lit("style_"), F.pmod(ordinal, F.lit(len(LINE_COLORS))).cast("string"))


def altitude(alt: Column, mode: str, offset: float, exaggeration: float) -> Column:
    """Altitude as drawn: transformed if absolute, 0 on the ground."""
    return (alt + offset) * exaggeration if mode == "absolute" else F.lit(0.0)


def altitude_mode(mode: str) -> str:
    return "absolute" if mode == "absolute" else "clampToGround"


def coordinate(lon: Column, lat: Column, alt: Column) -> Column:
    """``lon,lat,alt`` with 8, 8 and 3 decimals; a place keeps the sign that its table gives a zero."""
    return F.concat_ws(",", signed_fixed(lon, 8), signed_fixed(lat, 8), to_fixed(alt, 3))


def point_text(lat: Column, lon: Column, alt: Column) -> Column:
    """A point for display: 6, 6 and 2 decimals."""
    return F.concat(F.lit("GeoPoint("), to_fixed(lat, 6), F.lit(", "), to_fixed(lon, 6), F.lit(", "), to_fixed(alt, 2), F.lit("m)"))


def kilometre_label(km: Column) -> Column:
    return F.concat(F.lit("km "), to_fixed(km, 3))
