"""Transforms of ordered points, one partitioning by section all the way.

Points are rows with the section's key columns, a dense ``idx`` from 0 within the
key, and ``latitude``, ``longitude``, ``altitude``.  Every transform keeps the
hash distribution by key, so a chain of them needs one exchange; sections are
the unit of parallelism.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permaway.functions import curves, geodesy, jsnum

Keys = Sequence[str]
#: Sections need more points than this.
LEAST_POINTS = 3
#: Lines of more points than this get a decimated copy with every tenth point.
DECIMATE_OVER, DECIMATE_STEP = 20, 10
#: A last point nearer than this (metres) to the last output is left out.
TAIL = 0.001
#: Solver steps for points along a flattened line.
SHORT = 3


def _by(keys: Keys, *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*(order or ("idx",)))


def _whole(keys: Keys) -> Window:
    return Window.partitionBy(*keys)


def section_key(section: Column) -> Column:
    """The grouping name of a section: the empty name counts as ``default``, the point keeps its own."""
    return F.when(section == "", F.lit("default")).otherwise(section)


def numbered(df: DataFrame, keys: Keys, *order: str) -> DataFrame:
    """With a dense ``idx`` from 0 in the given order."""
    return df.withColumn("idx", (F.row_number().over(_by(keys, *order)) - 1).cast("bigint"))


def with_section_order(df: DataFrame, file: str = "file", key: str = "section_key", idx: str = "idx") -> DataFrame:
    """``section_ord`` from 1 per file: names that are whole numbers first, then by first appearance."""
    firsts = df.groupBy(file, key).agg(F.min(idx).alias("_first"))
    order = jsnum.section_order(F.col(key), F.col("_first"))
    ranked = firsts.withColumn("section_ord", F.row_number().over(Window.partitionBy(file).orderBy(order, key))).drop("_first")
    return df.join(ranked, [file, key])


def at_least(df: DataFrame, keys: Keys, more_than: int = LEAST_POINTS) -> DataFrame:
    """Only sections of more than so many points."""
    return df.withColumn("_n", F.count("*").over(_whole(keys))).where(F.col("_n") > more_than).drop("_n")


def legs(df: DataFrame, keys: Keys, steps: int = geodesy.STEPS) -> DataFrame:
    """With distance and azimuth to the next point; null at the last."""
    w = _by(keys)
    ahead = df.withColumns({"_lat2": F.lead("latitude").over(w), "_lon2": F.lead("longitude").over(w)})
    return geodesy.with_inverse(ahead, "latitude", "longitude", "_lat2", "_lon2", ("leg_m", "leg_azimuth"), steps=steps).drop("_lat2", "_lon2")


def chainage(df: DataFrame, keys: Keys) -> DataFrame:
    """With ``chainage_m``: the geodesic length from the section's first point."""
    w = _by(keys)
    back = df.withColumns({"_lat1": F.lag("latitude").over(w), "_lon1": F.lag("longitude").over(w)})
    d = geodesy.with_inverse(back, "_lat1", "_lon1", "latitude", "longitude", ("_d",)).drop("_lat1", "_lon1")
    return d.withColumn("chainage_m", F.sum(F.coalesce("_d", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def check_densify(max_segment: float, spacing: float) -> None:
    """Values for which stepping along a leg ends; raises for all others."""
    if not (max_segment > 0 and 0 < spacing <= 2 * max_segment and math.isfinite(max_segment)):
        raise ValueError("densify needs max_segment > 0 and 0 < spacing <= 2 * max_segment")


def densify(df: DataFrame, keys: Keys, max_segment: float, spacing: float) -> DataFrame:
    """Adds points at ``spacing`` along legs longer than ``max_segment``, until what is left is not longer.

    New points keep the altitude of the leg's start and all else of its end.
    """
    check_densify(max_segment, spacing)
    w = _by(keys)
    back = df.withColumns({"_lat1": F.lag("latitude").over(w), "_lon1": F.lag("longitude").over(w), "_alt1": F.lag("altitude").over(w)})
    d = geodesy.with_inverse(back, "_lat1", "_lon1", "latitude", "longitude", ("_d", "_az"))
    n = F.when(F.col("_d") > max_segment, F.ceil((F.col("_d") - max_segment) / spacing)).otherwise(F.lit(0)).cast("int")
    d = d.withColumn("_n", n)
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n") + 1)))
    new = F.col("_k") <= F.col("_n")
    d = d.withColumns({"_s": F.when(new, F.col("_k") * F.lit(float(spacing))), "_lat0": F.when(new, F.col("_lat1")), "_lon0": F.when(new, F.col("_lon1"))})
    d = geodesy.with_direct(d, "_lat0", "_lon0", "_az", "_s", ("_lat2", "_lon2"))
    d = d.withColumns({"latitude": F.when(new, F.col("_lat2")).otherwise(F.col("latitude")), "longitude": F.when(new, F.col("_lon2")).otherwise(F.col("longitude")), "altitude": F.when(new, F.col("_alt1")).otherwise(F.col("altitude"))})
    return numbered(d, keys, "idx", "_k").select(df.columns)


def handles(df: DataFrame, keys: Keys, tension: float = 0.5) -> DataFrame:
    """With the Bezier handles of a cardinal spline at every anchor: in_lat, in_lon, out_lat, out_lon; null where there is no segment."""
    w, k = _by(keys), tension / 3.0
    out = {}
    for name, c in (("lat", "latitude"), ("lon", "longitude")):
        before, after, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        step = F.when(before.isNotNull() & after.isNotNull(), after - before)
        out[f"in_{name}"] = F.when(step.isNotNull(), here - k * step).otherwise(here + k * (before - here))
        out[f"out_{name}"] = F.when(step.isNotNull(), here + k * step).otherwise(here + k * (after - here))
    return df.withColumns(out)


def control_points(df: DataFrame, keys: Keys, tension: float = 0.5) -> DataFrame:
    """The flat list anchor, out, in, anchor, ...: 3n - 2 points for n anchors."""
    h = handles(df, keys, tension)
    point = lambda kind, lat, lon: F.struct(F.lit(kind).alias("kind"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    three = F.array(point(0, "in_lat", "in_lon"), point(1, "latitude", "longitude"), point(2, "out_lat", "out_lon"))
    flat = h.withColumn("_p", F.explode(F.filter(three, lambda p: p["latitude"].isNotNull())))
    out = flat.withColumns({"latitude": F.col("_p.latitude"), "longitude": F.col("_p.longitude"), "kind": F.col("_p.kind")})
    # an anchor's place in the list is 3 idx; its handles stand around it
    return out.withColumn("idx", F.col("idx") * 3 + F.col("kind") - 1).select(*df.columns, "kind")


def flatten(df: DataFrame, keys: Keys, detail: int = 60, tension: float = 0.5) -> DataFrame:
    """The Bezier curve through the anchors: every anchor and ``detail`` points between two of them.

    Only anchors keep their altitude; points between have 0.
    """
    w = _by(keys)
    h = handles(df, keys, tension)
    h = h.withColumns({"_lat3": F.lead("latitude").over(w), "_lon3": F.lead("longitude").over(w), "_lat2": F.lead("in_lat").over(w), "_lon2": F.lead("in_lon").over(w)})
    last = F.col("_lat3").isNull()
    h = h.withColumn("_j", F.explode(F.when(last, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(detail)))))
    t = F.col("_j") / F.lit(detail + 1.0)
    anchor = F.col("_j") == 0
    on = lambda c, s: F.when(anchor, F.col(c)).otherwise(curves.bezier(F.col(c), F.col(f"out_{s}"), F.col(f"_{s}2"), F.col(f"_{s}3"), t))
    out = h.withColumns({"latitude": on("latitude", "lat"), "longitude": on("longitude", "lon"), "altitude": F.when(anchor, F.col("altitude")).otherwise(F.lit(0.0)), "idx": F.col("idx") * (detail + 1) + F.col("_j")})
    return out.select(df.columns)


def cardinal_spline(df: DataFrame, keys: Keys, tension: float = 0.5, steps: int = 60) -> DataFrame:
    """The Hermite form, ``steps`` points from each anchor on; end points count as their own neighbours."""
    w = _by(keys)
    names = ("latitude", "longitude", "altitude")
    around = {}
    for c in names:
        around[f"_{c}0"] = F.coalesce(F.lag(c).over(w), F.col(c))
        around[f"_{c}2"] = F.lead(c).over(w)
        around[f"_{c}3"] = F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w))
    h = df.withColumns(around)
    last = F.col("_latitude2").isNull()
    h = h.withColumn("_j", F.explode(F.when(last, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    t = F.col("_j") / F.lit(float(steps))
    value = lambda c: F.when(last, F.col(c)).otherwise(curves.hermite(F.col(f"_{c}0"), F.col(c), F.col(f"_{c}2"), F.col(f"_{c}3"), t, tension))
    return h.withColumns({**{c: value(c) for c in names}, "idx": F.col("idx") * steps + F.col("_j")}).select(df.columns)


def catmull_rom(df: DataFrame, keys: Keys) -> DataFrame:
    return cardinal_spline(df, keys, tension=0.0)


def resample(df: DataFrame, keys: Keys, interval: float) -> DataFrame:
    """Points every ``interval`` metres along the line, from the first point on, and the last point.

    A new point lies on the geodesic of its segment and keeps all else of the
    segment's start; the last point is left out within a millimetre of the one before.
    """
    if not (interval > 0 and math.isfinite(interval)):
        raise ValueError("resample needs interval > 0")
    w = _by(keys)
    d = legs(df, keys, steps=SHORT)
    so_far = F.sum(F.coalesce("leg_m", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_to", so_far).withColumn("_hi", F.floor(F.col("_to") / interval))
    d = d.withColumn("_lo", F.lag("_hi").over(w))
    first, last = F.col("_lo").isNull(), F.col("leg_m").isNull()
    lo = F.when(first, F.lit(0).cast("bigint")).otherwise(F.col("_lo") + 1)
    places = F.when(F.col("_hi") >= lo, F.sequence(lo, F.col("_hi"))).otherwise(F.array().cast("array<bigint>"))
    # at the last point no leg begins: it stands for itself, by the number -1
    places = F.when(last, F.array(F.lit(-1).cast("bigint"))).otherwise(places)
    d = d.select(*df.columns, "leg_m", "leg_azimuth", "_to", F.explode(places).alias("_k"))
    tail = F.col("_k") == -1
    d = d.withColumn("_s", F.when(tail, F.lit(0.0)).otherwise(F.col("_k") * F.lit(float(interval)) - (F.col("_to") - F.col("leg_m")))).withColumn("_tail", tail)
    moved = d.withColumns({"_lat0": F.when(F.col("_s") > 0, F.col("latitude")), "_lon0": F.when(F.col("_s") > 0, F.col("longitude"))})
    d = geodesy.with_direct(moved, "_lat0", "_lon0", "leg_azimuth", "_s", ("_lat2", "_lon2"), steps=SHORT)
    d = d.withColumns({"latitude": F.coalesce("_lat2", "latitude"), "longitude": F.coalesce("_lon2", "longitude")})
    w2 = _by(keys, "_tail", "_k")
    d = d.withColumns({"_n": F.row_number().over(w2), "_plat": F.lag("latitude").over(w2), "_plon": F.lag("longitude").over(w2)})
    near = F.when(F.col("_tail") & (F.col("_n") > 1), geodesy.distance(F.col("_plat"), F.col("_plon"), F.col("latitude"), F.col("longitude")) <= TAIL).otherwise(F.lit(False))
    return d.where(~near).withColumn("idx", (F.col("_n") - 1).cast("bigint")).select(df.columns)


def decimate(df: DataFrame, keys: Keys) -> DataFrame:
    """Every tenth point and the last, of lines with more than twenty points."""
    n = df.withColumn("_n", F.count("*").over(_whole(keys)))
    return n.where((F.col("_n") > DECIMATE_OVER) & ((F.col("idx") % DECIMATE_STEP == 0) | (F.col("idx") == F.col("_n") - 1))).drop("_n")


def curve_radius(df: DataFrame, keys: Keys, arc: float = 100.0, threshold: float = 5000.0) -> DataFrame:
    """With ``curve_radius`` in metres from the turn over ``arc``; 0 where straight, unknown or above ``threshold``.

    The number of points to each side follows from the section's first spacing.
    A section is one array here, as it is one window partition elsewhere.
    """
    others = [c for c in df.columns if c not in (*keys, "idx")]
    points = F.array_sort(F.collect_list(F.struct("idx", *others)))
    a = df.groupBy(*keys).agg(points.alias("_a"))
    p = lambda k: F.get("_a", F.lit(k))
    spacing = F.when(F.size("_a") > 1, geodesy.distance(p(0)["latitude"], p(0)["longitude"], p(1)["latitude"], p(1)["longitude"])).otherwise(F.lit(25.0))
    a = a.withColumn("_spacing", spacing)
    # no spacing: an endless skip, so every radius is 0
    skip = F.when(F.col("_spacing") > 0, F.greatest(F.lit(1), F.least(jsnum.round_half_up(F.lit(arc / 2.0) / F.col("_spacing")), F.lit(2_000_000_000)).cast("int"))).otherwise(F.lit(2_000_000_000))
    a = a.withColumn("_skip", skip)
    near = lambda q, s: F.struct(q["latitude"].alias("latitude"), q["longitude"].alias("longitude")).alias(s)
    rows = F.transform("_a", lambda x, i: F.struct(x.alias("p"), near(F.get("_a", i - F.col("_skip")), "b"), near(F.get("_a", i + F.col("_skip")), "f")))
    d = a.select(*keys, F.inline(rows))
    d = d.select(*keys, "p.*", F.col("b.latitude").alias("_lat0"), F.col("b.longitude").alias("_lon0"), F.col("f.latitude").alias("_lat2"), F.col("f.longitude").alias("_lon2"))
    d = geodesy.with_inverse(d, "_lat0", "_lon0", "latitude", "longitude", ("_d1", "_az1"), steps=SHORT)
    d = geodesy.with_inverse(d, "latitude", "longitude", "_lat2", "_lon2", ("_d2", "_az2"), steps=SHORT)
    d = geodesy.with_inverse(d, "_lat0", "_lon0", "_lat2", "_lon2", ("_chord",), steps=SHORT)
    turn = F.abs(F.col("_az1") - F.col("_az2"))
    d = d.withColumn("_turn", F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn))
    d = d.withColumn("_r", F.when(F.col("_turn") > 1e-4, F.col("_chord") / 2.0 / F.sin(F.col("_turn") / 2.0)))
    return d.withColumn("curve_radius", F.when(F.col("_r") <= threshold, F.col("_r")).otherwise(F.lit(0.0))).select(*df.columns, "curve_radius")


def curvature(df: DataFrame, keys: Keys) -> DataFrame:
    """Inner points with ``radius_m`` through the point and its neighbours: infinite where the turn is under 0.001."""
    w = _by(keys)
    d = df.withColumns({"_lat0": F.lag("latitude").over(w), "_lon0": F.lag("longitude").over(w), "_lat2": F.lead("latitude").over(w), "_lon2": F.lead("longitude").over(w)})
    d = d.where("_lat0 is not null and _lat2 is not null")
    d = geodesy.with_inverse(d, "_lat0", "_lon0", "latitude", "longitude", ("_d1", "_az1"))
    d = geodesy.with_inverse(d, "latitude", "longitude", "_lat2", "_lon2", ("_d2", "_az2"))
    d = geodesy.with_inverse(d, "_lat0", "_lon0", "_lat2", "_lon2", ("_chord",))
    turn = F.abs(F.col("_az1") - F.col("_az2"))
    d = d.withColumn("_turn", F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn))
    radius = F.when(F.col("_turn") < 0.001, F.lit(float("inf"))).otherwise(F.col("_chord") / 2.0 / F.sin(F.col("_turn") / 2.0))
    return d.withColumn("radius_m", radius).select(*df.columns, "radius_m")


def smooth(df: DataFrame, keys: Keys, window: int = 3) -> DataFrame:
    """Means over ``window // 2`` neighbours to each side; sections of fewer than ``window`` points stay as they are."""
    half = window // 2
    w = _by(keys).rowsBetween(-half, half)
    enough = F.count("*").over(_whole(keys)) >= window
    return df.withColumns({c: F.when(enough, F.avg(c).over(w)).otherwise(F.col(c)) for c in ("latitude", "longitude", "altitude")})
