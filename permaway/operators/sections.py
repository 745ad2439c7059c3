"""The whole chain of a section in one pass: anchors go in, equally spaced points come out.

A fitted curve has some sixty points for each anchor and for a few outputs.  As
rows they would be sorted and windowed four times; here they exist only as arrays
of a few thousand anchors at a time inside one task, and the engine moves nothing
but anchors and results: one exchange, whatever is chained.  The transforms of
``track`` are the same steps one by one, and tests hold this module against them.

Columns other than the coordinates follow the rules of the single steps: a point
between anchors has what the anchor before it has, altitude 0, and a point added to
a long leg has the altitude of the leg's start and all else of its end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from permaway.functions.geodesy import direct_arrays, inverse_arrays
from permaway.operators.track import TAIL, check_densify
from permaway.shipping import ship
from permaway.sinks.archive import deflated

#: Segments whose curve is held at once.
SEGMENTS = 2048

Points = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # latitude, longitude, altitude, row of the input


def _legs(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, az, _ = inverse_arrays(lat[:-1], lon[:-1], lat[1:], lon[1:])
    return np.where(np.isfinite(d), d, 0.0), az


def densified(points: Points, most: float, spacing: float) -> Points:
    """Points at ``spacing`` along legs longer than ``most``, until what is left is not longer."""
    lat, lon, alt, row = points
    if len(lat) < 2:
        return points
    d, az = _legs(lat, lon)
    n = np.concatenate([[0], np.where(d > most, np.ceil((d - most) / spacing), 0)]).astype(np.int64)  # before each point
    end = np.repeat(np.arange(len(lat)), n + 1)
    k = np.arange(len(end)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1) + 1
    new = np.flatnonzero(k <= n[end])
    start = end[new] - 1
    out_lat, out_lon, out_alt = lat[end], lon[end], alt[end]
    out_lat[new], out_lon[new] = direct_arrays(lat[start], lon[start], az[start], k[new] * float(spacing))
    out_alt[new] = alt[start]
    return out_lat, out_lon, out_alt, row[end]


def _handles(x: np.ndarray, tension: float) -> tuple[np.ndarray, np.ndarray]:
    """One coordinate of the handles before and behind every anchor; what has no segment is of no use."""
    k, before, after = tension / 3.0, np.roll(x, 1), np.roll(x, -1)
    into, out = x - k * (after - before), x + k * (after - before)
    into[-1], out[0] = x[-1] + k * (before[-1] - x[-1]), x[0] + k * (after[0] - x[0])
    return into, out


def _curve(x: np.ndarray, into: np.ndarray, out: np.ndarray, a: int, b: int, t: np.ndarray) -> np.ndarray:
    """One coordinate along the segments a to b, each from its anchor on, and of the anchor behind the last."""
    s = 1.0 - t
    p0, p1, p2, p3 = (v[:, None] for v in (x[a:b], out[a:b], into[a + 1 : b + 1], x[a + 1 : b + 1]))
    flat = s * s * s * p0 + 3.0 * s * s * t * p1 + 3.0 * s * t * t * p2 + t * t * t * p3
    flat[:, 0] = x[a:b]
    return np.append(flat.ravel(), x[b])


def resampled_curve(points: Points, interval: float, detail: int = 60, tension: float = 0.5) -> Points:
    """The curve through the anchors at every ``interval`` metres, from the first anchor on, and the last anchor."""
    lat, lon, alt, row = points
    n = len(lat)
    if n < 2:
        return points
    handles = [_handles(x, tension) for x in (lat, lon)]
    t = np.arange(detail + 1) / (detail + 1.0)
    parts: list[Points] = [(lat[:1], lon[:1], alt[:1], row[:1])]
    total = 0.0
    for a in range(0, n - 1, SEGMENTS):
        b = min(n - 1, a + SEGMENTS)
        p_lat, p_lon = (_curve(x, *h, a, b, t) for x, h in zip((lat, lon), handles, strict=True))
        d, az = _legs(p_lat, p_lon)
        to = total + np.cumsum(d)
        begin = np.concatenate([[total], to[:-1]])
        lo = np.floor(begin / interval).astype(np.int64)
        count = np.floor(to / interval).astype(np.int64) - lo
        at = np.repeat(np.arange(len(d)), count)
        place = lo[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        new_lat, new_lon = direct_arrays(p_lat[at], p_lon[at], az[at], place * float(interval) - begin[at])
        anchor = a + at // (detail + 1)
        parts.append((new_lat, new_lon, np.where(at % (detail + 1) == 0, alt[anchor], 0.0), row[anchor]))
        total = float(to[-1])
    out = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if _legs(np.append(out[0][-1:], lat[-1]), np.append(out[1][-1:], lon[-1]))[0][0] > TAIL:
        out = tuple(np.append(x, last) for x, last in zip(out, (lat[-1], lon[-1], alt[-1], row[-1]), strict=True))
    return out


def radii(lat: np.ndarray, lon: np.ndarray, arc: float, threshold: float) -> np.ndarray:
    """Radius in metres from the turn over ``arc`` around each point; 0 where straight, unknown or above ``threshold``."""
    n = len(lat)
    out = np.zeros(n)
    spacing = float(_legs(lat[:2], lon[:2])[0][0]) if n > 1 else 25.0
    skip = max(1, min(n, math.floor(arc / 2.0 / spacing + 0.5))) if spacing > 0 else n
    if n <= 2 * skip:
        return out
    before, here, after = slice(0, n - 2 * skip), slice(skip, n - skip), slice(2 * skip, n)
    az1 = inverse_arrays(lat[before], lon[before], lat[here], lon[here])[1]
    az2 = inverse_arrays(lat[here], lon[here], lat[after], lon[after])[1]
    chord = inverse_arrays(lat[before], lon[before], lat[after], lon[after])[0]
    turn = np.abs(az1 - az2)
    turn = np.where(turn > math.pi, 2 * math.pi - turn, turn)
    bent = np.flatnonzero(turn > 1e-4)
    radius = chord[bent] / 2.0 / np.sin(turn[bent] / 2.0)
    out[skip + bent] = np.where(radius <= threshold, radius, 0.0)
    return out


class _Chain:
    """The chain of one section: what stands in a result's rows, and the rows of the anchors that the rest is taken from."""

    def __init__(self, interval: float, detail: int, tension: float, densify: tuple[float, float] | None, curves: tuple[float, float] | None, chainage: bool):
        if not (interval > 0 and math.isfinite(interval)):
            raise ValueError("resample needs interval > 0")
        if densify:
            check_densify(*densify)
        self.interval, self.detail, self.tension, self.densify, self.curves, self.chainage = interval, detail, tension, densify, curves, chainage

    def run(self, table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """``table`` is ordered by idx."""
        lat, lon, alt = (table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("latitude", "longitude", "altitude"))
        points = (lat, lon, alt, np.arange(len(lat)))
        if self.densify:
            points = densified(points, *self.densify)
        lat, lon, alt, row = resampled_curve(points, self.interval, self.detail, self.tension)
        made = {"latitude": lat, "longitude": lon, "altitude": alt, "idx": np.arange(len(lat))}
        if self.curves:
            made["curve_radius"] = radii(lat, lon, *self.curves)
        if self.chainage:
            made["chainage_m"] = np.concatenate([[0.0], np.cumsum(_legs(lat, lon)[0])]) if len(lat) > 1 else np.zeros(len(lat))
        return made, row


def fitted(df: DataFrame, keys: Sequence[str], interval: float, detail: int = 60, tension: float = 0.5, densify: tuple[float, float] | None = None, curves: tuple[float, float] | None = None, chainage: bool = False, more_than: int = 0) -> DataFrame:
    """The curve through the ordered anchors of each section, resampled: ``df``'s columns, and what else is asked for.

    ``densify``: longest leg and spacing of points that are added first.  ``curves``:
    arc and threshold of ``curve_radius``.  ``chainage``: with ``chainage_m``.  A section
    of no more than ``more_than`` points gives one row with the ``idx`` -1 and no coordinates.
    """
    chain = _Chain(interval, detail, tension, densify, curves, chainage)
    ship(df.sparkSession)
    names = df.columns
    kept = [n for n in names if n not in ("idx", "latitude", "longitude", "altitude")]
    more = ["curve_radius"] * bool(curves) + ["chainage_m"] * chainage
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in df.schema), *(StructField(n, DoubleType()) for n in more)])

    def run(table: pa.Table) -> pa.Table:
        if len(table) <= more_than:
            return pa.table({n: table.column(n).slice(0, 1) if n in kept else pa.array([-1]) if n == "idx" else pa.nulls(1, pa.float64()) for n in [*names, *more]})
        table = table.sort_by("idx")
        made, row = chain.run(table)
        rest = table.select(kept).take(pa.array(row))
        return pa.table({n: pa.array(made[n]) if n in made else rest.column(n) for n in [*names, *more]})

    return df.groupBy(*keys).applyInArrow(run, schema)


def _rounding(x: np.ndarray, digits: int) -> np.ndarray:
    """Values whose decimals print as ``jsnum.to_fixed`` has them: ties away from zero, and no negative zero."""
    x = x + 0.0
    with np.errstate(all="ignore"):
        scaled, dyadic = np.abs(x) * 10.0**digits, np.abs(x) * 2.0 ** (digits + 1)
        tie = (scaled - np.floor(scaled) == 0.5) & (dyadic == np.floor(dyadic)) & (np.abs(x) < 1e9)
        return np.where(tie, np.copysign((np.floor(scaled) + 1) / 10.0**digits, x), x)


def csv_text(names: list[str], columns: Sequence[tuple[np.ndarray, int]]) -> str:
    """Lines of a name and numbers with so many decimals; each line ends."""
    width = len(columns) + 1
    cells: list = [None] * (len(names) * width)
    cells[::width] = names
    kinds = ["%s"]
    for k, (x, digits) in enumerate(columns, 1):
        x = _rounding(x, digits)
        if np.isfinite(x).all():
            cells[k::width] = x.tolist()
            kinds.append(f"%.{digits}f")
        else:
            cells[k::width] = [f"{v:.{digits}f}" if math.isfinite(v) else "NaN" if math.isnan(v) else "∞" if v > 0 else "-∞" for v in x.tolist()]
            kinds.append("%s")
    return (",".join(kinds) + "\n") * len(names) % tuple(cells)


def printed(df: DataFrame, keys: Sequence[str], interval: float, detail: int = 60, densify: tuple[float, float] | None = None, curves: tuple[float, float] | None = None, more_than: int = 0, level: int | None = None) -> DataFrame:
    """(keys, section_ord, text): the lines of ``text.csv_line`` of each section, which never are rows; null for a section of no more than ``more_than`` points.

    With ``level`` there are ``data``, ``crc`` and ``size`` instead, a piece of an archive's entry.
    """
    chain = _Chain(interval, detail, 0.5, densify, curves, True)
    ship(df.sparkSession)
    kept = [*keys, "section_ord"]
    more = StructType([StructField("text", StringType())] if level is None else [StructField("data", BinaryType()), StructField("crc", LongType()), StructField("size", LongType())])
    types = {"text": pa.string(), "data": pa.binary(), "crc": pa.int64(), "size": pa.int64()}

    def run(table: pa.Table) -> pa.Table:
        made: tuple = (None,) * len(more)
        if len(table) > more_than:
            table = table.sort_by("idx")
            line, row = chain.run(table)
            km, radius = (np.where(np.isnan(x), 0.0, x) for x in (line["chainage_m"], line.get("curve_radius", np.zeros(len(row)))))
            names = table.column("section").take(pa.array(row)).to_pylist()
            text = csv_text(names, [(line["latitude"], 8), (line["longitude"], 8), (line["altitude"], 3), (km / 1000.0, 3), (radius, 1)])
            made = (text,) if level is None else tuple(deflated([text], level))
        first = table.select(kept).slice(0, 1)
        return pa.table({**{n: first.column(n) for n in kept}, **{n: pa.array([v], types[n]) for n, v in zip(more.names, made, strict=True)}})

    return df.groupBy(*keys).applyInArrow(run, StructType([*(StructField(n, df.schema[n].dataType) for n in kept), *more]))
