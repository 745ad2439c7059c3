"""Geodesics on an ellipsoid as Column expressions (Vincenty's inverse and direct problems).

Both problems iterate one number until it moves by no more than 1e-12, at most 19
times.  The state is the pair (previous, current); once they agree it stays.
``inverse`` and ``direct`` are single expressions that loop in a higher-order
function, for use anywhere.  ``with_inverse`` and ``with_direct`` give the same
numbers in generated code: a few steps as stacked projections, and the loop only
for rows that need more.  Python workers would solve a pair in half of the time,
but the engine forgets how rows are partitioned behind them: every window after
them would shuffle anew.  The ``_arrays`` forms are such an independent check.

Coincident points have distance and azimuths 0.  A pair on the equator, where a
term is 0/0, takes that term as 0.  Longitudes are not normalised; the pair
(-180, +180) is finite.  Near-antipodal pairs that do not converge return the
last iterate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-axes in metres."""

    semi_major: float
    semi_minor: float

    @property
    def flattening(self) -> float:
        return (self.semi_major - self.semi_minor) / self.semi_major

    @property
    def inverse_flattening(self) -> float:
        return 1.0 / self.flattening


WGS84 = Ellipsoid(6378137.0, 6356752.314245)
GRS80 = Ellipsoid(6378137.0, 6356752.314140)

#: Loop rule of both problems.
TOLERANCE, BODIES = 1e-12, 19
#: Steps of the stacked forms before they fall back on the loop: 3 do for legs up to 100 m, 4 up to 15 km.
STEPS = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0.0, F.lit(0.0)).otherwise(a / b)


def _series(ell: Ellipsoid, cos2_alpha: Column) -> tuple[Column, Column]:
    """The coefficients A and B of the arc length."""
    a, b = ell.semi_major, ell.semi_minor
    u2 = cos2_alpha * ((a * a - b * b) / (b * b))
    big_a = F.lit(1.0) + u2 / 16384.0 * (4096.0 + u2 * (-768.0 + u2 * (320.0 - 175.0 * u2)))
    big_b = u2 / 1024.0 * (256.0 + u2 * (-128.0 + u2 * (74.0 - 47.0 * u2)))
    return big_a, big_b


def _delta_sigma(big_b: Column, sin_s: Column, cos_s: Column, c2m: Column) -> Column:
    q = 2.0 * c2m * c2m - 1.0
    return big_b * sin_s * (c2m + big_b / 4.0 * (cos_s * q - big_b / 6.0 * c2m * (4.0 * sin_s * sin_s - 3.0) * (4.0 * c2m * c2m - 3.0)))


def _longitude_term(ell: Ellipsoid, cos2_alpha: Column) -> Column:
    f = ell.flattening
    return f / 16.0 * cos2_alpha * (4.0 + f * (4.0 - 3.0 * cos2_alpha))


# ---- inverse problem: reduced latitudes (su1, cu1, su2, cu2), longitude difference lon


class _Arc:
    """What one pair of points has at a trial longitude difference, built from single-use steps."""

    def __init__(self, ell: Ellipsoid, su1: Column, cu1: Column, su2: Column, cu2: Column, sin_l: Column, cos_l: Column):
        self.x = cu2 * sin_l
        self.y = cu1 * su2 - su1 * cu2 * cos_l
        self.cos_s = su1 * su2 + cu1 * cu2 * cos_l
        self.back = (cu1 * sin_l, cu1 * su2 * cos_l - su1 * cu2)
        self.cross = cu1 * cu2 * sin_l
        self.uu = 2.0 * su1 * su2


def _lambda_step(ell: Ellipsoid, lon: Column, sin_s: Column, cos_s: Column, sigma: Column, sin_a: Column, uu: Column) -> Column:
    cos2a = 1.0 - sin_a * sin_a
    c2m = F.when(cos2a == 0.0, F.lit(0.0)).otherwise(cos_s - uu / cos2a)

    def moved(c2m: Column, c: Column) -> Column:
        return lon + (1.0 - c) * ell.flattening * sin_a * (sigma + c * sin_s * (c2m + c * cos_s * (2.0 * c2m * c2m - 1.0)))

    return let(c2m, lambda m: let(_longitude_term(ell, cos2a), lambda c: moved(m, c)))


def _next_lambda(ell: Ellipsoid, u: dict[str, Column], lam: Column) -> Column:
    def at(sin_l: Column, cos_l: Column) -> Column:
        arc = _Arc(ell, u["su1"], u["cu1"], u["su2"], u["cu2"], sin_l, cos_l)
        return let(F.sqrt(arc.x * arc.x + arc.y * arc.y), lambda ss: let(arc.cos_s, lambda cs: let(_ratio(arc.cross, ss), lambda sa: _lambda_step(ell, u["lon"], ss, cs, F.atan2(ss, cs), sa, arc.uu))))

    return let(F.sin(lam), lambda s: let(F.cos(lam), lambda c: at(s, c)))


def _looped(state: Column, step: Callable[[Column], Column], bodies: int) -> Column:
    """The state struct (p, c) after the loop."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(bodies)), state, lambda s, _: F.when(F.abs(s["c"] - s["p"]) > TOLERANCE, F.struct(s["c"].alias("p"), step(s["c"]).alias("c"))).otherwise(s)
    )


def _inverse_result(ell: Ellipsoid, u: dict[str, Column], lam: Column) -> Column:
    """struct(distance_m, azimuth, final_azimuth) from the longitude difference of the last step."""

    def at(sin_l: Column, cos_l: Column) -> Column:
        arc = _Arc(ell, u["su1"], u["cu1"], u["su2"], u["cu2"], sin_l, cos_l)
        zero = F.lit(0.0)

        def found(ss: Column, cs: Column, cos2a: Column) -> Column:
            c2m = F.when(cos2a == 0.0, zero).otherwise(cs - arc.uu / cos2a)
            big_a, big_b = _series(ell, cos2a)
            distance = let(c2m, lambda m: let(big_b, lambda b: ell.semi_minor * big_a * (F.atan2(ss, cs) - _delta_sigma(b, ss, cs, m))))
            return F.struct(
                F.when(ss == 0.0, zero).otherwise(distance).alias("distance_m"),
                F.when(ss == 0.0, zero).otherwise(F.atan2(arc.x, arc.y)).alias("azimuth"),
                F.when(ss == 0.0, zero).otherwise(F.atan2(*arc.back)).alias("final_azimuth"),
            )

        return let(F.sqrt(arc.x * arc.x + arc.y * arc.y), lambda ss: let(arc.cos_s, lambda cs: let(_ratio(arc.cross, ss), lambda sa: let(1.0 - sa * sa, lambda c2: found(ss, cs, c2)))))

    return let(F.sin(lam), lambda s: let(F.cos(lam), lambda c: at(s, c)))


def _reduced(ell: Ellipsoid, lat: Column) -> tuple[Column, Column]:
    """Sine and cosine of the reduced latitude."""
    t = (1.0 - ell.flattening) * F.tan(F.radians(lat))
    cos_u = F.lit(1.0) / F.sqrt(1.0 + t * t)
    return t * cos_u, cos_u


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ell: Ellipsoid = WGS84) -> Column:
    """struct(distance_m, azimuth, final_azimuth) between two points in degrees; azimuths in radians."""
    (su1, cu1), (su2, cu2) = _reduced(ell, lat1), _reduced(ell, lat2)
    u = F.struct(su1.alias("su1"), cu1.alias("cu1"), su2.alias("su2"), cu2.alias("cu2"), F.radians(lon2 - lon1).alias("lon"))

    def solved(v: Column) -> Column:
        parts = {k: v[k] for k in ("su1", "cu1", "su2", "cu2", "lon")}
        start = F.struct(F.lit(2 * math.pi).alias("p"), parts["lon"].alias("c"))
        return let(_looped(start, lambda lam: _next_lambda(ell, parts, lam), BODIES), lambda s: _inverse_result(ell, parts, s["p"]))

    return let(u, solved)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ell: Ellipsoid = WGS84) -> Column:
    """Metres along the geodesic."""
    return inverse(lat1, lon1, lat2, lon2, ell)["distance_m"]


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ell: Ellipsoid = WGS84) -> Column:
    """Azimuth at the first point in radians, in (-pi, pi]."""
    return inverse(lat1, lon1, lat2, lon2, ell)["azimuth"]


def inverse_arrays(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, ell: Ellipsoid = WGS84) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, azimuth and final azimuth of whole arrays; every pair stops by itself."""
    f, minor = ell.flattening, ell.semi_minor
    t1, t2 = (1 - f) * np.tan(np.radians(lat1)), (1 - f) * np.tan(np.radians(lat2))
    cu1, cu2 = 1 / np.sqrt(1 + t1 * t1), 1 / np.sqrt(1 + t2 * t2)
    su1, su2 = t1 * cu1, t2 * cu2
    lon = np.radians(lon2 - lon1)
    used, now = np.full_like(lon, 2 * math.pi), lon.copy()

    def arc(lam, su1, cu1, su2, cu2):
        sl, cl = np.sin(lam), np.cos(lam)
        x, y = cu2 * sl, cu1 * su2 - su1 * cu2 * cl
        ss, cs = np.sqrt(x * x + y * y), su1 * su2 + cu1 * cu2 * cl
        sa = np.divide(cu1 * cu2 * sl, ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1 - sa * sa
        m = cs - np.divide(2 * su1 * su2, c2a, out=cs.copy(), where=c2a != 0)
        return sl, cl, x, y, ss, cs, sa, c2a, m

    left = np.flatnonzero(np.abs(now - used) > TOLERANCE)
    for _ in range(BODIES):
        if not len(left):
            break
        lam = now[left]
        _, _, _, _, ss, cs, sa, c2a, m = arc(lam, su1[left], cu1[left], su2[left], cu2[left])
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        moved = lon[left] + (1 - c) * f * sa * (np.arctan2(ss, cs) + c * ss * (m + c * cs * (2 * m * m - 1)))
        used[left], now[left] = lam, moved
        left = left[np.abs(moved - lam) > TOLERANCE]
    sl, cl, x, y, ss, cs, sa, c2a, m = arc(used, su1, cu1, su2, cu2)
    u2 = c2a * ((ell.semi_major**2 - minor**2) / minor**2)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    distance = minor * big_a * (np.arctan2(ss, cs) - _delta_sigma(big_b, ss, cs, m))
    apart = ss != 0
    return tuple(np.where(apart, v, np.where(np.isnan(ss), np.nan, 0.0)) for v in (distance, np.arctan2(x, y), np.arctan2(cu1 * sl, cu1 * su2 * cl - su1 * cu2)))


def direct_arrays(lat: np.ndarray, lon: np.ndarray, azimuth: np.ndarray, metres: np.ndarray, ell: Ellipsoid = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of the end points of whole arrays."""
    f = ell.flattening
    t = (1 - f) * np.tan(np.radians(lat))
    cu = 1 / np.sqrt(1 + t * t)
    su, sin1, cos1 = t * cu, np.sin(azimuth), np.cos(azimuth)
    sa, s1 = cu * sin1, np.arctan2(t, cos1)
    c2a = 1 - sa * sa
    u2 = c2a * ((ell.semi_major**2 - ell.semi_minor**2) / ell.semi_minor**2)
    first = metres / (ell.semi_minor * (1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    used, now = np.full_like(first, 2 * math.pi), first.copy()
    left = np.flatnonzero(np.abs(now - used) > TOLERANCE)
    for _ in range(BODIES):
        if not len(left):
            break
        s = now[left]
        moved = first[left] + _delta_sigma(big_b[left], np.sin(s), np.cos(s), np.cos(2 * s1[left] + s))
        used[left], now[left] = s, moved
        left = left[np.abs(moved - s) > TOLERANCE]
    ss, cs, m = np.sin(used), np.cos(used), np.cos(2 * s1 + used)
    tmp = su * ss - cu * cs * cos1
    lat2 = np.arctan2(su * cs + cu * ss * cos1, (1 - f) * np.sqrt(sa * sa + tmp * tmp))
    c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
    shift = np.arctan2(ss * sin1, cu * cs - su * ss * cos1) - (1 - c) * f * sa * (now + c * ss * (m + c * cs * (2 * m * m - 1)))
    return np.degrees(lat2), lon + np.degrees(shift)


class _Steps:
    """Named steps that refer to earlier ones, in layers: each is one projection, and all run in one pass."""

    def __init__(self, **first: Column):
        self.layers: list[list[Column]] = []
        self.add(**first)

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_g_{name}")

    def add(self, **values: Column) -> None:
        self.layers.append([v.alias(f"_g_{n}") for n, v in values.items()])

    def select(self, df: DataFrame, keep: list[str], results: dict[str, Column]) -> DataFrame:
        for layer in self.layers:
            df = df.select("*", *layer)
        # a generator's output: filters on it stay above the steps instead of multiplying them
        return df.select(*keep, F.inline(F.array(F.struct(*(r.alias(n) for n, r in results.items())))))


def with_inverse(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: tuple[str, ...] = ("distance_m", "azimuth", "final_azimuth"), ell: Ellipsoid = WGS84, steps: int = STEPS) -> DataFrame:
    """``df`` with distance, azimuth and final azimuth (as many as there are names); null coordinates give null."""
    (su1, cu1), (su2, cu2) = _reduced(ell, F.col(lat1)), _reduced(ell, F.col(lat2))
    g = _Steps(su1=su1, cu1=cu1, su2=su2, cu2=cu2, lon=F.radians(F.col(lon2) - F.col(lon1)), p0=F.lit(2 * math.pi))
    g.add(c0=g["lon"] + 0.0)

    def arc(n: str, lam: str) -> None:
        """What the pair has at a trial longitude difference; the names end in n."""
        g.add(**{f"sl{n}": F.sin(g[lam]), f"cl{n}": F.cos(g[lam])})
        at = _Arc(ell, g["su1"], g["cu1"], g["su2"], g["cu2"], g[f"sl{n}"], g[f"cl{n}"])
        g.add(**{f"ss{n}": F.sqrt(at.x * at.x + at.y * at.y), f"cs{n}": at.cos_s})
        g.add(**{f"s{n}": F.atan2(g[f"ss{n}"], g[f"cs{n}"]), f"sa{n}": _ratio(at.cross, g[f"ss{n}"])})
        c2a = 1.0 - g[f"sa{n}"] * g[f"sa{n}"]
        g.add(**{f"a{n}": c2a, f"m{n}": F.when(c2a == 0.0, F.lit(0.0)).otherwise(g[f"cs{n}"] - at.uu / c2a), f"t{n}": _longitude_term(ell, c2a)})

    for n in range(steps):
        arc(str(n), f"c{n}")
        t, m, ss, cs, p, c = (g[f"{x}{n}"] for x in ("t", "m", "ss", "cs", "p", "c"))
        moved = g["lon"] + (1.0 - t) * ell.flattening * g[f"sa{n}"] * (g[f"s{n}"] + t * ss * (m + t * cs * (2.0 * m * m - 1.0)))
        open_ = F.abs(c - p) > TOLERANCE
        g.add(**{f"p{n + 1}": F.when(open_, c).otherwise(p), f"c{n + 1}": F.when(open_, moved).otherwise(c)})
    p, c = g[f"p{steps}"], g[f"c{steps}"]
    parts = {k: g[k] for k in ("su1", "cu1", "su2", "cu2", "lon")}
    rest = _looped(F.struct(p.alias("p"), c.alias("c")), lambda lam: _next_lambda(ell, parts, lam), BODIES - steps)["p"]
    g.add(q=F.when(F.abs(c - p) > TOLERANCE, rest).otherwise(p))
    arc("f", "q")
    big_a, big_b = _series(ell, g["af"])
    g.add(A=big_a, B=big_b)
    at = _Arc(ell, g["su1"], g["cu1"], g["su2"], g["cu2"], g["slf"], g["clf"])
    zero = lambda x: F.when(g["ssf"] == 0.0, F.lit(0.0)).otherwise(x)
    found = (ell.semi_minor * g["A"] * (g["sf"] - _delta_sigma(g["B"], g["ssf"], g["csf"], g["mf"])), F.atan2(at.x, at.y), F.atan2(*at.back))
    return g.select(df, df.columns, {n: zero(x) for n, x in zip(out, found, strict=False)})


# ---- direct problem


def _direct_terms(ell: Ellipsoid, lat: Column, azimuth: Column, metres: Column) -> dict[str, Column]:
    t = (1.0 - ell.flattening) * F.tan(F.radians(lat))
    return {"t": t, "sin1": F.sin(azimuth), "cos1": F.cos(azimuth), "m": metres}


def direct(lat: Column, lon: Column, azimuth: Column, metres: Column, ell: Ellipsoid = WGS84) -> Column:
    """struct(latitude, longitude) in degrees of the point at an azimuth (radians) and distance."""

    def from_terms(v: Column) -> Column:
        cu = F.lit(1.0) / F.sqrt(1.0 + v["t"] * v["t"])
        return let(F.struct(v["t"].alias("t"), cu.alias("cu"), (v["t"] * cu).alias("su"), v["sin1"].alias("sin1"), v["cos1"].alias("cos1"), (cu * v["sin1"]).alias("sa"), v["m"].alias("m")), from_angles)

    def from_angles(v: Column) -> Column:
        return let(1.0 - v["sa"] * v["sa"], lambda c2: let(F.struct(*(x.alias(n) for x, n in zip(_series(ell, c2), ("a", "b"), strict=True))), lambda ab: solved(v, c2, ab)))

    def solved(v: Column, cos2a: Column, ab: Column) -> Column:
        first = v["m"] / (ell.semi_minor * ab["a"])
        start = F.atan2(v["t"], v["cos1"])
        return let(F.struct(first.alias("s0"), start.alias("s1")), lambda w: let(_looped(F.struct(F.lit(2 * math.pi).alias("p"), w["s0"].alias("c")), lambda s: _next_sigma(w["s0"], w["s1"], ab["b"], s), BODIES), lambda s: _direct_result(ell, lon, v, cos2a, w["s1"], s["p"], s["c"])))

    terms = _direct_terms(ell, lat, azimuth, metres)
    return let(F.struct(*(x.alias(n) for n, x in terms.items())), from_terms)


def _next_sigma(s0: Column, s1: Column, big_b: Column, s: Column) -> Column:
    return let(F.sin(s), lambda ss: let(F.cos(s), lambda cs: let(F.cos(2.0 * s1 + s), lambda m: s0 + _delta_sigma(big_b, ss, cs, m))))


def _direct_result(ell: Ellipsoid, lon: Column, v: Column, cos2a: Column, s1: Column, last: Column, sigma: Column) -> Column:
    def at(ss: Column, cs: Column, m: Column) -> Column:
        lat2, lon2 = _end_point(ell, lon, v["su"], v["cu"], v["sin1"], v["cos1"], v["sa"], ss, cs, m, sigma, _longitude_term(ell, cos2a))
        return F.struct(lat2.alias("latitude"), lon2.alias("longitude"))

    return let(F.sin(last), lambda ss: let(F.cos(last), lambda cs: let(F.cos(2.0 * s1 + last), lambda m: at(ss, cs, m))))


def _end_point(ell, lon, su, cu, sin1, cos1, sa, ss, cs, m, sigma, c) -> tuple[Column, Column]:
    tmp = su * ss - cu * cs * cos1
    lat2 = F.atan2(su * cs + cu * ss * cos1, (1.0 - ell.flattening) * F.sqrt(sa * sa + tmp * tmp))
    lam = F.atan2(ss * sin1, cu * cs - su * ss * cos1)
    shift = lam - (1.0 - c) * ell.flattening * sa * (sigma + c * ss * (m + c * cs * (2.0 * m * m - 1.0)))
    return F.degrees(lat2), lon + F.degrees(shift)


def with_direct(df: DataFrame, lat: str, lon: str, azimuth: str, metres: str, out: tuple[str, str] = ("latitude", "longitude"), ell: Ellipsoid = WGS84, steps: int = STEPS) -> DataFrame:
    """``df`` with the end point in degrees; outputs may replace the inputs."""
    g = _Steps(**_direct_terms(ell, F.col(lat), F.col(azimuth), F.col(metres)))
    g.add(cu=F.lit(1.0) / F.sqrt(1.0 + g["t"] * g["t"]), s1=F.atan2(g["t"], g["cos1"]))
    g.add(su=g["t"] * g["cu"], sa=g["cu"] * g["sin1"])
    g.add(a=1.0 - g["sa"] * g["sa"])
    big_a, big_b = _series(ell, g["a"])
    g.add(s0=g["m"] / (ell.semi_minor * big_a), B=big_b, p0=F.lit(2 * math.pi))
    g.add(c0=g["s0"] + 0.0)
    for n in range(steps):
        p, c = g[f"p{n}"], g[f"c{n}"]
        g.add(**{f"ss{n}": F.sin(c), f"cs{n}": F.cos(c), f"cm{n}": F.cos(2.0 * g["s1"] + c)})
        moved = g["s0"] + _delta_sigma(g["B"], g[f"ss{n}"], g[f"cs{n}"], g[f"cm{n}"])
        open_ = F.abs(c - p) > TOLERANCE
        g.add(**{f"p{n + 1}": F.when(open_, c).otherwise(p), f"c{n + 1}": F.when(open_, moved).otherwise(c)})
    state = F.struct(g[f"p{steps}"].alias("p"), g[f"c{steps}"].alias("c"))
    looped = _looped(state, lambda s: _next_sigma(g["s0"], g["s1"], g["B"], s), BODIES - steps)
    g.add(r=F.when(F.abs(g[f"c{steps}"] - g[f"p{steps}"]) > TOLERANCE, looped).otherwise(state))
    g.add(last=g["r"]["p"], sig=g["r"]["c"])
    g.add(ssf=F.sin(g["last"]), csf=F.cos(g["last"]), cmf=F.cos(2.0 * g["s1"] + g["last"]), tf=_longitude_term(ell, g["a"]))
    lat2, lon2 = _end_point(ell, F.col(lon), g["su"], g["cu"], g["sin1"], g["cos1"], g["sa"], g["ssf"], g["csf"], g["cmf"], g["sig"], g["tf"])
    return g.select(df, [n for n in df.columns if n not in out], {out[0]: lat2, out[1]: lon2})
