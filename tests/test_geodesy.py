from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from permaway.functions import geodesy

#: Published test line Flinders Peak to Buninyon.
FLINDERS = (-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600)
BUNINYON = (-(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600)

PAIRS = {
    "published": (*FLINDERS, *BUNINYON),
    "coincident": (10.0, 20.0, 10.0, 20.0),
    "equatorial": (0.0, 0.0, 0.0, 1.0),
    "meridional": (0.0, 0.0, 1.0, 0.0),
    "wrapped": (10.0, 179.5, 10.0, -179.5),
    "full turn": (10.0, -180.0, 10.0, 180.0),
    "long": (40.0, -75.0, -33.0, 151.0),
    "near antipodal": (0.3, 0.0, -0.3, 179.7),
}


@pytest.fixture(scope="module")
def solved(spark):
    df = spark.createDataFrame([(k, *v) for k, v in PAIRS.items()], "name string, a double, b double, c double, d double")
    column = df.select("name", geodesy.inverse(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("r")).select("name", "r.*")
    batch = geodesy.with_inverse(df, "a", "b", "c", "d").select("name", "distance_m", "azimuth", "final_azimuth")
    return {r.name: r for r in column.collect()}, {r.name: r for r in batch.collect()}


def test_known_answers(solved):
    column, _ = solved
    assert column["published"].distance_m == pytest.approx(54972.271, abs=1e-3)
    assert math.degrees(column["published"].azimuth) % 360 == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-6)
    assert tuple(column["coincident"])[1:] == (0.0, 0.0, 0.0)
    assert column["equatorial"].distance_m == pytest.approx(111319.4908, abs=1e-3)
    assert column["meridional"].distance_m == pytest.approx(110574.3886, abs=1e-3)
    assert 100_000 < column["wrapped"].distance_m < 110_000
    assert all(math.isfinite(x) for r in column.values() for x in tuple(r)[1:])


def test_both_forms_agree(solved):
    column, batch = solved
    for name in PAIRS:
        if name != "near antipodal":
            assert batch[name].distance_m == pytest.approx(column[name].distance_m, abs=1e-6), name
            assert batch[name].azimuth == pytest.approx(column[name].azimuth, abs=1e-9), name


def test_array_form_agrees(solved):
    column, _ = solved
    names = [n for n in PAIRS if n != "near antipodal"]
    d, az, _ = geodesy.inverse_arrays(*np.array([PAIRS[n] for n in names]).T)
    assert np.allclose(d, [column[n].distance_m for n in names], atol=1e-6) and np.allclose(az, [column[n].azimuth for n in names], atol=1e-9)


def test_direct_undoes_inverse(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(a + c), float(b + d)) for a, b, c, d in zip(rng.uniform(-70, 70, 200), rng.uniform(-180, 180, 200), rng.uniform(-1, 1, 200), rng.uniform(-1, 1, 200), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    there = geodesy.with_direct(geodesy.with_inverse(df, "a", "b", "c", "d"), "a", "b", "azimuth", "distance_m", ("lat", "lon"))
    assert there.select(F.max(F.abs(F.col("lat") - F.col("c"))), F.max(F.abs(F.col("lon") - F.col("d")))).first() == pytest.approx((0, 0), abs=1e-9)
    column = df.select(geodesy.direct(F.col("a"), F.col("b"), F.lit(1.0), F.lit(5000.0)).alias("p"), "a", "b")
    batch = geodesy.with_direct(df.select("a", "b", F.lit(1.0).alias("z"), F.lit(5000.0).alias("m")), "a", "b", "z", "m", ("lat", "lon"))
    assert np.allclose(sorted((r.p.latitude, r.p.longitude) for r in column.collect()), sorted((r.lat, r.lon) for r in batch.collect()), atol=1e-11)


def test_zero_distance_and_nulls(spark):
    df = spark.createDataFrame([(10.0, 20.0, 1.0, 0.0), (None, 20.0, 1.0, 5.0)], "a double, b double, z double, m double")
    got = geodesy.with_direct(df, "a", "b", "z", "m", ("lat", "lon")).orderBy("m").collect()
    assert (got[0].lat, got[0].lon) == pytest.approx((10.0, 20.0), abs=1e-12)
    assert got[1].lat is None and got[1].lon is None
    back = geodesy.with_inverse(df, "a", "b", "a", "b").orderBy("m").collect()
    assert back[0].distance_m == 0.0 and back[1].distance_m is None


def test_filters_on_results_stay_cheap(spark):
    df = spark.range(100).select((F.col("id") / 100).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), F.lit(0.5).alias("d"))
    far = geodesy.with_inverse(df, "a", "b", "c", "d").where("distance_m > 60000")
    assert 0 < far.count() < 100
