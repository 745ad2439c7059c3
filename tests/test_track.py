from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from permaway.functions import geodesy
from permaway.operators import sections, track

KEYS = ("section",)
SCHEMA = "section string, idx bigint, latitude double, longitude double, altitude double"


def points(spark, **sections):
    return spark.createDataFrame([(name, k, *map(float, p)) for name, ps in sections.items() for k, p in enumerate(ps)], SCHEMA)


def rows(df, section=None):
    got = (df if section is None else df.where(F.col("section") == section)).orderBy("section", "idx").collect()
    return [(r.latitude, r.longitude, r.altitude) for r in got]


def inv(p, q):
    d, az, _ = geodesy.inverse_arrays(*(np.array([x]) for x in (p[0], p[1], q[0], q[1])))
    return float(d[0]), float(az[0])


def ahead(p, az, s):
    lat, lon = geodesy.direct_arrays(*(np.array([x]) for x in (p[0], p[1], az, s)))
    return float(lat[0]), float(lon[0])


def random_track(seed, n, step):
    rng = random.Random(seed)
    p, out = (-33.0, 151.0, 5.0), []
    for k in range(n):
        out.append(p)
        p = (p[0] + rng.uniform(-step, step), p[1] + rng.uniform(0.2 * step, step), float(k))
    return out


def sequential_densify(track_points, most, spacing):
    out = [track_points[0]]
    for p in track_points[1:]:
        prev = out[-1]
        while inv(prev, p)[0] > most:
            d, az = inv(prev, p)
            prev = (*ahead(prev, az, spacing), prev[2])
            out.append(prev)
        out.append(p)
    return out


def sequential_resample(track_points, interval):
    out, since = [track_points[0]], 0.0
    for p, q in zip(track_points, track_points[1:], strict=False):
        (length, az), covered = inv(p, q), 0.0
        while covered < length:
            if interval - since <= length - covered:
                covered += interval - since
                out.append((*ahead(p, az, covered), p[2]))
                since = 0.0
            else:
                since += length - covered
                covered = length
    if inv(out[-1], track_points[-1])[0] > 0.001:
        out.append(track_points[-1])
    return out


@pytest.mark.parametrize(("most", "spacing"), [(800.0, 600.0), (300.0, 200.0), (800.0, 1500.0)])
def test_densify_follows_the_steps(spark, most, spacing):
    want = random_track(3, 12, 0.02)
    got = rows(track.densify(points(spark, a=want), KEYS, most, spacing))
    model = sequential_densify(want, most, spacing)
    assert len(got) == len(model)
    assert max(inv(a, b)[0] for a, b in zip(got, model, strict=True)) < 1e-3
    assert [a[2] for a in got] == [b[2] for b in model]


@pytest.mark.parametrize("interval", [25.0, 130.0, 5000.0])
def test_resample_follows_the_steps(spark, interval):
    want = random_track(5, 15, 0.004)
    got = rows(track.resample(points(spark, a=want), KEYS, interval))
    model = sequential_resample(want, interval)
    assert len(got) == len(model)
    assert max(inv(a, b)[0] for a, b in zip(got, model, strict=True)) < 1e-6
    assert [a[2] for a in got] == [b[2] for b in model]


def test_single_points_pass_through(spark):
    one = points(spark, a=[(1, 2, 3)])
    for out in (track.densify(one, KEYS, 800, 600), track.flatten(one, KEYS), track.resample(one, KEYS, 25), track.cardinal_spline(one, KEYS), track.smooth(one, KEYS), track.control_points(one, KEYS)):
        assert rows(out) == [(1.0, 2.0, 3.0)]
    assert track.decimate(one, KEYS).count() == 0
    assert track.chainage(one, KEYS).first().chainage_m == 0.0
    assert track.curve_radius(one, KEYS).first().curve_radius == 0.0


@pytest.mark.parametrize("bad", [(0.0, 1.0), (-1.0, 1.0), (800.0, 0.0), (800.0, 1601.0), (math.nan, 1.0)])
def test_endless_options_are_refused(spark, bad):
    with pytest.raises(ValueError):
        track.densify(points(spark, a=[(1, 2, 3)]), KEYS, *bad)
    with pytest.raises(ValueError):
        track.resample(points(spark, a=[(1, 2, 3)]), KEYS, min(0.0, bad[0]) if bad[0] == bad[0] else bad[0])


def test_control_points_by_hand(spark):
    got = rows(track.control_points(points(spark, a=[(0, 0, 1), (6, 0, 2), (6, 12, 3)]), KEYS))
    want = [(0, 0), (1, 0), (5, -2), (6, 0), (7, 2), (6, 10), (6, 12)]
    assert np.allclose([p[:2] for p in got], want)


def test_flatten_counts_and_altitudes(spark):
    got = rows(track.flatten(points(spark, a=[(0, 0, 1), (0, 3, 2), (0, 6, 3)]), KEYS, 2))
    assert len(got) == 2 * 3 + 1
    assert [p[2] for p in got] == [1, 0, 0, 2, 0, 0, 3]
    assert [p[1] for p in got] == sorted(p[1] for p in got)


@pytest.mark.parametrize(("n", "kept"), [(20, 0), (21, 3), (22, 4), (31, 4)])
def test_decimate_keeps_every_tenth_and_the_last(spark, n, kept):
    got = track.decimate(points(spark, a=[(k, 0, 0) for k in range(n)]), KEYS)
    assert got.count() == kept
    assert not kept or got.agg(F.max("idx")).first()[0] == n - 1


def test_radius_of_arcs(spark):
    def arc(radius, n=41, spacing=25.0):
        p, az, out = (-33.0, 151.0), 0.0, []
        for _ in range(n):
            out.append((*p, 0.0))
            p, az = ahead(p, az + spacing / radius / 2, spacing), az + spacing / radius
        return out

    line = [(*ahead((-33.0, 151.0), 1.0, 25.0 * k), 0.0) for k in range(41)]
    got = track.curve_radius(points(spark, tight=arc(200), wide=arc(800), flat=arc(6000), line=line), KEYS)
    mean = {r.section: r.m for r in got.where("idx between 2 and 38").groupBy("section").agg(F.avg("curve_radius").alias("m")).collect()}
    # the turn is measured between chords over half of the arc each, so the formula gives twice the radius of an arc
    assert mean["tight"] == pytest.approx(400, rel=0.02) and mean["wide"] == pytest.approx(1600, rel=0.02)
    assert mean["flat"] == 0 and mean["line"] == 0
    assert got.where("idx < 2 or idx > 38").agg(F.max("curve_radius")).first()[0] == 0


def test_curvature_of_triples(spark):
    got = track.curvature(points(spark, a=[(0, 0, 0), (0, 0.01, 0), (0, 0.02, 0), (0.01, 0.02, 0)]), KEYS).orderBy("idx").collect()
    assert [r.idx for r in got] == [1, 2] and got[0].radius_m == math.inf and 0 < got[1].radius_m < 2000


def test_smooth_clips_at_the_ends(spark):
    got = rows(track.smooth(points(spark, a=[(0, 0, 0), (3, 3, 3), (9, 9, 9)], b=[(1, 1, 1), (2, 2, 2)]), KEYS, 3))
    assert got == [(1.5, 1.5, 1.5), (4, 4, 4), (6, 6, 6), (1, 1, 1), (2, 2, 2)]


def test_sections_gate_and_order(spark):
    df = points(spark, a=[(0, 0, 0)] * 3, b=[(0, 0, 0)] * 4)
    assert {r.section for r in track.at_least(df, KEYS).select("section").collect()} == {"b"}
    named = spark.createDataFrame([("f", k, n) for k, n in enumerate(["B", "10", "2", "A", "default", "4294967295"])], "file string, idx bigint, section_key string")
    order = [r.section_key for r in track.with_section_order(named).orderBy("section_ord").collect()]
    assert order == ["2", "10", "B", "A", "default", "4294967295"]


def test_chainage_starts_at_zero_and_grows(spark):
    got = [r.chainage_m for r in track.chainage(points(spark, a=random_track(9, 30, 0.01)), KEYS).orderBy("idx").collect()]
    assert got[0] == 0 and all(a <= b for a, b in zip(got, got[1:], strict=False))


def test_order_of_rows_and_partitions_does_not_matter(spark):
    df = points(spark, a=random_track(2, 20, 0.01), b=random_track(4, 25, 0.01))
    one = rows(track.resample(track.flatten(df, KEYS, 5), KEYS, 25.0))
    two = rows(track.resample(track.flatten(df.orderBy(F.rand(1)).repartition(7), KEYS, 5), KEYS, 25.0))
    assert one == two


def test_one_exchange_for_the_whole_chain(spark):
    from permaway.options import CenterlineOptions
    from permaway.plans.pipelines import centerline

    df = points(spark, a=random_track(2, 20, 0.01)).withColumn("file", F.lit("f"))
    plan = centerline(df, CenterlineOptions(), ("file", "section"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FlatMapGroupsInArrow") == 1 and "Window" not in plan


@pytest.mark.parametrize("size", [1, 3, sections.SEGMENTS])
def test_the_whole_chain_equals_its_steps(spark, monkeypatch, size):
    """In pieces of any size, with extra columns, short sections and a section without any length."""
    monkeypatch.setattr(sections, "SEGMENTS", size)
    tracks = {"long": random_track(2, 40, 0.01), "loop": [(-33.0, 151.0, 1.0), (-33.0, 151.002, 2.0), (-33.001, 151.001, 3.0), (-33.0, 151.0, 4.0)], "still": [(1.0, 2.0, 3.0)] * 5, "two": random_track(3, 2, 0.003), "one": [(5.0, 6.0, 7.0)]}
    df = points(spark, **tracks).withColumn("mark", F.concat("section", F.col("idx").cast("string"))).withColumn("chainage", F.lit(1))
    step = track.resample(track.flatten(track.densify(df, KEYS, 300.0, 200.0), KEYS, 20), KEYS, 25.0)
    want = track.chainage(track.curve_radius(step, KEYS, 100.0, 5000.0), KEYS)
    got = sections.fitted(df, KEYS, 25.0, detail=20, densify=(300.0, 200.0), curves=(100.0, 5000.0), chainage=True)
    assert got.columns == want.columns
    a, b = (x.orderBy("section", "idx").toPandas() for x in (want, got))
    assert a[["section", "idx", "mark", "chainage"]].equals(b[["section", "idx", "mark", "chainage"]]) and len(a) > 100
    for c in ("latitude", "longitude", "altitude", "chainage_m"):
        assert np.allclose(a[c], b[c], rtol=0, atol=1e-7)
    assert np.allclose(a.curve_radius, b.curve_radius, rtol=1e-4)


def test_sections_of_few_points_are_named(spark):
    df = points(spark, a=random_track(2, 5, 0.001), b=random_track(2, 3, 0.001))
    got = sections.fitted(df, KEYS, 25.0, curves=(100.0, 5000.0), chainage=True, more_than=3).where("section = 'b'").collect()
    assert [(r.idx, r.latitude, r.chainage_m) for r in got] == [(-1, None, None)]
    assert sections.fitted(df.limit(0), KEYS, 25.0).count() == 0
