from __future__ import annotations

import hashlib
import math
import random
import zipfile
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from permaway.functions import jsnum, styling
from permaway.operators import sections
from permaway.options import CenterlineOptions, DrawingOptions
from permaway.paths import files_of
from permaway.plans import pipelines
from permaway.sinks import archive, text
from permaway.sources import centerline_csv, kml

DOC = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:kml="urn:x"><Document>
<Placemark><name>B</name><description>d</description><LineString><coordinates>151,-33,5 151.01,-33.01 151.02,-33.0,x
 151.03,-33.02,</coordinates></LineString></Placemark>
<Placemark><Point><coordinates>1,2</coordinates></Point></Placemark>
<Placemark><name></name><MultiGeometry><LineString><coordinates>3,4 bad 5</coordinates></LineString><Point><coordinates>x,1 5,6,7</coordinates></Point></MultiGeometry></Placemark>
<kml:Placemark><name>no</name></kml:Placemark></Document></kml>"""


def test_placemarks_in_document_order():
    got = kml.placemarks(DOC)
    assert [(m[0], m[1], m[2], len(m[3])) for m in got] == [(0, "B", "d", 1), (1, "Section_1", "", 1), (2, "", "", 2)]
    assert kml.placemarks("<kml><Placemark></kml>") == []
    assert kml.placemarks('<!DOCTYPE a [<!ENTITY x "y">]><a/>') == []


def test_kml_points(spark, tmp_path):
    (tmp_path / "one.kml").write_text(DOC)
    (tmp_path / "bad.kml").write_text("<kml><Placemark>")
    got = kml.points(kml.read_placemarks(spark, [str(tmp_path / "one.kml"), str(tmp_path / "bad.kml")])).orderBy("file", "placemark_idx", "tuple_idx").collect()
    assert [(r.section, r.longitude, r.latitude) for r in got] == [("B", 151, -33), ("B", 151.01, -33.01), ("B", 151.02, -33.0), ("B", 151.03, -33.02), ("Section_1", 1, 2), ("", 3, 4), ("", 5, 6)]
    alts = [r.altitude for r in got]
    assert alts[:2] == [5, 0] and math.isnan(alts[2]) and math.isnan(alts[3]) and alts[-1] == 7


MESSY = "﻿Section,Lat,Lon\r\n#c,1,2,3\r\n\r\na,1.5x, 2e1 ,12.5d,0.25\r\nb\t3\t4\r\nx,1\r\nc,nope,3\r\nd,5,6,,z\n\te\t7\t8\t9\n f , 1 , 2 \n"


def test_messy_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSY, encoding="utf-8", newline="")
    got = centerline_csv.read_centerlines(spark, [str(tmp_path / "m.csv")]).orderBy("line_no").collect()
    assert [(r.section, r.latitude, r.longitude, r.kilometrage) for r in got] == [("a", 1.5, 20, 0.25), ("b", 3, 4, None), ("d", 5, 6, None), ("e", 7, 8, None), ("f", 1, 2, None)]
    assert got[0].altitude == 12.5 and got[1].altitude == 0 and math.isnan(got[2].altitude) and got[3].altitude == 9


def test_generic_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert centerline_csv.read_table(spark, [str(tmp_path / "t.csv")]).dtypes == [("a", "int"), ("b", "string")]
    assert centerline_csv.read_table(spark, [str(tmp_path / "t.csv")], typed=False).dtypes == [("a", "string"), ("b", "string")]


@pytest.mark.parametrize(
    ("x", "digits", "shown"),
    [(1.005, 2, "1.00"), (0.0625, 3, "0.063"), (-0.0625, 3, "-0.063"), (-0.0, 3, "0.000"), (-0.0001, 3, "-0.000"), (math.nan, 3, "NaN"), (2.5, 0, "3"), (1234567.125, 2, "1234567.13"), (151.123456784, 8, "151.12345678")],
)
def test_fixed_decimals(spark, x, digits, shown):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(jsnum.to_fixed(F.col("x"), digits).alias("t")).first().t == shown


@pytest.mark.parametrize("digits", [0, 1, 3, 8])
def test_fixed_decimals_by_exact_arithmetic(spark, digits):
    rng = random.Random(digits)
    xs = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-9, min(8, 13 - digits)) for _ in range(3000)]
    xs += [(rng.randint(-(10**6), 10**6) + 0.5) / 10**digits for _ in range(1000)] + [k / 2 ** (digits + 1) for k in range(-40, 40)] + [0.0, -0.0, 1e-6, 999999.0]
    got = spark.createDataFrame(list(enumerate(xs)), "k int, x double").select("k", jsnum.to_fixed(F.col("x"), digits).alias("t")).orderBy("k").collect()
    for x, r in zip(xs, got, strict=True):
        want = f"{Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"
        assert r.t == (want.lstrip("-") if x == 0 else want), x


def test_number_prefixes(spark):
    texts = ["12.5abc", "12.5d", "1e3", "", " .5", "-7.", "x1", "Infinity", "+3", "1e"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.v for r in df.select("k", jsnum.parse_float(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got == [12.5, 12.5, 1000.0, None, 0.5, -7.0, None, math.inf, 3.0, 1.0]
    assert [r.v for r in df.select("k", jsnum.parse_int(F.col("t")).alias("v")).orderBy("k").collect()][:3] == [12, 12, 1]


def test_escape_and_names(spark):
    df = spark.createDataFrame([("<a & 'b' \"c\">", "x.csv.csv", "plain")], "t string, n string, m string")
    r = df.select(styling.escape_xml(F.col("t")).alias("t"), text.renamed(F.col("n"), ".csv", "").alias("n"), text.renamed(F.col("m"), ".csv", "").alias("m")).first()
    assert tuple(r) == ("&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;", "x.csv", "plain")


def test_paths_to_centerlines_and_back(spark, tmp_path):
    marks = "".join(f"<Placemark><name>{n}</name><LineString><coordinates>{' '.join(f'{151 + k * 0.004:.4f},{-33 - d + (k % 3) * 0.001:.4f},{k}' for k in range(6))}</coordinates></LineString></Placemark>" for n, d in (("B", 0), ("10", 0.1), ("", 0.2)))
    (tmp_path / "a.kml").write_text(f"<kml><Document>{marks}<Placemark><name>short</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>")
    out = tmp_path / "out.zip"
    files = pipelines.build_centerlines(spark, [str(tmp_path / "a.kml")], output=str(out)).collect()
    assert [f.file_name for f in files] == ["a.csv"]
    lines = files[0].content.split("\n")
    assert lines[0] == text.CSV_HEADER and lines[-1] == ""
    sections = [line.split(",")[0] for line in lines[1:-1]]
    assert list(dict.fromkeys(sections)) == ["10", "B", ""]
    first = lines[1].split(",")
    assert first[3:] == ["0.000", "0.000", "0.0"] and len(first[1].split(".")[1]) == 8
    assert zipfile.ZipFile(out).read("a.csv").decode() == files[0].content

    (tmp_path / "a.csv").write_text(files[0].content)
    kmz = tmp_path / "lines.kmz"
    doc = pipelines.build_lines(spark, [str(tmp_path / "a.csv")], output=str(kmz)).first().content
    assert zipfile.ZipFile(kmz).read("doc.kml").decode() == doc
    tree = ElementTree.fromstring(doc.encode())
    ns = {"k": "http://www.opengis.net/kml/2.2"}
    assert [f.find("k:name", ns).text for f in tree.findall("k:Document/k:Folder", ns)] == ["Lines", "Posts"]
    assert len(tree.findall(".//k:Style", ns)) == 11
    names = [p.find("k:name", ns).text for p in tree.findall("k:Document/k:Folder/k:Folder/k:Placemark", ns)]
    assert names[:2] == ["a", "a - Low Detail"] and names[2] == "km 0.000"
    assert len(names) == 2 + len(lines) - 2


def marks(name, lon, lat, n=6):
    return f"<kml><Placemark><name>{name}</name><LineString><coordinates>{' '.join(f'{lon + k * 0.0004:.4f},{lat + (k % 3) * 0.0001:.4f},{k}' for k in range(n))}</coordinates></LineString></Placemark></kml>"


def test_empty_file_stops_the_batch(spark, tmp_path):
    (tmp_path / "a.kml").write_text(marks("s", 151, -33))
    (tmp_path / "e.kml").write_text("<kml/>")
    (tmp_path / "short.kml").write_text(marks("s", 151, -33, 2))
    paths = [str(tmp_path / f"{n}.kml") for n in ("a", "e")]
    with pytest.raises(pipelines.EmptyFileError, match="no points in e.csv"):
        pipelines.build_centerlines(spark, paths, output=str(tmp_path / "out" / "x.zip"))
    assert not list((tmp_path / "out").glob("*.zip"))
    with pytest.raises(Exception, match="no points in e.csv"):
        pipelines.build_centerlines(spark, paths).collect()
    # sections that are too short make an empty table, no empty file
    short = pipelines.build_centerlines(spark, [str(tmp_path / "short.kml")]).collect()
    assert [(r.file_name, r.content) for r in short] == [("short.csv", text.CSV_HEADER + "\n")]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    """Two folders hold x.kml, on two continents: each is fitted by itself, and the last counts."""
    for folder, lon in (("a", 10.0), ("b", 151.0), ("c d", 70.0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.kml").write_text(marks(folder, lon, -33))
    (tmp_path / "c d" / "y é+1 %20.kml").write_text(marks("y", 20.0, 50))
    paths = [str(tmp_path / p) for p in ("a/x.kml", "c d/y é+1 %20.kml", "b/x.kml")]
    got = {r.file_name: r.content.splitlines() for r in pipelines.build_centerlines(spark, paths, output=str(tmp_path / "o.zip")).collect()}
    assert set(got) == {"x.csv", "y é+1 %20.csv"}
    assert got["x.csv"][1].startswith("b,-33.00000000,151.00000000") and 6 < len(got["x.csv"]) < 20
    assert sorted(zipfile.ZipFile(tmp_path / "o.zip").namelist()) == sorted(got)
    # one that is empty stops the batch, though another of its name comes later
    (tmp_path / "a" / "x.kml").write_text("<kml/>")
    with pytest.raises(pipelines.EmptyFileError):
        pipelines.build_centerlines(spark, paths, output=str(tmp_path / "p.zip"))


def test_tables_of_one_name_and_odd_names(spark, tmp_path):
    for folder, lat in (("a", -33), ("b c", 50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my file+1 %20[x].csv").write_text("".join(f"s,{lat + k},{151},0\n" for k in range(3)))
    (tmp_path / "a" / "z.csv").write_text("s,1,2\ns,3,4\n")
    paths = [str(tmp_path / p) for p in ("a/my file+1 %20[x].csv", "a/z.csv", "b c/my file+1 %20[x].csv")]
    lines = centerline_csv.read_lines(spark, paths)
    assert {(r.file, r.file_ord) for r in lines.collect()} == {("my file+1 %20[x].csv", 0), ("z.csv", 1), ("my file+1 %20[x].csv", 2)}
    got = pipelines.drawn_points(centerline_csv.read_centerlines(spark, paths)).orderBy("line_ord", "idx").collect()
    assert [(r.line, r.line_ord, r.idx, r.latitude) for r in got] == [("my file+1 %20[x]", 0, 0, 50), ("my file+1 %20[x]", 0, 1, 51), ("my file+1 %20[x]", 0, 2, 52), ("z", 1, 0, 1), ("z", 1, 1, 3)]
    # a folder stands for its files by name
    assert [paths_.rsplit("/", 1)[1] for paths_ in files_of(spark, [str(tmp_path / "a")])] == ["my file+1 %20[x].csv", "z.csv"]


def test_plain_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a, b ,a\n1,"x,2\n\n  \n 3 \n')
    df = centerline_csv.read_plain(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect()), key=str) == sorted([("2", '"x'), (None, None)], key=str)


def test_documents_need_one_aggregate_of_the_points(spark):
    df = spark.createDataFrame([("x", 0, k, -33.0 + k, 151.0, 1.0, None) for k in range(30)], "line string, line_ord int, idx int, latitude double, longitude double, altitude double, kilometrage double")
    plan = text.lines_document(df.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate(keys=[line") + plan.count("SortAggregate(keys=[line") <= 2 and plan.count("Exchange hashpartitioning") <= 4
    assert text.lines_document(df).first().content.count("Low Detail") == 1


def test_last_file_of_a_name_wins(spark):
    df = spark.createDataFrame([("a.csv", 0, 0, 1.0), ("b.csv", 1, 0, 2.0), ("a.csv", 2, 0, 3.0)], "file string, file_ord int, line_no int, latitude double")
    got = {(r.line, r.line_ord): r.latitude for r in pipelines.last_of_each(df).collect()}
    assert got == {("a", 0): 3.0, ("b", 1): 2.0}


def test_styles_of_lines(spark):
    df = spark.createDataFrame([(f"L{k:02d}", k, 0) for k in range(12)], "line string, line_ord int, idx int")
    got = [r.style for r in text.with_style(df).orderBy("line_ord").collect()]
    assert got[0] == "style_1" and got[9] == "style_0" and got[10] == "style_1"


def test_documents_are_well_formed(spark):
    df = spark.createDataFrame([("<x>", 0, k, -33.0 + k, 151.0, 1.0, None) for k in range(3)], "line string, line_ord int, idx int, latitude double, longitude double, altitude double, kilometrage double")
    simple = text.simple_document(df, "absolute", 3.0, 2.0).first().content
    assert "<name>&lt;x&gt;</name>" in simple and "151.00000000,-33.00000000,8.000" in simple
    ElementTree.fromstring(simple.encode())
    ElementTree.fromstring(text.index_document().encode())
    assert "Low Detail" not in text.lines_document(df).first().content


def test_archive_of_equal_names_keeps_the_last():
    import io

    z = zipfile.ZipFile(io.BytesIO(archive.zipped([("a", "1"), ("b", "2"), ("a", "3")])))
    assert z.read("a") == b"3" and sorted(z.namelist()) == ["a", "b"]


def test_archive_of_a_document_needs_no_row_of_the_whole(spark, tmp_path, monkeypatch):
    for k in range(150):
        (tmp_path / f"t{k:03d}é.csv").write_text("".join(f"s,{-33 + j / 100},{151 + k / 100},0,{j / 8}\n" for j in range(25)), encoding="utf-8")
    rows, saved = [], archive._saved
    monkeypatch.setattr(archive, "_saved", lambda df, *a, **o: (rows.append(df.agg(F.max(F.length("content"))).first()[0]), saved(df, *a, **o)))
    document = pipelines.build_lines(spark, [str(tmp_path)], output=str(tmp_path / "out" / "l.kmz")).first().content
    z = zipfile.ZipFile(tmp_path / "out" / "l.kmz")
    assert z.namelist() == ["doc.kml"] and z.testzip() is None and z.read("doc.kml").decode() == document
    assert rows[0] * 50 < len(document)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["l.kmz"]
    digest = archive.read_digests(spark, [str(tmp_path / "out" / "l.kmz")]).collect()
    assert [tuple(r) for r in digest] == [("doc.kml", hashlib.md5(document.encode()).hexdigest(), len(document))]


def test_large_folders_are_listed_at_once(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"f {k:03d}+%20é.csv").write_text(f"s,{k},2\n")
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "sub").mkdir()
    client, calls = type(spark.sparkContext._gateway._gateway_client), []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda self, *a, **b: (calls.append(1), send(self, *a, **b))[1])
    files = files_of(spark, [str(tmp_path)])
    again = files_of(spark, files[::-1])
    assert len(calls) < 300 and len(files) == 300 and again == files[::-1]
    got = centerline_csv.read_centerlines(spark, files[::-1])
    assert got.rdd.getNumPartitions() < 50
    assert sorted((r.file_ord, r.file, r.latitude) for r in got.collect()) == [(299 - k, f"f {k:03d}+%20é.csv", k) for k in range(299, -1, -1)]


def test_zip_records_of_large_archives():
    import io
    import struct
    import zlib

    a, b = b"ab" * 1000, "é".encode() * 777
    assert archive.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and archive.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)
    entries = [archive.Entry(f"n{k}", k, 10, 20, k * 10**5) for k in range(70000)]
    listed = zipfile.ZipFile(io.BytesIO(archive._end(entries, 0))).infolist()
    assert [(i.filename, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in listed] == [tuple(e) for e in entries]
    assert listed[-1].header_offset > 2**32
    large = archive.Entry("x", 1, 5 * 10**9, 6 * 10**9)
    assert struct.unpack("<2H2Q", large.record(False)[-20:]) == (1, 16, 6 * 10**9, 5 * 10**9)


def test_archives_of_tables_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"f{k:02d}.kml").write_text(marks(f"s{k}", 100 + k / 10, -33))
    frames, saved = [], archive._saved
    monkeypatch.setattr(archive, "_saved", lambda df, *a, **o: (frames.append(df), saved(df, *a, **o)))
    monkeypatch.setattr(archive, "ROW", 2000)
    out = str(tmp_path / "out" / "t.zip")
    want = {r.file_name: r.content for r in pipelines.build_centerlines(spark, [str(tmp_path)], output=out).collect()}
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobin" not in plan
    read = archive.read_archives(spark, [out])
    assert {r.file_name: r.content for r in read.collect()} == want and len(want) == 40
    assert len({r.p for r in read.select(F.spark_partition_id().alias("p")).collect()}) > 1
    z = zipfile.ZipFile(out)
    assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == want


def test_sections_print_as_columns_do(spark):
    rng = random.Random(5)
    xs = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-9, 5) for _ in range(500)] + [k / 16 for k in range(-40, 40)] + [0.0, -0.0, -0.0004, 2.5, math.nan, math.inf, -math.inf]
    rows = [(k, x) for k, x in enumerate(xs)]
    shown = [jsnum.to_fixed(F.col("x"), d) for d in (8, 3, 1)]
    want = [r.t for r in spark.createDataFrame(rows, "k int, x double").select("k", F.concat_ws(",", F.lit("a%s"), *shown).alias("t")).orderBy("k").collect()]
    x = np.array(xs)
    for part in (slice(None), slice(0, -3)):
        assert sections.csv_text(["a%s"] * len(xs[part]), [(x[part], 8), (x[part], 3), (x[part], 1)]).splitlines() == want[part]


def test_options():
    assert CenterlineOptions.curve_finding().output_spacing == 5.0
    assert CenterlineOptions.parse(spline_detail="60.9", output_spacing="10m").spline_detail == 60
    for bad in ({"output_spacing": math.nan}, {"output_spacing": 0.0}, {"max_segment": -1.0}, {"densify_spacing": 5000.0}):
        with pytest.raises(ValueError):
            CenterlineOptions(**bad)
    with pytest.raises(ValueError):
        CenterlineOptions.parse(spline_detail="x")
    assert DrawingOptions(exaggeration=0.0, offset=0.0).exaggeration == 0.0
    assert DrawingOptions(exaggeration=0.0, offset=0.0, legacy_zero_defaults=True).offset == 3.0
    assert styling.altitude_mode("relative") == "clampToGround"
