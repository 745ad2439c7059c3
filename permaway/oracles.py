"""DuckDB SQL that must give the same rows as the track queries.

The geodesics iterate in recursive common table expressions, the points come
from the same fixture text, and everything else is written from the formulas:
none of it shares a formulation with the engine.
"""

from __future__ import annotations

#: The fixture: one ordered track per user of the table events. The text runs in Spark and DuckDB alike.
TRACKS = """
select concat('U', cast(user_id as varchar(12))) as section, seq,
       -33e0 + cast(user_id as double)*1e-3 + cast((event_id*7919)%11 as double)*5e-4 as lat,
       151e0 + cast(seq as double)*6e-3 + cast((event_id*31)%5 as double)*1e-3 as lon,
       value as alt
from (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events) t
"""

POINTS = f"pts AS (SELECT section, seq - 1 AS i, lat, lon, alt FROM ({TRACKS}) AS t)"

LEGS = POINTS + """, leg AS (
  SELECT section AS g, i, lat AS y1, lon AS x1, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY section ORDER BY i)
)"""


def inverse(name: str, source: str, minor: float = 6356752.314245) -> str:
    """CTEs that end in ``name``(g, i, d, az1, az2) from ``source``(g, i, y1, x1, y2, x2)."""
    f = (6378137.0 - minor) / 6378137.0
    return f"""
{name}_u AS (
  SELECT g, i, atan({1 - f!r} * tan(radians(y1))) AS u1, atan({1 - f!r} * tan(radians(y2))) AS u2, radians(x2 - x1) AS l FROM {source} WHERE x2 IS NOT NULL AND x1 IS NOT NULL
), {name}_it AS (
  SELECT g, i, u1, u2, l, l AS lam, 2e0 * pi() AS prev, 0 AS n FROM {name}_u
  UNION ALL
  SELECT g, i, u1, u2, l, CASE WHEN ss = 0 THEN lam ELSE l + (1 - c) * {f!r} * sa * (atan2(ss, cs) + c * ss * (m + c * cs * (-1 + 2 * m * m))) END, lam, n + 1
  FROM (
    SELECT *, {f!r} / 16 * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c, CASE WHEN c2 = 0 THEN 0e0 ELSE cs - 2 * sin(u1) * sin(u2) / c2 END AS m FROM (
      SELECT *, 1 - sa * sa AS c2 FROM (
        SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (
          SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs
          FROM {name}_it WHERE abs(lam - prev) > 1e-12 AND n < 19) AS a) AS b) AS c) AS d
), {name}_last AS (
  SELECT g, i, arg_max(u1, n) AS u1, arg_max(u2, n) AS u2, arg_max(prev, n) AS lam FROM {name}_it GROUP BY g, i
), {name}_t AS (
  SELECT *, CASE WHEN c2 = 0 THEN 0e0 ELSE cs - 2 * sin(u1) * sin(u2) / c2 END AS m, c2 * {(6378137.0**2 - minor**2) / minor**2!r} AS uu FROM (
    SELECT *, 1 - sa * sa AS c2 FROM (
      SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (
        SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM {name}_last) AS a) AS b) AS c
), {name} AS (
  SELECT g, i, CASE WHEN ss = 0 THEN 0e0 ELSE {minor!r} * aa * (atan2(ss, cs) - bb * ss * (m + bb / 4 * (cs * (-1 + 2 * m * m) - bb / 6 * m * (-3 + 4 * ss * ss) * (-3 + 4 * m * m)))) END AS d,
         CASE WHEN ss = 0 THEN 0e0 ELSE atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) END AS az1,
         CASE WHEN ss = 0 THEN 0e0 ELSE atan2(cos(u1) * sin(lam), -sin(u1) * cos(u2) + cos(u1) * sin(u2) * cos(lam)) END AS az2
  FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM {name}_t) AS e
)"""


def direct(name: str, source: str) -> str:
    """CTEs that end in ``name``(g, i, lat, lon) from ``source``(g, i, y1, x1, az, s)."""
    minor = 6356752.314245
    f = (6378137.0 - minor) / 6378137.0
    return f"""
{name}_u AS (
  SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM (
    SELECT *, c2 * {(6378137.0**2 - minor**2) / minor**2!r} AS uu FROM (
      SELECT *, cos(u1) * sin(az) AS sa, 1 - (cos(u1) * sin(az)) ** 2 AS c2, atan2(tan(u1), cos(az)) AS s1 FROM (
        SELECT g, i, y1, x1, az, s, atan({1 - f!r} * tan(radians(y1))) AS u1 FROM {source} WHERE az IS NOT NULL) AS a) AS b) AS c
), {name}_it AS (
  SELECT *, s / ({minor!r} * aa) AS sig, 2e0 * pi() AS prev, 0 AS n FROM {name}_u
  UNION ALL
  SELECT g, i, y1, x1, az, s, u1, sa, c2, s1, uu, aa, bb,
         s / ({minor!r} * aa) + bb * sin(sig) * (cos(2 * s1 + sig) + bb / 4 * (cos(sig) * (-1 + 2 * cos(2 * s1 + sig) ** 2) - bb / 6 * cos(2 * s1 + sig) * (-3 + 4 * sin(sig) ** 2) * (-3 + 4 * cos(2 * s1 + sig) ** 2))), sig, n + 1
  FROM {name}_it WHERE abs(sig - prev) > 1e-12 AND n < 19
), {name} AS (
  SELECT g, i, degrees(atan2(sin(u1) * cos(q) + cos(u1) * sin(q) * cos(az), {1 - f!r} * sqrt(sa ** 2 + (sin(u1) * sin(q) - cos(u1) * cos(q) * cos(az)) ** 2))) AS lat,
         x1 + degrees(atan2(sin(q) * sin(az), cos(u1) * cos(q) - sin(u1) * sin(q) * cos(az)) - (1 - c) * {f!r} * sa * (sig + c * sin(q) * (cos(2 * s1 + q) + c * cos(q) * (-1 + 2 * cos(2 * s1 + q) ** 2)))) AS lon
  FROM (SELECT *, prev AS q, {f!r} / 16 * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c, row_number() OVER (PARTITION BY g, i ORDER BY n DESC) AS newest FROM {name}_it) AS z WHERE newest = 1
)"""


#: The fixture as files have it: 8, 8 and 3 decimals.
PRINTED = f"pts AS (SELECT section, seq - 1 AS i, cast(printf('%.8f', lat) AS double) AS lat, cast(printf('%.8f', lon) AS double) AS lon, cast(printf('%.3f', alt) AS double) AS alt FROM ({TRACKS}) AS t)"

#: Anchors with their Bezier handles (tension 0.5).
HANDLES = """hand AS (
  SELECT section, i, lat, lon, alt, n,
         CASE WHEN i = 0 THEN NULL WHEN i = n - 1 THEN lat + (plat - lat) / 6 ELSE lat - (nlat - plat) / 6 END AS in_lat,
         CASE WHEN i = 0 THEN NULL WHEN i = n - 1 THEN lon + (plon - lon) / 6 ELSE lon - (nlon - plon) / 6 END AS in_lon,
         CASE WHEN i = n - 1 THEN NULL WHEN i = 0 THEN lat + (nlat - lat) / 6 ELSE lat + (nlat - plat) / 6 END AS out_lat,
         CASE WHEN i = n - 1 THEN NULL WHEN i = 0 THEN lon + (nlon - lon) / 6 ELSE lon + (nlon - plon) / 6 END AS out_lon
  FROM (SELECT *, count(*) OVER (PARTITION BY section) AS n, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pts WINDOW w AS (PARTITION BY section ORDER BY i)) AS a
)"""

#: The curve through the anchors, by repeated linear steps.
FLAT = HANDLES + """, seg AS (
  SELECT *, lead(lat) OVER w AS lat3, lead(lon) OVER w AS lon3, lead(in_lat) OVER w AS lat2, lead(in_lon) OVER w AS lon2 FROM hand WINDOW w AS (PARTITION BY section ORDER BY i)
), lin AS (
  SELECT section, i, j, j / 61e0 AS t, lat, lon, out_lat, out_lon, lat2, lon2, lat3, lon3, alt FROM seg, unnest(range(0, CASE WHEN lat3 IS NULL THEN 1 ELSE 61 END)) AS r(j)
), one AS (
  SELECT section, i, j, t, alt, lat, lon, lat + (out_lat - lat) * t AS a1, out_lat + (lat2 - out_lat) * t AS b1, lat2 + (lat3 - lat2) * t AS c1,
         lon + (out_lon - lon) * t AS a2, out_lon + (lon2 - out_lon) * t AS b2, lon2 + (lon3 - lon2) * t AS c2 FROM lin
), two AS (
  SELECT *, a1 + (b1 - a1) * t AS d1, b1 + (c1 - b1) * t AS e1, a2 + (b2 - a2) * t AS d2, b2 + (c2 - b2) * t AS e2 FROM one
), flat AS (
  SELECT section, i * 61 + j AS i, CASE WHEN j = 0 THEN lat ELSE d1 + (e1 - d1) * t END AS lat, CASE WHEN j = 0 THEN lon ELSE d2 + (e2 - d2) * t END AS lon, CASE WHEN j = 0 THEN alt ELSE 0 END AS alt FROM two
)"""


def legs_of(points: str, name: str) -> str:
    return f"{name} AS (SELECT section AS g, i, lat AS y1, lon AS x1, lead(lat) OVER w AS y2, lead(lon) OVER w AS x2 FROM {points} WINDOW w AS (PARTITION BY section ORDER BY i))"


#: Outputs every 25 m along the curve, and the last point; alt by the rule of the segment's start.
RESAMPLED = f"""{FLAT}, {legs_of("flat", "fleg")}, {inverse("fi", "fleg")}, cum AS (
  SELECT f.section, f.i, f.lat, f.lon, f.alt, fi.d, fi.az1, coalesce(sum(fi.d) OVER (PARTITION BY f.section ORDER BY f.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0
  FROM flat AS f LEFT JOIN fi ON fi.g = f.section AND fi.i = f.i
), bounds AS (
  SELECT *, CASE WHEN i = 0 THEN -1 ELSE lag(hi) OVER (PARTITION BY section ORDER BY i) END AS lo FROM (SELECT *, cast(floor((c0 + coalesce(d, 0)) / 25) AS bigint) AS hi FROM cum) AS a
), hits AS (
  SELECT section || ':' || k AS g, 0 AS i, section, k, lat AS y1, lon AS x1, az1 AS az, k * 25e0 - c0 AS s, alt FROM bounds, unnest(range(lo + 1, hi + 1)) AS r(k) WHERE d IS NOT NULL
), {direct("moved", "hits")}, placed AS (
  SELECT h.section, h.k, CASE WHEN h.k = 0 THEN h.y1 ELSE m.lat END AS lat, CASE WHEN h.k = 0 THEN h.x1 ELSE m.lon END AS lon, h.alt FROM hits AS h JOIN moved AS m ON m.g = h.g
), ends AS (
  SELECT b.section AS g, 0 AS i, p.lat AS y1, p.lon AS x1, b.lat AS y2, b.lon AS x2, b.alt, p.k FROM bounds AS b JOIN (SELECT section, max(k) AS k, arg_max(lat, k) AS lat, arg_max(lon, k) AS lon FROM placed GROUP BY section) AS p ON p.section = b.section WHERE b.d IS NULL
), {inverse("ei", "ends")}, res AS (
  SELECT section, k AS i, lat, lon, alt FROM placed
  UNION ALL SELECT ends.g, ends.k + 1, y2, x2, alt FROM ends JOIN ei ON ei.g = ends.g WHERE ei.d > 0.001
)"""

#: Sums that identify a set of points to the digits both engines share.
SUMS = "cast(count(*) AS bigint) AS n_points, round(sum(lat) / count(*), 7) AS mean_lat, round(sum(lon) / count(*), 7) AS mean_lon"

DENSE = f"""{legs_of("pts", "leg")}, {inverse("li", "leg")}, many AS (
  SELECT p.section, p.i, p.lat, p.lon, p.alt, l.d, l.az1, CASE WHEN l.d > 800 THEN cast(ceil((l.d - 800) / 600) AS integer) ELSE 0 END AS n FROM pts AS p LEFT JOIN li AS l ON l.g = p.section AND l.i = p.i
), added AS (
  SELECT section || ':' || i AS g, k AS i, section, i AS at, lat AS y1, lon AS x1, az1 AS az, k * 600e0 AS s, alt FROM many, unnest(range(1, n + 1)) AS r(k)
), {direct("dm", "added")}, dense AS (
  SELECT section, i * 1000 AS o, lat, lon, alt FROM many UNION ALL SELECT a.section, a.at * 1000 + a.i, dm.lat, dm.lon, a.alt FROM added AS a JOIN dm ON dm.g = a.g AND dm.i = a.i
)"""


#: The whole chain, from added points to radius and chainage: lines(section, i, lat, lon, alt, radius, chainage).
CHAIN = f"""{DENSE}, dpts AS (
  SELECT section, row_number() OVER (PARTITION BY section ORDER BY o) - 1 AS i, lat, lon, alt FROM dense
), {RESAMPLED.replace("FROM pts WINDOW", "FROM dpts WINDOW")}, {legs_of("res", "rleg")}, {inverse("ri", "rleg")}, TURN_, lines AS (
  SELECT res.*, CASE WHEN dt > 1e-4 AND chord / 2 / sin(dt / 2) <= 5000 THEN chord / 2 / sin(dt / 2) ELSE 0 END AS radius,
         coalesce(sum(ri.d) OVER (PARTITION BY res.section ORDER BY res.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chainage
  FROM res LEFT JOIN turn ON turn.g = res.section AND turn.i = res.i LEFT JOIN ri ON ri.g = res.section AND ri.i = res.i
)"""

#: Lines of centerline tables, one for each section, and what stands first and last there.
TABLES = """tables AS (
  SELECT section, cast(count(*) AS bigint) AS n_lines, arg_min(line, i) AS first_line, arg_max(printf('%.3f', chainage / 1000), i) AS last_km
  FROM (SELECT *, section || ',' || printf('%.8f,%.8f,%.3f,%.3f,%.1f', lat, lon, alt, chainage / 1000, radius) AS line FROM lines) AS l GROUP BY section
)"""

#: Style elements of the documents, from the colours in their order.
STYLES = "(SELECT string_agg(printf('  <Style id=\"style_%d\">\n    <LineStyle>\n      <color>%s</color>\n      <width>3</width>\n    </LineStyle>\n    <PolyStyle>\n      <color>%s</color>\n    </PolyStyle>\n  </Style>\n', k, c, c), '' ORDER BY k) FROM (SELECT k, ([COLORS_])[k + 1] AS c FROM unnest(range(10)) AS r(k)) AS s)".replace(
    "COLORS_", ", ".join(f"'{c}'" for c in ("ff00ff00", "ff0000ff", "ffffff00", "ff00a5ff", "ff00ffff", "ffff00ff", "ff9e9e5f", "ff008cff", "ff800000", "ff800080"))
) + """ || '  <Style id="post_style">\n    <IconStyle>\n      <color>ffffffff</color>\n      <scale>0.4</scale>\n      <Icon>\n        <href>http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png</href>\n      </Icon>\n    </IconStyle>\n    <LabelStyle>\n      <scale>0.7</scale>\n    </LabelStyle>\n  </Style>\n'"""
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n'


def _drawn(km: str, height: str = "'0.000'", mode: str = "clampToGround", indent: str = "      ", seen: tuple[str, str] = ("1", "0")) -> str:
    """CTEs that end in drawn(line, o, whole, low, posts) from pts; ``km``: a point's kilometrage."""
    see = ["" if not v else f"{indent}  <visibility>{v}</visibility>\n" for v in seen]
    mark = lambda extra, v, c: f"'{indent}<Placemark>\n{indent}  <name>' || line || '{extra}</name>\n{v}{indent}  <styleUrl>#style_' || (o % 10) || '</styleUrl>\n{indent}  <LineString>\n{indent}    <extrude>0</extrude>\n{indent}    <tessellate>1</tessellate>\n{indent}    <altitudeMode>{mode}</altitudeMode>\n{indent}    <coordinates>\n' || {c} || '{indent}    </coordinates>\n{indent}  </LineString>\n{indent}</Placemark>\n'"
    return f"""shown AS (
  SELECT section AS line, i, count(*) OVER (PARTITION BY section) AS n, printf('%.8f,%.8f,', lon, lat) || {height} AS c, {km} AS km FROM pts
), grouped AS (
  SELECT line, row_number() OVER (ORDER BY line) AS o, any_value(n) AS n, string_agg('{indent}      ' || c || '\n', '' ORDER BY i) AS full_c,
         string_agg(CASE WHEN i % 10 = 0 OR i = n - 1 THEN '{indent}      ' || c || '\n' ELSE '' END, '' ORDER BY i) AS low_c,
         string_agg(CASE WHEN km IS NULL THEN '' ELSE '      <Placemark>\n        <name>km ' || printf('%.3f', km) || '</name>\n        <visibility>0</visibility>\n        <styleUrl>#post_style</styleUrl>\n        <Point>\n          <altitudeMode>{mode}</altitudeMode>\n          <coordinates>' || c || '</coordinates>\n        </Point>\n      </Placemark>\n' END, '' ORDER BY i) AS posts
  FROM shown GROUP BY line
), drawn AS (
  SELECT line, cast(o AS integer) AS o, {mark("", see[0], "full_c")} AS whole, CASE WHEN n > 20 THEN {mark(" - Low Detail", see[1], "low_c")} END AS low, posts FROM grouped
)"""


#: A document with folders of lines and posts.
DOCUMENT = f"""'{HEAD}  <name>Centerlines</name>\n  <description>Generated from CSV files</description>\n' || {STYLES} || '  <Folder>\n    <name>Lines</name>\n' ||
  string_agg('    <Folder>\n      <name>' || line || '</name>\n' || whole || coalesce(low, '') || '    </Folder>\n', '' ORDER BY o) || '  </Folder>\n  <Folder>\n    <name>Posts</name>\n    <visibility>0</visibility>\n' ||
  string_agg('    <Folder>\n      <name>' || line || '</name>\n' || posts || '    </Folder>\n', '' ORDER BY o) || '  </Folder>\n</Document>\n</kml>'"""


def hermite(tension: float) -> str:
    s = (1 - tension) / 2
    value = lambda c: f"(2*t*t*t - 3*t*t + 1) * {c} + (-2*t*t*t + 3*t*t) * {c}2 + (t*t*t - 2*t*t + t) * {s!r} * ({c}2 - {c}0) + (t*t*t - t*t) * {s!r} * ({c}3 - {c})"
    around = ", ".join(f"coalesce(lag({c}) OVER w, {c}) AS {c}0, lead({c}) OVER w AS {c}2, coalesce(lead({c}, 2) OVER w, lead({c}) OVER w) AS {c}3" for c in ("lat", "lon", "alt"))
    return f"""WITH {POINTS}, h AS (SELECT *, {around} FROM pts WINDOW w AS (PARTITION BY section ORDER BY i)),
c AS (SELECT section, CASE WHEN lat2 IS NULL THEN lat ELSE {value("lat")} END AS lat, CASE WHEN lat2 IS NULL THEN lon ELSE {value("lon")} END AS lon, CASE WHEN lat2 IS NULL THEN alt ELSE {value("alt")} END AS alt
  FROM (SELECT *, j / 60e0 AS t FROM h, unnest(range(0, CASE WHEN lat2 IS NULL THEN 1 ELSE 60 END)) AS r(j)) AS a)
SELECT section, {SUMS}, round(sum(alt) / count(*), 4) AS mean_alt FROM c GROUP BY section"""


def oracle_sql() -> dict[str, str]:
    legs = f"WITH RECURSIVE {LEGS}, {inverse('r', 'leg')}"
    ahead = f"WITH RECURSIVE {POINTS}, go AS (SELECT section AS g, i, lat AS y1, lon AS x1, cast(i % 12 AS double) / 2 - 3 AS az, 100e0 + 50e0 * i AS s FROM pts), {direct('r', 'go')}"
    three = lambda shift: f"t3 AS (SELECT section AS g, i, lag(lat, {shift}) OVER w AS ya, lag(lon, {shift}) OVER w AS xa, lat AS yb, lon AS xb, lead(lat, {shift}) OVER w AS yc, lead(lon, {shift}) OVER w AS xc FROM POINTS_ WINDOW w AS (PARTITION BY section ORDER BY i)), sa AS (SELECT g, i, ya AS y1, xa AS x1, yb AS y2, xb AS x2 FROM t3 WHERE ya IS NOT NULL AND yc IS NOT NULL), sb AS (SELECT g, i, yb AS y1, xb AS x1, yc AS y2, xc AS x2 FROM t3 WHERE ya IS NOT NULL AND yc IS NOT NULL), sc AS (SELECT g, i, ya AS y1, xa AS x1, yc AS y2, xc AS x2 FROM t3 WHERE ya IS NOT NULL AND yc IS NOT NULL), {inverse('ia', 'sa')}, {inverse('ib', 'sb')}, {inverse('ic', 'sc')}, turn AS (SELECT g, i, CASE WHEN abs(ia.az1 - ib.az1) > pi() THEN 2 * pi() - abs(ia.az1 - ib.az1) ELSE abs(ia.az1 - ib.az1) END AS dt, ic.d AS chord FROM ia JOIN ib USING (g, i) JOIN ic USING (g, i))"
    smooth = "avg({0}) OVER (PARTITION BY section ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    chain = CHAIN.replace("TURN_", three(2).replace("POINTS_", "res"))
    tenth = "CASE WHEN i % 10 = 0 THEN i / 8e0 END"
    placemarks = "SELECT section || '.kml' AS file, section, cast(count(*) AS bigint) AS n_points, round(avg(lat), 7) AS mean_lat FROM pts GROUP BY section UNION ALL SELECT DISTINCT section || '.kml', 'Section_1', cast(2 AS bigint), -33e0 FROM pts"
    return {
        "kml_scan": f"WITH {PRINTED} {placemarks}",
        "placemark_files": f"WITH {PRINTED} {placemarks}",
        "csv_generic": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, alt AS altitude FROM pts",
        "csv_plain": f"WITH {POINTS} SELECT section, cast(i AS varchar) AS idx, ' ' || printf('%.3f', alt) AS altitude FROM pts",
        "csv_lines": f"WITH RECURSIVE {POINTS}, {chain} SELECT section || '.kml' AS file, cast(count(*) AS bigint) AS n_lines, round(sum(lat) / count(*), 6) AS mean_lat, round(sum(lon) / count(*), 6) AS mean_lon, round(max(chainage) / 1000, 3) AS length_km FROM lines GROUP BY section",
        "csv_files": f"WITH RECURSIVE {POINTS}, {chain}, {TABLES} SELECT section || '.csv' AS file_name, n_lines, first_line, last_km FROM tables",
        "centerline_archive": f"WITH RECURSIVE {PRINTED}, {chain}, {TABLES} SELECT section || '.csv' AS file_name, n_lines, first_line, last_km FROM tables",
        "centerlines": f"WITH RECURSIVE {POINTS}, {chain} SELECT section, cast(count(*) AS bigint) AS n_points, round(max(chainage), 2) AS length_m, cast(sum(CASE WHEN radius > 0 THEN 1 ELSE 0 END) AS bigint) AS n_curved FROM lines GROUP BY section",
        "kml_lines": f"WITH {POINTS}, {_drawn(tenth)} SELECT line, o AS style_ord, whole AS content FROM drawn",
        "kml_lowdetail": f"WITH {POINTS}, {_drawn(tenth)} SELECT line, o AS style_ord, low AS content FROM drawn WHERE low IS NOT NULL",
        "kml_posts": f"WITH {POINTS}, {_drawn(tenth)} SELECT line, o AS style_ord, posts AS content FROM drawn",
        "kml_document": f"WITH {POINTS}, {_drawn(tenth)} SELECT {DOCUMENT} AS content FROM drawn",
        "lines_archive": f"WITH {PRINTED}, {_drawn('i / 8e0')} SELECT 'doc.kml' AS file_name, md5(content) AS content_md5, cast(length(content) AS bigint) AS n_chars FROM (SELECT {DOCUMENT} AS content FROM drawn) AS d",
        "kml_simple": f"WITH {POINTS}, {_drawn(tenth, 'printf(\'%.3f\', alt + 3)', 'absolute', '  ', ('', ''))} SELECT '{HEAD}  <name>Centerlines</name>\n  <description>Generated from CSV files</description>\n' || {STYLES} || string_agg(whole, '' ORDER BY o) || '</Document>\n</kml>' AS content FROM drawn",
        "kml_index": f"SELECT '{HEAD}  <name>Centerlines Index</name>\n  <description>Index file linking all centerline KMZ files</description>\n  <NetworkLink>\n    <name>Lines</name>\n    <visibility>1</visibility>\n    <Link>\n      <href>lines.kmz</href>\n    </Link>\n  </NetworkLink>\n</Document>\n</kml>' AS content",
        "leg_metrics": f"{legs} SELECT g AS section, cast(count(*) AS bigint) AS n_legs, round(sum(d), 2) AS length_m, round(max(d), 2) AS longest_m FROM r GROUP BY g",
        "geodesic_inverse": f"{legs} SELECT g AS section, cast(i AS bigint) AS idx, round(d, 2) AS distance_m, round(az1, 7) AS azimuth, round(az2, 7) AS final_azimuth FROM r",
        "geodesic_distance": f"WITH RECURSIVE {POINTS}, far AS (SELECT section AS g, i, -33e0 AS y1, 151e0 AS x1, lat AS y2, lon AS x2 FROM pts), {inverse('r', 'far', 6356752.314140)} SELECT g AS section, cast(i AS bigint) AS idx, round(d, 2) AS distance_m FROM r",
        "geodesic_bearing": f"WITH RECURSIVE {POINTS}, far AS (SELECT section AS g, i, 40e0 AS y1, -75e0 AS x1, lat AS y2, lon AS x2 FROM pts), {inverse('r', 'far')} SELECT g AS section, cast(i AS bigint) AS idx, round(az1, 7) AS azimuth FROM r",
        "geodesic_direct": f"{ahead} SELECT g AS section, cast(i AS bigint) AS idx, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM r",
        "geodesic_project": f"{ahead} SELECT r.g AS section, cast(r.i AS bigint) AS idx, round(r.lat, 7) AS latitude, round(r.lon, 7) AS longitude, p.alt AS altitude FROM r JOIN pts AS p ON p.section = r.g AND p.i = r.i",
        "ellipsoid_consts": "SELECT * FROM (VALUES ('WGS84', 6378137.0e0, 6356752.314245e0, round(1e0 / ((6378137.0e0 - 6356752.314245e0) / 6378137.0e0), 6)), ('GRS80', 6378137.0e0, 6356752.314140e0, round(1e0 / ((6378137.0e0 - 6356752.314140e0) / 6378137.0e0), 6))) AS t(name, semi_major, semi_minor, inverse_flattening)",
        "chainage": f"{legs} SELECT section, cast(p.i AS bigint) AS idx, round(coalesce(sum(r.d) OVER (PARTITION BY section ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS chainage_m FROM pts AS p LEFT JOIN r ON r.g = p.section AND r.i = p.i",
        "having_min_points": f"SELECT section, cast(count(*) AS bigint) AS n_points FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT t.*, cast(substr(section, 2) AS bigint) AS user_id FROM ({TRACKS}) AS t) AS a WHERE seq <= 1 + user_id % 6) AS b WHERE n > 3 GROUP BY section",
        "section_key": "SELECT section_key, cast(count(*) AS bigint) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'default' ELSE event_type END AS section_key FROM events) AS t GROUP BY section_key",
        "section_order": "SELECT name, cast(row_number() OVER (ORDER BY CASE WHEN regexp_full_match(name, '0|[1-9][0-9]*') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(name, '0|[1-9][0-9]*') THEN cast(name AS bigint) END, first) AS integer) AS section_ord FROM (SELECT name, min(event_id) AS first FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN cast(user_id % 40 AS varchar) ELSE event_type END AS name FROM events) AS a GROUP BY name) AS b",
        "densify": f"WITH RECURSIVE {POINTS}, {DENSE} SELECT section, {SUMS}, round(sum(alt), 2) AS sum_alt FROM dense GROUP BY section",
        "spline_control_points": f"WITH {POINTS}, {HANDLES}, c AS (SELECT section, 3 * i AS idx, lat, lon FROM hand UNION ALL SELECT section, 3 * i - 1, in_lat, in_lon FROM hand WHERE in_lat IS NOT NULL UNION ALL SELECT section, 3 * i + 1, out_lat, out_lon FROM hand WHERE out_lat IS NOT NULL) SELECT section, cast(idx AS bigint) AS idx, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM c",
        "lerp2d": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, round(lat + (la - lat) * 0.25e0, 7) AS latitude, round(lon + (lo - lon) * 0.25e0, 7) AS longitude, 0e0 AS altitude FROM (SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM pts WINDOW w AS (PARTITION BY section ORDER BY i)) AS a WHERE la IS NOT NULL",
        "lerp3d": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, round(lat + (la - lat) * 0.25e0, 7) AS latitude, round(lon + (lo - lon) * 0.25e0, 7) AS longitude, round(alt + (al - alt) * 0.25e0, 4) AS altitude FROM (SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo, lead(alt) OVER w AS al FROM pts WINDOW w AS (PARTITION BY section ORDER BY i)) AS a WHERE la IS NOT NULL",
        "bezier_point": f"WITH {POINTS}, {FLAT} SELECT section, cast(i AS bigint) AS idx, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM flat WHERE i % 61 = 30",
        "bezier_flatten": f"WITH {POINTS}, {FLAT} SELECT section, {SUMS}, round(sum(alt), 2) AS sum_alt FROM flat GROUP BY section",
        "cardinal_spline": hermite(0.5),
        "catmull_rom": hermite(0.0),
        "resample": f"WITH RECURSIVE {POINTS}, {RESAMPLED} SELECT section, {SUMS}, round(sum(alt), 2) AS sum_alt FROM res GROUP BY section",
        "decimate": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM (SELECT *, count(*) OVER (PARTITION BY section) AS n FROM pts) AS a WHERE n > 20 AND (i % 10 = 0 OR i = n - 1)",
        "curvature3": f"WITH RECURSIVE {POINTS}, {three(1).replace('POINTS_', 'pts')} SELECT g AS section, cast(i AS bigint) AS idx, CASE WHEN dt < 0.001 THEN -1e0 ELSE round(chord / 2 / sin(dt / 2), 2) END AS radius_m FROM turn",
        "curve_radius": f"WITH RECURSIVE {POINTS}, {RESAMPLED}, {three(2).replace('POINTS_', 'res')} SELECT section, cast(count(*) AS bigint) AS n_points, cast(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS bigint) AS n_curved, round(sum(r) / count(*), 2) AS mean_radius FROM (SELECT res.section, CASE WHEN dt > 1e-4 AND chord / 2 / sin(dt / 2) <= 5000 THEN chord / 2 / sin(dt / 2) ELSE 0 END AS r FROM res LEFT JOIN turn ON turn.g = res.section AND turn.i = res.i) AS z GROUP BY section",
        "smooth": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, round({smooth.format('lat')}, 7) AS latitude, round({smooth.format('lon')}, 7) AS longitude, round({smooth.format('alt')}, 4) AS altitude FROM pts",
        "altitude_transform": "SELECT event_id, round((value + 3) * 1.5e0, 4) AS absolute_alt, 0e0 AS ground_alt FROM events",
        "style_index": f"WITH {POINTS} SELECT section, 'style_' || cast(row_number() OVER (ORDER BY section) % 10 AS varchar) AS style FROM (SELECT DISTINCT section FROM pts) AS a",
        "palette": "SELECT cast(k - 1 AS integer) AS k, (['ff00ff00', 'ff0000ff', 'ffffff00', 'ff00a5ff', 'ff00ffff', 'ffff00ff', 'ff9e9e5f', 'ff008cff', 'ff800000', 'ff800080'])[k] AS line_color, (['#00FF00', '#FF0000', '#00FFFF', '#FFA500', '#FFFF00', '#FF00FF', '#5F9EA0', '#FF8C00', '#000080', '#800080'])[k] AS display_color FROM unnest(range(1, 11)) AS r(k)",
        "escape_xml": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')) AS escaped_md5 FROM pages",
        "csv_scan": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, round(lat, 7) AS latitude, round(lon, 7) AS longitude, round(alt, 3) AS altitude, cast(i AS double) / 8 AS kilometrage FROM pts",
        "filter_csv": "SELECT cast(count(*) AS bigint) AS n_points FROM events WHERE event_id % 5 NOT IN (0, 1, 2)",
        "filter_coords": "SELECT cast(count(*) AS bigint) AS n_points, round(sum(value), 2) AS sum_alt FROM events WHERE event_id % 4 IN (2, 3)",
        "to_fixed": "SELECT event_id, cast(event_id AS varchar) || '.0' AS one, cast(event_id AS varchar) || '.500' AS three, CASE WHEN event_id = 0 THEN '0' ELSE '-' || cast(event_id AS varchar) END AS whole FROM events",
        "point_to_string": f"WITH {POINTS} SELECT section, cast(i AS bigint) AS idx, 'GeoPoint(' || printf('%.6f', lat) || ', ' || printf('%.6f', lon) || ', 0.25m)' AS shown FROM pts",
        "base_name": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id || '.csv' ELSE 'a' || event_id || '.kml.csv' END AS table_name, 'a' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.csv' END AS line_name FROM events",
    }
