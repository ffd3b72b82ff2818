"""Queries on polygons: points within them, cells clipped by them, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import polygons as P
from ..operators import spatial as S
from .registry import Source, query, view

# a star with four points around each site, every second one with a square hole
view("zones", """
SELECT CAST(site AS BIGINT) AS polygon, ring, seq, x + dx * (1 + site % 3) AS x, y + dy * (1 + site % 3) AS y FROM {sites} s
CROSS JOIN (VALUES (0, 0, 400, 0), (0, 1, 120, 120), (0, 2, 0, 400), (0, 3, -120, 120), (0, 4, -400, 0), (0, 5, -120, -120), (0, 6, 0, -400), (0, 7, 120, -120), (1, 0, 45, 45), (1, 1, 45, -45), (1, 2, -45, -45), (1, 3, -45, 45)) AS v(ring, seq, dx, dy)
WHERE ring = 0 OR site % 2 = 0""")
# a city whose outline has bays, with a lake
view("city", """
SELECT CAST(1 AS BIGINT) AS polygon, ring, seq, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y
FROM (VALUES (0, 0, 150, 220), (0, 1, 9700, 480), (0, 2, 9100, 4300), (0, 3, 6250, 4800), (0, 4, 9650, 9400), (0, 5, 5100, 6150), (0, 6, 1300, 9800), (0, 7, 2450, 3900), (1, 0, 3300, 2100), (1, 1, 4650, 2300), (1, 2, 4100, 3450)) AS v(ring, seq, px, py)""")
view("zone_edges", "SELECT polygon, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {zones} z WINDOW w AS (PARTITION BY polygon, ring ORDER BY seq)")
view("city_edges", "SELECT polygon, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {city} z WINDOW w AS (PARTITION BY polygon, ring ORDER BY seq)")

# parity of all edges to the right of a point, for every point and polygon; places on an edge are out
_SIDE = "((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))"
_PARITY = f"SELECT place, polygon, population FROM {{places}} p CROSS JOIN {{zone_edges}} e GROUP BY place, polygon, population HAVING count(*) FILTER ((y1 <= y AND y < y2 AND {_SIDE} > 0) OR (y2 <= y AND y < y1 AND {_SIDE} < 0)) % 2 = 1 AND NOT bool_or({_SIDE} = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"


@query("j10_points_in_polygons", f"SELECT p.place, h.polygon FROM {{places}} p LEFT JOIN ({_PARITY}) h USING (place)")
def _(s: Source) -> DataFrame:
    return P.points_in_polygons(s.view("places"), s.view("zones"), 200.0).select("place", "polygon")


@query("l10_zone_sums", f"SELECT polygon, CAST(sum(population) AS BIGINT) AS population, count(*) AS places FROM ({_PARITY}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return P.points_in_polygons(s.view("places"), s.view("zones"), 200.0).filter("polygon IS NOT NULL").groupBy("polygon").agg(F.sum("population").alias("population"), F.count("*").alias("places"))


def _areas(edges: str, size: int) -> str:
    """Area of polygon and cell by Green's formula: along each edge the integral of its height, held between the bottom and top of the cell, over the columns of the cell."""
    cells = f"SELECT DISTINCT polygon, cx, cy FROM (SELECT polygon, CAST(floor(min(x1) / {size}) AS BIGINT) AS c0, CAST(floor(max(x1) / {size}) AS BIGINT) AS c1, CAST(floor(min(y1) / {size}) AS BIGINT) AS r0, CAST(floor(max(y1) / {size}) AS BIGINT) AS r1 FROM {edges} e GROUP BY 1), unnest(range(c0, c1 + 1)) a(cx), unnest(range(r0, r1 + 1)) b(cy)"
    part = f"SELECT e.polygon, ring, cx, cy, cy * {size}.0 AS lo, cy * {size}.0 + {size} AS hi, sign(x2 - x1) AS way, greatest(least(x1, x2), cx * {size}.0) AS a, least(greatest(x1, x2), cx * {size}.0 + {size}) AS b, x1, y1, x2, y2 FROM {edges} e JOIN ({cells}) c ON c.polygon = e.polygon AND least(x1, x2) < cx * {size}.0 + {size} AND greatest(x1, x2) > cx * {size}.0"
    ends = f"SELECT *, y1 + (a - x1) / (x2 - x1) * (y2 - y1) AS ya, y1 + (b - x1) / (x2 - x1) * (y2 - y1) AS yb FROM ({part}) WHERE b > a"
    held = "CASE WHEN {y} < lo THEN lo * ({y} - lo) WHEN {y} <= hi THEN ({y} * {y} - lo * lo) / 2 ELSE (hi * hi - lo * lo) / 2 + hi * ({y} - hi) END"
    level = f"CASE WHEN abs(yb - ya) < 1e-9 THEN least(hi, greatest(lo, ya)) ELSE (({held.format(y='yb')}) - ({held.format(y='ya')})) / (yb - ya) END"
    return f"SELECT polygon, cx, cy, sum(CASE WHEN ring = 0 THEN one ELSE -one END) AS area FROM (SELECT polygon, ring, cx, cy, abs(sum(way * (b - a) * ({level}))) AS one FROM ({ends}) GROUP BY ALL) GROUP BY 1, 2, 3"


@query("x27_boundary_coverage", f"SELECT polygon, cx, cy, round(area, 3) AS area, round(area / 250000, 6) AS coverage FROM ({_areas('{city_edges}', 500)}) WHERE area / 250000 >= 0.25")
def _(s: Source) -> DataFrame:
    covered = P.cell_coverage(s.view("city"), 500.0, 0.25)
    return covered.withColumns({"area": F.round("area", 3), "coverage": F.round("coverage", 6)})


@query("x27_zone_areas", f"SELECT polygon, cx, cy, round(area, 3) AS area FROM ({_areas('{zone_edges}', 300)}) WHERE area > 0.0005")
def _(s: Source) -> DataFrame:
    return P.cell_areas(s.view("zones"), 300.0).filter("area > 0.0005").withColumn("area", F.round("area", 3))


# streets as recorded, some of them both ways round; each counts once
view("street_pieces", "SELECT x AS x1, y AS y1, least(x + population, 9999.0) AS x2, least(y + population / 2.0, 9999.0) AS y2 FROM {places} p UNION ALL SELECT least(x + population, 9999.0), least(y + population / 2.0, 9999.0), x, y FROM {places} p WHERE place % 3 = 0")
_ONCE = "SELECT DISTINCT x1, y1, x2, y2 FROM {street_pieces} s WHERE x1 < x2 OR (x1 = x2 AND y1 < y2)"
_TOUCHED = f"SELECT *, CAST(unnest(generate_series(CAST(floor(y1 / 1000) AS BIGINT), CAST(floor(y2 / 1000) AS BIGINT))) AS BIGINT) AS cy FROM (SELECT *, CAST(unnest(generate_series(CAST(floor(x1 / 1000) AS BIGINT), CAST(floor(x2 / 1000) AS BIGINT))) AS BIGINT) AS cx FROM ({_ONCE}))"
_SHARE = "greatest(0, least(1.0, CASE WHEN x2 > x1 THEN ((cx + 1) * 1000 - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN ((cy + 1) * 1000 - y1) / (y2 - y1) ELSE 1 END) - greatest(0.0, CASE WHEN x2 > x1 THEN (cx * 1000 - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (cy * 1000 - y1) / (y2 - y1) ELSE 0 END))"


@query("l09_street_density", f"SELECT cx, cy, round(coalesce(length, 0), 4) AS length, round(area, 2) AS area, round(coalesce(length, 0) / area, 8) AS density FROM ({_areas('{city_edges}', 1000)}) a LEFT JOIN (SELECT cx, cy, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) * {_SHARE}) AS length FROM ({_TOUCHED}) GROUP BY 1, 2) l USING (cx, cy) WHERE area > 0.01")
def _(s: Source) -> DataFrame:
    lengths = S.clipped_lengths(S.undirected(s.view("street_pieces")), 1000.0)
    found = P.densities(lengths, P.cell_areas(s.view("city"), 1000.0).filter("area > 0.01"))
    return found.withColumns({"length": F.round("length", 4), "area": F.round("area", 2), "density": F.round("density", 8)})
