"""Polygons as tables of vertices (polygon, ring, seq, x, y): points within them, and their areas clipped by grid cells.

Ring 0 is the outline, other rings are holes in it; rings close by themselves. Vertices with a null or non-finite place are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialise

#: Cells on whose border an edge lies count as touched, rounding included.
SLACK = 1e-9


def finite(*columns: str) -> Column:
    return reduce(Column.__and__, (F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in columns))


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Rows (polygon, ring, x1, y1, x2, y2)."""
    in_ring = Window.partitionBy("polygon", "ring").orderBy("seq")
    whole = in_ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ends = {c: F.coalesce(F.lead(v).over(in_ring), F.first(v).over(whole)) for c, v in (("x2", x), ("y2", y))}
    return vertices.filter(finite("x", "y")).select("polygon", "ring", x.alias("x1"), y.alias("y1"), ends["x2"].alias("x2"), ends["y2"].alias("y2"))


def row_edges(edges: DataFrame, size: float) -> DataFrame:
    """Each edge under every grid row (cy) that it meets, with the cells cx_from..cx_to of its part in the row."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor(low / size - SLACK), F.floor(high / size + SLACK))))

    def across(y: Column) -> Column:
        share = (F.least(high, F.greatest(low, y)) - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        return F.col("x1") + share * (F.col("x2") - F.col("x1"))

    a, b = (F.coalesce(across((F.col("cy") + k) * F.lit(size)), F.col(x)) for k, x in ((0, "x1"), (1, "x2")))
    return rows.withColumns({"cx_from": F.floor(F.least(a, b) / size - SLACK), "cx_to": F.floor(F.greatest(a, b) / size + SLACK)})


def touched_cells(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, "cy", F.explode(F.sequence("cx_from", "cx_to")).alias("cx")).distinct()


def inner_cells(rows: DataFrame, touched: DataFrame, size: float, *by: str) -> DataFrame:
    """Cells that lie inside whole: along the middle of a grid row, those between an odd crossing and the next that no edge touches."""
    middle = (F.col("cy") + 0.5) * F.lit(size)
    crossing = F.floor((F.col("x1") + (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))) / size)
    at = rows.filter((F.col("y1") <= middle) != (F.col("y2") <= middle)).groupBy(*by, "cy").agg(F.array_sort(F.collect_list(crossing)).alias("at"))
    between = F.transform(F.sequence(F.lit(1), F.floor(F.size("at") / 2).cast("int")), lambda i: F.struct((F.get("at", 2 * i - 2) + 1).alias("a"), (F.get("at", 2 * i - 1) - 1).alias("b")))
    runs = at.select(*by, "cy", F.explode(F.filter(between, lambda r: r["a"] <= r["b"])).alias("r"))
    return runs.select(*by, "cy", F.explode(F.sequence("r.a", "r.b")).alias("cx")).join(touched, [*by, "cx", "cy"], "left_anti")


def points_in_polygons(points: DataFrame, vertices: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """All columns of points and `polygon`: a row for each polygon that a point lies strictly within, or one with null.

    Polygons are listed by grid cell: a cell inside whole answers by equality, and only in cells that an edge touches a point is held against the
    polygon's edges in its grid row, by the parity of those to its right. A place on an edge is not within; holes are outside. Places are looked up once, however many
    points share them; points without a finite place are in none.
    """
    rows = materialise(row_edges(polygon_edges(vertices), size), "polygon-rows")
    touched = materialise(touched_cells(rows, "polygon"), "polygon-cells")
    at = points.filter(finite(x, y)).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct().withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    sure = at.join(inner_cells(rows, touched, size, "polygon"), ["cx", "cy"]).select("px", "py", "polygon")
    edges = rows.select("polygon", "cy", "x1", "y1", "x2", "y2")
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1"))
    up, down = (F.col("y1") <= F.col("py")) & (F.col("py") < F.col("y2")), (F.col("y2") <= F.col("py")) & (F.col("py") < F.col("y1"))
    on = (side == 0) & F.col("px").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("py").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    counted = at.join(touched, ["cx", "cy"]).join(edges, ["polygon", "cy"]).groupBy("px", "py", "polygon").agg(F.count_if((up & (side > 0)) | (down & (side < 0))).alias("right"), F.max(on).alias("on"))
    hits = sure.unionByName(counted.filter((F.col("right") % 2 == 1) & ~F.col("on")).select("px", "py", "polygon"))
    names = [F.col(f"p.`{c}`") for c in points.columns]
    return points.alias("p").join(hits.alias("h"), (F.col(f"p.`{x}`").cast("double") == F.col("h.px")) & (F.col(f"p.`{y}`").cast("double") == F.col("h.py")), "left").select(*names, F.col("h.polygon").alias("polygon"))


def clipped(ring: DataFrame, column: str, axis: str, bound: Column, above: bool) -> DataFrame:
    """One step of Sutherland and Hodgman: the ring in `column` (an array of (x, y)) cut by the line axis = bound, the part above or below it kept."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] >= bound if above else p[axis] <= bound

    def step(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        share = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        cut = F.struct(*[v.alias(n) for n, v in sorted(((axis, bound.cast("double")), (other, a[other] + share * (b[other] - a[other]))))])
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(b), F.array(cut, b)).when(inside(a), F.array(cut)).otherwise(F.slice(F.array(b), 1, 0))

    return paired(ring, column).withColumn(column, F.flatten(F.transform("_pairs", step))).drop("_pairs")


def paired(ring: DataFrame, column: str) -> DataFrame:
    """Adds `_pairs`, each vertex b of the ring with the one before it, a."""
    n = F.size(column)
    before = F.when(n > 0, F.concat(F.slice(column, F.greatest(n, F.lit(1)), 1), F.slice(column, F.lit(1), F.greatest(n - 1, F.lit(0))))).otherwise(F.col(column))
    return ring.withColumn("_pairs", F.transform(F.arrays_zip(before.alias("a"), F.col(column).alias("b")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"))))


def cell_areas(vertices: DataFrame, size: float) -> DataFrame:
    """Rows (polygon, cx, cy, area) of the grid cells of which polygons, concave ones too, cover some area.

    Where an edge touches a cell, the ring is clipped to its grid row, then to the cell, and measured by the shoelace formula; cells inside whole count whole. Holes are taken off.
    """
    edges = polygon_edges(vertices)
    by = ("polygon", "ring")
    rows = materialise(row_edges(edges, size), "polygon-rows")
    touched = materialise(touched_cells(rows, *by), "polygon-cells")
    rings = vertices.filter(finite("x", "y")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("v"))
    rings = rings.select(*by, F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("v"))
    strips = touched.groupBy(*by, "cy").agg(F.collect_list("cx").alias("cells")).join(rings, [*by])
    for above in (True, False):
        strips = clipped(strips, "v", "y", (F.col("cy") + (0 if above else 1)) * F.lit(size), above)
    cut = strips.select(*by, "cy", F.explode("cells").alias("cx"), "v")
    for above in (True, False):
        cut = clipped(cut, "v", "x", (F.col("cx") + (0 if above else 1)) * F.lit(size), above)
    left, low = F.col("cx") * F.lit(size), F.col("cy") * F.lit(size)
    twice = F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + (p["a"]["x"] - left) * (p["b"]["y"] - low) - (p["b"]["x"] - left) * (p["a"]["y"] - low))
    parts = paired(cut, "v").select(*by, "cx", "cy", (F.abs(twice) / 2).alias("area")).unionByName(inner_cells(rows, touched, size, *by).select(*by, "cx", "cy", F.lit(float(size * size)).alias("area")))
    return parts.groupBy("polygon", "cx", "cy").agg(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area")).filter(F.col("area") > SLACK * size * size)


def cell_coverage(vertices: DataFrame, size: float, least: float = 0.25) -> DataFrame:
    """Rows (polygon, cx, cy, area, coverage): cells of which a polygon covers the share `least` or more."""
    return cell_areas(vertices, size).withColumn("coverage", F.col("area") / (size * size)).filter(F.col("coverage") >= least)


def densities(lengths: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows (cx, cy, length, area, density): lengths (cx, cy, length) for each unit of area (cx, cy, area); every cell with area, those without length 0."""
    return areas.join(lengths, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("length", F.lit(0.0)).alias("length"), "area", (F.coalesce("length", F.lit(0.0)) / F.col("area")).alias("density"))
