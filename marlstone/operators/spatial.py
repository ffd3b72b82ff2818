"""Planar joins by grid cells: points in cells, nearest neighbours, clipped lengths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialise


def cell_of(x: Column, y: Column, size: float) -> Column:
    """The half-open grid cell of a point."""
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def points_in_cells(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)})


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points joined with the half-open boxes (minx, miny, maxx, maxy) they lie in: boxes are listed under the cells they touch, so the join is by equality."""
    spread = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("minx") / size), F.floor(F.col("maxx") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("miny") / size), F.floor(F.col("maxy") / size))))
    inside = (F.col(x) >= F.col("minx")) & (F.col(x) < F.col("maxx")) & (F.col(y) >= F.col("miny")) & (F.col(y) < F.col("maxy"))
    return points_in_cells(points, size, x, y).join(spread, ["cx", "cy"]).filter(inside).drop("cx", "cy")


def counts_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (minx, miny, maxx, maxy, and others) that hold a point, with their number of points (x, y) as n. Equal places are counted first, and equal boxes are one, so what meets are distinct places and boxes."""
    box = ["minx", "miny", "maxx", "maxy"]
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    found = points_in_boxes(places, boxes.select(*box).distinct(), size).groupBy(*box).agg(F.sum("n").alias("n"))
    return boxes.join(found, box)


#: Bits of a place, bits that a level of cells takes of each axis, and the number of points that a cell is no longer split at.
BITS, STEP, FEW = 24, 2, 64


class CellTree:
    """Cells of points (id, x, y, by), each split into 16 until it holds FEW places at most, with the box around the points of each.

    A level is one grouped count of the points in cells that are still split, so no task holds a crowded cell; equal places are one, with the least id.
    """

    def __init__(self, points: DataFrame, by: Sequence[str]) -> None:
        self.by = list(by)
        lowest, highest = points.agg(F.array(F.min("x"), F.min("y")), F.array(F.max("x"), F.max("y"))).first()
        self.empty = lowest is None or lowest[0] is None
        if self.empty:
            return
        unit = (1 << BITS) / (max(highest[0] - lowest[0], highest[1] - lowest[1]) or 1.0)
        place = [F.least(F.floor((F.col(c) - F.lit(at)) * F.lit(unit)), F.lit((1 << BITS) - 1)).alias(f"{c}_bits") for c, at in (("x", lowest[0]), ("y", lowest[1]))]
        open_ = materialise(points.groupBy(*self.by, "x", "y").agg(F.min("id").alias("id")).select("*", *place), "places")
        nodes, leaves = [], []
        for level in range(0, BITS + STEP, STEP):
            cell = F.struct(*[F.shiftright(f"{c}_bits", BITS - level).alias(c) for c in ("x", "y")])
            parent = F.struct(*[F.shiftright(f"{c}_bits", BITS - level + STEP).alias(c) for c in ("x", "y")])
            placed = open_.withColumns({"cell": cell, "parent": parent if level else cell})
            sizes = placed.groupBy(*self.by, "cell", "parent").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")])
            nodes.append(materialise(sizes.withColumn("leaf", (F.col("n") <= FEW) | F.lit(level == BITS)), "cells"))
            marks = nodes[-1].select(*self.by, "cell", "leaf")
            known = materialise(placed.join(marks, [*self.by, "cell"]), "placed")
            leaves.append(known.filter("leaf").select(*self.by, F.lit(level).alias("level"), "cell", F.col("x").alias("rx"), F.col("y").alias("ry"), "id"))
            open_ = known.filter(~F.col("leaf")).select(*self.by, "x", "y", "id", "x_bits", "y_bits")
            if nodes[-1].filter(~F.col("leaf")).isEmpty():
                break
        self.levels, self.points = nodes, reduce(DataFrame.unionByName, leaves)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (left_id, [by], right_id, distance): the nearest right row of each left row (and value of `by`), ties to the lesser id; columns x, y.

    The cells of the right rows are searched from the whole down: every place of left rows keeps the cells whose box is no farther than the farthest corner of some other, since one of their
    points must be the nearest, and goes on to the cells within them, until they hold few points. So work follows the number of distinct places and the depth of the cells, however crowded some
    of them are, and ends when boxes prove it. Rows without a finite place, and right rows with a null in `by`, are left out; an id at several places counts from the nearest of them.
    """
    placed = (F.abs(F.col("x").cast("double")) < float("inf")) & (F.abs(F.col("y").cast("double")) < float("inf"))
    x, y = F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in by), F.lit(True))
    tree = CellTree(right.filter(placed & known).select(F.col(right_id).alias("id"), x, y, *by), by)
    kinds = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}
    if tree.empty:
        return left.sparkSession.createDataFrame([], ", ".join(f"`{c}` {kinds[c]}" for c in (left_id, *by, right_id)) + ", distance double")
    ids = left.filter(placed).select(F.col(left_id).alias("l"), x, y).distinct()
    rows = ids.select("x", "y").distinct()  # equal places have the same nearest
    dx, dy = (F.greatest(F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"), F.lit(0.0)) for c in ("x", "y"))
    fx, fy = (F.greatest(F.abs(F.col(c) - F.col(f"lo{c}")), F.abs(F.col(c) - F.col(f"hi{c}"))) for c in ("x", "y"))
    one = Window.partitionBy("x", "y", *by)
    frontier, found = None, []
    for level, nodes in enumerate(tree.levels):
        cells = nodes.withColumnRenamed("cell", "_cell")
        if frontier is None:
            met = rows.crossJoin(F.broadcast(cells.drop("parent")))  # the root, one row for each value of `by`
        else:
            held = frontier.filter(F.col("leaf"))
            met = frontier.filter(~F.col("leaf")).select("x", "y", *by, F.col("_cell").alias("parent")).join(cells, [*by, "parent"]).drop("parent")
        met = met.withColumns({"near": F.hypot(dx, dy), "far": F.hypot(fx, fy), "_level": F.lit(level * STEP)}).select("x", "y", *by, "_cell", "_level", "leaf", "near", "far")
        if frontier is not None:
            met = met.unionByName(held)
        kept = met.withColumn("bound", F.min("far").over(one)).filter(F.col("near") <= F.col("bound") * (1 + 1e-12)).drop("bound")
        frontier = materialise(kept, "frontier")
    close = frontier.join(tree.points.select(*by, F.col("level").alias("_level"), F.col("cell").alias("_cell"), "rx", "ry", "id"), [*by, "_level", "_cell"])
    of_place = close.groupBy("x", "y", *by).agg(F.min(F.struct(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")).alias("d"), "id")).alias("b"))
    best = ids.join(of_place, ["x", "y"]).groupBy("l", *by).agg(F.min("b").alias("b"))
    return best.select(F.col("l").alias(left_id), *by, F.col("b.id").alias(right_id), F.col("b.d").alias("distance"))


def undirected(segments: DataFrame) -> DataFrame:
    """Segments (x1, y1, x2, y2) once, whichever way round they are recorded; those without length, or with a null or infinite end, go."""
    a, b = F.struct(*[F.col(c).cast("double").alias(c[0]) for c in ("x1", "y1")]), F.struct(*[F.col(c).cast("double").alias(c[0]) for c in ("x2", "y2")])
    ends = segments.filter(" AND ".join(f"abs(CAST({c} AS DOUBLE)) < CAST('inf' AS DOUBLE)" for c in ("x1", "y1", "x2", "y2"))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.filter("a <> b").select(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).distinct()


def clipped_lengths(segments: DataFrame, size: float, segment: str = "segment") -> DataFrame:
    """Rows (cx, cy, length): the length of segments (x1, y1, x2, y2) within each grid cell.

    A segment is cut where it crosses grid lines: the crossings along it, sorted, bound pieces that each lie in the cell of their middle.
    """
    def crossings(a: str, b: str) -> Column:
        low, high = F.floor(F.least(a, b) / size) + 1, F.ceil(F.greatest(a, b) / size) - 1
        lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
        return F.transform(lines, lambda k: (k * F.lit(size) - F.col(a)) / (F.col(b) - F.col(a)))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("x1", "x2"), crossings("y1", "y2"))))
    pieces = segments.withColumn("t", cuts).withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.get("t", i - 1).alias("a"), F.get("t", i).alias("b")))))
    middle = (F.col("p.a") + F.col("p.b")) / 2
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (F.col("p.b") - F.col("p.a"))
    at = pieces.select(F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * middle) / size).alias("cx"), F.floor((F.col("y1") + (F.col("y2") - F.col("y1")) * middle) / size).alias("cy"), length.alias("length"))
    return at.groupBy("cx", "cy").agg(F.sum("length").alias("length"))


def cell_sums(pixels: DataFrame, size: float, value: str = "v") -> DataFrame:
    """Rows (cx, cy, total) of pixel values; negative and null count as 0."""
    return points_in_cells(pixels, size).groupBy("cx", "cy").agg(F.sum(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))).alias("total"))


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: the box around the points."""
    return points.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def grid(box: DataFrame, size: float) -> DataFrame:
    """Rows (cx, cy): the cells that a box (one row of minx, miny, maxx, maxy) touches."""
    def along(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    return box.select("miny", "maxy", along("minx", "maxx").alias("cx")).select("cx", along("miny", "maxy").alias("cy"))


def coverage(cells: DataFrame, area: DataFrame, size: float, least: float = 0.25) -> DataFrame:
    """Cells (cx, cy) with the share of each that an axis-aligned area (one row) covers, if at least `least`."""
    both = cells.crossJoin(area)
    left, low = F.col("cx") * size, F.col("cy") * size
    wide = F.greatest(F.lit(0.0), F.least(left + size, F.col("maxx")) - F.greatest(left, F.col("minx")))
    high = F.greatest(F.lit(0.0), F.least(low + size, F.col("maxy")) - F.greatest(low, F.col("miny")))
    return both.select("cx", "cy", (wide * high / (size * size)).alias("coverage")).filter(F.col("coverage") >= least)
