"""Queries on features, models, space and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as M
from ..operators import graphs as G
from ..operators import spatial as S
from .aggregate_queries import rounded
from .registry import Source, query, view

view("features", """
SELECT zone, day, load_c / CAST(100000 AS DOUBLE) AS load, coalesce(lag(load_c) OVER (PARTITION BY zone ORDER BY day), 0) / CAST(100000 AS DOUBLE) AS previous, pickups, CAST(extract(month FROM day) AS INT) AS month FROM {panel} p""")
_TRAIN = "SELECT * FROM {features} f WHERE day <= (SELECT max(day) - 30 FROM {panel} p)"
_COEF = f"SELECT regr_slope(load, pickups) AS slope, regr_intercept(load, pickups) AS intercept FROM ({_TRAIN})"


def _split(s: Source) -> tuple[DataFrame, DataFrame]:
    both = M.temporal_split(s.view("features"), "day")
    return both.filter("part = 'train'"), both.filter("part = 'test'")


@query("f01_feature_contract", "SELECT zone, day, CAST(pickups AS DOUBLE) AS pickups, previous, load FROM {features} f")
def _(s: Source) -> DataFrame:
    return M.materialize(s.view("features"), "zone", "day", {"pickups": "double", "previous": "double"}, "load")


@query("f02_temporal_split", "SELECT CASE WHEN day > (SELECT max(day) - 30 FROM {panel} p) THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM {features} f GROUP BY 1")
def _(s: Source) -> DataFrame:
    return M.temporal_split(s.view("features"), "day").groupBy("part").agg(F.count("*").alias("n"))


@query("f03_naive_baseline", "SELECT count(*) AS n, round(avg(abs(load - previous)), 6) AS mae, round(sqrt(avg((load - previous) * (load - previous))), 6) AS rmse, round(1 - avg((load - previous) * (load - previous)) / var_pop(load), 6) AS r2 FROM {features} f")
def _(s: Source) -> DataFrame:
    from ..operators.aggregates import regression_metrics

    return rounded(regression_metrics(s.view("features"), "load", "previous"), 6)


@query("f04_linear_coefficients", f"SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, (SELECT count(*) FROM ({_TRAIN})) AS n FROM ({_COEF})")
def _(s: Source) -> DataFrame:
    return rounded(M.linear_coefficients(_split(s)[0], "pickups", "load"), 6)


# least squares on three features by the adjugate of their covariances
_X = ("pickups", "previous", "month")
_COV = f"SELECT {', '.join(f'covar_pop({a}, {b}) AS {n}' for n, a, b in (('a', 'pickups', 'pickups'), ('b', 'pickups', 'previous'), ('c', 'pickups', 'month'), ('d', 'previous', 'previous'), ('e', 'previous', 'month'), ('f', 'month', 'month')))}, {', '.join(f'covar_pop({x}, load) AS r{i}, avg({x}) AS m{i}' for i, x in enumerate(_X))}, avg(load) AS my FROM ({_TRAIN})"
_BETA = f"SELECT *, ((d * f - e * e) * r0 + (c * e - b * f) * r1 + (b * e - c * d) * r2) / det AS b0, ((c * e - b * f) * r0 + (a * f - c * c) * r1 + (b * c - a * e) * r2) / det AS b1, ((b * e - c * d) * r0 + (b * c - a * e) * r1 + (a * d - b * b) * r2) / det AS b2 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM ({_COV}))"


@query("f04_linear_model", f"SELECT zone, day, round(my + b0 * (pickups - m0) + b1 * (previous - m1) + b2 * (month - m2), 4) AS prediction FROM {{features}} f CROSS JOIN ({_BETA}) WHERE day > (SELECT max(day) - 30 FROM {{panel}} p)")
def _(s: Source) -> DataFrame:
    train, test = _split(s)
    return M.fit_linear(train, ["pickups", "previous", "month"], "load").transform(test).select("zone", "day", F.round("prediction", 4).alias("prediction"))


@query("f05_logistic_model")
def _(s: Source) -> DataFrame:
    rows = M.stratified_split(s.view("attendance").filter("rural IS NOT NULL AND deprivation_score IS NOT NULL"), "student_id", "rural")
    model = M.fit_logistic(rows.filter("part = 'train'"), ["academic_year"], ["deprivation_score", "absent"], "rural")
    return model.transform(rows.filter("part = 'test'")).groupBy("rural", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("f06_site_placement")
def _(s: Source) -> DataFrame:
    return M.place_sites(s.view("places").withColumn("w", (F.col("population") + 1).cast("double")), "x", "y", "w", 4)


@query("f07_batch_scores", f"SELECT zone, day, round(slope * pickups + intercept, 5) AS prediction FROM {{features}} f CROSS JOIN ({_COEF}) c WHERE day > (SELECT max(day) - 30 FROM {{panel}} p)")
def _(s: Source) -> DataFrame:
    train, test = _split(s)
    return M.score_linear(test, M.linear_coefficients(train, "pickups", "load"), "pickups").select("zone", "day", F.round("prediction", 5).alias("prediction"))


_HALVED = "SELECT f.*, CASE WHEN r <= floor(n / 2) THEN 'reference' ELSE 'current' END AS period FROM {features} f JOIN (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM {panel} p)) d USING (day)"
_DRIFT = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (period = 'reference') AS m0, avg({c}) FILTER (period = 'current') AS m1, stddev_samp({c}) FILTER (period = 'reference') AS s0 FROM ({_HALVED})" for c in ("load", "previous", "pickups", "month"))


@query("f08_drift", f"SELECT feature, round(m0, 6) AS reference_mean, round(m1, 6) AS current_mean, round(s0, 6) AS reference_std, round(abs(m1 - m0) / s0, 6) AS shift, abs(m1 - m0) / s0 >= 0.02 AS drifted FROM ({_DRIFT})")
def _(s: Source) -> DataFrame:
    return rounded(M.drift(s.view("features"), "day", ["load", "previous", "pickups", "month"], 0.02), 6)


@query("f09_performance", "SELECT n, round(mae, 6) AS mae, round(mae / 1.5, 6) AS mae_ratio, mae / 1.5 >= 1.25 AS degraded FROM (SELECT count(*) AS n, avg(abs(load - previous)) AS mae FROM {features} f)")
def _(s: Source) -> DataFrame:
    return rounded(M.performance(s.view("features"), "load", "previous", 1.5).select("n", "mae", "mae_ratio", "degraded"), 6)


@query("f10_retraining", f"SELECT n >= 2 OR degraded AS retrain, concat_ws('; ', CASE WHEN n >= 2 THEN n || ' features drifted' END, CASE WHEN degraded THEN 'performance degraded' END) AS reasons FROM (SELECT count(*) FILTER (abs(m1 - m0) / s0 >= 0.02) AS n FROM ({_DRIFT})) CROSS JOIN (SELECT avg(abs(load - previous)) / 1.5 >= 1.25 AS degraded FROM {{features}} f)")
def _(s: Source) -> DataFrame:
    return M.retrain_decision(M.drift(s.view("features"), "day", ["load", "previous", "pickups", "month"], 0.02), M.performance(s.view("features"), "load", "previous", 1.5))


@query("f11_standardized", "SELECT zone, day, round((load - m) / s, 6) AS load FROM {features} f CROSS JOIN (SELECT avg(load) AS m, stddev_pop(load) AS s FROM {features} f)")
def _(s: Source) -> DataFrame:
    return rounded(M.standardized(s.view("features").select("zone", "day", "load"), ["load"]), 6)


@query("j10_points_in_boxes", "SELECT site, count(*) AS n FROM {places} p JOIN {sites} t ON p.x >= t.x - 300 AND p.x < t.x + 300 AND p.y >= t.y - 300 AND p.y < t.y + 300 GROUP BY 1")
def _(s: Source) -> DataFrame:
    boxes = s.view("sites").select("site", *[(F.col(c) + d).alias(n) for n, c, d in (("minx", "x", -300), ("miny", "y", -300), ("maxx", "x", 300), ("maxy", "y", 300))])
    return S.counts_in_boxes(s.view("places"), boxes, 500.0).groupBy("site").agg(F.sum("n").alias("n"))


_DIST = "sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))"


@query("j11_nearest", f"SELECT place, site, round(d, 6) AS distance FROM (SELECT place, site, {_DIST} AS d, row_number() OVER (PARTITION BY place ORDER BY {_DIST}, site) AS r FROM {{places}} p CROSS JOIN {{sites}} t) WHERE r = 1")
def _(s: Source) -> DataFrame:
    return rounded(S.nearest(s.view("places"), s.view("sites"), "place", "site"), 6)


@query("j12_nearest_by_category", f"SELECT place, category, round(min({_DIST}), 6) AS distance FROM {{places}} p CROSS JOIN {{sites}} t GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return rounded(S.nearest(s.view("places"), s.view("sites"), "place", "site", by=["category"]).select("place", "category", "distance"), 6)


_SEGMENTS = "SELECT x AS x1, y AS y1, least(x + population, 9999.0) AS x2, least(y + population / 2.0, 9999.0) AS y2 FROM {places} p"
_TOUCHED = f"SELECT *, CAST(unnest(generate_series(CAST(floor(y1 / 1000) AS BIGINT), CAST(floor(y2 / 1000) AS BIGINT))) AS BIGINT) AS cy FROM (SELECT *, CAST(unnest(generate_series(CAST(floor(x1 / 1000) AS BIGINT), CAST(floor(x2 / 1000) AS BIGINT))) AS BIGINT) AS cx FROM ({_SEGMENTS}))"
_WITHIN = "greatest(0, " + " ".join(("least(1.0,", "CASE WHEN x2 > x1 THEN ((cx + 1) * 1000 - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN ((cy + 1) * 1000 - y1) / (y2 - y1) ELSE 1 END)", "- greatest(0.0, CASE WHEN x2 > x1 THEN (cx * 1000 - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (cy * 1000 - y1) / (y2 - y1) ELSE 0 END)")) + ")"


@query("j14_clipped_lengths", f"SELECT * FROM (SELECT cx, cy, round(sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) * {_WITHIN}), 4) AS length FROM ({_TOUCHED}) GROUP BY 1, 2) WHERE length > 0")
def _(s: Source) -> DataFrame:
    segments = s.view("places").select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.least(F.col("x") + F.col("population"), F.lit(9999.0)).alias("x2"), F.least(F.col("y") + F.col("population") / 2, F.lit(9999.0)).alias("y2"))
    return rounded(S.clipped_lengths(segments, 1000.0), 4).filter("length > 0")


@query("j14_total_length", "SELECT round(sum(sqrt(power(least(x + population, 9999) - x, 2) + power(least(y + population / 2.0, 9999) - y, 2))), 3) AS length FROM {places} p")
def _(s: Source) -> DataFrame:
    segments = s.view("places").select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.least(F.col("x") + F.col("population"), F.lit(9999.0)).alias("x2"), F.least(F.col("y") + F.col("population") / 2, F.lit(9999.0)).alias("y2"))
    return rounded(S.clipped_lengths(segments, 1000.0).agg(F.sum("length").alias("length")), 3)


_BOTH = "SELECT src, dst, w FROM {edges} e UNION ALL SELECT dst, src, w + 1 FROM {edges} e"


def _paths(name: str, both: str) -> str:
    return f"b_{name} AS MATERIALIZED ({both}), {name}(origin, node, cost) USING KEY (origin, node) AS (SELECT hub, hub, CAST(0 AS BIGINT) FROM {{hubs}} h UNION SELECT d.origin, b.dst, min(d.cost + b.w) FROM {name} d JOIN b_{name} b ON b.src = d.node LEFT JOIN recurring.{name} AS r ON r.origin = d.origin AND r.node = b.dst WHERE r.cost IS NULL OR d.cost + b.w < r.cost GROUP BY d.origin, b.dst)"


def _hubs(s: Source, name: str) -> DataFrame:
    return s.view("hubs").withColumnRenamed("hub", name)


@query("j18_shortest_times", f"WITH RECURSIVE {_paths('d', _BOTH)} SELECT origin, node, cost FROM d")
def _(s: Source) -> DataFrame:
    return G.shortest_times(s.sql(_BOTH), _hubs(s, "origin"))


# roads of several towns that do not meet, streets out of each that lead nowhere back, and a depot with one-way streets to everyone: the busiest node, in no component but its own
view("town_roads", """
SELECT src, dst FROM {edges} e WHERE src % 5 = -dst % 5 UNION ALL SELECT dst, src FROM {edges} e WHERE w >= 40 AND src % 5 = -dst % 5
UNION ALL SELECT CAST(1000000000 AS BIGINT), CAST(2000000000 + c_custkey AS BIGINT) FROM {customer}""")
_REACH = "WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {town_roads} t WHERE src < 1000000000), r(a, b) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), k AS MATERIALIZED (SELECT r.b AS node, min(r.a) AS component FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY 1)"


@query("j19_largest_component", f"{_REACH} SELECT node FROM k WHERE component = (SELECT component FROM k GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def _(s: Source) -> DataFrame:
    return G.largest_component(s.view("town_roads"))


@query("j19_component_sizes", f"{_REACH} SELECT component, count(*) AS nodes FROM k GROUP BY 1 UNION ALL SELECT n, 1 FROM (SELECT src AS n FROM {{town_roads}} t WHERE src >= 1000000000 UNION SELECT dst FROM {{town_roads}} t WHERE src >= 1000000000)")
def _(s: Source) -> DataFrame:
    return G.component_sizes(s.view("town_roads"))


# a large truck may not turn back and is slower, and in a disrupted hour short streets are closed
view("truck_roads", """
SELECT truck, scenario, src, dst, w * CASE WHEN truck = 'large' THEN 2 ELSE 1 END + CASE WHEN scenario = 'disrupted' THEN 3 ELSE 0 END AS w
FROM (SELECT src, dst, w, 0 AS turned FROM {edges} e UNION ALL SELECT dst, src, w + 1, 1 FROM {edges} e) b
CROSS JOIN (SELECT 'small' AS truck UNION ALL SELECT 'large') t CROSS JOIN (SELECT 'normal' AS scenario UNION ALL SELECT 'disrupted') c
WHERE (turned = 0 OR truck = 'small' OR w >= 40) AND (scenario = 'normal' OR w >= 5)""")
_KEYS = "truck, scenario"


def _keyed_paths(name: str, src: str, dst: str) -> str:
    return f"{name}(truck, scenario, origin, node, cost) USING KEY (truck, scenario, origin, node) AS (SELECT t.*, hub, hub, CAST(0 AS BIGINT) FROM {{hubs}} h CROSS JOIN (SELECT DISTINCT {_KEYS} FROM g) t UNION SELECT d.truck, d.scenario, d.origin, g.{dst}, min(d.cost + g.w) FROM {name} d JOIN g ON g.{src} = d.node AND g.truck = d.truck AND g.scenario = d.scenario LEFT JOIN recurring.{name} AS r ON r.truck = d.truck AND r.scenario = d.scenario AND r.origin = d.origin AND r.node = g.{dst} WHERE r.cost IS NULL OR d.cost + g.w < r.cost GROUP BY d.truck, d.scenario, d.origin, g.{dst})"


@query("l08_travel_matrix", f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {{truck_roads}} x), {_keyed_paths('t', 'src', 'dst')}, {_keyed_paths('u', 'dst', 'src')}
SELECT k.truck, k.scenario, hub, bin, t.cost AS there, u.cost AS back, t.cost + u.cost AS round_trip FROM {{hubs}} h CROSS JOIN (SELECT DISTINCT {_KEYS} FROM g) k CROSS JOIN (SELECT DISTINCT src AS bin FROM {{edges}} e)
LEFT JOIN t ON t.truck = k.truck AND t.scenario = k.scenario AND t.origin = hub AND t.node = bin LEFT JOIN u ON u.truck = k.truck AND u.scenario = k.scenario AND u.origin = hub AND u.node = bin""")
def _(s: Source) -> DataFrame:
    roads = s.view("truck_roads")
    hubs = s.view("hubs").crossJoin(roads.select("truck", "scenario").distinct())
    return G.travel_matrix(roads, hubs, s.view("edges").select(F.col("src").alias("bin")).distinct(), ["truck", "scenario"])


@query("l10_cell_sums", "SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, CAST(sum(greatest(population - 100, 0)) AS BIGINT) AS total FROM {places} p GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return S.cell_sums(s.view("places").withColumn("v", F.col("population") - 100), 1000.0)


_CELLS = "SELECT CAST(unnest(generate_series(CAST(floor(minx / 100) AS BIGINT), CAST(floor(maxx / 100) AS BIGINT))) AS BIGINT) AS cx, miny, maxy FROM (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {places} p)"
_GRID = f"SELECT cx, CAST(unnest(generate_series(CAST(floor(miny / 100) AS BIGINT), CAST(floor(maxy / 100) AS BIGINT))) AS BIGINT) AS cy FROM ({_CELLS})"


@query("x27_grid_coverage", f"SELECT cx, cy, round(greatest(0, least(cx * 100 + 100.0, maxx) - greatest(cx * 100.0, minx)) * greatest(0, least(cy * 100 + 100.0, maxy) - greatest(cy * 100.0, miny)) / 10000.0, 6) AS coverage FROM ({_GRID}) CROSS JOIN (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {{sites}} s) WHERE coverage >= 0.25")
def _(s: Source) -> DataFrame:
    return rounded(S.coverage(S.grid(S.bounds(s.view("places")), 100.0), S.bounds(s.view("sites")), 100.0), 6)
