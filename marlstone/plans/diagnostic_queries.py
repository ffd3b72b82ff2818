"""Queries on operations: daily, point and truck tables, demand of bins, travel of representatives, candidates of trucks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graphs as G
from ..operators import joins as J
from ..operators import service as V
from ..operators import spatial as S
from .registry import Source, query, view

view("operations", """
SELECT zone AS point, day, load_c / CAST(100 AS DOUBLE) AS fill, greatest(0, load_c - 20000000) / CAST(100 AS DOUBLE) AS overflow, load_c / CAST(20000000 AS DOUBLE) AS fill_ratio, CAST(extract(day FROM day) % 6 AS INT) AS days_since,
  CAST(load_c * (zone % 7 + 3) AS DOUBLE) / 1000 AS collected FROM {panel} p""")
_DAYS = "SELECT day, sum(fill) AS generated, sum(collected) AS collected, sum(overflow) AS overflow FROM {operations} o GROUP BY 1"


@query("l15_daily", f"SELECT day, round(generated, 4) AS generated, round(uncollected, 4) AS uncollected, round(collected * 100.0 / nullif(generated, 0), 6) AS collection_rate, round(uncollected - lag(uncollected) OVER (ORDER BY day), 4) AS backlog_change, round(overflow * 100.0 / nullif(uncollected, 0), 6) AS overflow_share FROM (SELECT *, generated - collected AS uncollected FROM ({_DAYS}))")
def _(s: Source) -> DataFrame:
    d = V.daily_diagnostics(s.sql(_DAYS))
    return d.select("day", *[F.round(c, n).alias(c) for c, n in (("generated", 4), ("uncollected", 4), ("collection_rate", 6), ("backlog_change", 4), ("overflow_share", 6))])


_POINTS = "SELECT CAST(site % 60 AS INT) AS point, count(*) AS bins, sum(capacity) AS capacity, CAST(sum(site % 90) AS DOUBLE) AS expected FROM {sites} s GROUP BY 1"


@query("l15_points", f"""SELECT o.*, p.bins, p.capacity, p.expected, round(p.expected / p.capacity, 9) AS load_ratio, overflow_days >= 10 AS persistent_overflow FROM (SELECT point, count(*) FILTER (overflow > 0) AS overflow_days, round(sum(overflow), 4) AS total_overflow, round(max(overflow), 4) AS peak_overflow,
  round(avg(fill_ratio), 9) AS mean_fill_ratio, round(max(fill_ratio), 9) AS peak_fill_ratio, max(days_since) AS longest_wait, round(arg_max(fill, day), 4) AS final_fill, round(arg_max(overflow, day), 4) AS final_overflow FROM {{operations}} o GROUP BY 1) o LEFT JOIN ({_POINTS}) p USING (point)""")
def _(s: Source) -> DataFrame:
    d = V.point_diagnostics(s.view("operations"), s.sql(_POINTS))
    places = {"total_overflow": 4, "peak_overflow": 4, "final_fill": 4, "final_overflow": 4, "mean_fill_ratio": 9, "peak_fill_ratio": 9, "load_ratio": 9}
    return d.withColumns({c: F.round(c, n) for c, n in places.items()})


_KINDS = ("pickup", "view", "click", "error", "signup", "breakdown")
_TRUCKS = "SELECT CAST(user_id % 80 AS INT) AS truck, CASE WHEN event_type = 'purchase' THEN 'pickup' ELSE event_type END AS kind, CAST(round(value) AS BIGINT) AS kg FROM {events}"


@query("l15_trucks", "SELECT truck, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS) + f", CAST(coalesce(sum(kg) FILTER (kind = 'pickup'), 0) AS BIGINT) AS collected FROM ({_TRUCKS}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return V.truck_diagnostics(s.sql(_TRUCKS), _KINDS)


_D = "sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))"


@query("l02_bin_demand", f"""WITH a AS (SELECT * FROM (SELECT place, population, healthcare, food, CAST(population * 0.9 + healthcare * 80 + food * 24 AS DOUBLE) AS expected, site, {_D} AS distance, row_number() OVER (PARTITION BY place ORDER BY {_D}, site) AS r FROM {{places}} p CROSS JOIN {{sites}} t) WHERE r = 1)
SELECT t.site AS bin, t.bin_type, t.capacity, count(a.place) AS places, round(coalesce(sum(expected), 0), 4) AS expected, round(coalesce(avg(distance), 0), 6) AS mean_distance, round(coalesce(max(distance), 0), 6) AS max_distance, CAST(coalesce(sum(population), 0) AS BIGINT) AS population, CAST(coalesce(sum(healthcare), 0) AS BIGINT) AS healthcare, CAST(coalesce(sum(food), 0) AS BIGINT) AS food
FROM {{sites}} t LEFT JOIN a USING (site) GROUP BY 1, 2, 3""")
def _(s: Source) -> DataFrame:
    kg = F.col("population") * X.DEMAND_KG_PER_PERSON + X.weighted({"healthcare": F.col("healthcare"), "food_service": F.col("food")}, X.DEMAND_KG)
    places = s.view("places").select("place", "population", "healthcare", "food", kg.alias("expected"))
    assigned = S.nearest(s.view("places"), s.view("sites"), "place", "site").join(places, "place").withColumnRenamed("site", "bin")
    bins = s.view("sites").select(F.col("site").alias("bin"), "bin_type", "capacity")
    found = V.bin_demand(assigned, bins, ["population", "healthcare", "food"])
    return found.withColumns({"expected": F.round("expected", 4), "mean_distance": F.round("mean_distance", 6), "max_distance": F.round("max_distance", 6)})


_ROADS = "SELECT src, dst, w FROM {edges} e UNION ALL SELECT dst, src, w + 1 FROM {edges} e"
_POINT_DAYS = "SELECT l_suppkey AS point, CAST(l_shipdate AS DATE) AS day, count(*) AS bins, CAST(min(l_partkey) AS BIGINT) AS representative FROM {lineitem} GROUP BY 1, 2"


def _way(name: str, src: str, dst: str) -> str:
    return f"{name}(origin, node, cost) USING KEY (origin, node) AS (SELECT hub, hub, CAST(0 AS BIGINT) FROM {{hubs}} h UNION SELECT d.origin, g.{dst}, min(d.cost + g.w) FROM {name} d JOIN g ON g.{src} = d.node LEFT JOIN recurring.{name} AS r ON r.origin = d.origin AND r.node = g.{dst} WHERE r.cost IS NULL OR d.cost + g.w < r.cost GROUP BY d.origin, g.{dst})"


@query("l06_representative_travel", f"WITH RECURSIVE g AS MATERIALIZED ({_ROADS}), {_way('t', 'src', 'dst')}, {_way('u', 'dst', 'src')} SELECT p.*, t.origin AS hub, t.cost AS there, u.cost AS back, t.cost + u.cost AS round_trip FROM ({_POINT_DAYS}) p LEFT JOIN t ON t.node = p.representative LEFT JOIN u ON u.node = p.representative AND u.origin = t.origin")
def _(s: Source) -> DataFrame:
    days = s.sql(_POINT_DAYS)
    travel = G.travel_matrix(s.sql(_ROADS), s.view("hubs"), days.select(F.col("representative").alias("bin")).distinct())
    return V.representative_travel(days, travel)


# trucks that wait at suppliers, roads to the bins there, and the windows of each bin, which overlap
view("waiting_trucks", "SELECT s_suppkey AS truck, CAST(-s_suppkey - 1 AS BIGINT) AS hub, CAST(s_suppkey * 37 % 300 AS BIGINT) AS now FROM {supplier}")
view("bin_windows", "SELECT CAST(p_partkey AS BIGINT) AS bin, CAST(p_partkey * 13 % 350 + k * 40 AS BIGINT) AS opens, CAST(p_partkey * 13 % 350 + k * 40 + 20 + p_size AS BIGINT) AS window_end FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k")
_REACHED = "SELECT truck, src AS bin, now, w AS travel, w + 1 AS back, CAST(4 AS BIGINT) AS service, now + w AS reach FROM {edges} e JOIN {waiting_trucks} t ON t.hub = e.dst"


@query("l18_candidates", f"SELECT truck, count(*) AS candidates, min(struct_pack(travel := travel, bin := bin, window_end := window_end)).bin AS best, min(struct_pack(travel := travel, bin := bin, window_end := window_end)).window_end AS best_until FROM ({_REACHED}) a JOIN {{bin_windows}} w USING (bin) WHERE reach >= opens AND reach < window_end AND reach + service <= window_end AND reach + service + back <= 450 GROUP BY 1")
def _(s: Source) -> DataFrame:
    met = J.interval_join(s.sql(_REACHED), s.view("bin_windows"), "reach", "opens", "window_end", ["bin"])
    best = F.min(F.struct("travel", "bin", "window_end"))
    return V.feasible(met).groupBy("truck").agg(F.count("*").alias("candidates"), best.alias("b")).select("truck", "candidates", F.col("b.bin").alias("best"), F.col("b.window_end").alias("best_until"))
