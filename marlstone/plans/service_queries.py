"""Queries on service rules, costs, serving and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import service as V
from ..operators.timeline import replay_points
from ..sources import tables as T
from ..streaming import requests as R
from .aggregate_queries import rounded
from .registry import Source, query, view

view("weather", "SELECT p.*, CAST(zone % 12 AS DOUBLE) AS rain, CAST(20 + zone % 20 AS DOUBLE) AS temperature FROM {panel} p")
view("states", """
SELECT p_partkey AS point, CAST(p_size * 10 AS DOUBLE) AS total_kg, CAST(250 AS DOUBLE) AS capacity_kg, CAST(p_partkey % 5 AS INT) AS days_since, CAST(1 + p_partkey % 3 AS INT) AS interval_days,
  p_size * 10 / CAST(250 AS DOUBLE) AS load_ratio, greatest(0, p_size * 10 - 250) AS overflow, CAST(0.85 AS DOUBLE) AS fill_trigger, CAST(p_partkey % 30 AS INT) AS day FROM {part}""")


@query("p04_threshold_flag", "SELECT place, true AS active FROM {places} p WHERE population >= 500")
def _(s: Source) -> DataFrame:
    return s.view("places").filter("population >= 500").select("place", F.lit(True).alias("active"))


@query("p05_either_positive", "SELECT place FROM {places} p WHERE healthcare > 2 OR food > 4")
def _(s: Source) -> DataFrame:
    return s.view("places").filter((F.col("healthcare") > 2) | (F.col("food") > 4)).select("place")


@query("p06_path_scope", "SELECT path FROM {assets} a WHERE path LIKE '%refuse%' OR path LIKE '%models%'")
def _(s: Source) -> DataFrame:
    return s.view("assets").filter(F.col("path").contains("refuse") | F.col("path").contains("models")).select("path")


@query("p07_membership", "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(s: Source) -> DataFrame:
    return s.table("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("p08_finite", "SELECT count(*) AS n FROM {edges} e WHERE w % 7 <> 0")
def _(s: Source) -> DataFrame:
    w = s.view("edges").withColumn("v", F.when(F.col("w") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("w").cast("double")))
    return w.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).agg(F.count("*").alias("n"))


@query("p12_fill_zero", "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {documents} LEFT JOIN {labels} USING (doc_id)")
def _(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id").join(s.table("labels"), "doc_id", "left").fillna(0, ["quality", "toxic"])


@query("s03_header_dialects", "SELECT source_file, count(*) AS n, count(DISTINCT student_id) AS students FROM {messy} m GROUP BY 1")
def _(s: Source) -> DataFrame:
    rows = s.view("messy").drop("k")
    two = {"student_id": "student", "district_id": "district", "academic_year": "year", "absent": "attendance_status", "deprivation_score": "deprivation", "rural": "location_type", "school_code": "school"}
    three = {"student_id": "StudentID", "district_id": "DistrictCode", "academic_year": "AcademicYear", "absent": "AbsentFlag", "deprivation_score": "DeprivationIndex", "rural": "RuralUrban", "school_code": "SchoolCode"}
    part = [rows.filter(F.col("source_file") == f"export_{i}.csv") for i in (1, 2, 3, 4)]
    frames = [part[0], part[1].withColumnsRenamed(two), part[2].withColumnsRenamed(three), part[3].select("school_code", "student_id", "rural", "district_id", "academic_year", "deprivation_score", "absent", "source_file", "source_row")]
    return Q.read_variants(frames).groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("student_id").alias("students"))


@query("s14_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM {customer}")
def _(s: Source) -> DataFrame:
    old = s.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return Q.latest_wins(old, old.filter("c_custkey % 4 = 0").withColumn("segment", F.lit("MOVED")), ["c_custkey"])


@query("s15_insert_ignore", "SELECT c_custkey FROM {customer} WHERE c_custkey % 4 <> 0")
def _(s: Source) -> DataFrame:
    keys = s.table("customer").select("c_custkey")
    return Q.insert_ignore(keys.filter("c_custkey % 4 = 0"), keys.unionByName(keys), ["c_custkey"])


@query("l02_assigned_demand", "SELECT nation, count(*) AS places, round(sum(CAST(population * 0.9 + healthcare * 80 + food * 24 AS DOUBLE)), 3) AS demand FROM {places} p GROUP BY 1")
def _(s: Source) -> DataFrame:
    from ..functions import scalars as X

    kg = F.col("population") * X.DEMAND_KG_PER_PERSON + X.weighted({"healthcare": F.col("healthcare"), "food_service": F.col("food")}, X.DEMAND_KG)
    return s.view("places").groupBy("nation").agg(F.count("*").alias("places"), F.round(F.sum(kg), 3).alias("demand"))


@query("l03_daily_demand", "SELECT zone, round(sum(load_c * (CASE WHEN isodow(day) >= 6 THEN 1.05 ELSE 1.0 END)::DOUBLE * (CASE WHEN temperature > 32 THEN 1.03 ELSE 1.0 END)::DOUBLE * (CASE WHEN rain > 5 THEN 0.97 ELSE 1.0 END)::DOUBLE), 1) AS demand FROM {weather} w GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("weather").groupBy("zone").agg(F.round(F.sum(V.demand_factors(F.col("load_c"), F.col("day"), F.col("temperature"), F.col("rain"))), 1).alias("demand"))


@query("l04_collection_points", "SELECT cx, cy, small_bins, medium_bins, large_bins, capacity, CAST(row_number() OVER (ORDER BY cx, cy) AS INT) AS point FROM (SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, count(*) FILTER (bin_type = 'small') AS small_bins, count(*) FILTER (bin_type = 'medium') AS medium_bins, count(*) FILTER (bin_type = 'large') AS large_bins, sum(capacity) AS capacity FROM {sites} s GROUP BY 1, 2)")
def _(s: Source) -> DataFrame:
    from ..operators.spatial import points_in_cells

    return V.collection_points(points_in_cells(s.view("sites"), 1000.0), ["cx", "cy"], "bin_type", "capacity")


@query("l05_service_policy", "SELECT place, priority, CASE WHEN priority THEN 'priority' ELSE 'standard' END AS service_class, CASE WHEN priority THEN 1 ELSE 2 END AS interval_days FROM (SELECT place, population >= (SELECT quantile_cont(population, 0.9) FROM {places} p) OR healthcare >= 3 OR food >= 5 AS priority FROM {places} p)")
def _(s: Source) -> DataFrame:
    return V.service_policy(s.view("places"), "population", {"healthcare": 3, "food": 5}).select("place", "priority", "service_class", "interval_days")


@query("l06_point_days", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_partkey) AS representative FROM {lineitem} GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.table("lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_partkey").alias("representative"))


@query("l09_undirected_lengths", "SELECT a, count(*) AS streets, CAST(sum(w) AS BIGINT) AS length FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, w FROM {edges} e) GROUP BY 1")
def _(s: Source) -> DataFrame:
    e = s.view("edges")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    once = both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").distinct()
    return once.groupBy("a").agg(F.count("*").alias("streets"), F.sum("w").alias("length"))


@query("l11_day_scenarios", "SELECT CASE WHEN rain >= 5 OR day(day) % 9 = 0 THEN 'disrupted' WHEN isodow(day) < 6 THEN 'rush' ELSE 'normal' END AS scenario, count(*) AS n FROM {weather} w GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("weather").groupBy(V.day_scenario(F.col("day"), F.col("rain")).alias("scenario")).agg(F.count("*").alias("n"))


for _mode, _order in (("utility", ("days_since >= interval_days THEN 'service_deadline'", "load_ratio >= fill_trigger THEN 'fill_trigger'")), ("nominal", ("load_ratio >= fill_trigger THEN 'fill_trigger'", "days_since >= interval_days THEN 'service_deadline'"))):
    @query(f"l12_due_{_mode}", f"SELECT reason, reason IS NOT NULL AS due, count(*) AS n FROM (SELECT CASE WHEN overflow > 0 THEN 'overflow' WHEN {_order[0]} WHEN {_order[1]} END AS reason FROM {{states}} s) GROUP BY 1, 2")
    def _(s: Source, mode: str = _mode) -> DataFrame:
        return V.service_due(s.view("states"), mode).groupBy("reason", "due").agg(F.count("*").alias("n"))


@query("l13_point_outcomes", "SELECT day, round(sum(least(total_kg, capacity_kg)), 3) AS bin_kg, round(sum(greatest(0, total_kg - capacity_kg)), 3) AS street_kg, count(*) FILTER (total_kg > capacity_kg) AS overflowed FROM {states} s GROUP BY 1")
def _(s: Source) -> DataFrame:
    return rounded(V.point_outcomes(s.view("states")).groupBy("day").agg(F.sum("bin_kg").alias("bin_kg"), F.sum("street_kg").alias("street_kg"), F.count_if("overflowed").alias("overflowed")), 3)


@query("l14_compliance", "SELECT day, count(*) FILTER (open) AS mandatory, count(*) FILTER (open AND served) AS served, coalesce(count(*) FILTER (open AND served) * 100.0 / NULLIF(count(*) FILTER (open), 0), 100.0)::DOUBLE AS compliance FROM (SELECT day, point % 11 <> 0 AS open, point % 4 <> 0 AS served FROM {states} s WHERE days_since >= interval_days) GROUP BY 1")
def _(s: Source) -> DataFrame:
    st = s.view("states")
    return V.compliance(st.filter("days_since >= interval_days"), st.filter("point % 11 = 0"), st.filter("point % 4 <> 0"), ["day"], "point")


@query("l15_hotspots", "SELECT zone, count(*) AS days, round(avg(load_c), 2) AS mean, max(load_c) AS peak, CAST(arg_max(load_c, day) AS BIGINT) AS last, round(sum(load_c) * 100 / CAST((SELECT sum(load_c) FROM {panel} p) AS DOUBLE), 6) AS share FROM {panel} p GROUP BY 1")
def _(s: Source) -> DataFrame:
    h = V.hotspots(s.view("panel"), "zone", "day", "load_c")
    return h.select("zone", "days", F.round("mean", 2).alias("mean"), "peak", "last", F.round("share", 6).alias("share"))


_LOG = "SELECT bin, day, minute, event_id, CAST(kind = 'pickup' AS INT) AS p, CAST(CASE WHEN kind = 'pickup' THEN -6 * kg ELSE kg END AS DOUBLE) AS c FROM {arrivals} a"
_LEVELS = f"SELECT *, plain - least(0, min(plain) OVER (PARTITION BY bin ORDER BY day, minute, p, event_id ROWS UNBOUNDED PRECEDING)) AS total FROM (SELECT *, sum(c) OVER (PARTITION BY bin ORDER BY day, minute, p, event_id ROWS UNBOUNDED PRECEDING) AS plain FROM ({_LOG}))"


@query("l16_replay", f"""SELECT bin, day, sum(greatest(c, 0.0)) AS arrived, sum(taken) AS collected, sum(CASE WHEN p = 1 THEN -c - taken ELSE 0.0 END) AS unmet, least(arg_max(total, (minute, p, event_id)), 400.0) AS left_in_bin, greatest(arg_max(total, (minute, p, event_id)) - 400.0, 0.0) AS left_on_street, max(greatest(total - 400.0, 0.0)) AS peak_street
  FROM (SELECT *, CASE WHEN p = 1 THEN coalesce(lag(total) OVER (PARTITION BY bin ORDER BY day, minute, p, event_id), 0.0) - total ELSE 0.0 END AS taken FROM ({_LEVELS})) GROUP BY 1, 2""")
def _(s: Source) -> DataFrame:
    events = s.view("arrivals").withColumn("kg", F.when(F.col("kind") == "pickup", F.col("kg") * 6).otherwise(F.col("kg")))
    return V.replay(events, 400.0)


@query("l16_replay_balance", "SELECT bin, CAST(sum(CASE WHEN kind = 'arrival' THEN kg ELSE 0 END) AS DOUBLE) AS arrived, CAST(sum(CASE WHEN kind = 'pickup' THEN kg * 6 ELSE 0 END) AS DOUBLE) AS scheduled FROM {arrivals} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    events = s.view("arrivals").withColumn("kg", F.when(F.col("kind") == "pickup", F.col("kg") * 6).otherwise(F.col("kg")))
    return V.replay(events, 400.0).groupBy("bin").agg(F.sum("arrived").alias("arrived"), F.sum(F.col("collected") + F.col("unmet")).alias("scheduled"))


# points of four bins; what a pickup takes from a point in all does not depend on how it is split, so windows over the point give it
_AT_POINTS = "SELECT bin // 4 AS point, day, minute, event_id, CAST(kind = 'pickup' AS INT) AS p, CAST(CASE WHEN kind = 'pickup' THEN -25 * kg ELSE kg END AS DOUBLE) AS c FROM {arrivals} a"
_POINT_LEVELS = f"SELECT *, plain - least(0, min(plain) OVER (PARTITION BY point ORDER BY day, minute, p, event_id ROWS UNBOUNDED PRECEDING)) AS total FROM (SELECT *, sum(c) OVER (PARTITION BY point ORDER BY day, minute, p, event_id ROWS UNBOUNDED PRECEDING) AS plain FROM ({_AT_POINTS}))"


def _replayed(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = s.view("arrivals")
    bins = log.select("bin").distinct().select("bin", F.floor(F.col("bin") / 4).alias("point"), F.lit(90.0).alias("capacity"))
    pickups = log.filter("kind = 'pickup'").select(F.col("event_id").alias("pickup"), F.floor(F.col("bin") / 4).alias("point"), "day", "minute", (F.col("kg") * 25).alias("kg"))
    return replay_points(bins, log.filter("kind = 'arrival'"), pickups)


@query("l16_pickups", f"SELECT event_id AS pickup, CAST(point AS BIGINT) AS point, day, -c AS scheduled, coalesce(before, 0) - total AS collected, -c - (coalesce(before, 0) - total) AS unmet, coalesce(before, 0) AS total_before, total AS total_after FROM (SELECT *, lag(total) OVER (PARTITION BY point ORDER BY day, minute, p, event_id) AS before FROM ({_POINT_LEVELS})) WHERE p = 1")
def _(s: Source) -> DataFrame:
    taken = _replayed(s)[1]
    before, after = (F.col(f"street_{w}") + F.col(f"bin_{w}") for w in ("before", "after"))
    return taken.select(F.col("pickup").cast("long").alias("pickup"), F.col("point").cast("long").alias("point"), "day", "scheduled", (F.col("from_street") + F.col("from_bin")).alias("collected"), "unmet", before.alias("total_before"), after.alias("total_after"))


@query("l16_point_days", f"SELECT CAST(point AS BIGINT) AS point, day, sum(greatest(c, 0.0)) AS arrived, arg_max(total, (minute, p, event_id)) AS left_over FROM ({_POINT_LEVELS}) GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    days = _replayed(s)[0].groupBy(F.col("point").cast("long").alias("point"), "day").agg(F.sum("arrived").alias("arrived"), F.sum(F.col("left_in_bin") + F.col("left_on_street")).alias("left_over"))
    eventful = s.view("arrivals").select(F.floor(F.col("bin") / 4).alias("point"), "day").distinct()
    return days.join(eventful, ["point", "day"], "left_semi")


@query("l16_bin_services")
def _(s: Source) -> DataFrame:
    return rounded(_replayed(s)[2].groupBy("point", "bin").agg(F.count("*").alias("services"), F.sum("from_street").alias("from_street"), F.sum("from_bin").alias("from_bin")), 6)


@query("l16_exposure")
def _(s: Source) -> DataFrame:
    return rounded(_replayed(s)[0].groupBy("point", "bin").agg(F.max("peak_street").alias("peak_street"), F.sum("kg_hours").alias("kg_hours"), F.sum("overflow_hours").alias("overflow_hours")), 6)


@query("l17_usable_minutes", "SELECT user_id % 50 AS truck, CAST(sum(least(CASE WHEN event_id % 13 = 0 THEN 0 ELSE greatest(0, 360 - coalesce(CASE WHEN event_id % 5 = 0 THEN 30 END, 0) - coalesce(CASE WHEN event_id % 7 = 0 THEN 45 END, 0)) END, coalesce(CASE WHEN event_id % 17 = 0 THEN 200 END, 360))) AS BIGINT) AS minutes FROM {events} GROUP BY 1")
def _(s: Source) -> DataFrame:
    e = F.col("event_id")
    flags = s.table("events").select((F.col("user_id") % 50).alias("truck"), F.when(e % 5 == 0, 30).alias("late_minutes"), F.when(e % 7 == 0, 45).alias("fault_minutes"), (e % 13 != 0).alias("crew_available"), F.lit(True).alias("vehicle_available"), F.when(e % 17 == 0, 200).alias("breakdown_after"))
    return V.usable_minutes(flags).groupBy("truck").agg(F.sum("usable_minutes").alias("minutes"))


@query("l17_reliability", "SELECT p_partkey, round((CASE WHEN p_size >= 8 THEN 1.35 WHEN p_size >= 6 THEN 1.15 ELSE 1.0 END)::DOUBLE * (CASE WHEN p_partkey % 120 >= 90 THEN 1.35 WHEN p_partkey % 120 >= 60 THEN 1.15 ELSE 1.0 END)::DOUBLE * (CASE WHEN p_partkey % 9 = 0 THEN 1.5 ELSE 1.0 END)::DOUBLE, 6) AS factor FROM {part}")
def _(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", F.round(V.reliability(F.col("p_size"), F.col("p_partkey") % 120, F.col("p_partkey") % 9 == 0), 6).alias("factor"))


@query("l18_feasible", "SELECT event_id FROM (SELECT event_id, minute % 300 AS now, CASE WHEN event_id % 10 <> 0 THEN kg % 60 END AS travel, 5 AS service, kg % 50 AS back, CASE WHEN minute % 300 < 135 THEN 135 ELSE 330 END AS e FROM {arrivals} a) WHERE travel IS NOT NULL AND now + travel + service <= e AND now + travel + service + back <= 450")
def _(s: Source) -> DataFrame:
    a = s.view("arrivals").select("event_id", (F.col("minute") % 300).alias("now"), F.when(F.col("event_id") % 10 != 0, F.col("kg") % 60).alias("travel"), F.lit(5).alias("service"), (F.col("kg") % 50).alias("back"))
    return V.feasible(a.withColumn("window_end", F.when(F.col("now") < 135, 135).otherwise(330))).select("event_id")


@query("c01_lookup", "SELECT district_id, academic_year, count(*) AS n FROM {attendance} a WHERE district_id = 7 GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.view("attendance").filter("district_id = 7").groupBy("district_id", "academic_year").agg(F.count("*").alias("n")).orderBy("academic_year")


view("hosts", """SELECT s_suppkey AS host, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(600 + s_suppkey AS DOUBLE) END AS price, CAST(36 AS DOUBLE) AS life_months, CAST(60 + s_suppkey % 40 AS DOUBLE) AS watts,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(3 AS DOUBLE) / 10 END AS tariff, CAST(5 AS DOUBLE) AS maintenance, CAST(s_suppkey % 30 AS DOUBLE) / 100 AS hourly_min, CAST(s_suppkey % 30 + 4 AS DOUBLE) / 100 AS hourly_max, CAST(200 AS DOUBLE) AS hours FROM {supplier}""")
_MONTHLY = "CASE WHEN price IS NOT NULL AND tariff IS NOT NULL THEN price / life_months + watts / 1000 * 730.5 * tariff + maintenance END"


@query("c04_local_cost", f"SELECT host, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN tariff IS NULL THEN 'tariff' END) AS missing, CASE WHEN price IS NULL OR tariff IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS status, round({_MONTHLY}, 6) AS monthly_cost FROM {{hosts}} h")
def _(s: Source) -> DataFrame:
    return V.local_cost(s.view("hosts")).select("host", "missing", "status", F.round("monthly_cost", 6).alias("monthly_cost"))


@query("c05_cloud_comparison", f"SELECT host, round(m / hourly_max, 5) AS break_even_from, CASE WHEN m IS NULL THEN 'UNKNOWN' WHEN m < hourly_min * hours THEN 'LOCAL' WHEN m > hourly_max * hours THEN 'CLOUD' ELSE 'AMBIGUOUS' END AS decision FROM (SELECT *, {_MONTHLY} AS m FROM {{hosts}} h)")
def _(s: Source) -> DataFrame:
    return V.cloud_comparison(V.local_cost(s.view("hosts"))).select("host", F.round("break_even_from", 5).alias("break_even_from"), "decision")


@query("c06_run_cost", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 3 = 0 THEN 'ACTUAL' WHEN o_orderkey % 3 = 1 THEN 'BAND' ELSE 'UNKNOWN' END AS kind, round(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 < 2 THEN 0.36 / 3600 * (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 100 END) END, 9)::DOUBLE AS low, CASE WHEN o_orderkey % 11 = 0 THEN 'no price' WHEN o_orderkey % 3 = 2 THEN 'no runtime' END AS reason FROM {orders}")
def _(s: Source) -> DataFrame:
    k = F.col("o_orderkey")
    runs = s.table("orders").select("o_orderkey", F.when(k % 11 != 0, F.lit(0.36)).alias("hourly_price"), F.when(k % 3 == 0, k).alias("billed_seconds"), F.when(k % 3 == 1, 100).alias("least_seconds"), F.when(k % 3 == 1, 300).alias("most_seconds"))
    return V.run_cost(runs).select("o_orderkey", "cost.kind", F.round("cost.low", 9).alias("low"), "cost.reason")


view("workloads", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS cloud, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS temporary, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS sustained,
  CAST(o_orderkey % 16 AS INT) AS need_cpu, 8 AS cpu, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 64 AS DOUBLE) END AS need_ram, CAST(32 AS DOUBLE) AS ram, CASE WHEN o_orderkey % 7 = 0 THEN CAST(10 AS DOUBLE) END AS need_gpu_memory, CAST(o_orderkey % 2 AS INT) AS gpus, CAST(8 AS DOUBLE) AS gpu_memory FROM {orders}""")
_LACKS = "concat_ws(',', CASE WHEN need_cpu > cpu THEN 'insufficient_cpu' END, CASE WHEN need_ram > ram THEN 'insufficient_ram' END, CASE WHEN need_gpu_memory IS NOT NULL AND gpus = 0 THEN 'gpu_unavailable' WHEN need_gpu_memory > gpu_memory THEN 'insufficient_gpu_memory' END)"


@query("c07_placement", f"SELECT constraints, CASE WHEN cloud IS NULL THEN 'POLICY_INPUT_REQUIRED:CLOUD_REQUIRED' WHEN cloud THEN CASE WHEN sustained IS NULL THEN 'POLICY_INPUT_REQUIRED:SUSTAINED_HIGH_LOAD' WHEN sustained THEN 'FULL_OR_COMMITTED_CLOUD' ELSE 'FULL_CLOUD_ON_DEMAND_OR_SPOT' END WHEN constraints = '' THEN 'LOCAL_PC' WHEN temporary IS NULL THEN 'POLICY_INPUT_REQUIRED:TEMPORARY_EXCESS' WHEN temporary THEN 'CLOUD_BURST' WHEN sustained IS NULL THEN 'POLICY_INPUT_REQUIRED:SUSTAINED_HIGH_LOAD' ELSE 'LOCAL_LINUX_SERVER_VS_COMMITTED_CLOUD' END AS route, count(*) AS n FROM (SELECT *, {_LACKS} AS constraints FROM {{workloads}} w) GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    w = s.view("workloads").withColumn("c", V.constraints())
    return w.groupBy(F.array_join("c", ",").alias("constraints"), V.route(F.col("cloud"), F.size("c") == 0, F.col("temporary"), F.col("sustained")).alias("route")).agg(F.count("*").alias("n"))


def _stream(s: Source) -> DataFrame:
    """The requests view as a stream over the events file."""
    schema = s.table("events").schema
    events = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200)
    return R.with_event_time(events.select("event_id", "ts", "user_id", F.when(kind.isin("click", "view"), "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), kind).alias("route"), status.alias("status"), (F.round(F.col("value") * 100) / 100000).alias("seconds")))


@query("r01_request_counts", "SELECT method, route, status, count(*) AS requests FROM {requests} r GROUP BY 1, 2, 3")
def _(s: Source) -> DataFrame:
    return R.run_to_end(R.request_counts(_stream(s)))


@query("r01_latency_histogram", "SELECT method, route, le, count(*) AS n FROM {requests} r JOIN (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in R.BOUNDS) + ", ('inf'::DOUBLE)) b(le) ON seconds <= le GROUP BY 1, 2, 3")
def _(s: Source) -> DataFrame:
    return R.run_to_end(R.latency_histogram(_stream(s)))


# windows that the watermark, ten minutes behind the last event, has closed
_SLIDING = "SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS start FROM {requests} r CROSS JOIN range(5) t(i) WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {events})"


@query("r02_error_ratio", f"SELECT start, count(*) AS requests, round(count(*) FILTER (status BETWEEN 500 AND 599) / CAST(count(*) AS DOUBLE), 9) AS error_ratio FROM ({_SLIDING}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return rounded(R.run_to_end(R.slo_windows(_stream(s), "5 minutes", "1 minute"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", "error_ratio"))


_B = [0.0, *R.BOUNDS]
_QUANTILE = "CASE " + " ".join(f"WHEN b{i} >= n * 0.95 THEN {_B[i]} + ({_B[i + 1]} - {_B[i]}) * coalesce((n * 0.95 - {f'b{i - 1}' if i else '0'}) / NULLIF(CAST(b{i} - {f'b{i - 1}' if i else '0'} AS DOUBLE), 0), 1.0)" for i in range(len(R.BOUNDS))) + f" ELSE {R.BOUNDS[-1]} END"


@query("r03_latency_quantile", f"SELECT start, round(CAST({_QUANTILE} AS DOUBLE), 6) AS quantile FROM (SELECT start, count(*) AS n, " + ", ".join(f"count(*) FILTER (seconds <= {b}) AS b{i}" for i, b in enumerate(R.BOUNDS)) + f" FROM ({_SLIDING}) GROUP BY 1)")
def _(s: Source) -> DataFrame:
    out = R.run_to_end(R.latency_quantile(_stream(s), 0.95, "5 minutes", "1 minute"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("quantile", 6).alias("quantile"))


@query("r04_request_rate", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, round(count(*) / 60.0, 9)::DOUBLE AS rate FROM {requests} r WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {events}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return R.run_to_end(R.slo_windows(_stream(s), "1 minute"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("rate", 9).alias("rate"))


@query("r04_request_board", f"SELECT start, round(CAST(n / 60.0 AS DOUBLE), 9) AS rate, round(errors / CAST(n AS DOUBLE), 9) AS error_ratio, round(CAST({_QUANTILE} AS DOUBLE), 6) AS quantile FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n, count(*) FILTER (status BETWEEN 500 AND 599) AS errors, " + ", ".join(f"count(*) FILTER (seconds <= {b}) AS b{i}" for i, b in enumerate(R.BOUNDS)) + " FROM {requests} r GROUP BY 1) WHERE start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {events})")
def _(s: Source) -> DataFrame:
    out = R.run_to_end(R.request_board(_stream(s), 0.95, "1 minute"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("rate", 9).alias("rate"), F.round("error_ratio", 9).alias("error_ratio"), F.round("quantile", 6).alias("quantile"))


_STATES = "SELECT *, CASE WHEN NOT bad THEN 'inactive' WHEN epoch_us(ts) - epoch_us(min(CASE WHEN bad THEN ts END) OVER (PARTITION BY user_id, run)) >= 3600000000 THEN 'firing' ELSE 'pending' END AS state FROM (SELECT *, sum(CASE WHEN bad AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT user_id, ts, event_id, seconds > 0.02 AS bad, lag(seconds > 0.02) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM {requests} r))"
_CHANGES = f"SELECT user_id, ts, CASE WHEN state = 'firing' THEN 'firing' ELSE 'resolved' END AS change FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'inactive') AS before FROM ({_STATES})) WHERE (state = 'firing') <> (before = 'firing')"


@query("r05_held_alert", f"SELECT state, count(*) AS n FROM ({_STATES}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return R.held_alert(s.view("requests"), "user_id", "ts", F.col("seconds") > 0.02, 3600).groupBy("state").agg(F.count("*").alias("n"))


@query("r06_alert_transitions", _CHANGES)
def _(s: Source) -> DataFrame:
    states = R.held_alert(s.view("requests"), "user_id", "ts", F.col("seconds") > 0.02, 3600)
    return R.alert_transitions(states, "user_id", "ts")


@query("r06_alert_stream", f"SELECT * FROM ({_CHANGES}) WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {{events}})")
def _(s: Source) -> DataFrame:
    samples = _stream(s).select("user_id", "ts", (F.col("seconds") > 0.02).alias("on"))
    return R.run_to_end(R.alert_stream(samples, "user_id", 3600), "append").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "change")


_STORAGE = "SELECT CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN 'other' ELSE 'main' END AS bucket, CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'obj' || user_id END AS object_name, CASE WHEN event_type = 'view' THEN 'OBJECT_DELETE' ELSE 'OBJECT_FINALIZE' END AS event_type FROM {events}"
view("storage_events", _STORAGE)


@query("r07_storage_events", "SELECT CASE WHEN bucket IS NULL OR object_name IS NULL THEN 'error:missing_field' WHEN event_type <> 'OBJECT_FINALIZE' THEN 'ignored:event_type' WHEN bucket <> 'main' THEN 'ignored:bucket' WHEN CAST(substr(object_name, 4) AS INT) % 3 = 0 THEN 'error:object_not_found' ELSE 'registered' END AS status, count(*) AS n FROM {storage_events} e GROUP BY 1")
def _(s: Source) -> DataFrame:
    existing = s.table("events").filter("user_id % 3 <> 0").select(F.concat(F.lit("obj"), F.col("user_id").cast("string")).alias("object_name"))
    return R.storage_status(s.view("storage_events"), "main", existing).groupBy("status").agg(F.count("*").alias("n"))


@query("r07_storage_register", "SELECT DISTINCT object_name FROM {storage_events} e WHERE bucket = 'main' AND object_name IS NOT NULL AND event_type = 'OBJECT_FINALIZE' AND CAST(substr(object_name, 4) AS INT) % 3 <> 0")
def _(s: Source) -> DataFrame:
    """The stream of storage events into the register, worked through twice from the start, as after a lost checkpoint."""
    path = T.scratch(s.spark, "register")
    s.spark.createDataFrame([], "object_name string").write.parquet(path)
    user = F.col("user_id")
    existing = s.table("events").filter("user_id % 3 <> 0").select(F.concat(F.lit("obj"), user.cast("string")).alias("object_name"))
    for _i in range(2):
        events = s.spark.readStream.schema(s.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
        events = events.select(F.when(user % 10 == 0, None).when(user % 10 == 1, "other").otherwise("main").alias("bucket"), F.when(user % 13 == 0, None).otherwise(F.concat(F.lit("obj"), user.cast("string"))).alias("object_name"), F.when(F.col("event_type") == "view", "OBJECT_DELETE").otherwise("OBJECT_FINALIZE").alias("event_type"))
        R.storage_status(events, "main", existing).writeStream.foreachBatch(R.register(path)).option("checkpointLocation", T.scratch(s.spark, "register-state")).trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(path)


@query("r08_ordered_events", "SELECT priority, count(*) AS n, min(minute) AS first_minute FROM (SELECT CASE WHEN kind = 'pickup' THEN 1 ELSE 0 END AS priority, minute FROM {arrivals} a UNION ALL SELECT DISTINCT 2, 1440 + 0 * day(day) FROM {arrivals} a WHERE false UNION ALL SELECT 2, 1440 FROM (SELECT DISTINCT day FROM {arrivals} a)) GROUP BY 1")
def _(s: Source) -> DataFrame:
    a = s.view("arrivals")
    log = R.ordered_events(a.filter("kind = 'arrival'"), a.filter("kind = 'pickup'"), a.select("day").distinct())
    return log.groupBy("priority").agg(F.count("*").alias("n"), F.min("minute").alias("first_minute"))


@query("r09_daily_totals", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM {requests} r GROUP BY 1")
def _(s: Source) -> DataFrame:
    return R.run_to_end(R.daily_totals(_stream(s))).select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", "errors")


@query("r09_closed_days", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM {requests} r GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {events})")
def _(s: Source) -> DataFrame:
    """In append mode: a day comes out once the watermark has passed its end, and its state is freed."""
    return R.run_to_end(R.daily_totals(_stream(s)), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", "errors")
