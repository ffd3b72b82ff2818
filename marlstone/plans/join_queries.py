"""Queries on joins, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from .aggregate_queries import rounded
from .registry import Source, query, view


def _orders(s: Source) -> DataFrame:
    return s.table("orders").withColumnRenamed("o_custkey", "c_custkey")


@query("j01_many_to_one", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey GROUP BY 1")
def _(s: Source) -> DataFrame:
    joined = J.checked_join(_orders(s), s.table("customer"), ["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_one_to_one", "SELECT c_custkey, c_name, n FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) ON o_custkey = c_custkey")
def _(s: Source) -> DataFrame:
    counts = _orders(s).groupBy("c_custkey").agg(F.count("*").alias("n"))
    return J.checked_join(s.table("customer").select("c_custkey", "c_name"), counts, ["c_custkey"], cardinality="one_to_one")


@query("j03_composite_inner", "SELECT zone, day, a.load_c - b.load_c AS error FROM {panel} a JOIN {panel} b USING (zone, day)")
def _(s: Source) -> DataFrame:
    p = s.view("panel")
    both = J.checked_join(p.select("zone", "day", "load_c"), p.select("zone", "day", F.col("load_c").alias("other")), ["zone", "day"], "inner", "one_to_one")
    return both.select("zone", "day", (F.col("load_c") - F.col("other")).alias("error"))


@query("j04_inner_lookup", "SELECT p_brand, round(sum(l_quantity), 2) AS quantity FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.table("lineitem").join(s.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j05_small_lookup", "SELECT r_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1")
def _(s: Source) -> DataFrame:
    nations = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("j06_reason_if_unmatched", "SELECT doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'not_labelled' END AS reason FROM {documents} d LEFT JOIN {labels} l USING (doc_id)")
def _(s: Source) -> DataFrame:
    return J.with_reason(s.table("documents").select("doc_id"), s.table("labels").select("doc_id", "quality"), ["doc_id"], "not_labelled")


@query("j07_unmapped", "SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_partkey NOT IN (SELECT p_partkey FROM {part} WHERE p_size > 25)")
def _(s: Source) -> DataFrame:
    parts = s.table("part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.unmatched(s.table("lineitem").select("l_partkey").distinct(), parts, ["l_partkey"])


@query("j08_due_without_reach", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
def _(s: Source) -> DataFrame:
    return J.unmatched(s.table("customer").select("c_custkey"), _orders(s), ["c_custkey"])


@query("j09_keys_seen", "SELECT c_nationkey, count(*) AS n FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') GROUP BY 1")
def _(s: Source) -> DataFrame:
    return J.matched(s.table("customer"), _orders(s).filter("o_orderstatus = 'P'"), ["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("j15_scenario_sweep", "SELECT scenario, count(*) FILTER (over > 0) AS events, round(sum(over), 3) AS excess FROM (SELECT CAST(r.range AS INT) AS scenario, greatest(w * (0.5 + r.range * (1.5 / 63)) - c, 0.0) AS over FROM range(64) r CROSS JOIN (SELECT l_quantity AS w, CAST(40 AS DOUBLE) AS c FROM {lineitem})) GROUP BY 1")
def _(s: Source) -> DataFrame:
    loads = s.table("lineitem").select(F.col("l_quantity").alias("w"), F.lit(40.0).alias("c"))
    return rounded(J.scenario_sweep(loads, "w", "c", scenarios=64), 3)


@query("j16_product", "SELECT n_name, r_name, n_regionkey = r_regionkey AS own FROM {nation} CROSS JOIN {region}")
def _(s: Source) -> DataFrame:
    return J.product(s.table("nation"), s.table("region")).select("n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


@query("j17_work_windows", """WITH w(s, e) AS (VALUES (480, 615), (630, 720), (780, 1020)) SELECT window_end, next_start, count(*) AS n FROM (SELECT minute, (SELECT min(e) FROM w WHERE s <= minute AND minute < e) AS window_end, (SELECT min(s) FROM w WHERE s > minute) AS next_start FROM {arrivals} a) GROUP BY 1, 2""")
def _(s: Source) -> DataFrame:
    windows = s.spark.createDataFrame([(480, 615), (630, 720), (780, 1020)], "start int, end int")
    return J.lookup_window(s.view("arrivals"), "minute", windows).groupBy("window_end", "next_start").agg(F.count("*").alias("n"))


# shifts of teams that overlap and run over midnight, in minutes from the start of the month
view("shifts", "SELECT CAST(o_orderkey AS BIGINT) AS shift, CAST(o_custkey % 20 AS INT) AS team, CAST(o_orderkey * 131 % 43000 AS BIGINT) AS begins, CAST(o_orderkey * 131 % 43000 + o_orderkey * 17 % 700 AS BIGINT) AS ends FROM {orders}")
view("calls", "SELECT event_id, CAST(user_id % 20 AS INT) AS team, CAST((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS at FROM {events}")


@query("j17_overlapping_shifts", "SELECT shift, count(*) AS calls, min(c.at) AS first_at, max(event_id) AS last_event FROM {calls} c JOIN {shifts} w ON w.team = c.team AND c.at >= begins AND c.at < ends GROUP BY 1")
def _(s: Source) -> DataFrame:
    calls = s.view("calls").withColumn("one", F.lit(1))
    met = J.interval_totals(calls, s.view("shifts"), "at", "begins", "ends", ["team"], {"calls": ("sum", "one"), "first_at": ("min", "at"), "last_event": ("max", "event_id")})
    return met.groupBy("shift").agg(F.sum("calls").alias("calls"), F.min("first_at").alias("first_at"), F.max("last_event").alias("last_event"))


@query("j17_shift_overlaps", "SELECT a.shift, count(*) AS others FROM {shifts} a JOIN {shifts} b ON a.team = b.team AND a.shift <> b.shift AND a.begins < b.ends AND b.begins < a.ends AND a.begins < a.ends AND b.begins < b.ends GROUP BY 1")
def _(s: Source) -> DataFrame:
    shifts, row = s.view("shifts"), ["team", "shift"]
    met = J.overlap_counts(shifts, "begins", "ends", ["team"]).groupBy(*row).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    # each meets itself; rows of one shift, if it has several, do not count among themselves
    several = shifts.join(J.repeated_keys(shifts, row), row, "left_semi")
    own = J.overlap_counts(several, "begins", "ends", row).groupBy(*row).agg(F.sum("n").alias("own"))
    others = met.join(own, row, "left").select("shift", (F.col("n") - F.coalesce("own", "rows")).alias("others"))
    return others.groupBy("shift").agg(F.sum("others").alias("others")).filter("others > 0")


@query("p10_policy_defaults", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'P-' || o_orderstatus) AS priority FROM {orders}")
def _(s: Source) -> DataFrame:
    requests = s.table("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"))
    policies = s.table("orders").select("o_orderstatus").distinct().withColumn("priority", F.concat(F.lit("P-"), "o_orderstatus"))
    return J.fill_from_policy(requests, policies, "o_orderstatus", ["priority"]).select("o_orderkey", "priority")


@query("u05_replicate_hot", "SELECT district_id, count(*) AS n FROM {skewed} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    return J.replicate(s.view("attendance"), F.col("district_id") == 1, 20).groupBy("district_id").agg(F.count("*").alias("n"))


@query("w01_number_in_group", "SELECT event_id, CAST(row_number() OVER (PARTITION BY day, bin ORDER BY minute, event_id) AS INT) AS n FROM {arrivals} a")
def _(s: Source) -> DataFrame:
    return W.numbered(s.view("arrivals"), ["day", "bin"], ["minute", "event_id"]).select("event_id", "n")


@query("w02_change", "SELECT zone, day, load_c - lag(load_c) OVER (PARTITION BY zone ORDER BY day) AS change FROM {panel} p")
def _(s: Source) -> DataFrame:
    return W.change(s.view("panel"), ["zone"], ["day"], "load_c").select("zone", "day", "change")


_PARETO = "SELECT o_custkey, amount, CAST(row_number() OVER w AS INT) AS rank, round(amount * 100 / CAST(sum(amount) OVER () AS DOUBLE), 6) AS share, round(sum(amount) OVER w * 100 / CAST(sum(amount) OVER () AS DOUBLE), 6) AS running_share FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS amount FROM {orders} GROUP BY 1) WINDOW w AS (ORDER BY amount DESC, o_custkey ROWS UNBOUNDED PRECEDING)"


@query("w03_pareto", _PARETO)
def _(s: Source) -> DataFrame:
    return rounded(W.pareto(s.table("orders").withColumn("v", F.round("o_totalprice").cast("long")), "o_custkey", "v"), 6)


@query("w04_top_shares", f"SELECT rank, running_share FROM ({_PARETO}) WHERE rank IN (10, 25, 50, 100)")
def _(s: Source) -> DataFrame:
    p = W.pareto(s.table("orders").withColumn("v", F.round("o_totalprice").cast("long")), "o_custkey", "v")
    return rounded(p.filter(F.col("rank").isin(10, 25, 50, 100)).select("rank", "running_share"), 6)


@query("w05_keep_first", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return W.top_per_group(s.table("lineitem").select("l_orderkey", "l_partkey").distinct(), ["l_orderkey"], [F.col("l_partkey")], 1).select("l_orderkey", "l_partkey")


@query("w06_latest", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, max(ts) AS ts FROM {events} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return W.top_per_group(s.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_type", "ts")


@query("w07_lag_with_seed", "SELECT zone, day, coalesce(lag(load_c) OVER (PARTITION BY zone ORDER BY day), 0) AS previous FROM {panel} p")
def _(s: Source) -> DataFrame:
    return W.lagged(s.view("panel"), ["zone"], "day", "load_c", 0).select("zone", "day", "previous")


@query("w08_running_max", "SELECT zone, day, max(load_c) OVER (PARTITION BY zone ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak_so_far FROM {panel} p")
def _(s: Source) -> DataFrame:
    return W.running_max(s.view("panel"), ["zone"], ["day"], "load_c").select("zone", "day", "peak_so_far")


@query("w09_running_total", "SELECT day, CAST(max(level) AS BIGINT) AS peak FROM (SELECT day, sum(CASE WHEN kind = 'pickup' THEN -kg ELSE kg END) OVER (PARTITION BY day ORDER BY minute, event_id ROWS UNBOUNDED PRECEDING) AS level FROM {arrivals} a) GROUP BY 1")
def _(s: Source) -> DataFrame:
    moved = s.view("arrivals").withColumn("delta", F.when(F.col("kind") == "pickup", -F.col("kg")).otherwise(F.col("kg")))
    return W.running_total(moved, ["day"], ["minute", "event_id"], "delta").groupBy("day").agg(F.max("level").alias("peak"))


@query("w10_exposure", "SELECT bin, day, round(sum(kg * (until - minute) / 60.0), 6) AS exposure FROM (SELECT *, coalesce(lead(minute) OVER (PARTITION BY bin, day ORDER BY minute, event_id), 1440) AS until FROM {arrivals} a) GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return rounded(W.exposure(s.view("arrivals"), ["bin", "day"], "minute", ["minute", "event_id"], "kg"), 6)


@query("w11_days_since", "SELECT zone, day, CAST(day - max(CASE WHEN pickups > 1 THEN day END) OVER (PARTITION BY zone ORDER BY day ROWS UNBOUNDED PRECEDING) AS INT) AS days_since FROM {panel} p")
def _(s: Source) -> DataFrame:
    return W.days_since(s.view("panel"), ["zone"], "day", F.col("pickups") > 1).select("zone", "day", "days_since")


@query("w12_halves", "SELECT CASE WHEN r <= floor(n / 2) THEN 'reference' ELSE 'current' END AS period, count(*) AS days FROM (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM {panel} p)) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return W.halves(s.view("panel"), "day").groupBy("period").agg(F.countDistinct("day").alias("days"))


@query("w13_surrogates", "SELECT p_brand, 'CP' || lpad(CAST(row_number() OVER (ORDER BY p_brand) AS STRING), 4, '0') AS surrogate FROM (SELECT DISTINCT p_brand FROM {part})")
def _(s: Source) -> DataFrame:
    return W.surrogate_ids(s.table("part"), "p_brand")


@query("w14_partition_sizes", "SELECT CAST(CAST('0x' || substr(md5(student_id), 1, 8) AS BIGINT) % 16 AS INT) AS partition, count(*) AS n FROM {skewed} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    return W.partition_sizes(s.view("skewed"), 16, "student_id")


@query("t01_sorted", "SELECT district_id, academic_year, count(*) AS n FROM {attendance} a GROUP BY 1, 2 ORDER BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.view("attendance").groupBy("district_id", "academic_year").agg(F.count("*").alias("n")).orderBy("district_id", "academic_year")


@query("t02_page", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(s: Source) -> DataFrame:
    return s.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("t03_top_k", "SELECT district_id, count(*) AS n FROM {skewed} a GROUP BY 1 ORDER BY n DESC, district_id LIMIT 10")
def _(s: Source) -> DataFrame:
    return s.view("skewed").groupBy("district_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district_id").limit(10)


@query("t04_top_rates", "SELECT district_id, academic_year, round(avg(CASE WHEN deprivation_score IS NULL THEN 1.0 ELSE 0.0 END), 9) AS rate FROM {attendance} a GROUP BY 1, 2 ORDER BY rate DESC, 1, 2 LIMIT 20")
def _(s: Source) -> DataFrame:
    rates = s.view("attendance").groupBy("district_id", "academic_year").agg(F.round(F.avg(F.col("deprivation_score").isNull().cast("int")), 9).alias("rate"))
    return rates.orderBy(F.desc("rate"), "district_id", "academic_year").limit(20)


@query("t05_hotspots", "SELECT zone, CAST(sum(load_c) AS BIGINT) AS total, max(peak_c) AS peak FROM {panel} p GROUP BY 1 ORDER BY total DESC, peak DESC, zone LIMIT 15")
def _(s: Source) -> DataFrame:
    return s.view("panel").groupBy("zone").agg(F.sum("load_c").alias("total"), F.max("peak_c").alias("peak")).orderBy(F.desc("total"), F.desc("peak"), "zone").limit(15)


@query("t06_worst_day", "SELECT day, CAST(sum(load_c) AS BIGINT) AS total FROM {panel} p GROUP BY 1 ORDER BY total DESC, day LIMIT 1")
def _(s: Source) -> DataFrame:
    return s.view("panel").groupBy("day").agg(F.sum("load_c").alias("total")).orderBy(F.desc("total"), "day").limit(1)


@query("t07_two_step_choice", "SELECT zone, arg_min(day, struct_pack(p := pickups, d := day)) AS day FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY load_c DESC, day) AS place FROM {panel} p) WHERE place <= 15 GROUP BY 1")
def _(s: Source) -> DataFrame:
    best = W.top_per_group(s.view("panel"), ["zone"], [F.desc("load_c"), F.col("day")], 15)
    return best.groupBy("zone").agg(F.min_by("day", F.struct("pickups", "day")).alias("day"))


@query("t08_head_sample", "SELECT doc_id, lang FROM {documents} ORDER BY doc_id LIMIT 100")
def _(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("u01_union_all", "SELECT source_file, count(*) AS n FROM {enrolment_dups} e GROUP BY 1")
def _(s: Source) -> DataFrame:
    base = s.view("enrolment")
    marked = [(29, "b.csv", {}), (31, "c.csv", {"school_code": F.lit("missing")}), (67, "d.csv", {"absent": 1 - F.col("absent")}), (71, "e.csv", {"district_id": (F.col("district_id") % 250 + 1).cast("int")})]
    return W.union_checked([base, *[base.filter(F.col("k") % m == 0).withColumns({"source_file": F.lit(f)} | c) for m, f, c in marked]]).groupBy("source_file").agg(F.count("*").alias("n"))


@query("u02_except", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'")
def _(s: Source) -> DataFrame:
    o = s.table("orders")
    return o.filter("o_orderstatus = 'P'").select("o_custkey").subtract(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("u03_intersect", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'")
def _(s: Source) -> DataFrame:
    o = s.table("orders")
    return o.filter("o_orderstatus = 'P'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("u04_snapshot_changes", "WITH o AS (SELECT DISTINCT zone FROM {panel} p WHERE day < DATE '1995-02-01'), n AS (SELECT DISTINCT zone FROM {panel} p WHERE day >= DATE '2001-07-20') SELECT zone, 'firing' AS change FROM n WHERE zone NOT IN (SELECT zone FROM o) UNION ALL SELECT zone, 'resolved' FROM o WHERE zone NOT IN (SELECT zone FROM n)")
def _(s: Source) -> DataFrame:
    p = s.view("panel")
    return W.snapshot_changes(p.filter("day < DATE '1995-02-01'"), p.filter("day >= DATE '2001-07-20'"), ["zone"])
