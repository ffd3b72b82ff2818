"""Service rules, outcomes and replay of arrivals and pickups; costs and placement of workloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import windows
from .selection import exact_quantiles

HOURS_PER_MONTH = 24 * 30.4375
NET_MINUTES = 360


def day_scenario(day: Column, rain_mm: Column) -> Column:
    """disrupted on rainy days and every ninth day of the month, else rush on weekdays, else normal."""
    return F.when((rain_mm >= 5) | (F.dayofmonth(day) % 9 == 0), "disrupted").when(F.weekday(day) < 5, "rush").otherwise("normal")


def demand_factors(base: Column, day: Column, temperature: Column, rain_mm: Column) -> Column:
    return base * F.when(F.weekday(day) >= 5, 1.05).otherwise(1.0) * F.when(temperature > 32, 1.03).otherwise(1.0) * F.when(rain_mm > 5, 0.97).otherwise(1.0)


def service_policy(df: DataFrame, demand: str, counts: dict[str, int], quantile: float = 0.9) -> DataFrame:
    """priority, class, interval and trigger: a place is a priority if a count reaches its least, or demand its quantile over all places."""
    level = exact_quantiles(df, demand, [quantile]).select(F.get("quantiles", F.lit(0)).alias("_q"))
    both = df.join(F.broadcast(level), how="left")  # one row at most
    priority = F.col(demand) >= F.col("_q")
    for c, least in counts.items():
        priority = priority | (F.col(c) >= least)
    return both.withColumns({"priority": priority, "service_class": F.when(priority, "priority").otherwise("standard"), "interval_days": F.when(priority, 1).otherwise(2), "fill_trigger": F.lit(0.85)}).drop("_q")


def service_due(state: DataFrame, mode: str = "utility") -> DataFrame:
    """due, reason and priority of points (load_ratio, overflow, days_since, interval_days, fill_trigger).

    Reasons in order: overflow, then the deadline (utility) or the trigger (nominal), then the other.
    """
    late, full = F.col("days_since") >= F.col("interval_days"), F.col("load_ratio") >= F.col("fill_trigger")
    first, second = (F.when(late, "service_deadline"), F.when(full, "fill_trigger")) if mode == "utility" else (F.when(full, "fill_trigger"), F.when(late, "service_deadline"))
    reason = F.coalesce(F.when(F.col("overflow") > 0, "overflow"), first, second)
    return state.withColumns({"reason": reason, "due": reason.isNotNull(), "priority": F.struct((F.col("overflow") > 0).cast("int").alias("over"), F.greatest(F.lit(0), F.col("days_since") - F.col("interval_days")).alias("overdue"), "load_ratio")})


def point_outcomes(state: DataFrame, total: str = "total_kg", capacity: str = "capacity_kg") -> DataFrame:
    t, c = F.col(total), F.col(capacity)
    inside = F.least(t, c)
    return state.withColumns({"bin_kg": inside, "street_kg": F.greatest(F.lit(0), t - c), "fill_ratio": F.try_divide(inside, c), "load_ratio": F.try_divide(t, c), "overflowed": t > c})


def compliance(due: DataFrame, unreachable: DataFrame, served: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Per group (due - unreachable - missed) / (due - unreachable) in per cent, 100 if nothing was due."""
    keys = [*by, key]
    open_ = due.select(*keys).distinct().join(unreachable.select(*keys).distinct(), keys, "left_anti")
    marked = open_.join(served.select(*keys).distinct().withColumn("_s", F.lit(1)), keys, "left")
    done = marked.groupBy(*by).agg(F.count("*").alias("mandatory"), F.count("_s").alias("served"))
    every = due.select(*by).distinct().join(done, list(by), "left").fillna(0, ["mandatory", "served"])
    return every.withColumn("compliance", F.coalesce(F.try_divide(F.col("served") * 100.0, F.col("mandatory")), F.lit(100.0)))


def collection_points(bins: DataFrame, by: Sequence[str], bin_type: str, capacity: str) -> DataFrame:
    """Co-located bins as one point: counts by type, capacity and a number in order of place."""
    points = bins.groupBy(*by).agg(*[F.count_if(F.col(bin_type) == t).alias(f"{t}_bins") for t in ("small", "medium", "large")], F.sum(capacity).alias("capacity"))
    return windows.ranked(points, list(by), "capacity").withColumn("point", F.col("rank").cast("int")).drop("rank", "running")


def hotspots(panel: DataFrame, zone: str, day: str, load: str) -> DataFrame:
    """Per zone: days, mean, peak, last load, and the share of the total with the running share."""
    per = panel.groupBy(zone).agg(F.count("*").alias("days"), F.avg(load).alias("mean"), F.max(load).alias("peak"), F.max_by(load, day).alias("last"))
    return per.join(windows.pareto(panel, zone, load).select(zone, "rank", "share", "running_share"), zone)


def daily_diagnostics(daily: DataFrame) -> DataFrame:
    """Days (day, generated, collected, overflow, one row each) with the share collected, what is left and its change since the day before, and the share of overflow in it; null where that has no meaning."""
    left = F.col("generated") - F.col("collected")
    both = daily.withColumn("uncollected", left)
    change = F.col("uncollected") - F.lag("uncollected").over(Window.orderBy("day"))  # a row a day
    return both.withColumns({"collection_rate": F.try_divide(F.col("collected") * 100.0, "generated"), "backlog_change": change, "overflow_share": F.try_divide(F.col("overflow") * 100.0, "uncollected")})


def point_diagnostics(states: DataFrame, points: DataFrame, persistent_days: int = 10) -> DataFrame:
    """Per point of states (point, day, fill, overflow, fill_ratio, days_since): days with overflow, its sum and peak, fill ratios, the longest wait and the last day's state, with the
    point's attributes (expected, capacity and others; one row a point) and its daily load ratio; persistent if overflow lasted persistent_days days or more."""
    last = {f"final_{c}": F.max_by(c, "day") for c in ("fill", "overflow")}
    per = states.groupBy("point").agg(F.count_if(F.col("overflow") > 0).alias("overflow_days"), F.sum("overflow").alias("total_overflow"), F.max("overflow").alias("peak_overflow"), F.avg("fill_ratio").alias("mean_fill_ratio"), F.max("fill_ratio").alias("peak_fill_ratio"), F.max("days_since").alias("longest_wait"), *[c.alias(n) for n, c in last.items()])
    return per.join(points, "point", "left").withColumns({"load_ratio": F.try_divide("expected", "capacity"), "persistent_overflow": F.col("overflow_days") >= persistent_days})


def truck_diagnostics(events: DataFrame, kinds: Sequence[str], pickup: str = "pickup") -> DataFrame:
    """Per truck of events (truck, kind, kg): a count for each of kinds, 0 for those that never happened, and what its pickups took in all."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return events.groupBy("truck").agg(*counts, F.coalesce(F.sum(F.when(F.col("kind") == pickup, F.col("kg"))), F.lit(0)).alias("collected"))


def bin_demand(assigned: DataFrame, bins: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Every bin (bin and its attributes) with what is assigned to it (bin, expected, distance and `sums`): places, expected amount, sums and the mean and greatest distance, 0 without any."""
    per = assigned.groupBy("bin").agg(F.count("*").alias("places"), F.sum("expected").alias("expected"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), *[F.sum(c).alias(c) for c in sums])
    return bins.join(per, "bin", "left").fillna(0, ["places", "expected", "mean_distance", "max_distance", *sums])


def representative_travel(point_days: DataFrame, travel: DataFrame) -> DataFrame:
    """Point-days (with representative, the least bin of each) and the travel (bin, hub, there, back, round_trip) of that bin; point-days whose bin no hub lists are kept with nulls."""
    return point_days.join(travel.withColumnRenamed("bin", "representative"), "representative", "left")


def usable_minutes(df: DataFrame) -> DataFrame:
    """Net minutes less lateness and faults; none without crew or vehicle; no more than to the breakdown (null: none)."""
    left = F.lit(NET_MINUTES) - F.coalesce("late_minutes", F.lit(0)) - F.coalesce("fault_minutes", F.lit(0))
    able = F.when(F.col("crew_available") & F.col("vehicle_available"), F.greatest(F.lit(0), left)).otherwise(0)
    return df.withColumn("usable_minutes", F.least(able, F.coalesce("breakdown_after", F.lit(NET_MINUTES))))


def reliability(age_years: Column, days_since_service: Column, maintenance_due: Column) -> Column:
    age = F.when(age_years >= 8, 1.35).when(age_years >= 6, 1.15).otherwise(1.0)
    unserviced = F.when(days_since_service >= 90, 1.35).when(days_since_service >= 60, 1.15).otherwise(1.0)
    return age * unserviced * F.when(maintenance_due, 1.5).otherwise(1.0)


def feasible(candidates: DataFrame, shift_end: int = 450) -> DataFrame:
    """Candidates that can be reached and left, served before the window closes, and leave time to return."""
    at = F.col("now") + F.col("travel") + F.col("service")
    return candidates.filter(F.col("travel").isNotNull() & F.col("back").isNotNull() & (at <= F.col("window_end")) & (at + F.col("back") <= shift_end))


def replay(events: DataFrame, capacity: float, key: str = "bin") -> DataFrame:
    """Rows (bin, day, arrived, collected, unmet, left_in_bin, left_on_street, peak_street): arrivals fill a bin to capacity, the rest goes to the
    street; a pickup takes from the street first, then from the bin, as far as there is any.

    Events (bin, day, minute, event_id, kind arrival or pickup, kg) are worked through in order of (day, minute, arrivals first, event_id); what is
    left is carried to the next day; minutes past 1440 are an error; a null amount is 0.

    The street holds something only while the bin is full, so the total is all there is to know, and a total that pickups cannot take below
    0 is its plain running sum less the least that this sum has come to (if below 0). Days are summed up first, to a sum and a least each; these are
    carried from day to day, and each (bin, day) is then worked through on its own.
    """
    late = F.when(F.col("minute") > 1440, F.raise_error(F.lit("an event after the end of its day")).cast("int"))
    pickup = (F.coalesce(F.col("kind"), F.lit("")) == "pickup").cast("int")
    kg = F.coalesce(F.col("kg").cast("double"), F.lit(0.0))
    signed = events.select(key, "day", F.coalesce(late, F.col("minute")).alias("minute"), pickup.alias("pickup"), "event_id", F.when(pickup == 1, -kg).otherwise(kg).alias("change"))
    inside = Window.partitionBy(key, "day").orderBy("minute", "pickup", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = signed.withColumn("plain", F.sum("change").over(inside)).withColumn("least", F.min("plain").over(inside))
    days = summed.groupBy(key, "day").agg(F.sum("change").alias("sum"), F.min("plain").alias("low"))
    earlier = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    begun = days.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)))
    begun = begun.withColumn("floor", F.least(F.lit(0.0), F.coalesce(F.min(F.col("base") + F.col("low")).over(earlier), F.lit(0.0)))).select(key, "day", "base", "floor")
    total = F.col("base") + F.col("plain") - F.least(F.col("floor"), F.col("base") + F.col("least"))
    states = summed.join(begun, [key, "day"]).withColumn("total", total)
    before = F.coalesce(F.lag("total").over(Window.partitionBy(key, "day").orderBy("minute", "pickup", "event_id")), F.col("base") - F.col("floor"))
    states = states.withColumn("taken", F.when(F.col("pickup") == 1, before - F.col("total")).otherwise(F.lit(0.0)))
    last = F.max_by("total", F.struct("minute", "pickup", "event_id"))
    out = states.groupBy(key, "day").agg(F.sum(F.greatest("change", F.lit(0.0))).alias("arrived"), F.sum("taken").alias("collected"), F.sum(F.when(F.col("pickup") == 1, -F.col("change") - F.col("taken")).otherwise(F.lit(0.0))).alias("unmet"), last.alias("left"), F.max(F.greatest(F.col("total") - capacity, F.lit(0.0))).alias("peak_street"))
    return out.select(key, "day", "arrived", "collected", "unmet", F.least("left", F.lit(float(capacity))).alias("left_in_bin"), F.greatest(F.col("left") - capacity, F.lit(0.0)).alias("left_on_street"), "peak_street")


def _unknown(names: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in names])


def local_cost(hosts: DataFrame) -> DataFrame:
    """monthly_cost of owned hosts = price / months + energy + maintenance; UNKNOWN with the names of what is missing."""
    needed = ["price", "life_months", "watts", "tariff", "maintenance"]
    cost = F.col("price") / F.col("life_months") + F.col("watts") / 1000 * HOURS_PER_MONTH * F.col("tariff") + F.col("maintenance")
    lacking = _unknown(needed)
    return hosts.withColumns({"missing": lacking, "status": F.when(lacking == "", "KNOWN").otherwise("UNKNOWN"), "monthly_cost": F.when(lacking == "", cost)})


def cloud_comparison(df: DataFrame) -> DataFrame:
    """Monthly band of hourly prices at `hours`, break-even hours, and the decision against monthly_cost."""
    low, high = F.col("hourly_min") * F.col("hours"), F.col("hourly_max") * F.col("hours")
    decision = F.when(F.col("monthly_cost").isNull() | low.isNull() | high.isNull(), "UNKNOWN").when(F.col("monthly_cost") < low, "LOCAL").when(F.col("monthly_cost") > high, "CLOUD").otherwise("AMBIGUOUS")
    return df.withColumns({"cloud_low": low, "cloud_high": high, "break_even_from": F.try_divide("monthly_cost", "hourly_max"), "break_even_to": F.try_divide("monthly_cost", "hourly_min"), "decision": decision})


def run_cost(df: DataFrame) -> DataFrame:
    """cost: a point from billed seconds, else a band from the runtime's bounds, else UNKNOWN with a reason."""
    rate = F.col("hourly_price") / 3600
    return df.withColumn("cost", F.when(F.col("hourly_price").isNull(), F.struct(F.lit("UNKNOWN").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("no price").alias("reason")))
        .when(F.col("billed_seconds").isNotNull(), F.struct(F.lit("ACTUAL").alias("kind"), (rate * F.col("billed_seconds")).alias("low"), (rate * F.col("billed_seconds")).alias("high"), F.lit(None).cast("string").alias("reason")))
        .when(F.col("least_seconds").isNotNull() & F.col("most_seconds").isNotNull(), F.struct(F.lit("BAND").alias("kind"), (rate * F.col("least_seconds")).alias("low"), (rate * F.col("most_seconds")).alias("high"), F.lit(None).cast("string").alias("reason")))
        .otherwise(F.struct(F.lit("UNKNOWN").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("no runtime").alias("reason"))))


def constraints() -> Column:
    """Names of what a host (cpu, ram, gpus, gpu_memory) lacks for a request (need_*); unknown facts constrain nothing, but a GPU must exist."""
    over = lambda need, have: F.col(need).isNotNull() & F.col(have).isNotNull() & (F.col(need) > F.col(have))
    no_gpu = F.coalesce(F.col("gpus"), F.lit(0)) == 0
    gpu = F.when(F.col("need_gpu_memory").isNotNull() & no_gpu, F.lit("gpu_unavailable")).when(over("need_gpu_memory", "gpu_memory"), F.lit("insufficient_gpu_memory"))
    return F.array_compact(F.array(F.when(over("need_cpu", "cpu"), F.lit("insufficient_cpu")), F.when(over("need_ram", "ram"), F.lit("insufficient_ram")), gpu))


def route(cloud_required: Column, sufficient: Column, temporary: Column, sustained: Column) -> Column:
    """The placement of a request; a fact that is needed and unknown is asked for, never guessed."""
    committed = F.when(sustained.isNull(), "POLICY_INPUT_REQUIRED:SUSTAINED_HIGH_LOAD")
    return (F.when(cloud_required.isNull(), "POLICY_INPUT_REQUIRED:CLOUD_REQUIRED").when(cloud_required, F.coalesce(committed, F.when(sustained, "FULL_OR_COMMITTED_CLOUD").otherwise("FULL_CLOUD_ON_DEMAND_OR_SPOT")))
            .when(sufficient, "LOCAL_PC").when(temporary.isNull(), "POLICY_INPUT_REQUIRED:TEMPORARY_EXCESS").when(temporary, "CLOUD_BURST")
            .otherwise(F.coalesce(committed, F.lit("LOCAL_LINUX_SERVER_VS_COMMITTED_CLOUD"))))
