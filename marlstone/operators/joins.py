"""Joins with checks, lookups, ranges, and scenario sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialise


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """A join that raises if a side that must be unique on its keys is not (one job for each such side)."""
    sides = {"many_to_one": (("right", right),), "one_to_many": (("left", left),), "one_to_one": (("left", left), ("right", right))}[cardinality]
    for name, side in sides:
        if bad := repeated_keys(side, on).head():
            raise ValueError(f"{name} side is not unique on {list(on)}: {bad.asDict()}")
    return left.join(right, list(on), how)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def with_reason(left: DataFrame, right: DataFrame, on: Sequence[str], reason: str, column: str = "reason") -> DataFrame:
    """A left join whose rows without a partner carry a reason."""
    return left.join(right.withColumn("_in", F.lit(True)), list(on), "left").withColumn(column, F.when(F.col("_in").isNull(), F.lit(reason))).drop("_in")


def lookup_window(df: DataFrame, minute: str, windows: DataFrame) -> DataFrame:
    """Adds window_end, of the window [start, end) that the minute lies in, and next_start, of the first window after it.

    The windows of one day are few (a table of minutes), so all 1,440 minutes are resolved first and joined by equality.
    """
    minutes = df.sparkSession.range(1440).select(F.col("id").cast("int").alias("_m"))
    inside = minutes.join(windows, (F.col("start") <= F.col("_m")) & (F.col("_m") < F.col("end")), "left").groupBy("_m").agg(F.min("end").alias("window_end"))
    after = minutes.join(windows, F.col("start") > F.col("_m"), "left").groupBy("_m").agg(F.min("start").alias("next_start"))
    return df.join(F.broadcast(inside.join(after, "_m")), df[minute] == F.col("_m"), "left").drop("_m")


def dyadic_cover(start: Column, end: Column) -> Column:
    """The fewest intervals [node * 2^level, (node + 1) * 2^level) that make up [start, end) of longs: an array of (level, node), two a level at most; empty unless start < end."""
    none = F.expr("CAST(array() AS array<struct<level: int, node: bigint>>)")
    s, e = start.cast("long"), end.cast("long")

    def at(v: Column) -> Column:
        """Of the nodes of level v that lie within, [a, b), those at either end that are not half of a whole pair."""
        low, b = F.call_function("shiftright", s, v), F.call_function("shiftright", e, v)
        a = low + F.when(F.call_function("shiftleft", low, v) < s, 1).otherwise(0)
        left, right = (a < b) & (a.bitwiseAND(F.lit(1)) == 1), (a < b) & (b.bitwiseAND(F.lit(1)) == 1)
        right = right & (b - 1 >= F.when(left, a + 1).otherwise(a))
        both = F.array(F.struct(v.alias("level"), F.when(left, a).alias("node")), F.struct(v.alias("level"), F.when(right, b - 1).alias("node")))
        return F.filter(both, lambda n: n["node"].isNotNull())

    top = F.coalesce(F.length(F.bin(F.try_subtract(e, s))) - 1, F.lit(62))  # no node is longer than the interval
    return F.when(s < e, F.flatten(F.transform(F.sequence(F.lit(0), top), at))).otherwise(none)


def interval_join(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Every point with every half-open window [start, end) that holds it, with equal `by`; at, start and end are whole numbers (minutes, microseconds).

    A window is covered by dyadic intervals, at most two a level, and a point lies in one of each level that any window uses: so the join is by equality, gives each pair once, and follows the
    number of pairs, however the windows overlap or how long they are. Nulls match nothing; empty windows hold nothing. The levels in use are looked up first (63 at most).
    Both sides are exploded, which Spark's size estimates do not see, so the join is not left to choose a broadcast by them.
    """
    right = windows.filter(F.col(start) < F.col(end)).withColumn("_n", F.explode(dyadic_cover(F.col(start), F.col(end)))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = sorted(r[0] for r in right.select("_level").distinct().collect())
    nodes = F.array(*[F.struct(F.lit(v).alias("_level"), F.shiftright(F.col(at).cast("long"), v).alias("_node")) for v in levels]) if levels else F.expr("CAST(array() AS array<struct<_level: int, _node: bigint>>)")
    left = points.filter(F.col(at).isNotNull()).withColumn("_n", F.explode(nodes)).withColumns({"_level": F.col("_n._level"), "_node": F.col("_n._node")}).drop("_n")
    return left.join(right.hint("merge"), [*by, "_level", "_node"]).drop("_level", "_node")


def interval_totals(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, by: Sequence[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Every window [start, end) that holds a point (of equal `by`), with totals over its points: {name: (sum, min or max, column of points)}. At, start and end are whole numbers.

    For windows that hold many points each: no pair is made. Points are totalled by dyadic node, each distinct window by its nodes, at most two a level, so work follows points plus windows, times levels.
    """
    ways = {"sum": F.sum, "min": F.min, "max": F.max}
    span = [*by, start, end]
    spans = windows.filter(F.col(start) < F.col(end)).select(*span).distinct()
    cover = spans.withColumn("_n", F.explode(dyadic_cover(F.col(start), F.col(end)))).select(*span, "_n.*")
    levels = sorted(r[0] for r in cover.select("level").distinct().collect())
    if not levels:
        levels = [0]
    moments = points.filter(F.col(at).isNotNull()).groupBy(*by, F.col(at).cast("long").alias("_at")).agg(*[ways[k](c).alias(n) for n, (k, c) in totals.items()])
    nodes = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright("_at", v).alias("node")) for v in levels])
    sums = moments.withColumn("_n", F.explode(nodes)).select(*by, "_n.*", *totals).groupBy(*by, "level", "node").agg(*[ways[k](n).alias(n) for n, (k, _) in totals.items()])
    found = cover.join(sums.hint("merge"), [*by, "level", "node"]).groupBy(*span).agg(*[ways[k](n).alias(n) for n, (k, _) in totals.items()])
    return windows.join(found, span)


#: Stretches of time into which running sums are cut, so that no task sorts a group whole.
STRETCHES = 256


def running_sums(df: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """df with the sums of values up to each row in order of at (whole numbers, one row for each value of by and at), within by: sums of stretches first, then within each."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    width = max(1, ((high or 0) - (low or 0)) // STRETCHES + 1)
    cut = df.withColumn("_stretch", F.floor((F.col(at) - F.lit(low or 0)) / width))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*by, "_stretch").agg(*[F.sum(v).alias(v) for v in values]).select(*by, "_stretch", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(*by, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select(*by, "_stretch", at, *values, *[F.sum(v).over(inside).alias(f"{v}_up_to") for v in values])
    return summed.join(parts, [*by, "_stretch"]).select(*by, at, *values, *[(F.col(f"{v}_up_to") + F.col(f"_{v}")).alias(f"{v}_up_to") for v in values])


def overlap_counts(intervals: DataFrame, start: str, end: str, by: Sequence[str], name: str = "n") -> DataFrame:
    """Intervals [start, end) that are not empty, with the number of them, of equal `by`, that each overlaps, itself included: those that begin before its end less those that have ended by its start.

    Two running sums over the distinct times and two lookups for each interval; no pair is made. Rows with a null take no part.
    """
    held = intervals.filter(F.col(start) < F.col(end)).dropna(subset=list(by))
    turns = held.select(*by, F.explode(F.array(F.struct(F.col(start).alias("_at"), F.lit(1).alias("begun"), F.lit(0).alias("ended")), F.struct(F.col(end).alias("_at"), F.lit(0).alias("begun"), F.lit(1).alias("ended")))).alias("t"))
    times = turns.select(*by, "t.*").groupBy(*by, "_at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    times = materialise(running_sums(times, by, "_at", ["begun", "ended"]), "times")
    gone = times.select(*by, F.col("_at").alias(start), F.col("ended_up_to").alias("_gone"))
    come = times.select(*by, F.col("_at").alias(end), (F.col("begun_up_to") - F.col("begun")).alias("_come"))
    return held.join(gone, [*by, start]).join(come, [*by, end]).select(*intervals.columns, (F.col("_come") - F.col("_gone")).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, start: tuple[str, str], end: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Every pair of half-open intervals that overlap, once: either the right one begins within the left one, or the left one begins after that and within the right one."""
    first = interval_join(right, left, start[1], start[0], end[0], by)
    second = interval_join(left.filter(F.col(start[0]) < F.col(end[0])), right.withColumn("_after", F.col(start[1]) + 1), start[0], "_after", end[1], by).drop("_after")
    names = [*left.columns, *[c for c in right.columns if c not in by]]
    return first.filter(F.col(start[1]) < F.col(end[1])).select(names).unionByName(second.select(names))


def scenario_sweep(df: DataFrame, load: str, capacity: str, scenarios: int = 2048, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Per multiplier between low and high: rows whose load, times it, passes capacity, and by how much in all.

    A row passes its capacity from one scenario on (a negative load: up to one), so it is counted where that begins and where it ends, and running sums
    over the scenarios give the rest: rows plus scenarios, not their product. Rows with a null take no part; an empty table gives no rows.
    """
    step = (high - low) / max(1, scenarios - 1)
    x, c = F.col(load), F.col(capacity)

    def passes(scenario: Column) -> Column:
        return x * (F.lit(low) + scenario * F.lit(step)) > c

    # the crossing by division, then to the exact scenario by the comparison itself: rounding moves it by one at most
    near = F.greatest(F.lit(-1), F.least(F.lit(scenarios + 1), F.floor((F.try_divide(c.cast("double"), x.cast("double")) - low) / (step or 1.0)))).cast("int")
    first = F.greatest(near - 1, F.lit(0))

    def turn(holds: Callable[[Column], Column]) -> Column:
        found = F.when(holds(first), first)
        for i in (1, 2, 3):
            found = found.when(holds(first + i), first + i)
        return F.least(found.otherwise(scenarios), F.lit(scenarios))

    up = F.when(x > 0, turn(passes)).otherwise(0)
    end = F.when(x < 0, turn(lambda s: ~passes(s))).otherwise(scenarios)
    end = F.when((x <= 0) & ~passes(F.lit(0)), 0).otherwise(end)
    turns = df.filter(x.isNotNull() & c.isNotNull()).select(F.explode(F.array(F.struct(up.alias("scenario"), F.lit(1).alias("sign")), F.struct(end.alias("scenario"), F.lit(-1).alias("sign")))).alias("t"), x.alias("x"), c.alias("c")).select("t.*", "x", "c")
    deltas = turns.filter(F.col("scenario") < scenarios).groupBy("scenario").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("x")).alias("x"), F.sum(F.col("sign") * F.col("c")).alias("c"))
    every = df.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario"))
    # one row for each scenario, a parameter
    running = Window.orderBy("scenario")
    sums = every.join(deltas, "scenario", "left").select("scenario", *[F.sum(F.coalesce(k, F.lit(0))).over(running).alias(k) for k in ("n", "x", "c")])
    excess = F.col("x") * (F.lit(low) + F.col("scenario") * F.lit(step)) - F.col("c")
    return sums.select("scenario", F.col("n").alias("events"), F.when(F.col("n") > 0, excess).otherwise(F.lit(0.0)).alias("excess"))


def product(*frames: DataFrame) -> DataFrame:
    """All combinations of the rows of small dimension tables; which side is broadcast, if any, is left to Spark, which knows the sizes."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def fill_from_policy(requests: DataFrame, policies: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """Null fields of a request taken from its policy."""
    p = policies.select(on, *[F.col(f).alias(f"_p_{f}") for f in fields])
    both = requests.join(p, on, "left")
    return both.select(*[F.coalesce(c, f"_p_{c}").alias(c) if c in fields else F.col(c) for c in requests.columns])


def replicate(df: DataFrame, hot: Column, times: int) -> DataFrame:
    """Rows for which `hot` holds `times` more times, with their copy number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(hot, times).otherwise(0))))
