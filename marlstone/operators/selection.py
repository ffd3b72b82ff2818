"""Exact quantiles of groups of any size: ranks are hunted down by mergeable summaries and counts, never by a buffer of a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Values of a summary at evenly spaced ranks, and the inverse of its error.
GRID, ACCURACY = 256, 10_000


def _on(left: str, right: str, by: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by), F.lit(True))


def _hunt(rows: DataFrame, open_: DataFrame, by: Sequence[str]) -> DataFrame:
    """One round for the ranks in open_ (by, rank, lo, hi, below, inside, answer): each gets its answer or a narrower open interval lo..hi, with the rows below and inside it."""
    def within(lo: str, hi: str) -> Column:
        return F.coalesce(F.col("r.v") > F.col(lo), F.lit(True)) & F.coalesce(F.col("r.v") < F.col(hi), F.lit(True))

    ranges = open_.select(*by, "lo", "hi").distinct()
    met = rows.alias("r").join(ranges.alias("t"), _on("r", "t", by) & within("t.lo", "t.hi"))
    summary = materialise(met.groupBy(*[F.col(f"t.{c}").alias(c) for c in (*by, "lo", "hi")]).agg(F.percentile_approx("r.v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("edges")), "summaries")
    same = _on("o", "s", by) & F.col("o.lo").eqNullSafe(F.col("s.lo")) & F.col("o.hi").eqNullSafe(F.col("s.hi"))
    place = F.floor((F.col("o.rank") - F.col("o.below")) * GRID / F.greatest(F.col("o.inside") - 1, F.lit(1))).cast("int")
    asked = open_.alias("o").join(summary.alias("s"), same).select("o.*", F.get("s.edges", F.greatest(place - 1, F.lit(0))).alias("a"), F.get("s.edges", F.least(place + 2, F.lit(GRID))).alias("b"))
    counts = {n: F.count_if(c) for n, c in (("below_a", F.col("r.v") < F.col("t.a")), ("to_a", F.col("r.v") <= F.col("t.a")), ("below_b", F.col("r.v") < F.col("t.b")), ("to_b", F.col("r.v") <= F.col("t.b")))}
    names = [*by, "rank", "lo", "hi", "below", "inside", "a", "b"]
    known = rows.alias("r").join(asked.alias("t"), _on("r", "t", by) & within("t.lo", "t.hi")).groupBy(*[F.col(f"t.{c}").alias(c) for c in names]).agg(*[c.alias(n) for n, c in counts.items()])
    k, a, b = F.col("rank") - F.col("below"), F.col("a"), F.col("b")
    low, middle = k < F.col("below_a"), (k >= F.col("to_a")) & (k < F.col("below_b"))
    answer = F.when((k >= F.col("below_a")) & (k < F.col("to_a")), a).when((k >= F.col("below_b")) & (k < F.col("to_b")), b)
    lo, hi = F.when(low, F.col("lo")).when(middle, a).otherwise(b), F.when(low, a).when(middle, b).otherwise(F.col("hi"))
    gone = F.when(low, F.lit(0)).when(middle, F.col("to_a")).otherwise(F.col("to_b"))
    left = F.when(low, F.col("below_a")).when(middle, F.col("below_b") - F.col("to_a")).otherwise(F.col("inside") - F.col("to_b"))
    return known.select(*by, "rank", lo.alias("lo"), hi.alias("hi"), (F.col("below") + gone).alias("below"), left.alias("inside"), answer.alias("answer"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), limit: int = 100_000) -> DataFrame:
    """Rows (by, n, quantiles): the exact quantiles of value in each group, linear between the two nearest ranks, in the order of probs, with the number of values.

    Groups of up to `limit` values are left to Spark's own buffer. In larger ones each rank is narrowed down: a mergeable summary of the values left gives two that are sure to lie about
    it, exact counts confirm them, and the rows between, about 3 in GRID, go on, until a rank is met or at most `limit` values are left, which are sorted. No task holds more than a
    summary or `limit` values of a group, however skewed. Nulls do not count and NaN is the largest; null keys are a group; groups without a value have no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0")
    large = materialise(sizes.filter(F.col("n") > limit), "large-groups")
    plain = F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("quantiles")
    if large.isEmpty():
        return rows.groupBy(*by).agg(F.count("*").alias("n"), plain).filter("n > 0")
    small = rows.alias("r").join(large.alias("l"), _on("r", "l", by), "left_anti").groupBy(*by).agg(F.count("*").alias("n"), plain).filter("n > 0")

    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)])))
    null = F.lit(None).cast("double")
    open_ = large.select(*by, ranks.alias("rank"), null.alias("lo"), null.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), null.alias("answer"))
    hunted = rows.alias("r").join(large.alias("l"), _on("r", "l", by), "left_semi")
    met = []
    while True:
        state = materialise(_hunt(hunted, open_, by), "ranks")
        met.append(state.filter(F.col("answer").isNotNull()).select(*by, "rank", "answer"))
        few = state.filter(F.col("answer").isNull() & (F.col("inside") <= limit))
        inner = hunted.alias("r").join(few.alias("t"), _on("r", "t", by) & F.coalesce(F.col("r.v") > F.col("t.lo"), F.lit(True)) & F.coalesce(F.col("r.v") < F.col("t.hi"), F.lit(True)))
        sorted_ = inner.groupBy(*[F.col(f"t.{c}").alias(c) for c in (*by, "rank", "below")]).agg(F.array_sort(F.collect_list("r.v")).alias("v"))  # `limit` values at most
        met.append(sorted_.select(*by, "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("answer")))
        open_ = state.filter(F.col("answer").isNull() & (F.col("inside") > limit))
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, met).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "answer"))).alias("at"))  # two ranks a quantile
    both = large.alias("l").join(found.alias("f"), _on("l", "f", by)).select("l.*", "f.at")

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return small.unionByName(both.select(*by, "n", F.array(*[between(p) for p in at]).alias("quantiles")))


def exact_medians(df: DataFrame, value: str, by: Sequence[str] = (), limit: int = 100_000) -> DataFrame:
    """Rows (by, n, median)."""
    return exact_quantiles(df, value, [0.5], by, limit).select(*by, "n", F.get("quantiles", F.lit(0)).alias("median"))
