"""Running measures, ranks, latest records and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..sources.tables import materialise


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def change(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The difference to the previous row."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def ranked(df: DataFrame, order: Sequence[str | Column], value: str) -> DataFrame:
    """Adds rank (from 1) and running, the sum of value up to the row, over the whole table in `order` (which should be total).

    No task sees more than a range of the rows: ranges are ordered within themselves and moved by the counts and sums of those
    before, one row a range. The ranges are written to the shared folder, so counts and rows come from the same ones.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order)
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    rows = dealt.withColumns({"rank": F.row_number().over(inside), "running": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(moved, "_range")
    return rows.withColumns({"rank": F.col("rank") + F.col("_n"), "running": F.col("running") + F.col("_s")}).drop("_range", "_n", "_s")


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, greatest first (ties by key): amount, rank, share of the total in per cent, and the running share."""
    sums = df.groupBy(key).agg(F.sum(value).alias("amount"))
    placed = ranked(sums, [F.desc("amount"), F.col(key)], "amount")
    total = placed.agg(F.sum("amount").alias("_total"))
    return placed.crossJoin(F.broadcast(total)).select(key, "amount", F.col("rank").cast("int").alias("rank"), (F.col("amount") * 100 / F.col("_total")).alias("share"), (F.col("running") * 100 / F.col("_total")).alias("running_share"))


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("peak_so_far", F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], delta: str) -> DataFrame:
    return df.withColumn("level", F.sum(delta).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def exposure(df: DataFrame, by: Sequence[str], minute: str, order: Sequence[str], state: str) -> DataFrame:
    """Per group the integral of the state over time, in state x hours: each row holds from its minute to the next row's, or to midnight."""
    w = Window.partitionBy(*by).orderBy(*order)
    span = F.coalesce(F.lead(minute).over(w), F.lit(1440)) - F.col(minute)
    return df.withColumn("_part", F.col(state) * span / 60.0).groupBy(*by).agg(F.sum("_part").alias("exposure"))


def days_since(df: DataFrame, by: Sequence[str], day: str, happened: Column) -> DataFrame:
    """Days since `happened` last held, null before it first did."""
    last = F.last(F.when(happened, F.col(day)), ignorenulls=True).over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("days_since", F.datediff(day, last))


def lagged(df: DataFrame, by: Sequence[str], day: str, value: str, seed: float | int) -> DataFrame:
    return df.withColumn("previous", F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(day)), F.lit(seed)))


def halves(df: DataFrame, day: str) -> DataFrame:
    """Rows with period: reference for the first floor(n / 2) of the n distinct days, else current. Only distinct days are ranked."""
    days = df.select(day).distinct()
    n = days.agg(F.count("*").alias("_n"))
    split = days.withColumn("_r", F.row_number().over(Window.orderBy(day))).crossJoin(F.broadcast(n)).select(day, F.when(F.col("_r") <= F.floor(F.col("_n") / 2), "reference").otherwise("current").alias("period"))
    return df.join(split, day)


def surrogate_ids(df: DataFrame, key: str, form: str = "CP%04d") -> DataFrame:
    """Formatted numbers in key order, for the distinct keys of a dimension."""
    keys = df.select(key).distinct().withColumn("_none", F.lit(0))
    return ranked(keys, [key], "_none").select(key, F.format_string(form, "rank").alias("surrogate"))


def partition_sizes(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of each of n partitions that a hash of the key chooses."""
    return df.repartitionById(n, X.md5_bucket(F.col(key), n).cast("int")).groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def snapshot_changes(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows only in the new snapshot (firing) or only in the old one (resolved)."""
    o, n = old.select(*columns).distinct(), new.select(*columns).distinct()
    return n.join(o, list(columns), "left_anti").withColumn("change", F.lit("firing")).unionByName(o.join(n, list(columns), "left_anti").withColumn("change", F.lit("resolved")))


def union_checked(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames that must have the same columns and types."""
    out = frames[0]
    for f in frames[1:]:
        if sorted(f.dtypes) != sorted(out.dtypes):
            raise ValueError(f"schemas differ: {sorted(set(f.dtypes) ^ set(out.dtypes))}")
        out = out.unionByName(f)
    return out
