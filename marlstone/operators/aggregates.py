"""Grouped measures: rates, partial and final aggregation, salting, skew, audits, duplicates, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import ranked


def _double(x: Column) -> Column:
    return x.cast("double")


def rate_metrics(df: DataFrame, by: Sequence[str], outcome: str, score: str, flag: str) -> DataFrame:
    """Count, outcome sum and rate, mean score, share of a flag among known values, and the rate of unknown flags."""
    return df.groupBy(*by).agg(
        F.count("*").alias("days"), F.sum(outcome).alias("outcome_days"), F.avg(_double(F.col(outcome))).alias("outcome_rate"),
        F.avg(score).alias("mean_score"), F.avg(_double(F.col(flag))).alias("flag_share"), F.avg(_double(F.col(flag).isNull().cast("int"))).alias("flag_unknown_rate"))


def partial_metrics(df: DataFrame, by: Sequence[str], outcome: str, score: str, flag: str) -> DataFrame:
    """Additive measures only, so that partials of any grouping can be merged; nulls are counted apart."""
    return df.groupBy(*by).agg(
        F.count("*").alias("days"), F.sum(outcome).alias("outcome_days"), F.sum(score).alias("score_sum"), F.count(score).alias("score_known"),
        F.coalesce(F.sum(flag), F.lit(0)).alias("flag_sum"), F.count(flag).alias("flag_known"))


def merge_metrics(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum partials and compute the ratios last; a ratio over nothing is null."""
    s = partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("days", "outcome_days", "score_sum", "score_known", "flag_sum", "flag_known")])

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(_double(F.col(a)), _double(F.col(b)))

    return s.select(*by, "days", "outcome_days", ratio("outcome_days", "days").alias("outcome_rate"), ratio("score_sum", "score_known").alias("mean_score"),
                    ratio("flag_sum", "flag_known").alias("flag_share"), (F.lit(1.0) - ratio("flag_known", "days")).alias("flag_unknown_rate"))


def heavy_hashes(df: DataFrame, keys: Sequence[str], share: float = 0.02, tracked: int = 10_000) -> list[int]:
    """Hashes of the keys with about `share` of the rows or more, from one pass with a mergeable summary of `tracked` counters; 1 / share of them at most."""
    k = max(1, round(1 / share))
    rows = df.select(F.xxhash64(*keys).alias("h"))
    top, n = rows.agg(F.expr(f"approx_top_k(h, {k}, {max(tracked, k)})"), F.count("*")).first()
    return [r["item"] for r in top or [] if r["count"] >= share * n]


def salted_metrics(df: DataFrame, by: Sequence[str], outcome: str, score: str, flag: str, salt_from: Sequence[str], hot: Column | None = None, buckets: int = 8) -> DataFrame:
    """As rate_metrics, in two stages: rows for which `hot` holds, by default those of keys that are found to be heavy, spread over `buckets` first."""
    if hot is None:
        hot = F.xxhash64(*by).isin(heavy_hashes(df, by))
    salt = F.when(hot, F.pmod(F.xxhash64(*salt_from), F.lit(buckets))).otherwise(0)
    return merge_metrics(partial_metrics(df.withColumn("_salt", salt), [*by, "_salt"], outcome, score, flag), by)


def hot_keys(df: DataFrame, key: str, times_mean: float = 4.0) -> DataFrame:
    """Keys with more than times_mean times the mean group size."""
    sizes = df.groupBy(key).count()
    mean = sizes.agg(F.avg("count").alias("mean"))
    return sizes.crossJoin(F.broadcast(mean)).filter(F.col("count") > F.lit(times_mean) * F.col("mean")).select(key, "count")


def size_statistics(df: DataFrame, key: str) -> DataFrame:
    """One row: the number of groups, and the least, greatest and mean group size."""
    return df.groupBy(key).count().agg(F.count("*").alias("groups"), F.min("count").alias("least"), F.max("count").alias("most"), F.avg("count").alias("mean"))


def missingness(df: DataFrame, value: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows, missing values and their rate for each grouping set, in one pass; `grouping` tells the sets apart."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    missing = F.col(value).isNull().cast("int")
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), F.count("*").alias("n"), F.sum(missing).alias("missing"), F.avg(_double(missing)).alias("rate"))


def consistency(df: DataFrame, group: Sequence[str], value: str, threshold: float = 0.95) -> DataFrame:
    """Per group: known values, the share of its commonest value, and whether that makes it stable."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).count()
    return counts.groupBy(*group).agg(F.sum("count").alias("known"), F.max("count").alias("dominant"), F.count("*").alias("values")).withColumn("share", F.col("dominant") / F.col("known")).withColumn("stable", F.col("share") >= threshold)


def duplicate_statistics(df: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """One row: keys, duplicated keys, extra rows, keys with exact and with conflicting rows, and conflicts by field; nulls are values.

    Whether a key's rows differ is whether their least and greatest do, so a key's rows are combined before the shuffle.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in compare]
    per_key = df.select(*keys, *shown).groupBy(*keys).agg(F.count("*").alias("n"), (F.min(F.struct(*compare)) != F.max(F.struct(*compare))).alias("differ"), *[(F.min(c) != F.max(c)).alias(f"of_{c}") for c in compare])
    again = F.col("n") > 1

    def number(x: Column) -> Column:
        return F.coalesce(F.sum(x.cast("int")), F.lit(0)).cast("long")

    return per_key.agg(F.count("*").alias("keys"), number(again).alias("duplicated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows"), number(again & ~F.col("differ")).alias("exact_keys"), number(F.col("differ")).alias("conflicting_keys"), *[number(F.col(f"of_{c}")).alias(f"conflict_{c}") for c in compare])


def exact_duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat another in all columns."""
    return df.groupBy(*columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated_rows"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows (value, n), the `top` commonest, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top) if top else counts


def column_profile(df: DataFrame, columns: Sequence[str], top: int = 15) -> DataFrame:
    """Per column and value, for the `top` commonest values: (column, value, n, blank); a null counts as blank."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("blank", F.col("value") == "")


def status_histogram(df: DataFrame, fields: Sequence[str], suffix: str = "_status") -> DataFrame:
    """Rows (field, status, n) from one status column per field."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + suffix).alias("status")) for f in fields])).alias("e")).groupBy("e.field", "e.status").agg(F.count("*").alias("n"))


def named_aggregates(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("peak"))


def pivot_counts(df: DataFrame, by: str, column: str, values: Sequence[str]) -> DataFrame:
    """One count column per given value, 0 where there is none."""
    return df.groupBy(by).pivot(column, list(values)).count().fillna(0, subset=list(values))


def category_counts(df: DataFrame, by: str, category: str, values: Sequence[str], amount: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.count_if(F.col(category) == v).alias(f"{v}_count") for v in values], F.sum(amount).alias("total"), F.avg(amount).alias("mean"))


def joined_values(df: DataFrame, by: str, value: str, separator: str = " | ") -> DataFrame:
    """The sorted distinct values of each group in one text."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("values"))


def totals_agree(parts: DataFrame, wholes: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """Keys whose parts do not sum to the whole, within 1e-8 + 1e-5 of it."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("parts"))
    both = sums.join(wholes.select(key, F.col(whole).alias("whole")), key)
    return both.filter(F.abs(F.col("parts") - F.col("whole")) > F.lit(1e-8) + F.lit(1e-5) * F.abs("whole"))


def worst_of(df: DataFrame, by: str, level: str, order: Sequence[str]) -> DataFrame:
    """The severest level of each group, by place in `order`."""
    rank = F.max(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(level))).cast("int")
    return df.groupBy(by).agg(F.element_at(F.array(*[F.lit(o) for o in order]), rank).alias("worst"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R squared in one pass."""
    e = F.col(truth) - F.col(predicted)
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(truth))).alias("r2"))


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy and ROC-AUC of a 0/1 label; AUC by rank sums, ties sharing the average rank.

    Ranks are running counts over distinct scores, made in ranges of the score.
    """
    scores = df.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    placed = ranked(scores, [F.col(score)], "n").withColumn("rank", F.col("running") - F.col("n") + (F.col("n") + 1) / 2)
    auc = placed.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("s")).select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, _double(F.col("p") * F.col("q"))).alias("auc"))
    hit = (F.col(score) >= threshold).cast("int") == F.col(label)
    rates = df.agg(F.avg(_double(hit.cast("int"))).alias("accuracy"), ((F.avg(F.when(F.col(label) == 1, _double(hit.cast("int")))) + F.avg(F.when(F.col(label) == 0, _double(hit.cast("int"))))) / 2).alias("balanced_accuracy"))
    return rates.crossJoin(auc)
