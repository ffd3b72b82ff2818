"""Cleaning, quarantine, duplicate resolution, imputation and comparison of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N
from .selection import exact_medians

FIELDS = ("student_id", "district_id", "academic_year", "absent", "deprivation_score", "rural", "school_code")


def canonical_names(df: DataFrame, synonyms: dict[str, str] = N.SYNONYMS) -> DataFrame:
    """Columns renamed through the synonyms."""
    return df.withColumnsRenamed({c: synonyms[c] for c in df.columns if c in synonyms})


def read_variants(frames: Sequence[DataFrame], canonical: Sequence[str] = FIELDS, synonyms: dict[str, str] = N.SYNONYMS) -> DataFrame:
    """Frames of several header dialects as one, in canonical names and order; a dialect that lacks a name is an error."""
    named = [canonical_names(f, synonyms) for f in frames]
    for f in named:
        if lacking := set(canonical) - set(f.columns):
            raise ValueError(f"no column for {sorted(lacking)}")
    return reduce(DataFrame.unionByName, [f.select(*canonical, *[c for c in f.columns if c not in canonical]) for f in named])


def clean_records(df: DataFrame) -> DataFrame:
    """Seven values and their statuses, and quarantine_reason; other columns are kept as they are."""
    # texts are trimmed first, and every field is worked out from these, so that no expression contains another's cases
    t = {c: F.col(f"_t_{c}") for c in FIELDS}
    done = df.withColumns({f"_t_{c}": N.trimmed(F.col(c)) for c in FIELDS}).withColumns({
        "_student": N.student(t["student_id"]), "_school": N.school(t["school_code"]), "_district": N.district(t["district_id"], t["school_code"]), "_year": N.year(t["academic_year"], t["student_id"]),
        "_absent": N.binary(t["absent"], N.ABSENT_ZERO, N.ABSENT_ONE), "_rural": N.binary(t["rural"], N.RURAL_ZERO, N.RURAL_ONE), "_score": N.share(t["deprivation_score"])})
    held = {"student_id": "_student", "district_id": "_district", "academic_year": "_year", "absent": "_absent", "deprivation_score": "_score", "rural": "_rural", "school_code": "_school"}
    reason = N.quarantine_reason(student=F.col("_student.value") == "", district=F.col("_district.value").isNull(), year=F.col("_year.value").isNull(), absent=F.col("_absent.value").isNull())
    rest = [F.col(c) for c in df.columns if c not in FIELDS]
    return done.select(*[F.col(f"{s}.value").alias(c) for c, s in held.items()], *[F.col(f"{s}.status").alias(f"{c}_status") for c, s in held.items()], *rest, reason.alias("quarantine_reason"))


def split_quarantine(df: DataFrame, reason: str = "quarantine_reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def resolve_duplicates(df: DataFrame, keys: Sequence[str], compare: Sequence[str], order: Sequence[str], repairable: str = "school_code", blocking: str = "absent", valid: Column | None = None) -> DataFrame:
    """Rows with duplicate_count, duplicate_resolution and conflict_reason (null for rows that stay).

    Of a key's rows: one stays as unique; if all compared fields agree, or only `repairable` differs, the first row in `order` stays (in
    the latter case with the single valid value of that field, or an empty text); a conflict in `blocking`, or in any other field,
    puts all rows of the key aside with a reason. Nulls are compared as empty texts.

    Forms are counted per key by one aggregation and joined back, so a key with very many rows is not held in one window; the
    first row is a grouped minimum.
    """
    valid = F.col(repairable).rlike(r"^SCH-\d{3}-\d{2}$") if valid is None else valid
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in compare}
    groups = df.groupBy(*keys).agg(F.count("*").alias("duplicate_count"), *[(F.min(x) != F.max(x)).alias(f"_of_{c}") for c, x in shown.items()], F.min(F.when(valid, F.col(repairable))).alias("_least"), F.max(F.when(valid, F.col(repairable))).alias("_most"), F.min(F.struct(*order)).alias("_first"))
    others = [c for c in compare if c != repairable]
    any_conflict = reduce(lambda a, b: a | b, [F.col(f"_of_{c}") for c in compare])
    other_conflict = reduce(lambda a, b: a | b, [F.col(f"_of_{c}") for c in others])
    names = F.upper(F.concat_ws("_", *[F.when(F.col(f"_of_{c}"), F.lit(c)) for c in sorted(compare)]))
    judged = groups.withColumns({
        "conflict_reason": F.when(F.col(f"_of_{blocking}"), F.lit(f"CONFLICTING_{blocking.upper()}" if blocking != "absent" else "CONFLICTING_ABSENCE")).when(other_conflict, F.concat(F.lit("CONFLICTING_"), names)),
        "duplicate_resolution": F.when(F.col("duplicate_count") == 1, "unique").when(~any_conflict, "exact_duplicate_collapsed").when(~other_conflict, "school_conflict_preserved").otherwise("quarantined")})
    both = df.join(judged.select(*keys, "duplicate_count", "duplicate_resolution", "conflict_reason", "_first", "_least", "_most"), list(keys))
    first = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_first.{c}")) for c in order])
    kept = both.filter(F.col("conflict_reason").isNotNull() | first)
    repaired = F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise("")
    out = kept.withColumn(repairable, F.when(F.col("duplicate_resolution") == "school_conflict_preserved", repaired).otherwise(F.col(repairable)))
    return out.drop("_first", "_least", "_most")


def impute_group_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """value filled by its group's median, with value_imputed (0/1) and imputation_method."""
    medians = exact_medians(df, value, by).select(*by, F.col("median").alias("_median"))
    both = df.join(medians, list(by), "left")
    was = F.col(value)
    method = F.when(was.isNotNull(), "observed_or_repaired").when(F.col("_median").isNotNull(), "group_median").otherwise("unresolved_no_group_median")
    return both.withColumns({"imputation_method": method, f"{value}_imputed": (was.isNull() & F.col("_median").isNotNull()).cast("int"), value: F.coalesce(was, "_median")}).drop("_median")


def flag_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_missing", F.col(column).isNull().cast("int"))


def compare_tables(expected: DataFrame, actual: DataFrame, keys: Sequence[str], exact: Sequence[str], approx: Sequence[str], relative: float = 1e-12, absolute: float = 1e-12) -> DataFrame:
    """Rows (keys, problem) where the tables differ: missing and extra keys, and names of differing columns; an expected null is not compared."""
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in (*exact, *approx)], F.lit(True).alias("in_e"))
    a = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (*exact, *approx)], F.lit(True).alias("in_a"))
    both = e.join(a, list(keys), "full")
    off = [F.when(F.col(f"e_{c}").isNotNull() & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in exact]
    for c in approx:
        near = F.abs(F.col(f"e_{c}") - F.col(f"a_{c}")) <= F.greatest(F.lit(relative) * F.greatest(F.abs(f"e_{c}"), F.abs(f"a_{c}")), F.lit(absolute))
        off.append(F.when(F.col(f"e_{c}").isNotNull() & ~F.coalesce(near, F.lit(False)), F.lit(c)))
    problem = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "extra").otherwise(F.concat_ws(",", *off))
    return both.withColumn("problem", problem).filter("problem <> ''").select(*keys, "problem")


def quality_counts(df: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """Rows (field, direct, review, missing, direct_rate)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("ok"), N.is_missing(N.trimmed(F.col(n))).alias("gone")) for n, v in valid.items()])).alias("e")).select("e.*")
    return long.groupBy("field").agg(F.count_if("ok").alias("direct"), F.count_if(~F.col("ok") & ~F.col("gone")).alias("review"), F.count_if("gone").alias("missing"), F.avg(F.col("ok").cast("int").cast("double")).alias("direct_rate"))


def valid_field_counts(df: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """Rows (valid_fields, n) from the number of fields down to 0, with zeros."""
    n = sum((v.cast("int") for v in valid.values()), F.lit(0))
    counts = df.groupBy(n.cast("long").alias("valid_fields")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(valid) + 1).withColumnRenamed("id", "valid_fields")
    return every.join(counts, "valid_fields", "left").fillna(0, ["n"])


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An upsert: the rows of both, those of `new` in place of old ones with their key; of equal keys in new the greatest row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct("_v", *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `new` to append: those whose key is neither in old nor earlier in new (the least row of a key counts)."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_b")).select(*keys, "_b.*") if rest else new.distinct()
    return once.select(new.columns).join(old.select(*keys), list(keys), "left_anti")


def newest_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
