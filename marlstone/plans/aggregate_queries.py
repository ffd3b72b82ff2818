"""Queries on grouped measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.selection import exact_medians, exact_quantiles
from .registry import Source, query

KEY = ["district_id", "academic_year"]
METRICS = """count(*) AS days, CAST(sum(absent) AS BIGINT) AS outcome_days, round(avg(CAST(absent AS DOUBLE)), 9) AS outcome_rate, round(avg(deprivation_score), 9) AS mean_score,
  round(avg(CAST(rural AS DOUBLE)), 9) AS flag_share, round(avg(CASE WHEN rural IS NULL THEN 1.0 ELSE 0.0 END), 9) AS flag_unknown_rate"""


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are compared rounded."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a01_district_year_metrics", f"SELECT district_id, academic_year, {METRICS} FROM {{attendance}} a GROUP BY district_id, academic_year")
def _(s: Source) -> DataFrame:
    return rounded(A.rate_metrics(s.view("attendance"), KEY, "absent", "deprivation_score", "rural"))


@query("a02_district_totals", "SELECT district_id, count(*) AS n, CAST(sum(absent) AS BIGINT) AS absent_days, round(sum(absent) / CAST(count(*) AS DOUBLE), 9) AS rate FROM {attendance} a GROUP BY district_id")
def _(s: Source) -> DataFrame:
    return rounded(s.view("attendance").groupBy("district_id").agg(F.count("*").alias("n"), F.sum("absent").alias("absent_days"), (F.sum("absent") / F.count("*")).alias("rate")))


@query("a03_partial_metrics", "SELECT district_id, academic_year, CAST(k % 4 AS INT) AS bucket, count(*) AS days, CAST(sum(absent) AS BIGINT) AS outcome_days, round(sum(deprivation_score), 6) AS score_sum, count(deprivation_score) AS score_known, CAST(coalesce(sum(rural), 0) AS BIGINT) AS flag_sum, count(rural) AS flag_known FROM {attendance} a GROUP BY 1, 2, 3")
def _(s: Source) -> DataFrame:
    df = s.view("attendance").withColumn("bucket", (F.col("k") % 4).cast("int"))
    return rounded(A.partial_metrics(df, [*KEY, "bucket"], "absent", "deprivation_score", "rural"), 6)


@query("a04_merged_partials", f"SELECT district_id, academic_year, {METRICS} FROM {{attendance}} a GROUP BY district_id, academic_year")
def _(s: Source) -> DataFrame:
    df = s.view("attendance").withColumn("bucket", F.pmod(F.xxhash64("student_id"), F.lit(4)))
    return rounded(A.merge_metrics(A.partial_metrics(df, [*KEY, "bucket"], "absent", "deprivation_score", "rural"), KEY))


@query("a05_salted_metrics", f"SELECT district_id, academic_year, {METRICS} FROM {{skewed}} a GROUP BY district_id, academic_year")
def _(s: Source) -> DataFrame:
    return rounded(A.salted_metrics(s.view("skewed"), KEY, "absent", "deprivation_score", "rural", ["student_id"]))


@query("a05_hot_keys", "WITH c AS (SELECT district_id, count(*) AS count FROM {skewed} a GROUP BY 1) SELECT district_id, count FROM c WHERE count > 4 * (SELECT avg(count) FROM c)")
def _(s: Source) -> DataFrame:
    return A.hot_keys(s.view("skewed"), "district_id")


@query("a06_group_median", "SELECT district_id, academic_year, round(median(deprivation_score), 9) AS median_score FROM {attendance} a GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    keys = s.view("attendance").select(*KEY).distinct()
    return rounded(keys.join(exact_medians(s.view("attendance"), "deprivation_score", KEY).select(*KEY, F.col("median").alias("median_score")), list(KEY), "left"))


@query("a06_skewed_median", "SELECT district_id, count(deprivation_score) AS n, round(median(deprivation_score), 9) AS median_score FROM {skewed} s GROUP BY 1 HAVING count(deprivation_score) > 0")
def _(s: Source) -> DataFrame:
    """One district with most of the rows, whose median is found by selection."""
    return rounded(exact_medians(s.view("skewed"), "deprivation_score", ["district_id"], limit=1000).withColumnRenamed("median", "median_score"))


@query("a07_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.9), 6) AS q90, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM {lineitem}")
def _(s: Source) -> DataFrame:
    found = exact_quantiles(s.table("lineitem"), "l_extendedprice", [0.9, 0.95], limit=5000)
    return rounded(found.select(F.get("quantiles", F.lit(0)).alias("q90"), F.get("quantiles", F.lit(1)).alias("q95")), 6)


@query("a08_common_values", "SELECT source AS value, count(*) AS n FROM {documents} GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def _(s: Source) -> DataFrame:
    return A.value_counts(s.table("documents"), "source", 5)


@query("a09_size_statistics", "SELECT count(*) AS groups, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM (SELECT count(*) AS n FROM {skewed} a GROUP BY district_id)")
def _(s: Source) -> DataFrame:
    return rounded(A.size_statistics(s.view("skewed"), "district_id"))


@query("a10_missingness", """SELECT academic_year, rural, absent, district_id, CAST(grouping_id(academic_year, rural, absent, district_id) AS BIGINT) AS grouping, count(*) AS n,
  CAST(sum(CASE WHEN deprivation_score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(avg(CASE WHEN deprivation_score IS NULL THEN 1.0 ELSE 0.0 END), 9) AS rate
  FROM {attendance} a GROUP BY GROUPING SETS ((), (academic_year), (rural), (absent), (district_id, academic_year))""")
def _(s: Source) -> DataFrame:
    return rounded(A.missingness(s.view("attendance"), "deprivation_score", [[], ["academic_year"], ["rural"], ["absent"], ["district_id", "academic_year"]]))


@query("a11_consistency", """SELECT school_code, CAST(sum(n) AS BIGINT) AS known, max(n) AS dominant, count(*) AS "values", round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS share, max(n) / CAST(sum(n) AS DOUBLE) >= 0.95 AS stable
  FROM (SELECT school_code, rural, count(*) AS n FROM {attendance} a WHERE rural IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def _(s: Source) -> DataFrame:
    return rounded(A.consistency(s.view("attendance"), ["school_code"], "rural"))


@query("a12_duplicate_statistics", """WITH f AS (SELECT student_id, academic_year, coalesce(CAST(district_id AS STRING), '') d, coalesce(CAST(absent AS STRING), '') a, coalesce(CAST(deprivation_score AS STRING), '') s, coalesce(CAST(rural AS STRING), '') r, coalesce(school_code, '') c FROM {enrolment_dups} e),
  k AS (SELECT count(*) n, count(DISTINCT (d, a, s, r, c)) forms, count(DISTINCT d) fd, count(DISTINCT a) fa, count(DISTINCT s) fs, count(DISTINCT r) fr, count(DISTINCT c) fc FROM f GROUP BY student_id, academic_year)
  SELECT count(*) AS keys, count(*) FILTER (n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) FILTER (n > 1 AND forms = 1) AS exact_keys, count(*) FILTER (forms > 1) AS conflicting_keys,
  count(*) FILTER (fd > 1) AS conflict_district_id, count(*) FILTER (fa > 1) AS conflict_absent, count(*) FILTER (fs > 1) AS conflict_deprivation_score, count(*) FILTER (fr > 1) AS conflict_rural, count(*) FILTER (fc > 1) AS conflict_school_code FROM k""")
def _(s: Source) -> DataFrame:
    return A.duplicate_statistics(s.view("enrolment_dups"), ["student_id", "academic_year"], ["district_id", "absent", "deprivation_score", "rural", "school_code"])


@query("a13_exact_duplicates", "SELECT CAST(sum(n - 1) AS BIGINT) AS repeated_rows FROM (SELECT count(*) n FROM {enrolment_dups} e GROUP BY student_id, district_id, academic_year, absent, deprivation_score, rural, school_code)")
def _(s: Source) -> DataFrame:
    return A.exact_duplicate_rows(s.view("enrolment_dups"), ["student_id", "district_id", "academic_year", "absent", "deprivation_score", "rural", "school_code"])


@query("a17_column_profile", """SELECT * FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value = '' AS blank FROM (
  SELECT 'district_id' AS "column", district_id AS value, count(*) AS n FROM {messy} m GROUP BY 2 UNION ALL SELECT 'absent', absent, count(*) FROM {messy} m GROUP BY 2 UNION ALL SELECT 'rural', rural, count(*) FROM {messy} m GROUP BY 2)) WHERE rank <= 15""")
def _(s: Source) -> DataFrame:
    return A.column_profile(s.view("messy"), ["district_id", "absent", "rural"])


@query("a18_category_counts", """SELECT p_brand, count(*) FILTER (band = 'small') AS small_count, count(*) FILTER (band = 'medium') AS medium_count, count(*) FILTER (band = 'large') AS large_count, round(sum(p_retailprice), 4) AS total, round(avg(p_retailprice), 4) AS mean
  FROM (SELECT *, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS band FROM {part}) GROUP BY 1""")
def _(s: Source) -> DataFrame:
    band = F.when(F.col("p_size") < 15, "small").when(F.col("p_size") < 35, "medium").otherwise("large")
    return rounded(A.category_counts(s.table("part").withColumn("band", band), "p_brand", "band", ["small", "medium", "large"], "p_retailprice"), 4)


@query("a19_named_aggregates", "SELECT l_suppkey, count(l_quantity) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS peak FROM {lineitem} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.table("lineitem").groupBy("l_suppkey").agg(F.count("l_quantity").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.max("l_quantity").alias("peak"))


@query("a20_constant_in_group", "SELECT o_custkey, min(c_name) AS name, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1")
def _(s: Source) -> DataFrame:
    joined = s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_custkey").agg(F.min("c_name").alias("name"), F.count("*").alias("n"))


@query("a21_last_by_date", "SELECT zone, count(*) FILTER (load_c > 20000000) AS heavy_days, max(peak_c) AS peak, CAST(arg_max(load_c, day) AS BIGINT) AS last_load FROM {panel} p GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("panel").groupBy("zone").agg(F.count_if(F.col("load_c") > 20000000).alias("heavy_days"), F.max("peak_c").alias("peak"), F.max_by("load_c", "day").alias("last_load"))


@query("a22_pivot_events", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "refund")) + " FROM {events} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return A.pivot_counts(s.table("events"), "user_id", "event_type", ["click", "error", "purchase", "refund"])


@query("a23_scenario_summary", "SELECT CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS scenario, count(*) AS n, round(avg(load_c) / 1000, 2) AS mean_thousands FROM {panel} p GROUP BY 1")
def _(s: Source) -> DataFrame:
    scenario = F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday")
    return s.view("panel").groupBy(scenario.alias("scenario")).agg(F.count("*").alias("n"), F.round(F.avg("load_c") / 1000, 2).alias("mean_thousands"))


@query("a24_finite_summary", "SELECT src, round(median(w), 4) AS middle, round(avg(w), 4) AS mean, max(w) AS most FROM {edges} e WHERE w < 1000 GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("edges").filter(F.col("w") < 1000).groupBy("src").agg(F.round(F.median("w"), 4).alias("middle"), F.round(F.avg("w"), 4).alias("mean"), F.max("w").alias("most"))


@query("a25_mean_of_daily_sums", "SELECT round(avg(t), 2) AS mean_daily, count(DISTINCT day) AS days, CAST(sum(n) AS BIGINT) AS rows_seen FROM (SELECT day, sum(load_c) AS t, count(*) AS n FROM {panel} p GROUP BY 1)")
def _(s: Source) -> DataFrame:
    daily = s.view("panel").groupBy("day").agg(F.sum("load_c").alias("t"), F.count("*").alias("n"))
    return daily.agg(F.round(F.avg("t"), 2).alias("mean_daily"), F.countDistinct("day").alias("days"), F.sum("n").alias("rows_seen"))


@query("a26_regression_metrics", """SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 9) AS r2
  FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM {lineitem})""")
def _(s: Source) -> DataFrame:
    df = s.table("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    m = A.regression_metrics(df, "y", "p")
    return m.select("n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("r2", 9).alias("r2"))


@query("a27_classification_metrics", """WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_quantity / 50 AS DOUBLE) AS p FROM {lineitem}), r AS (SELECT p, sum(y) AS pos, count(*) AS n FROM d GROUP BY 1),
  k AS (SELECT *, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2.0 AS rank FROM r)
  SELECT round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 9) AS accuracy, round((avg(CAST(p >= 0.5 AS INT)) FILTER (y = 1) + avg(CAST(p < 0.5 AS INT)) FILTER (y = 0)) / 2, 9) AS balanced_accuracy,
  round((SELECT (sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / CAST(sum(pos) * sum(n - pos) AS DOUBLE) FROM k), 9) AS auc FROM d""")
def _(s: Source) -> DataFrame:
    df = s.table("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).cast("double").alias("p"))
    return rounded(A.classification_metrics(df, "y", "p"))


@query("a28_period_statistics", """SELECT period, round(avg(load_c), 3) AS mean, round(stddev_samp(load_c), 3) AS deviation FROM (SELECT CASE WHEN day < DATE '1998-04-01' THEN 'reference' ELSE 'current' END AS period, load_c FROM {panel} p) GROUP BY 1""")
def _(s: Source) -> DataFrame:
    period = F.when(F.col("day") < F.lit("1998-04-01").cast("date"), "reference").otherwise("current")
    return rounded(s.view("panel").groupBy(period.alias("period")).agg(F.avg("load_c").alias("mean"), F.stddev_samp("load_c").alias("deviation")), 3)


@query("a29_token_counts", r"SELECT w AS value, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n]+')) AS w FROM {documents}) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def _(s: Source) -> DataFrame:
    words = s.table("documents").select(F.explode(F.split(F.lower("text"), "[ \t\n]+")).alias("w")).filter("w <> ''")
    return A.value_counts(words, "w", 50)


@query("a30_word_count", r"SELECT doc_id, CASE WHEN text IS NULL OR trim(text, E' \t\n') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \t\n'), '[ \t\n]+')) END AS words FROM {documents}")
def _(s: Source) -> DataFrame:
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "^[ \t\n]+|[ \t\n]+$", "")
    return s.table("documents").select("doc_id", F.when(clean == "", 0).otherwise(F.size(F.split(clean, "[ \t\n]+"))).cast("long").alias("words"))


@query("a31_joined_values", "SELECT p_brand, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS \"values\" FROM {part} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return A.joined_values(s.table("part"), "p_brand", "p_type")


@query("a32_totals_agree", "SELECT o_orderkey, CAST(parts AS BIGINT) AS parts, CAST(whole AS BIGINT) AS whole FROM (SELECT l_orderkey AS o_orderkey, sum(CAST(round(l_extendedprice) AS BIGINT)) AS parts FROM {lineitem} GROUP BY 1) JOIN (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS whole FROM {orders}) USING (o_orderkey) WHERE abs(parts - whole) > 1e-8 + 1e-5 * abs(whole)")
def _(s: Source) -> DataFrame:
    parts = s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.round("l_extendedprice").cast("long").alias("p"))
    wholes = s.table("orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("w"))
    return A.totals_agree(parts, wholes, "o_orderkey", "p", "w")


@query("a33_worst_level", "SELECT o_custkey, ['ALLOW', 'CONTROLLED', 'REVIEW', 'BLOCK'][CAST(max(o_orderkey % 4) + 1 AS INT)] AS worst FROM {orders} GROUP BY 1")
def _(s: Source) -> DataFrame:
    order = ["ALLOW", "CONTROLLED", "REVIEW", "BLOCK"]
    level = F.element_at(F.array(*[F.lit(o) for o in order]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return A.worst_of(s.table("orders").withColumn("level", level), "o_custkey", "level", order)


@query("a34_price_bands", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n FROM {part} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.table("part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count("*").alias("n"))
