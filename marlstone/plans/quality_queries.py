"""Queries on cleaning, quarantine, duplicates and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import aggregates as A
from ..operators import quality as Q
from .aggregate_queries import rounded
from .registry import Source, query, view

MARKERS = "('', '?', '-', 'unknown', 'n/a', 'na', 'missing')"
_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
view("clean_ids", rf"""
SELECT *, CASE WHEN lower(st) IN {MARKERS} THEN '' WHEN regexp_matches(st, '^STU-\d{{4}}_\d+$') THEN substr(st, 5) WHEN regexp_matches(st, '^\d{{4}}-\d+$') THEN replace(st, '-', '_') ELSE st END AS student_v,
  CASE WHEN lower(st) IN {MARKERS} THEN 'unresolved' WHEN regexp_matches(st, '^\d{{4}}_\d+$') THEN 'direct' WHEN regexp_matches(st, '^STU-\d{{4}}_\d+$') OR regexp_matches(st, '^\d{{4}}-\d+$') THEN 'normalized' ELSE 'unresolved' END AS student_s,
  CASE WHEN lower(school_code) IN {MARKERS} THEN '' ELSE school_code END AS school_v, CASE WHEN regexp_matches(school_code, '^SCH-\d{{3}}-\d{{2}}$') THEN 'direct' ELSE 'unresolved' END AS school_s,
  TRY_CAST(CASE WHEN regexp_matches(district_id, '^\d{{1,9}}$') AND CAST(district_id AS INT) BETWEEN 1 AND 250 THEN district_id END AS INT) AS d1,
  TRY_CAST(CASE WHEN regexp_matches(district_id, '^(?i)(district\s+|dist\s+|dist\.\s*|d)\d{{1,3}}$') AND CAST(regexp_extract(district_id, '(\d+)$', 1) AS INT) BETWEEN 1 AND 250 THEN regexp_extract(district_id, '(\d+)$', 1) END AS INT) AS d2,
  TRY_CAST(NULLIF(regexp_extract(school_code, '^SCH-(\d{{3}})-\d{{2}}$', 1), '') AS INT) AS d3
FROM (SELECT *, trim(student_id) AS st FROM {{messy}} m)""")
view("cleaned", rf"""
SELECT k, student_v AS student_id, student_s AS student_id_status, school_v AS school_code, school_s AS school_code_status, coalesce(d1, d2, d3) AS district_id,
  CASE WHEN d1 IS NOT NULL THEN 'direct' WHEN d2 IS NOT NULL THEN 'normalized' WHEN d3 IS NOT NULL THEN 'recovered_from_school' ELSE 'unresolved' END AS district_id_status,
  CASE WHEN academic_year IN ('2022', '2023', '2024', '2025') THEN CAST(academic_year AS INT) WHEN academic_year IN ('22', '23', '24', '25') THEN 2000 + CAST(academic_year AS INT)
    WHEN regexp_matches(academic_year, '^202[2-5]/\d{{4}}$') THEN CAST(substr(academic_year, 1, 4) AS INT) WHEN regexp_matches(student_v, '^202[2-5]_') THEN CAST(substr(student_v, 1, 4) AS INT) END AS academic_year,
  CASE WHEN academic_year IN ('2022', '2023', '2024', '2025') THEN 'direct' WHEN academic_year IN ('22', '23', '24', '25') OR regexp_matches(academic_year, '^202[2-5]/\d{{4}}$') THEN 'normalized'
    WHEN regexp_matches(student_v, '^202[2-5]_') THEN 'recovered_from_student_id' ELSE 'unresolved' END AS academic_year_status,
  CASE WHEN lower(absent) IN ('0', 'n', 'no', 'p', 'present') THEN 0 WHEN lower(absent) IN ('1', 'y', 'yes', 'a', 'absent') THEN 1 END AS absent,
  CASE WHEN absent IN ('0', '1') THEN 'direct' WHEN lower(absent) IN ('n', 'no', 'p', 'present', 'y', 'yes', 'a', 'absent') THEN 'normalized' ELSE 'unresolved' END AS absent_status,
  CASE WHEN lower(rural) IN ('0', 'n', 'no', 'u', 'urban') THEN 0 WHEN lower(rural) IN ('1', 'y', 'yes', 'r', 'rural') THEN 1 END AS rural,
  CASE WHEN rural IN ('0', '1') THEN 'direct' WHEN lower(rural) IN ('n', 'no', 'u', 'urban', 'y', 'yes', 'r', 'rural') THEN 'normalized' ELSE 'unresolved' END AS rural_status,
  CASE WHEN pc BETWEEN 0 AND 1 THEN pc WHEN num BETWEEN 0 AND 1 THEN num WHEN num > 1 AND num <= 100 THEN num / 100 END AS deprivation_score,
  CASE WHEN pc BETWEEN 0 AND 1 THEN 'normalized' WHEN num BETWEEN 0 AND 1 THEN 'direct' WHEN num > 1 AND num <= 100 THEN 'normalized' ELSE 'unresolved' END AS deprivation_score_status
FROM (SELECT *, TRY_CAST(CASE WHEN regexp_matches(t, {_NUMBER}) THEN t END AS DOUBLE) AS num, TRY_CAST(CASE WHEN t LIKE '%\%%' ESCAPE '\' AND regexp_matches(replace(t, '%', ''), {_NUMBER}) THEN replace(t, '%', '') END AS DOUBLE) / 100 AS pc
  FROM (SELECT *, replace(deprivation_score, ',', '.') AS t FROM {{clean_ids}} i))""")
REASON = "NULLIF('UNRESOLVED_' || concat_ws('_', CASE WHEN student_id = '' THEN 'STUDENT' END, CASE WHEN district_id IS NULL THEN 'DISTRICT' END, CASE WHEN academic_year IS NULL THEN 'YEAR' END, CASE WHEN absent IS NULL THEN 'ABSENT' END), 'UNRESOLVED_')"
FIELD = {"n01_student": "student_id", "n02_school": "school_code", "n04_district": "district_id", "n05_year": "academic_year", "n06_absent": "absent", "n06_rural": "rural", "n07_share": "deprivation_score"}


def _field_query(name: str, field: str) -> None:
    rnd = "round(deprivation_score, 9) AS deprivation_score" if field == "deprivation_score" else field

    @query(name, f"SELECT {rnd}, {field}_status, count(*) AS n FROM {{cleaned}} c GROUP BY 1, 2")
    def _(s: Source) -> DataFrame:
        cleaned = rounded(Q.clean_records(s.view("messy")).select(field, f"{field}_status"))
        return cleaned.groupBy(field, f"{field}_status").agg(F.count("*").alias("n"))


for _name, _field in FIELD.items():
    _field_query(_name, _field)


@query("n03_district_from_school", r"SELECT school_code, TRY_CAST(NULLIF(regexp_extract(school_code, '^SCH-(\d{3})-\d{2}$', 1), '') AS INT) AS district, count(*) AS n FROM {messy} m GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.view("messy").groupBy("school_code", N.district_from_school(F.col("school_code")).alias("district")).agg(F.count("*").alias("n"))


@query("n08_quarantine_reasons", f"SELECT {REASON} AS quarantine_reason, count(*) AS n FROM {{cleaned}} c GROUP BY 1")
def _(s: Source) -> DataFrame:
    return Q.clean_records(s.view("messy")).groupBy("quarantine_reason").agg(F.count("*").alias("n"))


VALID = r"""regexp_matches(student_id, '^\d{4}_\d+$') AS v_student, coalesce(TRY_CAST(CASE WHEN regexp_matches(district_id, '^\d{1,9}$') THEN district_id END AS INT) BETWEEN 1 AND 250, false) AS v_district,
  academic_year IN ('2022', '2023', '2024', '2025') AS v_year, absent IN ('0', '1') AS v_absent, rural IN ('0', '1') AS v_rural,
  coalesce(TRY_CAST(CASE WHEN regexp_matches(deprivation_score, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN deprivation_score END AS DOUBLE) BETWEEN 0 AND 1, false) AS v_score, regexp_matches(school_code, '^SCH-\d{3}-\d{2}$') AS v_school"""
view("validity", f"SELECT *, {VALID} FROM {{messy}} m")
SIGNATURE = "concat_ws('+', CASE WHEN NOT v_absent THEN 'absent' END, CASE WHEN NOT v_year THEN 'academic_year' END, CASE WHEN NOT v_score THEN 'deprivation_score' END, CASE WHEN NOT v_district THEN 'district_id' END, CASE WHEN NOT v_rural THEN 'rural' END, CASE WHEN NOT v_school THEN 'school_code' END, CASE WHEN NOT v_student THEN 'student_id' END)"


@query("n09_valid_fields", "SELECT " + ", ".join(f"count(*) FILTER ({v}) AS {c}" for c, v in (("student_id", "v_student"), ("district_id", "v_district"), ("academic_year", "v_year"), ("absent", "v_absent"), ("rural", "v_rural"), ("deprivation_score", "v_score"), ("school_code", "v_school"))) + " FROM {validity} v")
def _(s: Source) -> DataFrame:
    return s.view("messy").agg(*[F.count_if(v).alias(n) for n, v in N.validity().items()])


@query("n10_problem_signatures", f"SELECT {SIGNATURE} AS value, count(*) AS n FROM {{validity}} v GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def _(s: Source) -> DataFrame:
    return A.value_counts(s.view("messy").select(N.problem_signature(N.validity()).alias("signature")), "signature", 20)


@query("a14_quality_counts", "SELECT field, count(*) FILTER (ok) AS direct, count(*) FILTER (NOT ok AND NOT gone) AS review, count(*) FILTER (gone) AS missing, round(avg(CAST(ok AS INT)), 9) AS direct_rate FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {v} AS ok, lower(trim({c})) IN {MARKERS} AS gone FROM {{validity}} v" for c, v in (("student_id", "v_student"), ("district_id", "v_district"), ("academic_year", "v_year"), ("absent", "v_absent"), ("rural", "v_rural"), ("deprivation_score", "v_score"), ("school_code", "v_school"))) + ") GROUP BY 1")
def _(s: Source) -> DataFrame:
    return rounded(Q.quality_counts(s.view("messy"), N.validity()))


@query("a15_status_histogram", " UNION ALL ".join(f"SELECT '{f}' AS field, {f}_status AS status, count(*) AS n FROM {{cleaned}} c GROUP BY 2" for f in Q.FIELDS))
def _(s: Source) -> DataFrame:
    return A.status_histogram(Q.clean_records(s.view("messy")), Q.FIELDS)


@query("a16_valid_field_distribution", "SELECT r.range AS valid_fields, coalesce(n, 0) AS n FROM range(8) r LEFT JOIN (SELECT CAST(v_student AS INT) + CAST(v_district AS INT) + CAST(v_year AS INT) + CAST(v_absent AS INT) + CAST(v_rural AS INT) + CAST(v_score AS INT) + CAST(v_school AS INT) AS f, count(*) AS n FROM {validity} v GROUP BY 1) ON f = r.range")
def _(s: Source) -> DataFrame:
    return Q.valid_field_counts(s.view("messy"), N.validity())


@query("d01_clean_records", f"SELECT student_id, district_id, academic_year, absent, round(deprivation_score, 9) AS deprivation_score, rural, school_code, {REASON} AS quarantine_reason, count(*) AS n FROM {{cleaned}} c GROUP BY ALL")
def _(s: Source) -> DataFrame:
    cleaned = rounded(Q.clean_records(s.view("messy")))
    return cleaned.groupBy(*Q.FIELDS, "quarantine_reason").agg(F.count("*").alias("n"))


@query("d01_accepted_by_file", f"SELECT m.source_file, count(*) AS n FROM (SELECT *, {REASON} AS reason FROM {{cleaned}} c) c JOIN (SELECT DISTINCT k, source_file FROM {{messy}} m) m ON c.k = m.k WHERE reason IS NULL GROUP BY 1")
def _(s: Source) -> DataFrame:
    accepted, _ = Q.split_quarantine(Q.clean_records(s.view("messy")))
    return accepted.groupBy("source_file").agg(F.count("*").alias("n"))


COMPARE = ["district_id", "absent", "deprivation_score", "rural", "school_code"]
view("resolved", """
SELECT e.*, n AS duplicate_count, CASE WHEN n = 1 THEN 'unique' WHEN NOT (cd OR ca OR cs OR cr OR cc) THEN 'exact_duplicate_collapsed' WHEN NOT (cd OR ca OR cs OR cr) THEN 'school_conflict_preserved' ELSE 'quarantined' END AS duplicate_resolution,
  CASE WHEN ca THEN 'CONFLICTING_ABSENCE' WHEN cd OR cs OR cr THEN 'CONFLICTING_' || upper(concat_ws('_', CASE WHEN ca THEN 'absent' END, CASE WHEN cs THEN 'deprivation_score' END, CASE WHEN cd THEN 'district_id' END, CASE WHEN cr THEN 'rural' END, CASE WHEN cc THEN 'school_code' END)) END AS conflict_reason,
  CASE WHEN lo = hi THEN lo ELSE '' END AS single_school, row_number() OVER (PARTITION BY e.student_id, e.academic_year ORDER BY source_file, source_row) AS place
FROM {enrolment_dups} e JOIN (SELECT student_id, academic_year, count(*) n, count(DISTINCT coalesce(CAST(district_id AS STRING), '')) > 1 cd, count(DISTINCT coalesce(CAST(absent AS STRING), '')) > 1 ca, count(DISTINCT coalesce(CAST(deprivation_score AS STRING), '')) > 1 cs,
  count(DISTINCT coalesce(CAST(rural AS STRING), '')) > 1 cr, count(DISTINCT school_code) > 1 cc, min(school_code) FILTER (regexp_matches(school_code, '^SCH-[0-9][0-9][0-9]-[0-9][0-9]$')) lo, max(school_code) FILTER (regexp_matches(school_code, '^SCH-[0-9][0-9][0-9]-[0-9][0-9]$')) hi
  FROM {enrolment_dups} e GROUP BY 1, 2) g ON e.student_id = g.student_id AND e.academic_year = g.academic_year""")


@query("d02_resolve_duplicates", "SELECT student_id, academic_year, district_id, absent, source_file, duplicate_count, duplicate_resolution, conflict_reason, CASE WHEN duplicate_resolution = 'school_conflict_preserved' THEN single_school ELSE school_code END AS school_code FROM {resolved} r WHERE conflict_reason IS NOT NULL OR place = 1")
def _(s: Source) -> DataFrame:
    done = Q.resolve_duplicates(s.view("enrolment_dups"), ["student_id", "academic_year"], COMPARE, ["source_file", "source_row"])
    return done.select("student_id", "academic_year", "district_id", "absent", "source_file", "duplicate_count", "duplicate_resolution", "conflict_reason", "school_code")


@query("d03_impute_median", """SELECT a.district_id, a.academic_year, CASE WHEN deprivation_score IS NOT NULL THEN 'observed_or_repaired' WHEN m IS NOT NULL THEN 'group_median' ELSE 'unresolved_no_group_median' END AS imputation_method, round(coalesce(deprivation_score, m), 9) AS deprivation_score, count(*) AS n
  FROM {attendance} a LEFT JOIN (SELECT district_id, academic_year, median(deprivation_score) AS m FROM {attendance} a GROUP BY 1, 2) USING (district_id, academic_year) GROUP BY ALL""")
def _(s: Source) -> DataFrame:
    done = rounded(Q.impute_group_median(s.view("attendance"), "deprivation_score", ["district_id", "academic_year"]))
    return done.groupBy("district_id", "academic_year", "imputation_method", "deprivation_score").agg(F.count("*").alias("n"))


@query("d04_flag_missing", "SELECT rural, CAST(rural IS NULL AS INT) AS rural_missing, count(*) AS n FROM {attendance} a GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return Q.flag_missing(s.view("attendance"), "rural").groupBy("rural", "rural_missing").agg(F.count("*").alias("n"))


@query("d05_compare_tables", """WITH e AS (SELECT district_id, academic_year, count(*) AS n, avg(absent) AS r FROM {attendance} a GROUP BY 1, 2), b AS (SELECT district_id, academic_year, CASE WHEN district_id % 9 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN district_id % 10 = 0 THEN r + 0.5 ELSE r END AS r FROM e WHERE district_id % 8 <> 0)
  SELECT e.district_id, e.academic_year, CASE WHEN b.n IS NULL THEN 'missing' ELSE concat_ws(',', CASE WHEN e.n <> b.n THEN 'n' END, CASE WHEN abs(e.r - b.r) > 1e-9 THEN 'r' END) END AS problem FROM e LEFT JOIN b USING (district_id, academic_year) WHERE b.n IS NULL OR e.n <> b.n OR abs(e.r - b.r) > 1e-9""")
def _(s: Source) -> DataFrame:
    e = s.view("attendance").groupBy("district_id", "academic_year").agg(F.count("*").alias("n"), F.avg("absent").alias("r"))
    off = e.filter("district_id % 8 <> 0").withColumns({"n": F.when(F.col("district_id") % 9 == 0, F.col("n") + 1).otherwise(F.col("n")), "r": F.when(F.col("district_id") % 10 == 0, F.col("r") + 0.5).otherwise(F.col("r"))})
    return Q.compare_tables(e, off, ["district_id", "academic_year"], ["n"], ["r"], 1e-9, 1e-9)


@query("d06_text_upsert", r"""SELECT doc_id, length(t) AS chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words, version FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'revised text' ELSE trim(regexp_replace(lower(text), '[ \t\n]+', ' ', 'g')) END AS t, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM {documents})""")
def _(s: Source) -> DataFrame:
    clean = F.trim(F.regexp_replace(F.lower("text"), "[ \t\n]+", " "))
    old = s.table("documents").select("doc_id", F.struct(clean.alias("t"), F.lit(1).alias("version")).alias("note"))
    new = s.table("documents").filter("doc_id % 3 = 0").select("doc_id", F.struct(F.lit("revised text").alias("t"), F.lit(2).alias("version")).alias("note"))
    merged = Q.latest_wins(old, new, ["doc_id"]).select("doc_id", "note.*")
    return merged.select("doc_id", F.length("t").cast("long").alias("chars"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).cast("long").alias("words"), "version")
