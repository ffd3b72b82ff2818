"""Field normalisers: columns of struct<value, status>, status being direct, normalized, recovered_from_<field> or unresolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean a missing value, and words for 0 and 1.
MISSING_MARKERS = ("", "?", "-", "unknown", "n/a", "na", "missing")
ABSENT_ZERO = ("0", "n", "no", "p", "present")
ABSENT_ONE = ("1", "y", "yes", "a", "absent")
RURAL_ZERO = ("0", "n", "no", "u", "urban")
RURAL_ONE = ("1", "y", "yes", "r", "rural")
YEARS = (2022, 2023, 2024, 2025)
#: Header dialects and the names they stand for.
SYNONYMS = {
    "student": "student_id", "StudentID": "student_id", "district": "district_id", "DistrictCode": "district_id", "year": "academic_year", "AcademicYear": "academic_year",
    "attendance_status": "absent", "AbsentFlag": "absent", "deprivation": "deprivation_score", "DeprivationIndex": "deprivation_score",
    "location_type": "rural", "RuralUrban": "rural", "school": "school_code", "SchoolCode": "school_code",
}
DISTRICTS = (1, 250)
# `try_cast` also takes "1d"; only plain decimal notation counts as a number.
#: The year of a student number, as it stands after repair or as it would be repaired.
STUDENT_YEAR = r"^(?:STU-(?=\d{4}_\d+$))?(\d{4})(?:_|-\d+$)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(x: Column) -> Column:
    """Without white space at the ends; null as the empty text."""
    return F.coalesce(F.btrim(x, F.lit(" \t\n\r\f\v")), F.lit(""))


def is_missing(x: Column) -> Column:
    return F.lower(x).isin(*MISSING_MARKERS)


def _pair(value: Column, status: str | Column) -> Column:
    return F.struct(value.alias("value"), (F.lit(status) if isinstance(status, str) else status).alias("status"))


def _number(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


# The normalisers take trimmed text, so that a table's texts can be trimmed once, in a projection of their own.


def student(t: Column) -> Column:
    """year_number; an STU- prefix or a dash is repaired; other text is kept, unresolved."""
    bare = F.regexp_replace(t, "^STU-", "")
    return (F.when(is_missing(t), _pair(F.lit(""), "unresolved")).when(t.rlike(r"^\d{4}_\d+$"), _pair(t, "direct"))
            .when(t.startswith("STU-") & bare.rlike(r"^\d{4}_\d+$"), _pair(bare, "normalized"))
            .when(t.rlike(r"^\d{4}-\d+$"), _pair(F.replace(t, F.lit("-"), F.lit("_")), "normalized")).otherwise(_pair(t, "unresolved")))


def school(t: Column) -> Column:
    return F.when(is_missing(t), _pair(F.lit(""), "unresolved")).when(t.rlike(r"^SCH-\d{3}-\d{2}$"), _pair(t, "direct")).otherwise(_pair(t, "unresolved"))


def _in_range(x: Column) -> Column:
    n = x.try_cast("int")
    return F.when(n.between(*DISTRICTS), n)


def district_from_school(x: Column) -> Column:
    """The district number inside a school code, or null."""
    return _in_range(F.nullif(F.regexp_extract(x, r"^SCH-(\d{3})-\d{2}$", 1), F.lit("")))


def district(t: Column, school_code: Column) -> Column:
    """A number in range, one of five written forms, or the school's district."""
    plain = F.when(t.rlike(r"^\d{1,9}$"), _in_range(t))
    written = F.when(t.rlike(r"^(?i)(district\s+|dist\s+|dist\.\s*)(\d{1,3})$"), _in_range(F.regexp_extract(t, r"(\d{1,3})$", 1))).when(t.rlike(r"^(?i)d\d{3}$"), _in_range(F.substring(t, 2, 3)))
    of_school = district_from_school(school_code)
    return (F.when(plain.isNotNull(), _pair(plain, "direct")).when(written.isNotNull(), _pair(written, "normalized"))
            .when(of_school.isNotNull(), _pair(of_school, "recovered_from_school")).otherwise(_pair(F.lit(None).cast("int"), "unresolved")))


def year(t: Column, student_id: Column) -> Column:
    """A year in the set, its last two digits, a span that starts with it, or the year of the student's number."""
    full = F.when(t.rlike(r"^\d{4}$"), t.try_cast("int"))
    short = F.when(t.rlike(r"^\d{2}$"), t.try_cast("int") + 2000)
    span = F.when(t.rlike(r"^\d{4}/\d{4}$"), F.substring(t, 1, 4).try_cast("int"))
    of_student = F.nullif(F.regexp_extract(student_id, STUDENT_YEAR, 1), F.lit("")).try_cast("int")
    return (F.when(full.isin(*YEARS), _pair(full, "direct")).when(short.isin(*YEARS), _pair(short, "normalized")).when(span.isin(*YEARS), _pair(span, "normalized"))
            .when(of_student.isin(*YEARS), _pair(of_student, "recovered_from_student_id")).otherwise(_pair(F.lit(None).cast("int"), "unresolved")))


def binary(t: Column, zeros: Sequence[str], ones: Sequence[str]) -> Column:
    low = F.lower(t)
    return (F.when(is_missing(t), _pair(F.lit(None).cast("int"), "unresolved")).when(t.isin("0", "1"), _pair(t.try_cast("int"), "direct"))
            .when(low.isin(*zeros), _pair(F.lit(0), "normalized")).when(low.isin(*ones), _pair(F.lit(1), "normalized")).otherwise(_pair(F.lit(None).cast("int"), "unresolved")))


def share(t: Column) -> Column:
    """A number from 0 to 1; a per-cent sign or a value up to 100 is scaled; a decimal comma is read as a point."""
    t = F.replace(t, F.lit(","), F.lit("."))
    per_cent = _number(F.regexp_replace(t, r"\s*%$", "")) / 100
    plain = _number(t)
    return (F.when(is_missing(t), _pair(F.lit(None).cast("double"), "unresolved")).when(t.endswith("%") & per_cent.between(0, 1), _pair(per_cent, "normalized"))
            .when(plain.between(0, 1), _pair(plain, "direct")).when((plain > 1) & (plain <= 100), _pair(plain / 100, "normalized")).otherwise(_pair(F.lit(None).cast("double"), "unresolved")))


def quarantine_reason(**missing: Column) -> Column:
    """UNRESOLVED_ and the names, in the order given, of the fields that are missing; null if none is."""
    names = F.concat_ws("_", *[F.when(m, F.lit(n.upper())) for n, m in missing.items()])
    return F.when(names != "", F.concat(F.lit("UNRESOLVED_"), names))


def validity() -> dict[str, Column]:
    """For each raw field, whether it is valid as it stands."""
    return {
        "student_id": F.col("student_id").rlike(r"^\d{4}_\d+$"), "district_id": F.coalesce(F.when(F.col("district_id").rlike(r"^\d{1,9}$"), _in_range(F.col("district_id"))).isNotNull(), F.lit(False)),
        "academic_year": F.col("academic_year").isin(*map(str, YEARS)), "absent": F.col("absent").isin("0", "1"), "rural": F.col("rural").isin("0", "1"),
        "deprivation_score": F.coalesce(_number(F.col("deprivation_score")).between(0, 1), F.lit(False)), "school_code": F.col("school_code").rlike(r"^SCH-\d{3}-\d{2}$"),
    }


def problem_signature(valid: dict[str, Column]) -> Column:
    """The sorted names of invalid fields, joined by +."""
    return F.concat_ws("+", *[F.when(~F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in sorted(valid.items())])
