"""Catalog, privacy profile, pseudonyms, lineage, staleness and gates over tables of assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import quality

# Policy by layer, folders that are not a domain, and rules for column names and values.
LAYER_POLICY = {
    "raw": ("external_or_original_input", "source", "review_required"), "processed": ("derived_project_data", "derived", "project_lifetime"), "curated": ("derived_project_data", "curated_candidate", "project_lifetime"),
    "gis": ("geospatial_source_or_derived", "source_or_derived", "project_lifetime"), "artifact": ("generated_project_artifact", "experiment_or_operational_artifact", "project_lifetime"), "other": ("inferred_from_repository", "review_required", "review_required"),
}
NOT_DOMAINS = ("raw", "processed", "cleaned", "curated", "gis", "artifacts", "artifact", "analytics", "monitoring", "predictions", "feature_store")
SCANNED = (".csv", ".parquet", ".json", ".geojson")
SECRET = r"(?i)(api[_-]?key|secret|password|token|private[_-]?key)"
NAME_SIGNALS = {
    "email": (5, ("email", "e_mail", "mail_address")), "phone": (5, ("phone", "mobile", "telephone", "tel_no")), "person_name": (3, ("first_name", "last_name", "full_name", "surname", "given_name", "person_name")),
    "personal_id": (5, ("national_id", "passport", "ssn", "tc_kimlik", "identity_number", "person_id", "customer_id", "employee_id", "student_id")), "address": (4, ("home_address", "residential_address", "postal_address")),
    "date_of_birth": (4, ("date_of_birth", "birth_date", "dob")), "precise_location": (2, ("latitude", "longitude", "lat", "lon", "lng")),
}
STRONG = ("credential_or_secret", "email", "email_values", "phone", "phone_like_values", "personal_id", "date_of_birth")
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^\+?[\d\s().-]{7,20}$"
PSEUDONYM = r"^[0-9a-fA-F]{16,64}$"
TEMPORAL = ("date", "datetime", "timestamp", "year", "month", "day", "shift_start", "shift_end", "academic_year", "fiscal_year", "calendar_year", "school_year")
#: Folders that say how data is made, not what it is about; also those whose names start with a stage of its making.
TECHNICAL = ("attribution", "operations_state", "scheduler", "simulation", "traffic_scenarios", "distributed_cleaning", "global_resolution", "local_cleaning_test")
STAGES = ("curated", "processed", "clean", "raw")
TRANSFER = ("ALLOW", "CONTROLLED", "REVIEW", "BLOCK")


def build_catalog(files: DataFrame, path: str = "path", size: str = "size_bytes") -> DataFrame:
    """Adds extension, size in MB (4 places) and layer."""
    return files.withColumns({"extension": X.path_extension(F.col(path)), "size_mb": F.round(F.col(size) / 1048576, 4), "data_layer": X.path_layer(F.col(path))})


def enrich(catalog: DataFrame) -> DataFrame:
    """Adds domain, the layer's policy, purpose, sensitivity, metadata_complete and privacy_scan_required."""
    policy = catalog.sparkSession.createDataFrame([(k, *v) for k, v in LAYER_POLICY.items()], "data_layer string, source string, authoritative string, retention_policy string")
    out = catalog.join(F.broadcast(policy), "data_layer", "left").withColumn("domain", X.path_domain(F.col("path"), (*NOT_DOMAINS, *TECHNICAL), STAGES))
    suffix = F.when(F.col("data_layer") == "artifact", "_reproducibility_monitoring_or_experiment").when(F.col("data_layer") == "raw", "_source_data").when(F.col("data_layer") == "gis", "_geospatial_analysis").otherwise("_research_and_operations")
    scan = F.col("extension").isin(*SCANNED)
    out = out.withColumns({"purpose": F.concat("domain", suffix), "sensitivity": F.when(scan, "pending_privacy_scan").otherwise("review_required"), "privacy_scan_required": scan})
    needed = F.array("source", "authoritative", "retention_policy", "purpose", "domain", "data_layer")
    return out.withColumn("metadata_complete", ~F.exists(needed, lambda v: v.isNull() | (v == "review_required")))


def name_signals(columns: DataFrame, column: str = "column") -> DataFrame:
    """Rows (column, signal, weight) that column names give away."""
    name = X.normalized_name(F.col(column))
    rules = [F.when(name.isin(*names), F.struct(F.lit(s).alias("signal"), F.lit(w).alias("weight"))) for s, (w, names) in NAME_SIGNALS.items()]
    secret = F.when(name.rlike(SECRET), F.struct(F.lit("credential_or_secret").alias("signal"), F.lit(5).alias("weight")))
    return columns.select(column, F.explode(F.array_compact(F.array(secret, *rules))).alias("s")).select(column, "s.signal", "s.weight")


def is_temporal_name(x: Column) -> Column:
    name = X.normalized_name(x)
    return name.isin(*TEMPORAL) | name.rlike(r"(_date|_time|_timestamp)$") | name.rlike(r"^(date|time|timestamp)_")


def value_signals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, signal, weight) from all values of each text column that are not null: one pass, counted per partition before anything moves."""
    counted = {c: F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.rlike(EMAIL)).alias("mails"), F.count_if(v.rlike(PHONE)).alias("phones"), F.count_if(v.rlike(PSEUDONYM)).alias("hexes")) for c, v in ((c, F.col(c).cast("string")) for c in columns)}
    per = df.agg(F.array(*counted.values()).alias("e")).select(F.explode("e").alias("e")).select("e.*").filter("n > 0")
    temporal = is_temporal_name(F.col("column"))

    def found(when: Column, signal: str, weight: int) -> Column:
        return F.when(when, F.struct(F.lit(signal).alias("signal"), F.lit(weight).alias("weight")))

    rules = [found(F.col("mails") >= 2, "email_values", 5), found(temporal, "temporal_quasi_identifier", 2), found((F.col("n") >= 5) & ~temporal & (F.col("phones") >= 0.8 * F.col("n")), "phone_like_values", 4), found((F.col("n") >= 5) & (F.col("hexes") >= 0.95 * F.col("n")), "pseudonym_values", 0)]
    return per.select("column", F.explode(F.array_compact(F.array(*rules))).alias("s")).select("column", "s.signal", "s.weight")


def profile_privacy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, signal, weight): names and values; an id column that holds pseudonyms counts as pseudonymized_identifier, 3."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    found = name_signals(names).unionByName(value_signals(df, columns))
    hidden = found.filter("signal = 'pseudonym_values'").select("column", F.lit(True).alias("_hidden"))
    down = (F.col("signal") == "personal_id") & F.col("_hidden").isNotNull()
    both = found.filter("signal <> 'pseudonym_values'").join(hidden, "column", "left")
    return both.select("column", F.when(down, "pseudonymized_identifier").otherwise(F.col("signal")).alias("signal"), F.when(down, 3).otherwise(F.col("weight")).alias("weight"))


def classify(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score, classification and the signals as JSON text."""
    strong = F.max(F.col("signal").isin(*STRONG))
    score = F.coalesce(F.sum("weight"), F.lit(0))
    cls = F.when(F.coalesce(strong, F.lit(False)), "restricted").when(score >= 4, "potentially_personal").otherwise("internal")
    return signals.groupBy(*by).agg(score.alias("privacy_score"), cls.alias("privacy_classification"), F.to_json(F.array_sort(F.collect_list(F.struct("column", "signal", "weight")))).alias("signals"))


def apply_profile(catalog: DataFrame, profile: DataFrame) -> DataFrame:
    """The profile's class in place of a pending sensitivity, the action it calls for, and readiness."""
    both = catalog.join(profile, "path", "left")
    level = F.when(F.col("scan_status") == "scanned", F.col("privacy_classification")).otherwise(F.col("sensitivity"))
    action = F.when(level == "restricted", "pseudonymize_or_restrict").when(level == "potentially_personal", "manual_review").when(level == "internal", "allow_internal_use").otherwise("complete_scan")
    return both.withColumn("sensitivity", level).withColumn("privacy_action", action).withColumn("governance_complete", F.col("metadata_complete") & F.col("privacy_action").isin("allow_internal_use"))


def pseudonymize(df: DataFrame, salt: str, ids: Sequence[str], drops: Sequence[str]) -> DataFrame:
    return df.withColumns({c: X.salted_digest(F.col(c), salt) for c in ids if c in df.columns}).drop(*drops)


def latest_events(events: DataFrame) -> DataFrame:
    """Of each output the event of greatest (timestamp, sequence)."""
    named = events.select("*", F.explode("outputs.path").alias("output"))
    return quality.newest_first(named, ["output"], [F.desc("timestamp_utc"), F.desc("seq")])


def staleness(events: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (output, status, changed_inputs): potentially_stale if an input's hash is another now, else current if the output exists, else missing."""
    latest = latest_events(events)
    inputs = latest.select("output", F.explode_outer("inputs").alias("i")).select("output", F.col("i.path").alias("path"), F.col("i.sha256").alias("was"))
    now = current.select("path", F.col("sha256").alias("now"))
    changed = inputs.join(now, "path", "left").groupBy("output").agg(F.array_sort(F.collect_set(F.when(F.col("path").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")), F.col("path")))).alias("changed_inputs"))
    both = changed.join(now.withColumnRenamed("path", "output"), "output", "left")
    status = F.when(F.size("changed_inputs") > 0, "potentially_stale").when(F.col("now").isNotNull(), "current").otherwise("missing")
    return both.select("output", status.alias("status"), F.concat_ws(",", "changed_inputs").alias("changed_inputs"))


def lineage_checks(events: DataFrame, source: str, target: str) -> DataFrame:
    """One row: the log is not empty, every event has a run, a transformation and inputs or outputs, and one leads from source to target."""
    whole = F.col("run_id").isNotNull() & F.col("transformation").isNotNull() & (F.size("inputs") + F.size("outputs") > 0)
    link = F.exists("inputs", lambda i: i["path"] == source) & F.exists("outputs", lambda o: o["path"] == target)
    return events.agg((F.count("*") > 0).alias("not_empty"), F.coalesce(F.every(whole), F.lit(True)).alias("structured"), F.coalesce(F.some(link), F.lit(False)).alias("linked"))


def gate(catalog: DataFrame, stale: DataFrame, scope: Column | None = None, strict: bool = False) -> DataFrame:
    """Rows (path, reason) that fail: incomplete metadata, a privacy block, or staleness (strict: any status but current)."""
    inside = catalog.filter(scope) if scope is not None else catalog
    late = stale.filter("status <> 'current'" if strict else "status IN ('potentially_stale', 'missing')").select(F.col("output").alias("path"), F.concat(F.lit("lineage_"), "status").alias("reason"))
    if scope is not None:
        late = late.filter(scope)
    parts = [inside.filter("NOT metadata_complete").select("path", F.lit("metadata_incomplete").alias("reason")), inside.filter("privacy_action = 'pseudonymize_or_restrict'").select("path", F.lit("privacy_block").alias("reason")), late]
    return reduce(DataFrame.unionByName, parts)


def gate_status(failures: DataFrame) -> DataFrame:
    return failures.agg(F.when(F.count("*") > 0, "BLOCK").otherwise("PASS").alias("status"), F.count("*").alias("failures"))


def transfer_decision(row: Mapping[str, Column]) -> Column:
    """Whether an asset may leave: blocked if restricted, reviewed if unknown or possibly personal, controlled if incomplete."""
    return F.when(row["sensitivity"] == "restricted", "BLOCK").when(row["sensitivity"].isNull() | row["sensitivity"].isin("review_required", "pending_privacy_scan", "potentially_personal"), "REVIEW").when(~row["metadata_complete"], "CONTROLLED").otherwise("ALLOW")


def transfer_plan(events: DataFrame, catalog: DataFrame, transformation: str) -> DataFrame:
    """The inputs of a transformation's latest event with their decisions; inputs outside the catalog are reviewed."""
    runs = events.filter(F.col("transformation") == transformation)
    last = runs.agg(F.max_by("inputs", F.struct("timestamp_utc", "seq")).alias("inputs"))
    inputs = last.select(F.explode("inputs.path").alias("path")).distinct()
    both = inputs.join(catalog.withColumn("_in", F.lit(True)), "path", "left")
    decision = F.when(F.col("_in").isNull(), "REVIEW").otherwise(transfer_decision({c: F.col(c) for c in ("sensitivity", "metadata_complete")}))
    return both.select("path", decision.alias("decision"), F.when(F.col("_in").isNull(), "not_in_governance_catalog").alias("reason"))
