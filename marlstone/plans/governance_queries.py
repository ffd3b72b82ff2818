"""Queries on scalar functions, catalog, privacy, lineage and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import governance as G
from ..operators import joins as J
from ..sources import tables as T
from .aggregate_queries import rounded
from .registry import Source, query, view

view("catalog", """
SELECT path, digest, CASE page_id % 6 WHEN 0 THEN 'raw' WHEN 1 THEN 'curated' WHEN 2 THEN 'processed' WHEN 3 THEN 'gis' WHEN 4 THEN 'artifact' ELSE 'other' END AS data_layer,
  CASE page_id % 6 WHEN 0 THEN 'education' WHEN 1 THEN 'health' WHEN 2 THEN 'refuse' WHEN 3 THEN CASE WHEN page_id % 12 = 9 THEN 'transport' ELSE 'general_project_data' END WHEN 4 THEN 'models' ELSE 'general_project_data' END AS domain,
  CASE page_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.parquet' WHEN 2 THEN '.json' ELSE '.bin' END AS extension, round(size_bytes / CAST(1048576 AS DOUBLE), 4) AS size_mb,
  CASE WHEN page_id % 6 IN (0, 5) THEN false ELSE true END AS metadata_complete, page_id % 4 < 3 AS privacy_scan_required, page_id,
  CASE WHEN page_id % 4 = 3 THEN 'review_required' WHEN page_id % 10 = 1 THEN 'restricted' WHEN page_id % 10 = 2 THEN 'potentially_personal' ELSE 'internal' END AS sensitivity
FROM {assets} a""")


def _catalog(s: Source) -> DataFrame:
    full = G.enrich(G.build_catalog(s.view("assets")))
    profile = s.view("assets").filter("page_id % 4 < 3").select("path", F.lit("scanned").alias("scan_status"), F.when(F.col("page_id") % 10 == 1, "restricted").when(F.col("page_id") % 10 == 2, "potentially_personal").otherwise("internal").alias("privacy_classification"))
    return G.apply_profile(full, profile)


def _events(s: Source) -> DataFrame:
    """A lineage log on the pages: every third asset is made from the one before and the one after it, in two runs."""
    a = s.view("assets").select("path", "digest", "page_id")
    made = a.filter("page_id % 3 = 1").select(F.col("path").alias("o"), F.col("page_id").alias("p"))
    i = a.select(F.col("path").alias("i"), F.col("digest").alias("h"), F.col("page_id").alias("q"))
    near = made.withColumn("q", F.explode(F.array(F.col("p") - 1, F.col("p") + 1))).join(i, "q")
    grouped = near.groupBy("p", "o").agg(F.collect_list(F.struct(F.col("i").alias("path"), F.when(F.col("q") % 7 == 0, F.lit("old")).otherwise(F.col("h")).alias("sha256"))).alias("inputs"))
    one = grouped.select(F.format_string("run%d", "p").alias("run_id"), F.timestamp_seconds(F.col("p") * 60).alias("timestamp_utc"), F.col("p").alias("seq"), F.when(F.col("p") % 2 == 0, "train").otherwise("build").alias("transformation"), "inputs", F.array(F.struct(F.col("o").alias("path"))).alias("outputs"))
    earlier = one.select(F.concat("run_id", F.lit("a")).alias("run_id"), (F.col("timestamp_utc") - F.expr("INTERVAL 1 DAY")).alias("timestamp_utc"), "seq", "transformation", F.transform("inputs", lambda x: F.struct(x["path"].alias("path"), F.lit("older").alias("sha256"))).alias("inputs"), "outputs")
    return one.unionByName(earlier)


_STALE = """SELECT o.path AS output, CASE WHEN count(*) FILTER (i.page_id % 7 = 0) > 0 THEN 'potentially_stale' ELSE 'current' END AS status, coalesce(string_agg(CASE WHEN i.page_id % 7 = 0 THEN i.path END, ',' ORDER BY i.path), '') AS changed_inputs
  FROM {assets} o JOIN {assets} i ON i.page_id IN (o.page_id - 1, o.page_id + 1) WHERE o.page_id % 3 = 1 GROUP BY 1"""


@query("x01_clean_text", "SELECT doc_id, length(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS n FROM {documents}")
def _(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", F.length(X.clean_text(F.col("text"))).cast("long").alias("n"))


@query("x02_names", "SELECT DISTINCT translate(lower(trim(p_type)), ' -', '__') AS name FROM {part}")
def _(s: Source) -> DataFrame:
    return s.table("part").select(X.normalized_name(F.col("p_type")).alias("name")).distinct()


@query("x03_prefix_suffix", "SELECT count(*) FILTER (starts_with(url, 'https')) AS secure, count(*) FILTER (ends_with(url, '#top')) AS anchored FROM {pages}")
def _(s: Source) -> DataFrame:
    return s.table("pages").agg(F.count_if(F.col("url").startswith("https")).alias("secure"), F.count_if(F.col("url").endswith("#top")).alias("anchored"))


@query("x04_human_formats", "SELECT district_id, 'District ' || district_id AS label, regexp_replace(CAST(n AS STRING), '(\\d)(\\d{3})$', '\\1,\\2') AS days FROM (SELECT district_id, count(*) AS n FROM {attendance} a GROUP BY 1)")
def _(s: Source) -> DataFrame:
    counts = s.view("attendance").groupBy("district_id").agg(F.count("*").alias("n"))
    return counts.select("district_id", F.format_string("District %d", "district_id").alias("label"), X.raw_and_human(F.col("n"), F.format_number("n", 0))["human"].alias("days"))


@query("x05_report_sentence", "SELECT c_custkey, 'Customer ' || c_custkey || ' is in ' || lower(c_mktsegment) || ' (nation ' || c_nationkey || ').' AS sentence FROM {customer}")
def _(s: Source) -> DataFrame:
    return s.table("customer").select("c_custkey", F.format_string("Customer %d is in %s (nation %d).", "c_custkey", F.lower("c_mktsegment"), "c_nationkey").alias("sentence"))


@query("x06_path_parts", "SELECT path, data_layer, domain, extension FROM {catalog} c")
def _(s: Source) -> DataFrame:
    return s.view("assets").select("path", X.path_layer(F.col("path")).alias("data_layer"), X.path_domain(F.col("path"), (*G.NOT_DOMAINS, *G.TECHNICAL), G.STAGES).alias("domain"), X.path_extension(F.col("path")).alias("extension"))


_ROADS = "SELECT l_orderkey * 10 + l_linenumber AS edge, CASE l_partkey % 5 WHEN 0 THEN 'primary_link' WHEN 1 THEN 'residential' WHEN 2 THEN 'trunk' WHEN 3 THEN 'service' ELSE 'tertiary' END AS highway, CASE l_suppkey % 4 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' WHEN 2 THEN 'none' ELSE '[''40'', ''60'']' END AS speed_text, l_quantity * 10 AS length_m, l_partkey FROM {lineitem}"
view("roads", _ROADS)
_KPH = "least(greatest(CASE speed_text WHEN '30 mph' THEN 30 * 1.60934 WHEN '50' THEN 50.0 WHEN 'none' THEN CASE highway WHEN 'primary_link' THEN 40 WHEN 'residential' THEN 30 WHEN 'trunk' THEN 70 WHEN 'tertiary' THEN 40 ELSE 30 END ELSE 40.0 END, 10.0), 90.0)"


@query("x08_speeds", f"SELECT highway, speed_text, round(CAST({_KPH} AS DOUBLE), 5) AS kph, count(*) AS n FROM {{roads}} r GROUP BY 1, 2, 3")
def _(s: Source) -> DataFrame:
    return s.view("roads").groupBy("highway", "speed_text", F.round(X.speed_kph(X.first_listed(F.col("speed_text")), F.col("highway")), 5).alias("kph")).agg(F.count("*").alias("n"))


@query("x09_road_classes", "SELECT CASE WHEN highway = 'primary_link' THEN 'primary' ELSE highway END AS class, count(*) AS n FROM {roads} r GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("roads").groupBy(X.road_class(F.col("highway")).alias("class")).agg(F.count("*").alias("n"))


_FACTOR = "CASE highway WHEN 'primary_link' THEN 0.85 WHEN 'residential' THEN 0.70 WHEN 'trunk' THEN 0.90 WHEN 'tertiary' THEN 0.78 ELSE 0.70 END"
_RUSH = "CASE highway WHEN 'primary_link' THEN 1.60 WHEN 'residential' THEN 1.20 WHEN 'trunk' THEN 1.45 WHEN 'tertiary' THEN 1.35 ELSE 1.20 END"


@query("l07_traffic_state", f"SELECT highway, count(*) AS n, round(sum(t), 3) AS normal_s, round(sum(t * rush), 3) AS rush_s, round(sum(CASE WHEN NOT closed THEN t * rush * 1.12 END), 3) AS disrupted_s, count(*) FILTER (closed) AS closed FROM (SELECT highway, length_m / (greatest(8.0, least(CAST({_KPH} AS DOUBLE) * {_FACTOR}, 42.0)) * 1000 / 3600) AS t, CAST({_RUSH} AS DOUBLE) AS rush, l_partkey % 50 = 0 AS closed FROM {{roads}} r) GROUP BY 1")
def _(s: Source) -> DataFrame:
    highway = F.col("highway")
    seconds = X.travel_seconds(F.col("length_m"), X.vehicle_speed(X.speed_kph(X.first_listed(F.col("speed_text")), highway), highway, "small_truck"))
    r = s.view("roads").select("highway", seconds.alias("t"), X.choice(X.road_class(highway), X.RUSH_FACTOR, 1.20).alias("rush"), (F.col("l_partkey") % 50 == 0).alias("closed"))
    return rounded(r.groupBy("highway").agg(F.count("*").alias("n"), F.sum("t").alias("normal_s"), F.sum(F.col("t") * F.col("rush")).alias("rush_s"), F.sum(F.when(~F.col("closed"), F.col("t") * F.col("rush") * X.RAIN_FACTOR)).alias("disrupted_s"), F.count_if("closed").alias("closed")), 3)


@query("x10_cutoff", "SELECT max(day) - 29 AS cutoff, count(*) FILTER (day >= (SELECT max(day) - 29 FROM {panel} p)) AS after FROM {panel} p")
def _(s: Source) -> DataFrame:
    p = s.view("panel")
    return J.product(p, p.agg(F.date_sub(F.max("day"), 29).alias("cutoff"))).groupBy("cutoff").agg(F.count_if(F.col("day") >= F.col("cutoff")).alias("after"))


@query("x11_weekend", "SELECT isodow(day) >= 6 AS weekend, CAST(day(day) % 9 AS INT) AS turn, count(*) AS n FROM {panel} p GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.view("panel").groupBy((F.weekday("day") >= 5).alias("weekend"), (F.dayofmonth("day") % 9).alias("turn")).agg(F.count("*").alias("n"))


@query("x12_date_spine", "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM {panel} p)")
def _(s: Source) -> DataFrame:
    return s.view("panel").agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


@query("x13_clock", "SELECT DISTINCT minute, strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (28800 + minute * 60), '%H:%M:%S') AS clock FROM {arrivals} a")
def _(s: Source) -> DataFrame:
    return s.view("arrivals").select("minute", X.clock(F.col("minute")).alias("clock")).distinct()


@query("x14_seasonal", "SELECT zone, round(sum(greatest(0.5, least(1.5, 1 + 0.2 * sin(2 * 3.141592653589793 * dayofyear(day) / 365)))), 6) AS season FROM {panel} p GROUP BY 1")
def _(s: Source) -> DataFrame:
    season = F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1 + 0.2 * F.sin(F.lit(2 * 3.141592653589793) * F.dayofyear("day") / 365)))
    return rounded(s.view("panel").groupBy("zone").agg(F.sum(season).alias("season")), 6)


@query("x15_capacity_split", "SELECT bin, CAST(sum(least(kg, 100)) AS BIGINT) AS inside, CAST(sum(greatest(0, kg - 100)) AS BIGINT) AS outside FROM {arrivals} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    parts = s.view("arrivals").select("bin", X.split_by_capacity(F.col("kg"), F.lit(100)).alias("p"))
    return parts.groupBy("bin").agg(F.sum("p.inside").alias("inside"), F.sum("p.outside").alias("outside"))


@query("x16_interval_days", "SELECT p_size, CAST(greatest(1, round_even(7.0 / p_size, 0)) AS INT) AS days FROM {part} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.table("part").select("p_size").distinct().select("p_size", X.interval_days(F.col("p_size")).alias("days"))


@query("x17_weighted_scores", "SELECT place, CAST(healthcare * 4.0 + food * 1.5 AS DOUBLE) AS activity, round(CAST(population * 0.9 + healthcare * 80 + food * 24 AS DOUBLE), 4) AS demand FROM {places} p")
def _(s: Source) -> DataFrame:
    counts = {"healthcare": F.col("healthcare"), "food_service": F.col("food")}
    return s.view("places").select("place", X.weighted(counts, X.ACTIVITY_WEIGHT).alias("activity"), F.round(F.col("population") * X.DEMAND_KG_PER_PERSON + X.weighted(counts, X.DEMAND_KG), 4).alias("demand"))


@query("x19_distance", "SELECT place, round(sqrt((x - 5000) * (x - 5000) + (y - 5000) * (y - 5000)), 6) AS distance FROM {places} p")
def _(s: Source) -> DataFrame:
    return s.view("places").select("place", F.round(F.hypot(F.col("x") - 5000, F.col("y") - 5000), 6).alias("distance"))


@query("x20_safe_percent", "SELECT c_custkey, round(c_acctbal * 100.0 / NULLIF(c_custkey % 3, 0), 4) AS pct FROM {customer}")
def _(s: Source) -> DataFrame:
    return s.table("customer").select("c_custkey", F.round(X.safe_percent(F.col("c_acctbal"), F.col("c_custkey") % 3), 4).alias("pct"))


@query("x22_salted_digest", "SELECT c_custkey, substr(sha256('pepper::' || c_name), 1, 20) AS digest FROM {customer}")
def _(s: Source) -> DataFrame:
    return s.table("customer").select("c_custkey", X.salted_digest(F.col("c_name"), "pepper").alias("digest"))


@query("x23_md5_bucket", "SELECT CAST(CAST('0x' || substr(md5(student_id), 1, 8) AS BIGINT) % 4 AS BIGINT) AS bucket, count(*) AS n FROM {attendance} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.view("attendance").groupBy(X.md5_bucket(F.col("student_id"), 4).alias("bucket")).agg(F.count("*").alias("n"))


@query("x24_categories", "SELECT category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'healthcare' END, CASE WHEN s_suppkey % 4 = 1 THEN 'food_service' END, CASE WHEN s_suppkey % 3 = 0 THEN 'major_retail' END, CASE WHEN s_suppkey % 3 = 1 THEN 'industrial' END], lambda c: c IS NOT NULL)) AS category FROM {supplier}) GROUP BY 1")
def _(s: Source) -> DataFrame:
    amenity = F.element_at(F.array(*[F.lit(x) for x in ("clinic", "cafe", "bench", "bank")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    landuse = F.element_at(F.array(*[F.lit(x) for x in ("retail", "industrial", "forest")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.table("supplier").select(F.explode(X.categories({"amenity": amenity, "landuse": landuse})).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("x26_patterns", "SELECT count(*) FILTER (regexp_matches(contact, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS mails, count(*) FILTER (regexp_matches(mobile, '^\\+?[\\d\\s().-]{7,20}$')) AS phones, count(*) FILTER (regexp_matches(customer_id, '^[0-9a-fA-F]{16,64}$')) AS pseudonyms FROM {people} p")
def _(s: Source) -> DataFrame:
    return s.view("people").agg(F.count_if(F.col("contact").rlike(G.EMAIL)).alias("mails"), F.count_if(F.col("mobile").rlike(G.PHONE)).alias("phones"), F.count_if(F.col("customer_id").rlike(G.PSEUDONYM)).alias("pseudonyms"))


@query("x28_service_status", "SELECT kind, CASE WHEN kg - 50 <= 0 THEN 'cleared' WHEN kg > 50 THEN 'partial' ELSE 'street_remaining' END AS status, count(*) AS n FROM {arrivals} a GROUP BY 1, 2")
def _(s: Source) -> DataFrame:
    return s.view("arrivals").groupBy("kind", X.service_status(F.col("kg"), F.lit(50), F.col("kg") - 50).alias("status")).agg(F.count("*").alias("n"))


@query("s06_json_fields", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM {events} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return s.table("events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("s12_hash_files", "SELECT CAST(CAST('0x' || substr(md5(student_id), 1, 8) AS BIGINT) % 8 AS BIGINT) AS bucket, count(*) AS n, min(student_id) AS low, max(student_id) AS high, CAST(1 AS BIGINT) AS files FROM {attendance} a GROUP BY 1")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "hashed")
    T.write_hashed(s.view("attendance").select("student_id"), path, "student_id", 8)
    back = s.spark.read.schema("student_id string, bucket long").parquet(path)
    return back.groupBy("bucket").agg(F.count("*").alias("n"), F.min("student_id").alias("low"), F.max("student_id").alias("high"), F.size(F.collect_set("_metadata.file_path")).cast("long").alias("files"))


@query("g01_catalog", "SELECT path, extension, size_mb, data_layer FROM {catalog} c")
def _(s: Source) -> DataFrame:
    return G.build_catalog(s.view("assets")).select("path", "extension", "size_mb", "data_layer")


@query("g02_enriched", "SELECT path, domain, metadata_complete, privacy_scan_required, domain || CASE data_layer WHEN 'artifact' THEN '_reproducibility_monitoring_or_experiment' WHEN 'raw' THEN '_source_data' WHEN 'gis' THEN '_geospatial_analysis' ELSE '_research_and_operations' END AS purpose FROM {catalog} c")
def _(s: Source) -> DataFrame:
    return G.enrich(G.build_catalog(s.view("assets"))).select("path", "domain", "metadata_complete", "privacy_scan_required", "purpose")


_NAME_RULES = {"email": (5, ("email", "e_mail", "mail_address")), "phone": (5, ("phone", "mobile", "telephone")), "person_name": (3, ("first_name", "last_name", "full_name")), "personal_id": (5, ("national_id", "passport", "customer_id", "student_id")), "date_of_birth": (4, ("date_of_birth", "birth_date", "dob"))}
_NAMED = "SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM {people} p)"
_BY_NAME = " UNION ALL ".join([f"SELECT \"column\", 'credential_or_secret' AS signal, 5 AS weight FROM ({_NAMED}) WHERE regexp_matches(lower(\"column\"), 'api[_-]?key|secret|password|token|private[_-]?key')", *[f"SELECT \"column\", '{signal}', {weight} FROM ({_NAMED}) WHERE lower(\"column\") IN {names}" for signal, (weight, names) in _NAME_RULES.items()]])
_TEXTS = ["full_name", "contact", "mobile", "customer_id", "segment", "birth_date"]
_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (regexp_matches({c}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS mails, count(*) FILTER (regexp_matches({c}, '^\\+?[\\d\\s().-]{{7,20}}$')) AS phones, count(*) FILTER (regexp_matches({c}, '^[0-9a-fA-F]{{16,64}}$')) AS hexes FROM {{people}} p" for c in _TEXTS).replace("{{7,20}}", "{7,20}")
_BY_VALUE = f"SELECT \"column\", 'email_values' AS signal, 5 AS weight FROM ({_COUNTED}) WHERE mails >= 2 UNION ALL SELECT \"column\", 'temporal_quasi_identifier', 2 FROM ({_COUNTED}) WHERE \"column\" LIKE '%\\_date' ESCAPE '\\' AND n > 0 UNION ALL SELECT \"column\", 'phone_like_values', 4 FROM ({_COUNTED}) WHERE n >= 5 AND phones >= 0.8 * n AND NOT \"column\" LIKE '%\\_date' ESCAPE '\\' UNION ALL SELECT \"column\", 'pseudonym_values', 0 FROM ({_COUNTED}) WHERE n >= 5 AND hexes >= 0.95 * n"
_PROFILE = f"SELECT f.\"column\", CASE WHEN signal = 'personal_id' AND h.\"column\" IS NOT NULL THEN 'pseudonymized_identifier' ELSE signal END AS signal, CASE WHEN signal = 'personal_id' AND h.\"column\" IS NOT NULL THEN 3 ELSE weight END AS weight FROM ({_BY_NAME} UNION ALL SELECT * FROM ({_BY_VALUE}) WHERE signal <> 'pseudonym_values') f LEFT JOIN (SELECT \"column\" FROM ({_BY_VALUE}) WHERE signal = 'pseudonym_values') h ON f.\"column\" = h.\"column\""


@query("g03_name_signals", _BY_NAME)
def _(s: Source) -> DataFrame:
    p = s.view("people")
    names = p.select(F.explode(F.map_keys(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.lit(1))]))).alias("column")).distinct()
    return G.name_signals(names)


@query("g04_value_signals", _BY_VALUE)
def _(s: Source) -> DataFrame:
    return G.value_signals(s.view("people"), _TEXTS)


@query("g05_profile", _PROFILE)
def _(s: Source) -> DataFrame:
    return G.profile_privacy(s.view("people"), _TEXTS)


@query("g06_classify", f"""SELECT CAST(sum(weight) AS BIGINT) AS privacy_score, CASE WHEN bool_or(signal IN ('credential_or_secret', 'email', 'email_values', 'phone', 'phone_like_values', 'personal_id', 'date_of_birth')) THEN 'restricted' WHEN sum(weight) >= 4 THEN 'potentially_personal' ELSE 'internal' END AS privacy_classification,
  '[' || string_agg('{{"column":"' || "column" || '","signal":"' || signal || '","weight":' || weight || '}}', ',' ORDER BY "column", signal, weight) || ']' AS signals FROM ({_PROFILE})""")
def _(s: Source) -> DataFrame:
    return G.classify(G.profile_privacy(s.view("people"), _TEXTS)).select("privacy_score", "privacy_classification", "signals")


@query("g07_applied_profile", "SELECT path, sensitivity, CASE sensitivity WHEN 'restricted' THEN 'pseudonymize_or_restrict' WHEN 'potentially_personal' THEN 'manual_review' WHEN 'internal' THEN 'allow_internal_use' ELSE 'complete_scan' END AS privacy_action, metadata_complete AND sensitivity = 'internal' AS governance_complete FROM {catalog} c")
def _(s: Source) -> DataFrame:
    return _catalog(s).select("path", "sensitivity", "privacy_action", "governance_complete")


@query("g08_pseudonymized", "SELECT c_custkey, substr(sha256('pepper::' || customer_id), 1, 20) AS customer_id, substr(sha256('pepper::' || national_id), 1, 20) AS national_id, segment FROM {people} p")
def _(s: Source) -> DataFrame:
    return G.pseudonymize(s.view("people"), "pepper", ["customer_id", "national_id"], ["mobile", "contact", "full_name", "api_key", "balance", "birth_date"])


@query("g09_lineage_events", "SELECT transformation, count(*) AS runs, CAST(sum(k) AS BIGINT) AS inputs FROM (SELECT CASE WHEN o.page_id % 2 = 0 THEN 'train' ELSE 'build' END AS transformation, count(*) AS k FROM {assets} o JOIN {assets} i ON i.page_id IN (o.page_id - 1, o.page_id + 1) JOIN (VALUES (1), (2)) t(twice) ON true WHERE o.page_id % 3 = 1 GROUP BY o.page_id, twice) GROUP BY 1")
def _(s: Source) -> DataFrame:
    return _events(s).groupBy("transformation").agg(F.count("*").alias("runs"), F.sum(F.size("inputs")).alias("inputs"))


@query("g10_staleness", _STALE)
def _(s: Source) -> DataFrame:
    return G.staleness(_events(s), s.view("assets").select("path", F.col("digest").alias("sha256")))


_LINKS = "SELECT o.path AS o, i.path AS i FROM {assets} o JOIN {assets} i ON i.page_id IN (o.page_id - 1, o.page_id + 1) WHERE o.page_id % 3 = 1"
for _name, _from, _to in (("g11_lineage_checks", "data/raw/education/f0.csv", "data/curated/health/f1.parquet"), ("g11_lineage_without_link", "data/curated/health/f1.parquet", "data/raw/education/f0.csv")):
    @query(_name, f"SELECT count(*) > 0 AS not_empty, coalesce(bool_and(o IS NOT NULL AND i IS NOT NULL), true) AS structured, coalesce(bool_or(i = '{_from}' AND o = '{_to}'), false) AS linked FROM ({_LINKS})")
    def _(s: Source, start: str = _from, end: str = _to) -> DataFrame:
        return G.lineage_checks(_events(s), start, end)


_FAILURES = f"SELECT path, 'metadata_incomplete' AS reason FROM {{catalog}} c WHERE NOT metadata_complete UNION ALL SELECT path, 'privacy_block' FROM {{catalog}} c WHERE sensitivity = 'restricted' UNION ALL SELECT output, 'lineage_' || status FROM ({_STALE}) WHERE status <> 'current'"


@query("g12_gate", _FAILURES)
def _(s: Source) -> DataFrame:
    return G.gate(_catalog(s), G.staleness(_events(s), s.view("assets").select("path", F.col("digest").alias("sha256"))))


@query("g12_gate_status", f"SELECT CASE WHEN count(*) > 0 THEN 'BLOCK' ELSE 'PASS' END AS status, count(*) AS failures FROM ({_FAILURES})")
def _(s: Source) -> DataFrame:
    return G.gate_status(G.gate(_catalog(s), G.staleness(_events(s), s.view("assets").select("path", F.col("digest").alias("sha256")))))


@query("g13_scoped_gate", f"SELECT * FROM ({_FAILURES}) WHERE path LIKE '%refuse%' OR path LIKE '%models%'")
def _(s: Source) -> DataFrame:
    scope = F.col("path").contains("refuse") | F.col("path").contains("models")
    return G.gate(_catalog(s), G.staleness(_events(s), s.view("assets").select("path", F.col("digest").alias("sha256"))), scope, strict=True)


@query("g14_transfer_plan", "SELECT path, CASE WHEN sensitivity = 'restricted' THEN 'BLOCK' WHEN sensitivity <> 'internal' THEN 'REVIEW' WHEN NOT metadata_complete THEN 'CONTROLLED' ELSE 'ALLOW' END AS decision, CAST(NULL AS STRING) AS reason FROM {catalog} c WHERE page_id IN (WITH l AS (SELECT max(page_id) AS p FROM {assets} a WHERE page_id % 3 = 1 AND page_id % 2 = 0) SELECT p - 1 FROM l UNION SELECT p + 1 FROM l)")
def _(s: Source) -> DataFrame:
    return G.transfer_plan(_events(s), _catalog(s), "train")


@query("g14_worst_decision", "SELECT data_layer, ['ALLOW', 'CONTROLLED', 'REVIEW', 'BLOCK'][max(CASE WHEN sensitivity = 'restricted' THEN 4 WHEN sensitivity <> 'internal' THEN 3 WHEN NOT metadata_complete THEN 2 ELSE 1 END)] AS worst FROM {catalog} c GROUP BY 1")
def _(s: Source) -> DataFrame:
    cat = _catalog(s)
    return A.worst_of(cat.withColumn("decision", G.transfer_decision({c: F.col(c) for c in ("sensitivity", "metadata_complete")})), "data_layer", "decision", G.TRANSFER)
