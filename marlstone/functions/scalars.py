"""Scalar functions on text, numbers, dates and arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes with their default speeds in km/h, vehicle caps, and factors by vehicle and class.
DEFAULT_SPEED = {
    "motorway": 80, "motorway_link": 50, "trunk": 70, "trunk_link": 50, "primary": 50, "primary_link": 40, "secondary": 45, "secondary_link": 35,
    "tertiary": 40, "tertiary_link": 30, "residential": 30, "living_street": 20, "unclassified": 30,
}
VEHICLE_CAP = {"small_truck": 42.0, "large_truck": 34.0}
VEHICLE_FACTOR = {
    "small_truck": {"motorway": 0.95, "trunk": 0.90, "primary": 0.85, "secondary": 0.82, "tertiary": 0.78, "residential": 0.70, "living_street": 0.55, "unclassified": 0.70},
    "large_truck": {"motorway": 0.90, "trunk": 0.85, "primary": 0.78, "secondary": 0.74, "tertiary": 0.68, "residential": 0.58, "living_street": 0.42, "unclassified": 0.58},
}
RUSH_FACTOR = {"motorway": 1.30, "trunk": 1.45, "primary": 1.60, "secondary": 1.50, "tertiary": 1.35, "residential": 1.20, "living_street": 1.10, "unclassified": 1.20}
RAIN_FACTOR = 1.12
SLOWEST = 8.0
# Weights of counts by category, for activity and for demand in kg.
ACTIVITY_WEIGHT = {"healthcare": 4, "major_retail": 5, "supermarket": 3, "food_service": 1.5, "market": 2.5, "hotel": 2, "education": 1.5, "commercial": 2, "industrial": 2, "recreation": 0.5}
DEMAND_KG = {"healthcare": 80, "major_retail": 130, "supermarket": 65, "food_service": 24, "market": 70, "hotel": 35, "education": 18, "commercial": 45, "industrial": 55, "recreation": 8}
DEMAND_KG_PER_PERSON = 0.90
# What a feature's tags say about its activity.
CATEGORY_RULES = {
    "healthcare": ("amenity", ("hospital", "clinic")), "food_service": ("amenity", ("restaurant", "cafe", "fast_food")), "education": ("amenity", ("school", "university")), "market": ("amenity", ("marketplace",)),
    "supermarket": ("shop", ("supermarket", "convenience")), "major_retail": ("shop", ("mall", "department_store")), "hotel": ("tourism", ("hotel",)), "commercial": ("landuse", ("commercial",)),
    "industrial": ("landuse", ("industrial",)), "recreation": ("leisure", ("park", "sports_centre", "stadium")),
}


def choice(x: Column, table: Mapping[str, object], default: object) -> Column:
    """The table's value for x."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), F.lit(default))


def clean_text(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def normalized_name(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " -", "__")


def per_cent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 2), F.lit("%"))


def raw_and_human(x: Column, human: Column) -> Column:
    return F.struct(x.alias("raw"), human.alias("human"))


def path_layer(path: Column) -> Column:
    """The first of raw, curated, processed (or cleaned), gis and artifact that a folder of the path names, else other."""
    parts = F.split(path, "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    return F.when(has("raw"), "raw").when(has("curated"), "curated").when(has("processed", "cleaned"), "processed").when(has("gis"), "gis").when(has("artifact", "artifacts"), "artifact").otherwise("other")


def path_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def path_domain(path: Column, skip: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Below artifacts/ the next part; below data/ the first folder that is not in `skip` and starts with none of `prefixes`; else general_project_data."""
    parts = F.split(path, "/")
    folders = F.filter(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), lambda p: ~p.isin(*skip) & ~p.rlike(f"^({'|'.join(prefixes) or '$.'})"))
    top = F.element_at(parts, 1)
    found = F.when(top == "artifacts", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("artifacts"))).when(top == "data", F.try_element_at(folders, F.lit(1)))
    return F.coalesce(found, F.lit("general_project_data"))


def first_listed(x: Column) -> Column:
    """The first element of a list written as text, or the text itself."""
    return F.when(x.startswith("["), F.nullif(F.regexp_extract(x, r"""\[\s*['"]?([^'",\]]+)""", 1), F.lit(""))).otherwise(x)


def road_class(x: Column) -> Column:
    return F.when(x.isin("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"), F.replace(x, F.lit("_link"), F.lit(""))).otherwise(x)


def speed_kph(text: Column, highway: Column) -> Column:
    """The first number of a speed text (miles per hour converted), by default that of the class, within 10 and 90."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    stated = F.when(F.lower(text).contains("mph"), number * 1.60934).otherwise(number)
    return F.least(F.greatest(F.coalesce(stated, choice(highway, DEFAULT_SPEED, 30).cast("double")), F.lit(10.0)), F.lit(90.0))


def vehicle_speed(speed: Column, highway: Column, vehicle: str) -> Column:
    table = VEHICLE_FACTOR[vehicle]
    return F.greatest(F.lit(SLOWEST), F.least(speed * choice(road_class(highway), table, table["unclassified"]), F.lit(VEHICLE_CAP[vehicle])))


def travel_seconds(length_m: Column, kph: Column) -> Column:
    return length_m / (kph * 1000 / 3600)


def clock(minute: Column, start: int = 480) -> Column:
    """HH:MM:SS of a minute counted from `start`, cut to whole seconds."""
    return F.date_format(F.timestamp_seconds(F.lit(start * 60) + F.floor(minute * 60)), "HH:mm:ss")


def interval_days(per_week: Column) -> Column:
    """Whole days between services, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(7.0) / per_week).cast("int"))


def split_by_capacity(total: Column, capacity: Column) -> Column:
    return F.struct(F.least(total, capacity).alias("inside"), F.greatest(F.lit(0), total - capacity).alias("outside"))


def safe_percent(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double") * 100, b.cast("double"))


def weighted(counts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    return sum((F.coalesce(counts[c], F.lit(0)) * F.lit(float(w)) for c, w in weights.items() if c in counts), F.lit(0.0))


def categories(tags: Mapping[str, Column]) -> Column:
    """All activities that a feature's tags name; land use retail counts as major retail too."""
    rules = [F.when(tags[k].isin(*v), F.lit(c)) for c, (k, v) in CATEGORY_RULES.items() if k in tags]
    if "landuse" in tags:
        rules.append(F.when(tags["landuse"] == "retail", F.lit("major_retail")))
    return F.array_distinct(F.array_compact(F.array(*rules)))


def salted_digest(x: Column, salt: str, length: int = 20) -> Column:
    """Leading hex digits of SHA-256 of salt::value; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "::"), x.cast("string")), 256), 1, length)


def md5_bucket(x: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))


def service_status(before: Column, taken: Column, left: Column) -> Column:
    return F.when(left <= 0, "cleared").when((taken > 0) & (before > taken), "partial").otherwise("street_remaining")
