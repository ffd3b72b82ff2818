"""Queries that go through sinks and scans, and composite spatial and serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import quality as Q
from ..operators import spatial as S
from ..sources import tables as T
from .aggregate_queries import rounded
from .registry import Source, query


@query("s01_csv_scan", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM {orders} GROUP BY 1")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "csv")
    s.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("header", True).csv(path)
    back = T.read_csv(s.spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("s02_export_rows", "SELECT c_custkey AS key, c_name, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) + 1 AS source_row FROM {customer}")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "exports")
    four = s.table("customer").repartitionById(4, (F.col("c_custkey") % 4).cast("int")).sortWithinPartitions("c_custkey")
    four.select(F.col("c_custkey").cast("string").alias("key"), "c_name").write.option("header", True).csv(path)
    return T.read_exports(s.spark, path, ["key", "c_name"]).select(F.col("key").cast("long").alias("key"), "c_name", "source_row")


@query("s04_malformed_rows", "SELECT count(*) FILTER (c_custkey % 10 = 0) AS malformed FROM {customer}")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "lines")
    s.table("customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat_ws(",", "c_custkey", "c_nationkey", "c_mktsegment")).otherwise(F.concat_ws(",", "c_custkey", "c_nationkey")).alias("value")).write.text(path)
    return T.malformed_rows(s.spark, path, 2).agg(F.sum("malformed").alias("malformed"))


@query("s05_parquet_round_trip", "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY 1")
def _(s: Source) -> DataFrame:
    return T.materialise(s.table("lineitem").select("l_returnflag", "l_quantity"), "parquet").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s07_feature_collection", "SELECT site, x, y, category FROM {sites} s")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "features")
    T.to_features(s.view("sites").select("site", "x", "y", "category"), "x", "y").write.text(path)
    rows = s.spark.read.text(path).select(F.from_json("value", "geometry struct<coordinates array<double>>, properties struct<site long, category string>").alias("f"))
    return rows.select("f.properties.site", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "f.properties.category")


_FILES = "SELECT s_nationkey, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) AS body FROM {supplier} GROUP BY 1"


def _files_by_nation(s: Source, path: str) -> None:
    """A text file for each nation with its suppliers' names."""
    named = s.table("supplier").select("s_nationkey", "s_suppkey", "s_name").repartition(25, "s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    named.select("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(path)


@query("s08_binary_assets", f"SELECT s_nationkey, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size_bytes FROM ({_FILES})")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "assets")
    _files_by_nation(s, path)
    found = T.binary_assets(s.spark, path, skip=(".crc",)).filter("size_bytes > 0")
    return found.select(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int").alias("s_nationkey"), "sha256", "size_bytes")


@query("s09_whole_texts", f"SELECT sha256(trim(replace(lower(body), chr(10), ' '))) AS sha256 FROM ({_FILES})")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "texts")
    _files_by_nation(s, path)
    return T.whole_texts(s.spark, path).select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("s10_single_csv", "SELECT c_nationkey, count(*) AS n, CAST(1 AS BIGINT) AS files FROM {customer} GROUP BY 1")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "single")
    T.write_single_csv(s.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), path)
    rows = T.read_csv(s.spark, path, "c_nationkey int, n long").select("*", F.col("_metadata.file_path").alias("file"))
    return rows.join(rows.agg(F.countDistinct("file").alias("files")), how="cross").select("c_nationkey", "n", "files")


@query("s11_split_sink", "SELECT CASE WHEN c_acctbal < 0 THEN 'quarantined' ELSE 'accepted' END AS status, count(*) AS n FROM {customer} GROUP BY 1")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "split")
    T.write_split(s.table("customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "negative").alias("quarantine_reason")), path)
    return s.spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("s13_event_log", "SELECT event_type, 2 * count(*) AS n FROM {events} GROUP BY 1")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "log")
    for _i in range(2):
        T.append_log(s.table("events").select("event_id", "event_type"), path)
    return s.spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s15_idempotent_append", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM {customer}")
def _(s: Source) -> DataFrame:
    path, keys = T.scratch(s.spark, "register"), s.table("customer").select("c_custkey")
    keys.filter("c_custkey % 3 = 0").write.parquet(path)
    for _i in range(2):
        T.append_unseen(s.spark, path, keys, ["c_custkey"])
    return s.spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query("s16_report", "SELECT count(*) AS orders, round(avg(o_totalprice), 4) AS mean FROM {orders}")
def _(s: Source) -> DataFrame:
    path = T.scratch(s.spark, "report")
    T.write_report(s.table("orders").agg(F.struct(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean")).alias("report")), path)
    return s.spark.read.schema("report struct<orders long, mean double>").json(path).select("report.*")


@query("p01_synonyms", "SELECT source_file, count(*) AS n FROM {messy} m WHERE school_code <> '' GROUP BY 1")
def _(s: Source) -> DataFrame:
    named = Q.canonical_names(s.view("messy").withColumnsRenamed({"school_code": "SchoolCode", "student_id": "StudentID"}))
    return named.filter("school_code <> ''").groupBy("source_file").agg(F.count("*").alias("n"))


@query("p03_drop_columns", "SELECT c_custkey, segment FROM {people} p")
def _(s: Source) -> DataFrame:
    return s.view("people").drop("full_name", "contact", "mobile", "customer_id", "national_id", "api_key", "balance", "birth_date")


_D = "sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))"


@query("j13_snap_to_node", f"SELECT site, place, round(d, 6) AS distance FROM (SELECT site, place, {_D} AS d, row_number() OVER (PARTITION BY site ORDER BY {_D}, place) AS r FROM {{sites}} t CROSS JOIN {{places}} p) WHERE r = 1")
def _(s: Source) -> DataFrame:
    return rounded(S.nearest(s.view("sites"), s.view("places"), "site", "place"), 6)


@query("l01_cell_features", f"""WITH c AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, category, count(*) AS n FROM {{sites}} s GROUP BY 1, 2, 3), w AS (SELECT CAST(unnest(generate_series(CAST(floor(min(x) / 2000) AS BIGINT), CAST(floor(max(x) / 2000) AS BIGINT))) AS BIGINT) AS cx FROM {{places}} p), h AS (SELECT CAST(unnest(generate_series(CAST(floor(min(y) / 2000) AS BIGINT), CAST(floor(max(y) / 2000) AS BIGINT))) AS BIGINT) AS cy FROM {{places}} p), g AS (SELECT cx, cy, cx * 2000 + 1000.0 AS x, cy * 2000 + 1000.0 AS y FROM w CROSS JOIN h)
  SELECT p.cx, p.cy, CAST(coalesce((SELECT sum(n) FROM c WHERE c.cx = p.cx AND c.cy = p.cy AND category = 'healthcare'), 0) AS BIGINT) AS healthcare, CAST(coalesce((SELECT sum(n) FROM c WHERE c.cx = p.cx AND c.cy = p.cy AND category = 'supermarket'), 0) AS BIGINT) AS supermarket,
  CAST(coalesce((SELECT sum(n * CASE category WHEN 'healthcare' THEN 4 WHEN 'supermarket' THEN 3 ELSE 0 END) FROM c WHERE c.cx = p.cx AND c.cy = p.cy), 0) AS DOUBLE) AS activity, round((SELECT min({_D}) FROM {{sites}} t WHERE category = 'healthcare'), 6) AS nearest_healthcare FROM g p""")
def _(s: Source) -> DataFrame:
    cells = S.grid(S.bounds(s.view("places")), 2000.0).select("cx", "cy", F.struct("cx", "cy").alias("cell"), (F.col("cx") * 2000 + 1000.0).alias("x"), (F.col("cy") * 2000 + 1000.0).alias("y"))
    counts = S.points_in_cells(s.view("sites"), 2000.0).groupBy("cx", "cy").pivot("category", ["healthcare", "supermarket"]).count()
    near = S.nearest(cells, s.view("sites").filter("category = 'healthcare'"), "cell", "site").select("cell", F.round("distance", 6).alias("nearest_healthcare"))
    both = cells.join(counts, ["cx", "cy"], "left").fillna(0, ["healthcare", "supermarket"]).join(near, "cell")
    return both.select("cx", "cy", "healthcare", "supermarket", X.weighted({c: F.col(c) for c in ("healthcare", "supermarket")}, X.ACTIVITY_WEIGHT).alias("activity"), "nearest_healthcare")


@query("l02_bin_rollup", f"SELECT t.site, count(r.place) AS places, CAST(coalesce(sum(population), 0) AS BIGINT) AS population, round(coalesce(max(d), 0), 6) AS farthest FROM {{sites}} t LEFT JOIN (SELECT place, population, site, d FROM (SELECT place, population, site, {_D} AS d, row_number() OVER (PARTITION BY place ORDER BY {_D}, site) AS r FROM {{places}} p CROSS JOIN {{sites}} t) WHERE r = 1) r ON r.site = t.site GROUP BY 1")
def _(s: Source) -> DataFrame:
    assigned = S.nearest(s.view("places"), s.view("sites"), "place", "site").join(s.view("places").select("place", "population"), "place")
    sums = assigned.groupBy("site").agg(F.count("*").alias("places"), F.sum("population").alias("population"), F.round(F.max("distance"), 6).alias("farthest"))
    return s.view("sites").select("site").join(sums, "site", "left").fillna(0)


@query("c02_page", "SELECT district_id, count(*) AS n FROM {attendance} a WHERE academic_year = 2023 GROUP BY 1 ORDER BY district_id LIMIT 20 OFFSET 20")
def _(s: Source) -> DataFrame:
    return s.view("attendance").filter("academic_year = 2023").groupBy("district_id").agg(F.count("*").alias("n")).orderBy("district_id").offset(20).limit(20)


@query("c03_report_rows", "SELECT district_id, 'District ' || district_id || ': ' || n || ' days, ' || absent || ' absent' AS line FROM (SELECT district_id, count(*) AS n, sum(absent) AS absent FROM {attendance} a GROUP BY 1)")
def _(s: Source) -> DataFrame:
    rows = s.view("attendance").groupBy("district_id").agg(F.count("*").alias("n"), F.sum("absent").alias("absent"))
    return rows.select("district_id", F.format_string("District %d: %d days, %d absent", "district_id", "n", "absent").alias("line"))
