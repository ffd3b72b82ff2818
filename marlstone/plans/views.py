"""The views that the queries run on, built from the given tables by arithmetic on keys."""

from __future__ import annotations

from .registry import view

view("attendance", """
SELECT CAST(2022 + l_orderkey % 4 AS STRING) || '_' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS student_id,
  CAST(l_suppkey % 250 + 1 AS INT) AS district_id, CAST(2022 + l_orderkey % 4 AS INT) AS academic_year,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS absent,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) / CAST(10 AS DOUBLE) END AS deprivation_score,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 2 AS INT) END AS rural,
  'SCH-' || lpad(CAST(l_suppkey % 250 + 1 AS STRING), 3, '0') || '-' || lpad(CAST(l_partkey % 20 AS STRING), 2, '0') AS school_code,
  l_orderkey * 7 + l_partkey * 3 + l_linenumber AS k
FROM {lineitem}""")

view("skewed", """
SELECT a.* FROM {attendance} a UNION ALL
SELECT a.* FROM {attendance} a CROSS JOIN (SELECT n_nationkey FROM {nation} WHERE n_nationkey < 20) n WHERE a.district_id = 1""")

view("messy", """
SELECT k, 'export_' || CAST(k % 4 + 1 AS STRING) || '.csv' AS source_file, k AS source_row,
  CASE k % 23 WHEN 0 THEN '' WHEN 1 THEN '  ' || student_id || ' ' WHEN 2 THEN replace(student_id, '_', '-') WHEN 3 THEN 'STU-' || student_id
    WHEN 4 THEN 'unknown' WHEN 5 THEN 'X' || student_id ELSE student_id END AS student_id,
  CASE k % 19 WHEN 0 THEN '' WHEN 1 THEN 'District ' || lpad(CAST(district_id AS STRING), 3, '0') WHEN 2 THEN 'D' || lpad(CAST(district_id AS STRING), 3, '0')
    WHEN 3 THEN 'Dist. ' || lpad(CAST(district_id AS STRING), 3, '0') WHEN 4 THEN CAST(district_id + 1000 AS STRING) WHEN 5 THEN 'n/a'
    WHEN 6 THEN 'DIST ' || CAST(district_id AS STRING) ELSE CAST(district_id AS STRING) END AS district_id,
  CASE k % 17 WHEN 0 THEN '' WHEN 1 THEN substr(CAST(academic_year AS STRING), 3, 2) WHEN 2 THEN CAST(academic_year AS STRING) || '/' || CAST(academic_year + 1 AS STRING)
    WHEN 3 THEN '1999' ELSE CAST(academic_year AS STRING) END AS academic_year,
  CASE k % 13 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN absent = 1 THEN 'Yes' ELSE 'no' END WHEN 2 THEN CASE WHEN absent = 1 THEN 'A' ELSE 'present' END
    WHEN 3 THEN '2' WHEN 4 THEN '-1' WHEN 5 THEN '?' ELSE CAST(absent AS STRING) END AS absent,
  CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN CAST(k % 100 AS STRING) || '.5%' WHEN 2 THEN '0,' || CAST(k % 10 AS STRING) WHEN 3 THEN CAST(k % 90 + 2 AS STRING)
    WHEN 4 THEN 'low' WHEN 5 THEN '1d' WHEN 6 THEN '-0.5' ELSE '0.' || CAST(k % 10 AS STRING) END AS deprivation_score,
  CASE k % 7 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'Urban' ELSE 'rural' END WHEN 1 THEN '?' ELSE CAST(k % 2 AS STRING) END AS rural,
  CASE k % 29 WHEN 0 THEN '' WHEN 1 THEN 'bad school' ELSE school_code END AS school_code
FROM {attendance} a""")

view("enrolment", """
SELECT CAST(2022 + o_orderkey % 4 AS STRING) || '_' || CAST(o_orderkey AS STRING) AS student_id, CAST(o_custkey % 250 + 1 AS INT) AS district_id,
  CAST(2022 + o_orderkey % 4 AS INT) AS academic_year, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS absent,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS INT) / CAST(10 AS DOUBLE) END AS deprivation_score,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS rural,
  'SCH-' || lpad(CAST(o_custkey % 250 + 1 AS STRING), 3, '0') || '-' || lpad(CAST(o_orderkey % 20 AS STRING), 2, '0') AS school_code,
  o_orderkey AS k, 'a.csv' AS source_file, o_orderkey AS source_row
FROM {orders}""")

view("enrolment_dups", """
SELECT * FROM {enrolment} e UNION ALL
SELECT student_id, district_id, academic_year, absent, deprivation_score, rural, school_code, k, 'b.csv', k FROM {enrolment} e WHERE k % 29 = 0 UNION ALL
SELECT student_id, district_id, academic_year, absent, deprivation_score, rural, 'missing', k, 'c.csv', k FROM {enrolment} e WHERE k % 31 = 0 UNION ALL
SELECT student_id, district_id, academic_year, 1 - absent, deprivation_score, rural, school_code, k, 'd.csv', k FROM {enrolment} e WHERE k % 67 = 0 UNION ALL
SELECT student_id, district_id % 250 + 1, academic_year, absent, deprivation_score, rural, school_code, k, 'e.csv', k FROM {enrolment} e WHERE k % 71 = 0""")

view("people", """
SELECT c_custkey, c_name AS full_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS contact,
  '+90 555 ' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') AS mobile, md5(CAST(c_custkey AS STRING)) AS customer_id,
  CAST(c_custkey AS STRING) AS national_id, c_mktsegment AS segment, 'tok' || CAST(c_nationkey AS STRING) AS api_key, c_acctbal AS balance,
  '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS birth_date
FROM {customer}""")

view("panel", """
SELECT CAST(o_custkey % 50 AS INT) AS zone, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS pickups,
  CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS load_c, CAST(max(round(o_totalprice * 100)) AS BIGINT) AS peak_c
FROM {orders} GROUP BY CAST(o_custkey % 50 AS INT), CAST(o_orderdate AS DATE)""")

view("places", """
SELECT c_custkey AS place, CAST((c_custkey * 7919) % 10000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10000 AS DOUBLE) AS y,
  CAST(c_custkey * 31 % 1500 AS INT) AS population, CAST(c_custkey % 4 AS INT) AS healthcare, CAST(c_custkey % 6 AS INT) AS food, c_nationkey AS nation
FROM {customer}""")

view("sites", """
SELECT s_suppkey AS site, CAST((s_suppkey * 6007) % 10000 AS DOUBLE) AS x, CAST((s_suppkey * 3001) % 10000 AS DOUBLE) AS y,
  CASE s_suppkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'supermarket' WHEN 2 THEN 'major_retail' WHEN 3 THEN 'food_service' ELSE 'industrial' END AS category,
  CASE WHEN s_suppkey % 3 = 0 THEN 'small' WHEN s_suppkey % 3 = 1 THEN 'medium' ELSE 'large' END AS bin_type, CAST(100 + s_suppkey % 3 * 200 AS DOUBLE) AS capacity
FROM {supplier}""")

view("edges", """
SELECT CAST(l_partkey AS BIGINT) AS src, CAST(-l_suppkey - 1 AS BIGINT) AS dst, min(CAST(l_quantity AS BIGINT)) AS w
FROM {lineitem} GROUP BY CAST(l_partkey AS BIGINT), CAST(-l_suppkey - 1 AS BIGINT)""")

view("hubs", "SELECT min(dst) AS hub FROM {edges} e UNION SELECT max(dst) FROM {edges} e")

view("requests", """
SELECT event_id, ts, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method, '/' || event_type AS route,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status, CAST(round(value * 100) AS BIGINT) / CAST(100000 AS DOUBLE) AS seconds
FROM {events}""")

view("arrivals", """
SELECT CAST(user_id AS INT) AS bin, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute, event_id,
  CASE WHEN event_type = 'purchase' THEN 'pickup' ELSE 'arrival' END AS kind, CAST(round(value) AS BIGINT) AS kg
FROM {events}""")

view("assets", """
SELECT CAST(page_id AS STRING) AS asset_id, CASE page_id % 6 WHEN 0 THEN 'data/raw/education/' WHEN 1 THEN 'data/curated/health/' WHEN 2 THEN 'data/processed/refuse/'
    WHEN 3 THEN CASE WHEN page_id % 12 = 9 THEN 'data/gis/processed_v2/simulation/transport/' ELSE 'data/gis/' END WHEN 4 THEN 'artifacts/models/' ELSE 'docs/' END || 'f' || CAST(page_id AS STRING) || CASE page_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.parquet' WHEN 2 THEN '.json' ELSE '.bin' END AS path,
  CAST(length(html) AS BIGINT) AS size_bytes, md5(coalesce(html, '')) AS digest, page_id
FROM {pages}""")
