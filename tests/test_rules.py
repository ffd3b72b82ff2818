"""Rules on hand-made rows, invariants, sinks and streams."""

from __future__ import annotations

import datetime
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import normalize as N
from marlstone.functions import scalars as X
from marlstone.operators import aggregates as A
from marlstone.operators import governance as G
from marlstone.operators import joins as J
from marlstone.operators import quality as Q
from marlstone.operators import service as V
from marlstone.operators import graphs
from marlstone.operators import spatial as S
from marlstone.sources import tables as T
from marlstone.streaming import requests as R

FOLDER = "/root/testdata/sf0.001"


def values(spark, column, inputs, ddl="x string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)], f"i int, {ddl}")
    return [tuple(r.v) if hasattr(r.v, "asDict") else r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_student_rules(spark):
    got = values(spark, N.student(N.trimmed(F.col("x"))), ["2022_15", " 2022_15\t", "STU-2022_15", "2022-15", "stu-2022_15", "", None, "N/A", "x"])
    assert got == [("2022_15", "direct"), ("2022_15", "direct"), ("2022_15", "normalized"), ("2022_15", "normalized"), ("stu-2022_15", "unresolved"), ("", "unresolved"), ("", "unresolved"), ("", "unresolved"), ("x", "unresolved")]


def test_district_rules(spark):
    cases = [("7", ""), ("0", "SCH-012-01"), ("1001", "SCH-012-01"), ("District 007", ""), ("DIST 7", ""), ("Dist.7", ""), ("d007", ""), ("D7", "SCH-999-01"), ("Distrct 7", None), (None, "SCH-250-00")]
    got = values(spark, N.district(N.trimmed(F.col("x")), F.col("s")), cases, "x string, s string")
    assert got == [(7, "direct"), (12, "recovered_from_school"), (12, "recovered_from_school"), (7, "normalized"), (7, "normalized"), (7, "normalized"), (7, "normalized"), (None, "unresolved"), (None, "unresolved"), (250, "recovered_from_school")]


def test_year_and_share_rules(spark):
    got = values(spark, N.year(N.trimmed(F.col("x")), F.col("s")), [("2023", ""), ("23", ""), ("2023/2024", ""), ("1999", "2024_1"), ("1999", "1999_1"), (None, None)], "x string, s string")
    assert got == [(2023, "direct"), (2023, "normalized"), (2023, "normalized"), (2024, "recovered_from_student_id"), (None, "unresolved"), (None, "unresolved")]
    got = values(spark, N.share(N.trimmed(F.col("x"))), ["0.5", "0,5", "12.5%", "50", "100", "101", "-0.1", "1d", "low", "", None, "150%", "1e-1"])
    assert got == [(0.5, "direct"), (0.5, "direct"), (0.125, "normalized"), (0.5, "normalized"), (1.0, "normalized"), *[(None, "unresolved")] * 6, (None, "unresolved"), (0.1, "direct")]


def test_binary_rules(spark):
    got = values(spark, N.binary(N.trimmed(F.col("x")), N.ABSENT_ZERO, N.ABSENT_ONE), ["1", "0", "Yes", "P", "2", "-1", "?", None])
    assert got == [(1, "direct"), (0, "direct"), (1, "normalized"), (0, "normalized"), *[(None, "unresolved")] * 4]


def test_scalars(spark):
    assert values(spark, X.interval_days(F.col("x")), [2.8, 14.0, 2.0, 100.0], "x double") == [2, 1, 4, 1]
    assert values(spark, X.salted_digest(F.col("x"), "s"), [None]) == [None]
    assert values(spark, X.clean_text(F.col("x")), ["  A\n\tB ", None]) == ["a b", None]
    assert values(spark, X.speed_kph(F.col("x"), F.lit("residential")), ["30 mph", "50", "fast", "200", None], "x string") == [pytest.approx(48.2802), 50.0, 30.0, 90.0, 30.0]


def test_quarantine_keeps_every_row(spark):
    from marlstone.plans.registry import Source

    rows = Source(spark, FOLDER).view("messy")
    accepted, rejected = Q.split_quarantine(Q.clean_records(rows))
    assert accepted.count() + rejected.count() == rows.count()


def test_header_dialects_need_all_columns(spark):
    with pytest.raises(ValueError, match="no column"):
        Q.read_variants([spark.createDataFrame([("1",)], "StudentID string")])


def test_salting_changes_nothing(spark):
    rows = spark.createDataFrame([(1, i, i % 2, None if i % 3 == 0 else i / 7, None if i % 5 == 0 else i % 2) for i in range(500)], "k int, i int, o int, s double, f int")
    plain = A.rate_metrics(rows, ["k"], "o", "s", "f").first()
    salted = A.salted_metrics(rows, ["k"], "o", "s", "f", ["i"], F.col("k") == 1).first()
    assert list(salted) == [pytest.approx(x) for x in plain]
    assert A.merge_metrics(A.partial_metrics(rows.limit(0), ["k"], "o", "s", "f"), ["k"]).count() == 0


def test_checked_join_raises(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, w int")
    with pytest.raises(ValueError, match="not unique"):
        J.checked_join(a, b, ["k"])
    assert J.checked_join(b, a, ["k"]).count() == 2


def test_nearest_settles_far_points(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0), (3, 5.0, 0.0)], "place int, x double, y double")
    right = spark.createDataFrame([(10, 4.0, 0.0), (11, 6.0, 0.0)], "site int, x double, y double")
    got = {r.place: (r.site, round(r.distance, 3)) for r in S.nearest(left, right, "place", "site").collect()}
    assert got == {1: (10, 4.0), 2: (11, 1268.557), 3: (10, 1.0)}


def test_interval_joins(spark):
    rng = random.Random(5)
    spans = [(i, rng.randrange(3), a := rng.choice([rng.randrange(-50, 50), rng.randrange(-(10**12), 10**12)]), a + rng.choice([0, 1, 2, 7, 64, 10**11, -3])) for i in range(80)] + [(90, 1, None, 5), (91, 1, 5, None), (92, None, 0, 10), (93, 0, -(10**15), 10**15)]
    points = [(i, rng.randrange(3), rng.choice([rng.randrange(-60, 60), rng.randrange(-(10**12), 10**12)])) for i in range(150)] + [(200, 1, None), (201, None, 3), (0, 0, 7), (0, 0, 7)]
    p_df, w_df = spark.createDataFrame(points, "p int, k int, at long"), spark.createDataFrame(spans, "w int, k int, b long, e long")
    for by in ([], ["k"]):
        got = Counter((r.p, r.w) for r in J.interval_join(p_df, w_df if by else w_df.drop("k"), "at", "b", "e", by).collect())
        assert got == Counter((p, w) for p, k, at in points for w, j, b, e in spans if None not in (at, b, e) and b <= at < e and (not by or (k is not None and k == j)))
    other = w_df.toDF("w2", "k", "b2", "e2")
    got = Counter((r.w, r.w2) for r in J.overlap_join(w_df, other, ("b", "b2"), ("e", "e2"), ["k"]).collect())
    whole = [s for s in spans if None not in s]
    assert got == Counter((w, v) for w, k, b, e in whole for v, j, c, d in whole if k == j and b < e and c < d and b < d and c < e)
    assert J.interval_join(p_df, w_df.limit(0).drop("k"), "at", "b", "e").isEmpty()


def test_heavy_keys_are_found(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 3, 1).when(F.col("id") % 10 < 5, 2).otherwise(F.col("id") % 5000 + 10).alias("k"), F.col("id").alias("s"), (F.col("id") % 2).alias("o"), (F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("f"))
    hot = {r.k: r.h for r in rows.select("k", F.xxhash64("k").alias("h")).filter("k <= 2").distinct().collect()}
    assert set(A.heavy_hashes(rows, ["k"], 0.1)) == set(hot.values())
    plain, salted = A.rate_metrics(rows, ["k"], "o", "v", "f"), A.salted_metrics(rows, ["k"], "o", "v", "f", ["s"])
    same = [sorted(tuple(round(v, 9) for v in r) for r in df.select(plain.columns).collect()) for df in (plain, salted)]
    assert same[0] == same[1]
    assert A.heavy_hashes(rows.limit(0), ["k"]) == []


def test_nearest_in_crowded_places(spark):
    rng = random.Random(11)
    inf, nan = float("inf"), float("nan")
    crowd = [(i, rng.uniform(500, 500.001), rng.uniform(500, 500.001), "ab"[i % 2]) for i in range(900)]  # nine tenths of all, in a cell
    right = crowd + [(1000 + i, rng.uniform(0, 1000), rng.uniform(0, 1000), "ab"[i % 2]) for i in range(100)] + [(2000 + k, 3.0, 3.0, "b") for k in (5, 2, 9)] + [(3000, inf, 1.0, "a"), (3001, None, 1.0, "a"), (3002, 1.0, nan, "a"), (3003, 3.0, 3.0, None)]
    left = [(i, rng.uniform(-100, 1100), rng.uniform(-100, 1100), 0) for i in range(150)] + [(200 + i, rng.uniform(499.9995, 500.0015), rng.uniform(499.9995, 500.0015), 0) for i in range(150)] + [(400, 3.0, 3.0, 0), (401, inf, 0.0, 0), (402, -inf, nan, 0), (403, None, 0.0, 0), (404, 1e12, 1e12, 0), (400, 3.0, 3.0, 0)]
    l_df, r_df = spark.createDataFrame(left, "place int, x double, y double, id int"), spark.createDataFrame(right, "site int, x double, y double, kind string")
    for by in ([], ["kind"]):
        got = {(r.place, *(r[c] for c in by)): (r.site, r.distance) for r in S.nearest(l_df, r_df, "place", "site", by=by).collect()}
        want = {}
        for p, x, y, _ in left:
            for kind in "ab" if by else [None]:
                if x is not None and abs(x) < inf and abs(y) < inf:
                    want[(p, kind) if by else (p,)] = min((math.hypot(x - rx, y - ry), s) for s, rx, ry, k in right if rx is not None and abs(rx) < inf and abs(ry) < inf and (not by or k == kind))
        assert set(got) == set(want) and all(got[k][1] == pytest.approx(want[k][0]) for k in want)
        assert sum(got[k][0] != want[k][1] for k in want) == 0
    assert S.nearest(l_df, r_df.limit(0), "place", "site").isEmpty() and S.nearest(l_df.limit(0), r_df, "place", "site", by=["kind"]).isEmpty()


def test_shortest_times_with_keys_and_closed_edges(spark):
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("a", 1, 3, 5.0), ("b", 1, 2, float("inf")), ("b", 1, 3, 4.0), ("b", 3, 3, None)], "t string, src int, dst int, w double")
    got = {(r.t, r.node): r.cost for r in graphs.shortest_times(edges, spark.createDataFrame([("a", 1), ("b", 1)], "t string, origin int"), ["t"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0, ("b", 3): 4}


def test_replay(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(1, day, 10, 1, "arrival", 80), (1, day, 20, 2, "arrival", 50), (1, day, 20, 3, "pickup", 60), (1, datetime.date(2024, 1, 2), 5, 4, "pickup", 500)]
    got = V.replay(spark.createDataFrame(rows, "bin int, day date, minute int, event_id int, kind string, kg int"), 100.0).orderBy("day").collect()
    assert [tuple(r)[2:] for r in got] == [(130.0, 60.0, 0.0, 70.0, 0.0, 30.0), (0.0, 70.0, 430.0, 0.0, 0.0, 0.0)]
    with pytest.raises(Exception, match="after the end of its day"):
        V.replay(spark.createDataFrame([(1, day, 1441, 1, "arrival", 1)], "bin int, day date, minute int, event_id int, kind string, kg int"), 1.0).collect()


def test_profile_on_empty_table(spark):
    people = spark.createDataFrame([], "id int, email string, note string")
    assert {(r.column, r.signal) for r in G.profile_privacy(people, ["email", "note"]).collect()} == {("email", "email")}


def test_csv_exports(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"export_{i}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(3)))
    (tmp_path / "other.txt").write_text("a,b\n1,2\n")
    rows = T.read_exports(spark, str(tmp_path), ["a", "b"]).orderBy("source_file", "source_row").collect()
    assert [(r.source_file, r.source_row, r.a, r.b) for r in rows] == [(f"export_{i}.csv", j + 2, str(i), str(j)) for i in (1, 2) for j in range(3)]
    (tmp_path / "export_3.csv").write_text("a,b\n1\n1,2,3\n1,2\n")
    bad = {r.source_file: r.malformed for r in T.malformed_rows(spark, str(tmp_path / "export_3.csv"), 2).collect()}
    assert bad == {"export_3.csv": 2}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "k int, quarantine_reason string")
    T.write_split(df, str(tmp_path / "split"))
    assert {r.status: r["count"] for r in spark.read.parquet(str(tmp_path / "split")).groupBy("status").count().collect()} == {"accepted": 2, "quarantined": 1}
    T.write_single_csv(df, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    T.write_hashed(df, str(tmp_path / "hashed"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "hashed")).count() == 3
    store = str(tmp_path / "register")
    df.select("k").limit(1).write.parquet(store)
    for _ in range(2):
        T.append_unseen(spark, store, df.select("k"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(store).collect()) == [1, 2, 3]
    T.append_log(df, str(tmp_path / "log"))
    T.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    target = T.upsert(spark, store, spark.createDataFrame([(3,), (9,)], "k int"), ["k"])
    assert spark.read.parquet(target).count() == 4
    T.to_features(spark.createDataFrame([(1.0, 2.0, "n")], "x double, y double, name string"), "x", "y").write.text(str(tmp_path / "geo"))
    lines = "".join(p.read_text() for p in (tmp_path / "geo").glob("*.txt"))
    (tmp_path / "places.json").write_text('{"type": "FeatureCollection", "features": [' + lines.strip() + "]}")
    assert tuple(T.read_feature_collection(spark, str(tmp_path / "places.json"), "name string").first()) == (1.0, 2.0, "n")
    assets = T.binary_assets(spark, str(tmp_path), skip=(".crc",))
    assert assets.filter(F.col("path").contains("places.json")).first().size_bytes == len((tmp_path / "places.json").read_bytes())


def test_alert_stream_equals_table(spark):
    start = datetime.datetime(2024, 1, 1)
    on = [0, 1, 1, 1, 1, 0, 1, 0, 1, 1, 1, 1]
    rows = [(k, start + datetime.timedelta(seconds=60 * i), bool(v) if k == 1 else not v) for k in (1, 2) for i, v in enumerate(on)]
    samples = spark.createDataFrame(rows, "k int, ts timestamp, on boolean")
    path = T.scratch(spark, "samples")
    # files that cut and mix the samples of a key, one a batch
    samples.repartition(5).write.parquet(path)
    stream = R.with_event_time(spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path), delay="1 hour")
    last = spark.createDataFrame([(3, start + datetime.timedelta(hours=2), False)], samples.schema)  # moves the watermark past all others
    last.write.mode("append").parquet(path)
    got = sorted(map(tuple, R.run_to_end(R.alert_stream(stream, "k"), "append").collect()))
    table = R.alert_transitions(R.held_alert(samples, "k", "ts", F.col("on")), "k", "ts")
    assert got == sorted(map(tuple, table.collect())) and len(got) == 3


def test_alert_stream_leaves_out_late_samples(spark):
    start = datetime.datetime(2024, 1, 1)
    path = T.scratch(spark, "late-samples")
    for batch in ([(1, 0, True), (1, 180, False), (2, 0, True), (2, 1, True)], [(1, 179, True), (2, 200, True)], [(3, 400, False)]):  # the second brings a sample that the watermark has passed
        spark.createDataFrame([(k, start + datetime.timedelta(minutes=m), v) for k, m, v in batch], "k int, ts timestamp, on boolean").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their time
    stream = R.with_event_time(spark.readStream.schema("k int, ts timestamp, on boolean").option("maxFilesPerTrigger", 1).parquet(path), delay="1 minute")
    got = [tuple(r) for r in R.run_to_end(R.alert_stream(stream, "k", 120), "append").collect()]
    assert got == [(2, start + datetime.timedelta(minutes=200), "firing")]


def test_storage_register_is_idempotent(spark):
    path = T.scratch(spark, "register")
    spark.createDataFrame([("old",)], "object_name string").write.parquet(path)
    batch = spark.createDataFrame([("main", "a", "OBJECT_FINALIZE"), ("main", "a", "OBJECT_FINALIZE"), ("main", "gone", "OBJECT_FINALIZE"), (None, "a", "x"), ("other", "a", "OBJECT_FINALIZE")], "bucket string, object_name string, event_type string")
    status = R.storage_status(batch, "main", spark.createDataFrame([("a",), ("old",)], "object_name string"))
    assert sorted(r.status for r in status.collect()) == ["error:missing_field", "error:object_not_found", "ignored:bucket", "registered", "registered"]
    for i in range(2):
        R.register(path)(status, i)
    assert sorted(r.object_name for r in spark.read.parquet(path).collect()) == ["a", "old"]


def test_logistic_model_equals_newton_steps(spark):
    from marlstone.operators import features as M
    from marlstone.plans.registry import Source

    rows = M.stratified_split(Source(spark, FOLDER).view("attendance").filter("rural IS NOT NULL AND deprivation_score IS NOT NULL"), "student_id", "rural")
    model = M.fit_logistic(rows.filter("part = 'train'"), ["academic_year"], ["deprivation_score", "absent"], "rural")
    pdf = rows.select("part", "academic_year", "deprivation_score", "absent", "rural").toPandas()
    years = sorted(pdf.academic_year.unique())
    x = np.column_stack([np.ones(len(pdf)), *[(pdf.academic_year == y).to_numpy(float) for y in years[1:]], pdf.deprivation_score, pdf.absent])
    train, y, beta = (pdf.part == "train").to_numpy(), pdf.rural.to_numpy(float), np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-x[train] @ beta))
        beta += np.linalg.solve((x[train] * (p * (1 - p))[:, None]).T @ x[train], x[train].T @ (y[train] - p))
    got = np.array([r.probability[1] for r in model.transform(rows.filter("part = 'test'").select("academic_year", "deprivation_score", "absent", "rural")).select("probability").collect()])
    assert np.abs(np.sort(got) - np.sort(1 / (1 + np.exp(-x[~train] @ beta)))).max() < 0.01


def test_sites_are_weighted_means_and_near_the_best(spark):
    from marlstone.operators import features as M

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (60, 2)) for c in ((0, 0), (40, 0), (0, 40), (40, 40))])
    w = rng.uniform(1, 5, len(x))
    got = M.place_sites(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, w, strict=True)], "x double, y double, w double"), "x", "y", "w", 4)
    centres = np.array(sorted((r.x, r.y) for r in got.collect()))
    of = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    assert sorted(np.bincount(of).tolist()) == [60] * 4
    for i in range(4):
        assert np.allclose(centres[i], np.average(x[of == i], axis=0, weights=w[of == i]), atol=1e-6)


def test_scenario_sweep_equals_the_product(spark):
    rows = [(x, c) for x in (-3.0, 0.0, 0.5, 1.0, 2.0, 7.5) for c in (-4.0, 0.0, 1.0, 1.5, 30.0)] + [(None, 1.0), (2.0, None)]
    for n in (1, 2, 64):
        got = {r.scenario: (r.events, r.excess) for r in J.scenario_sweep(spark.createDataFrame(rows, "w double, c double"), "w", "c", scenarios=n).collect()}
        step = 1.5 / max(1, n - 1)
        for s in range(n):
            over = [w * (0.5 + s * step) - c for w, c in rows if w is not None and c is not None]
            assert got[s] == (sum(o > 0 for o in over), pytest.approx(sum(max(o, 0) for o in over), abs=1e-9))
    assert J.scenario_sweep(spark.createDataFrame([], "w double, c double"), "w", "c").count() == 0


def test_replay_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    start = datetime.date(2024, 1, 1)
    rows = [(int(rng.integers(3)), start + datetime.timedelta(days=int(rng.integers(5))), int(rng.integers(0, 1440, endpoint=True)), i, "pickup" if rng.random() < 0.3 else "arrival", float(rng.integers(0, 90))) for i in range(300)]
    want = {}
    inside, street = dict.fromkeys(range(3), 0.0), dict.fromkeys(range(3), 0.0)
    for b, day, _, kind, _, kg in sorted((b, d, m, k == "pickup", i, kg) for b, d, m, i, k, kg in rows):
        row = want.setdefault((b, day), [0.0] * 6)
        if kind:
            of_street = min(street[b], kg)
            of_bin = min(inside[b], kg - of_street)
            street[b], inside[b] = street[b] - of_street, inside[b] - of_bin
            row[1], row[2] = row[1] + of_street + of_bin, row[2] + kg - of_street - of_bin
        else:
            room = min(kg, 100.0 - inside[b])
            inside[b], street[b], row[0] = inside[b] + room, street[b] + kg - room, row[0] + kg
        row[3], row[4], row[5] = inside[b], street[b], max(row[5], street[b])
    got = {(r.bin, r.day): list(r)[2:] for r in V.replay(spark.createDataFrame(rows, "bin int, day date, minute int, event_id int, kind string, kg double"), 100.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.shared_dir(session("spark://host:7077"))
    assert T.shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert T.shared_dir(session("local[2]")).endswith("spark-warehouse/scratch")


def test_counts_and_totals_of_intervals_make_no_pairs(spark):
    rng = random.Random(4)
    shifts = [(rng.randrange(60), rng.choice([1, 2, None]), b, b + rng.randrange(-2, 90)) for b in (rng.randrange(-500, 500) for _ in range(150))]
    held = [r for r in shifts if r[2] < r[3] and r[1] is not None]
    df = spark.createDataFrame(shifts, "shift int, team int, begins long, ends long")
    got = J.overlap_counts(df, "begins", "ends", ["team"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((*r, sum(o[1] == r[1] and o[2] < r[3] and r[2] < o[3] for o in held)) for r in held)
    calls = [(rng.choice([1, 2, None]), rng.randrange(-600, 600), i) for i in range(200)] + [(1, None, 7)]
    totals = J.interval_totals(spark.createDataFrame(calls, "team int, at long, id long"), df, "at", "begins", "ends", ["team"], {"first": ("min", "at"), "last": ("max", "id"), "all": ("sum", "id")})
    want = []
    for r in held:
        if inside := [c for c in calls if c[0] == r[1] and c[1] is not None and r[2] <= c[1] < r[3]]:
            want.append((*r, min(c[1] for c in inside), max(c[2] for c in inside), sum(c[2] for c in inside)))
    assert sorted(tuple(r) for r in totals.select(*df.columns, "first", "last", "all").collect()) == sorted(want)
    # 40,000 intervals that all meet: 1.6 billion pairs
    crowd = spark.range(40_000).select(F.lit(1).alias("team"), F.col("id").alias("begins"), (F.col("id") + 50_000).alias("ends"))
    assert J.overlap_counts(crowd, "begins", "ends", ["team"]).agg(F.min("n"), F.max("n")).first() == (40_000, 40_000)


def test_exploded_intervals_are_not_broadcast(spark):
    """Estimates of size do not see that windows are exploded: 3,000 of them have over 100,000 nodes."""
    windows = spark.range(3000).select(F.col("id").alias("w"), F.col("id").alias("opens"), (F.col("id") + 1_000_000_007).alias("closes"))
    met = J.interval_join(spark.range(10).withColumnRenamed("id", "at"), windows, "at", "opens", "closes")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == sum(i + 1 for i in range(10))


def test_equal_places_are_searched_and_counted_once(spark, monkeypatch):
    seen, keep = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    places = spark.range(600).select(F.col("id").alias("place"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    sites = spark.createDataFrame([(i, float(i % 13), float(i % 7), "ab"[i % 2]) for i in range(200)], "site long, x double, y double, category string")
    near = {(r.place, r.category): (r.site, r.distance) for r in S.nearest(places, sites, "place", "site", by=["category"]).collect()}
    rows = sites.collect()
    for place in (0, 1, 5, 598, 599):
        for c in "ab":
            d, site = min((math.hypot(t.x - place % 3, t.y - place % 2), t.site) for t in rows if t.category == c)
            assert near[place, c] == (site, d)
    assert len(near) == 1200 and all(df.count() <= 6 * 2 * 64 for name, df in seen if name == "frontier")
    boxes = spark.range(50).select(F.col("id").alias("site"), F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(1.5).alias("maxx"), F.lit(1.0).alias("maxy"))
    assert {tuple(r) for r in S.counts_in_boxes(places, boxes, 1.0).groupBy("n").count().collect()} == {(200, 50)}


def test_hashed_folders_are_written_by_a_task_each(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    T.write_hashed(df, str(tmp_path / "h"), "k", 8)
    back = spark.read.schema("k string, bucket long").parquet(str(tmp_path / "h"))
    files = {(r.bucket, r.part) for r in back.select("bucket", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part")).distinct().collect()}
    assert files == {(i, i) for i in range(8)} and back.count() == 4000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    # nor is what is read back, for its least and greatest texts
    from marlstone.plans import catalog

    assert "Sort" not in catalog.queries()["s12_hash_files"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_tables_and_methods_stay_small(spark, monkeypatch):
    from marlstone.plans import registry

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(registry, "SHARE", 1000)
    try:
        registry.Source(spark, FOLDER)
        assert int(spark.conf.get(name)) > 100
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_samples_of_a_batch_wait_as_one_entry():
    import pandas as pd

    class State:
        def __init__(self):
            self.rows, self.value = [], None

        def appendValue(self, row):
            self.rows.append(row)

        def put(self, rows):
            self.rows = list(rows)

        def get(self):
            return iter(self.rows) if self.value is None else self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.rows, self.value = [], None

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    p, handle = R.AlertProcessor("key", 2), Handle()
    p.init(handle)
    seconds = [5, 1, 2, 3, 4, 6, 90]
    frame = pd.DataFrame({"ts": pd.to_datetime(seconds, unit="s"), "on": [None, True, True, True, True, True, False]})
    list(p.handleInputRows((7,), iter([frame.iloc[:4], frame.iloc[4:]]), Clock(0)))
    assert len(p.waiting.rows) == 1 and handle.timers == [1000]
    out = [tuple(r) for f in p.handleExpiredTimer((7,), Clock(60_000), None) for r in f.itertuples(index=False)]
    assert out == [(7, pd.Timestamp(3, unit="s"), "firing"), (7, pd.Timestamp(5, unit="s"), "resolved")]
    assert len(p.waiting.rows) == 1 and handle.timers == [1000, 90_000] and p.run.value == (6_000_000, False)
