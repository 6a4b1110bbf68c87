"""The general problems on small cases: nulls, ties, repeated rows, empty tables, clashing columns, hot keys, brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import canonical_id, cents, day_date, located, month_key, zip3
from flowquarry.functions.geo import point_in_polygon
from flowquarry.operators import orphans, proximity, rolling, skew, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cleaning(spark):
    raw = [("  00123.00 ",), ("123",), ("\t123",), ("123.5",), ("000",), ("",), (" ",), (None,), ("00T-7.0",), ("1A",)]
    got = [r[0] for r in spark.createDataFrame(raw, "x string").select(canonical_id("x")).collect()]
    assert got == ["123", "123", "123", "123.5", "0", None, None, None, "T-7", "1A"]
    months = [("2024-03",), (" 2024-03",), ("202403",), ("2024-03-01",), ("2024/03",), ("2024-13",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(months, "x string").select(month_key("x")).collect()]
    assert got == ["2024-03"] * 5 + [None] * 3
    days = [("2024-03-05",), ("20240305",), ("2024/03/05",), ("2024-03-05 ",), ("2024-02-31",), ("2024-03",), (None,)]
    got = [r[0] for r in spark.createDataFrame(days, "x string").select(day_date("x")).collect()]
    assert got == [dt.date(2024, 3, 5)] * 4 + [None] * 3
    money = [(1.15,), (0.1 + 0.2,), (float("nan"),), (float("inf"),), (None,)]
    assert [r[0] for r in spark.createDataFrame(money, "x double").select(cents("x")).collect()] == [115, 30, None, None, None]
    zips = [("7",), ("07",), ("123",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(zips, "x string").select(zip3("x")).collect()] == ["007", "007", "123", None, None]
    pts = [(1.0, 2.0), (0.0, 0.0), (float("nan"), 1.0), (91.0, 1.0), (None, 1.0), (0.0, 5.0)]
    assert [r[0] for r in spark.createDataFrame(pts, "a double, b double").select(located("a", "b")).collect()] == [True, False, False, False, False, True]


def _days(spark, data):
    return spark.createDataFrame(data, "node string, day date, cents bigint")


def test_rolling_against_brute_force(spark):
    rng = random.Random(3)
    start = dt.date(2024, 1, 1)
    data = [(n, start + dt.timedelta(days=i), rng.choice([None, 0, rng.randint(1, 999)])) for n in "abc" for i in range(60) if rng.random() < 0.3]
    last = start + dt.timedelta(days=64)
    got = {(r["node"], r["day"]): r for r in rolling.rolling_totals(_days(spark, data), F.lit(last)).collect()}
    amount = {(n, d): c or 0 for n, d, c in data}
    want = 0
    for n in "abc":
        act = [d for m, d, c in data if m == n and c]
        for i in range((last - min(act)).days + 1):
            d = min(act) + dt.timedelta(days=i)
            want += 1
            for w in (7, 30):
                v = [amount.get((n, d - dt.timedelta(days=k)), 0) for k in range(w)]
                assert got[n, d][f"total_{w}"] == sum(v)
                assert got[n, d][f"active_{w}"] == sum(x > 0 for x in v)
                assert got[n, d][f"avg_{w}"] == pytest.approx(sum(v) / 100 / w, abs=1e-6)
    assert len(got) == want


def test_rolling_quiet_and_empty(spark):
    d = dt.date(2024, 1, 1)
    assert rolling.rolling_totals(_days(spark, []), F.lit(d)).count() == 0
    assert rolling.rolling_totals(_days(spark, [("a", d, 0), ("b", d, None)]), F.lit(d)).count() == 0


def test_current_days_ties_and_nulls(spark):
    t = dt.datetime(2024, 1, 2)
    raw = spark.createDataFrame([("a", "2024-01-01", 1.0, t), ("a", "20240101", 1.0, t), (" a", "2024/01/01", None, t + dt.timedelta(1)), ("b", "2024-01-01", 2.0, t), ("b", "2024-01-01", 3.0, t), (None, "2024-01-01", 9.0, t), ("c", None, 9.0, t), ("d", "2024-01-01", 4.0, None)], "node string, time_key string, strength double, load_ts timestamp").withColumn("day", F.lit("clash"))
    got = rows(rolling.current_days(raw, canonical_id("node"), day_date("time_key"), cents("strength"), F.col("load_ts")))
    d = dt.date(2024, 1, 1)
    assert got == [("a", d, None), ("b", d, 300), ("d", d, 400)]


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [0.25, 30.0, 900.0])
def test_near_pairs_against_brute_force(spark, radius):
    rng = random.Random(int(radius))
    deg = radius / 111
    pts = []
    for i in range(150):
        base = rng.choice([(40, -100), (89.99, 10), (-89.9, 0), (10, 179.999), (10, -180.0), (0, 0.001), (60, 20)])
        lat = float(max(-90, min(90, base[0] + rng.uniform(-deg, deg) * 1.5)))
        span = min(170.0, 1.5 * deg / max(0.001, math.cos(math.radians(lat))))
        lon = (base[1] + rng.uniform(-span, span) + 180) % 360 - 180
        pts.append((f"k{i % 120}", lat, lon))
    pts += [("dup1", 40.0, -100.0), ("dup2", 40.0, -100.0), ("dup2", 40.0, -100.0), ("pole1", 90.0, 5.0), ("pole2", 90.0, -170.0), (None, 40.0, -100.0)]
    want = {}
    for i, (a, la, lo) in enumerate(pts):
        for b, lb, lp in pts[i + 1 :]:
            if a and b and a != b and (km := _km(la, lo, lb, lp)) <= radius:
                k = (min(a, b), max(a, b))
                want[k] = min(km, want.get(k, 1e9))
    got = {(r[0], r[1]): r[2] for r in proximity.near_pairs(spark.createDataFrame(pts, "node string, lat double, lon double"), radius).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_near_pairs_empty_and_hot_cell(spark):
    empty = spark.createDataFrame([], "node string, lat double, lon double")
    assert proximity.near_pairs(empty, 1.0).count() == 0
    hot = [(f"n{i}", 10 + i * 1e-7, 20.0) for i in range(60)]
    left = spark.createDataFrame([(1, i) for i in range(50)], "c int, i int")
    right = spark.createDataFrame([(1, i) for i in range(70)] + [(2, 0)], "c int, j int")
    assert skew.salted_join(left, right, ["c"], most=10).count() == 50 * 70
    assert proximity.near_pairs(spark.createDataFrame(hot, "node string, lat double, lon double"), 0.25).count() == 60 * 59 // 2


def test_one_place_of_many_keys(spark):
    """A placeholder point: the classes of 20,000 nodes take a row, and the pairs of a smaller one are all there, split by load."""
    far = spark.createDataFrame([("x", 10.001, 20.0), ("x", 50.0, 50.0), ("y", 10.0, 20.003), (None, 10.0, 20.0)], "node string, lat double, lon double")
    at = lambda n: spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon")).unionByName(far)
    got = rows(proximity.near_places(at(20_000).withColumn("n_keys", F.lit("clash")), 0.25))
    assert got == [(10.0, 20.0, 20_000, 1, 1), (10.0, 20.003, 1, 0, 0), (10.001, 20.0, 1, 1, 20_000), (50.0, 50.0, 1, 0, 0)]
    assert proximity.near_pairs(at(1200), 0.25).count() == 1200 * 1199 // 2 + 1200
    assert proximity.near_places(far.limit(0), 0.25).count() == 0


def test_boxes_and_polygons(spark):
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, "x"), (2, 1.0, 2.0, 0.0, 1.0, "y"), (3, -5.0, 5.0, 10.0, 20.0, "z"), (4, None, 1.0, 0.0, 1.0, "n")], "area_id int, min_lat double, max_lat double, min_lon double, max_lon double, node string")
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.5), ("c", 0.5, 1.0), ("d", 4.999, 19.999), ("e", None, 1.0), ("f", 50.0, 50.0)], "node string, lat double, lon double")
    got = rows(proximity.in_boxes(pts, boxes).select("node", "area_id"))
    assert got == [("a", 1), ("b", 2), ("d", 3)]
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 3.0), (1.0, 3.0), (1.0, 0.0)]
    regions = spark.createDataFrame([("L", ring), ("none", []), ("line", ring[:2])], "name string, ring array<struct<lat: double, lon: double>>")
    p = spark.createDataFrame([("in", 0.5, 0.5), ("out", 2.0, 1.0), ("arm", 3.0, 3.5), ("far", 9.0, 9.0)], "node string, lat double, lon double")
    assert rows(proximity.in_polygons(p, regions).select("node", "name")) == [("arm", "L"), ("in", "L")]
    assert not spark.range(1).select(point_in_polygon(F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("array<struct<lat: double, lon: double>>"))).first()[0]


def test_orphans(spark):
    t = dt.datetime
    par = spark.createDataFrame(
        [("1", t(2023, 1, 1), None), ("2", t(2024, 2, 28, 23), None), ("3", t(2023, 1, 1), t(2024, 1, 31, 23)), ("03.0", t(2024, 3, 1), None), ("4", None, None), (None, t(2023, 1, 1), None)],
        "node string, loaded_at timestamp, deleted_at timestamp",
    )
    e = spark.createDataFrame([("1", "2", "2024-01"), ("2", "2", "202402"), ("3", "3.0", "2024-01-01"), ("3", "9", "2024-02"), ("3", " ", "2024-03"), ("4", None, "2024-01"), ("1", "1", None)], "source string, dest string, time_key string").withColumn("node", F.lit("clash"))
    refs = orphans.references(e, "edges", ["source", "dest"], F.col("time_key"))
    got = rows(orphans.orphans(refs, orphans.presence(par)).select("field_name", "time_key", "node", "kind"))
    assert got == [("dest", "2024-01", "2", "late"), ("dest", "2024-02", "9", "missing"), ("source", "2024-01", "4", "late"), ("source", "2024-02", "3", "deleted")]
    rep = {(r["field_name"], r["time_key"]): r for r in orphans.orphan_report(refs, orphans.orphans(refs, orphans.presence(par))).collect()}
    assert rep["source", "2024-01"]["n_ids"] == 3 and rep["source", "2024-01"]["ids_late"] == 1
    none = e.limit(0)
    assert orphans.orphans(orphans.references(none, "e", ["source"], F.col("time_key")), orphans.presence(par)).count() == 0
    assert orphans.orphans(refs, orphans.presence(par.limit(0))).count() == refs.count()


def test_pack_is_even_and_splits():
    plan = skew.pack(8, [10] * 64, [(("hub",), 5000), (("b",), 300)])
    assert plan.imbalance < 1.2
    hub = dict((x[0], x[1]) for x in plan.large)
    assert len(hub["hub"]) > 8 and sum(plan.loads) == pytest.approx(5940)


def test_balanced_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [("hub" if rng.random() < 0.4 else f"n{rng.randint(0, 50)}", rng.choice([None, *[f"o{i}" for i in range(300)]]), rng.randint(1, 9)) for _ in range(4000)]
    raw = spark.createDataFrame(data, "node string, other string, cents bigint")
    pairs = raw.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"))
    plan = skew.plan_fragments(pairs, ["node"], 6)
    assert any(k[0] == "hub" for k in plan.large) and plan.imbalance < 1.5
    got = rows(skew.balanced_totals(pairs, ["node"], "other", plan))
    want = rows(raw.groupBy("node").agg(F.count(F.lit(1)).alias("a"), F.sum("cents").alias("b"), F.count_distinct("other").alias("c")))
    assert got == want
    empty = pairs.limit(0)
    assert skew.balanced_totals(empty, ["node"], "other", skew.plan_fragments(empty, ["node"], 6)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fragment_replicate_join(spark, how):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["hub", "hub", "a", "b", None, "zz"]), i) for i in range(500)], "k string, i int").withColumn("v", F.lit("left"))
    right = spark.createDataFrame([("hub", 1), ("hub", 2), ("a", 3), (None, 4)], "k string, w int").withColumn("v", F.lit("right"))
    plan = skew.plan_fragments(left, ["k"], 4)
    got = skew.fragment_replicate_join(left, right, ["k"], F.col("i"), plan, how)
    want = left.join(right.drop("v"), "k", how)
    assert rows(got.select("k", "i", "v", "w")) == rows(want.select("k", "i", "v", "w"))
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, ["k"], F.col("i"), plan, "full")


def test_change_events(spark):
    data = [("a", m, 1) for m in ("01", "02", "04")] + [("b", "01", 1), ("b", "02", 2), ("b", "04", 2)] + [("c", "02", 5), ("d", "01", 1), ("d", "04", 1), ("e", "04", None), ("f", "01", None), ("f", "02", 3), ("f", "04", 3)]
    df = spark.createDataFrame(data, "k string, p string, v int")
    periods = snapshots.snapshot_ranks(df, "p")
    iv = snapshots.validity_intervals(df, ["k"], "p", F.xxhash64("v"), periods)
    got = rows(snapshots.change_events(iv, ["k"], periods))
    assert got == [("b", "02", "changed"), ("c", "02", "added"), ("c", "04", "removed"), ("d", "02", "removed"), ("d", "04", "added"), ("e", "04", "added"), ("f", "02", "changed")]
    named = df.withColumnsRenamed({"k": "r"})
    again = snapshots.change_events(snapshots.validity_intervals(named, ["r"], "p", F.xxhash64("v"), periods), ["r"], periods)
    assert rows(again) == got
    e = df.limit(0)
    assert snapshots.change_events(snapshots.validity_intervals(e, ["k"], "p", F.xxhash64("v"), snapshots.snapshot_ranks(e, "p")), ["k"], snapshots.snapshot_ranks(e, "p")).count() == 0


def test_current_rows(spark):
    df = spark.createDataFrame([(1, "x", 1, 5), (1, "y", 2, 6), (1, "y", 2, 6), (2, None, None, 7), (None, "z", 1, 8), (3, "p", 1, 1), (3, "q", 1, 1)], "id int, v string, o int, __o int")
    assert rows(snapshots.current_rows(df, "id", "o", {"v": F.col("v")})) == [("q",), ("y",), (None,)]
