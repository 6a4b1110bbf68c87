"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from flowquarry.session import cut, drop_cuts
from flowquarry.sources import readers as rd
from flowquarry.sources import writers as wr


def test_monthly_csv(spark, tmp_path):
    (tmp_path / "cust_2024-01.csv").write_text("note,source,dest,amount,volume\nx,001,2,5.5,1\ny,001,2,1.5,2\nz,3,3,9,1\nw,4,5,-1,1\nv,,5,3,1\nu,7,8,bad,x\n")
    (tmp_path / "cust_2024-02.csv").write_text("note,source,dest,amount,volume\n,001,2,7,4\n")
    df = rd.monthly_csv(spark, str(tmp_path / "cust_*.csv"))
    assert df.filter("time_key = '2024-02'").first().asDict() == {"time_key": "2024-02", "source": "001", "dest": "2", "amount": 7.0, "volume": 4}
    got = sorted(tuple(r) for r in rd.clean_snapshot(df).collect())
    assert got == [("2024-01", "001", "2", 700, 3), ("2024-02", "001", "2", 700, 4)]
    with pytest.raises(ValueError):
        rd.monthly_csv(spark, str(tmp_path / "cust_*.csv"), ["source", "missing"])
    (tmp_path / "cust_2024-03.csv").write_text("volume,dest,source,amount,note\n4,2,001,7,\n")
    with pytest.raises(Exception, match="CSV|header|FAILED_READ"):  # files whose columns stand in another order are refused, not misread
        rd.monthly_csv(spark, str(tmp_path / "cust_*.csv")).collect()


def test_aliases_hazards_and_guards(spark):
    df = spark.createDataFrame([(1, "n", 2108)], "PARTY int, cust string, zip int")
    got = rd.with_aliases(df, {"node": ["party_id", "party"], "name": ["cust"], "city": []}, optional=["city"])
    assert got.columns == ["node", "name", "city"] and got.first()["city"] is None
    with pytest.raises(ValueError):
        rd.with_aliases(df, {"node": ["nope"]})
    assert rd.dtype_hazards(df, ["zip", "cust"]) == [("zip", "int")]
    with pytest.raises(ValueError):
        rd.guarded_collect(spark.range(11), 10)
    assert len(rd.guarded_sql(spark, "SELECT * FROM range(:n)", 10, n=5)) == 5
    assert rd.wide_snapshot(spark.createDataFrame([(None, "a")], "amount double, source string"), ["source", "amount"]).first()["amount"] == 0
    with pytest.raises(ValueError):
        rd.wide_snapshot(df, ["source"])


def test_months_and_resume(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "time_key string, x int")
    assert wr.missing_months(df, path).count() == 2
    wr.write_months(df.filter("x = 1"), path)
    assert [r["time_key"] for r in wr.missing_months(df, path).collect()] == ["2024-02"]
    wr.write_months(df.filter("x = 2"), path)
    wr.write_months(spark.createDataFrame([("2024-01", 9)], "time_key string, x int"), path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [2, 9]
    assert rd.latest(spark.read.parquet(path), "time_key").count() == 1


def test_ladder_files(spark, tmp_path):
    flags = spark.createDataFrame([("a", "True", 0), ("b", "0", 1), ("c", None, None)], "node string, in_P99 string, in_P99_9 int")
    ladder = wr.ladder_from_flags(flags)
    assert sorted(map(tuple, ladder.collect())) == [("P99", "a"), ("P99_9", "b")]
    wr.save_ladder(ladder, spark.createDataFrame([("P99", 1.0)], "version string, degree_at double"), str(tmp_path))
    assert wr.load_ladder(spark, str(tmp_path))[0].count() == 2
    panel = spark.createDataFrame([("2024-01", "V0"), ("2024-01", "P99"), ("2024-01", None)], "time_key string, version string")
    kept, dry = wr.retire_version(panel, "P99")
    assert kept.count() == 2 and tuple(dry.first()) == ("2024-01", 1, 2)
    wr.write_report(str(tmp_path / "r.json"), {"a": 1})


def test_panel_source(spark, tmp_path):
    nodes = spark.createDataFrame([("2024-01", "a", 5.0), ("2024-01", "b", 9.0), ("2024-02", "a", 1.0)], "time_key string, node string, strength double")
    roles = spark.createDataFrame([("2024-01", "a", "x"), ("2024-01", "b", "y")], "time_key string, node string, role string")
    nodes.write.parquet(str(tmp_path / "n"))
    roles.write.parquet(str(tmp_path / "r"))
    s = rd.PanelSource(spark, str(tmp_path / "n"), str(tmp_path / "r"))
    assert s.months() == ["2024-01", "2024-02"]
    assert [r["node"] for r in s.roles_month("2024-01", 1).collect()] == ["b"]
    assert s.history("a").count() == 2


def test_cut_and_table(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert cut(df).dtypes == df.dtypes and cut(df).count() == 5
    kept = cut(df)
    drop_cuts(spark)
    with pytest.raises(Exception, match="exist|FAILED_READ|NOT_FOUND"):
        kept.count()


def test_state_and_retirement(spark, tmp_path):
    import os

    p = str(tmp_path / "state")
    assert wr.load_state(spark, p) is None
    for i in range(3):
        old = wr.load_state(spark, p)
        new = spark.createDataFrame([(i, "V0"), (i, "P99")], "x int, version string").withColumn("time_key", F.lit("2024-01"))
        wr.save_state(new if old is None else old.unionByName(new), p)
    assert wr.load_state(spark, p).count() == 6 and sorted(os.listdir(tmp_path)) == ["state"]
    os.rename(p, p + ".old")  # as a run leaves it that ends between the renames
    assert wr.load_state(spark, p).count() == 6
    report = wr.apply_retirement(spark, p, "P99", str(tmp_path / "backup")).collect()
    assert [(r["n_gone"], r["n_kept"]) for r in report] == [(3, 3)]
    assert wr.load_state(spark, p).count() == 3 and spark.read.parquet(str(tmp_path / "backup")).count() == 6
    with pytest.raises(Exception, match="backup"):
        wr.apply_retirement(spark, p, "V0", str(tmp_path / "backup"))
    assert wr.projected_seconds([], 23, 100) == (0.0, True) and wr.projected_seconds([10, 20], 10, 100) == (150.0, False)


def test_isolated_metrics(spark):
    from flowquarry.plans.isolation import isolated

    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    good = lambda: df.select("a", F.col("b").alias("x"))
    assert isolated(spark, "m", good, "a int, x double").collect() == [(1, 2.0)]
    assert isolated(spark, "m", lambda: df.select("nothing"), "a int, x double").collect() == [(None, None)]
    assert isolated(spark, "m", lambda: df, "a int, x double").collect() == [(None, None)]
    assert isolated(spark, "m", good, "a int, x double", {"m": False}).collect() == [(None, None)]


def test_ranking_columns_are_listed(spark, tmp_path):
    p = str(tmp_path / "panel")
    spark.createDataFrame([("2024-01", "a", 1.0, "x"), ("2024-02", "b", 2.0, "y")], "time_key string, node string, strength double, label string").write.parquet(p)
    s = rd.PanelSource(spark, p, p)
    assert s.months() == s.months() == ["2024-01", "2024-02"] and s.node_month("2024-01", 5).count() == 1
    with pytest.raises(ValueError):
        s.node_month("2024-01", 5, "label")


def test_payable(spark):
    from flowquarry.operators.match import payable

    data = [(1, "Acme Inc", "Bolt Supplies", "WIRE", 500), (2, "Acme Inc", "Bolt Supplies", "WIRE", 499), (3, "Acme Inc", "Bolt Supplies", "ACH", 10), (4, "Acme Inc", "Bolt Supplies", "CARD", 900), (5, "HUB", "Bolt Supplies", "ACH", 10),
            (6, "Acme Inc", "PAYROLL CO", "ACH", 10), (7, " ", "Bolt Supplies", "ACH", 10), (8, "Acme Inc", "Bol", "ACH", 10), (9, "Acme Inc", None, "ACH", 10), (10, None, "Bolt", "ACH", 10), (11, "A Inc", "Bolt Supplies", "ACH", 10), (12, "Acme Inc", "Bolt Supplies", None, None)]
    df = spark.createDataFrame(data, "i int, a string, b string, rail string, amt int")
    assert [r["i"] for r in payable(df, "a", "b", "rail", "amt", {"WIRE": 500, "ACH": 10}, ("HUB",), ("PAYROLL CO",)).orderBy("i").collect()] == [1, 3]


def test_completed_schema(spark):
    df = spark.createDataFrame([("a", 1, 2.5)], "node string, k int, extra double")
    got = rd.completed(df, "k bigint, node string, spread_km double")
    assert got.dtypes == [("k", "bigint"), ("node", "string"), ("spread_km", "double")] and got.collect() == [(1, "a", None)]
