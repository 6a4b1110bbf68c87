"""Each stream against its batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowquarry.operators import temporal as tm
from flowquarry.streaming import streams as ss


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_relationship_memory(spark, tmp_path):
    rng = random.Random(1)
    data = [(f"2024-{t:02d}", s, d, 1, 1, t) for t in range(1, 13) for s in "abc" for d in "xyz" if rng.random() < 0.45 or s == "c"]
    df = spark.createDataFrame(data, "time_key string, source string, dest string, cents bigint, volume bigint, t int")
    for t in range(1, 13):
        df.filter(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ss.arrivals(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    got = ss.run_available(ss.relationship_memory(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = tm.relationship_memory(df.drop("t")).select("source", "dest", "t", "cohort", "is_persistent")
    assert rows(got) == rows(want)


def test_windows_repeats_and_sessions(spark, tmp_path, folder):
    raw = spark.read.parquet(f"{folder}/edges.parquet")
    path = str(tmp_path / "edges")
    raw.repartition(3).write.parquet(path)
    e = ss.clean_edges(ss.arrivals(spark, path, raw.schema))
    # A window comes out once it is final: the batch form has it too, with the same rows.
    got = ss.run_available(ss.window_totals(e, ["time_key"], "load_ts", "30 days", "1000 days"), str(tmp_path / "w"), str(tmp_path / "wc"))
    batch = ss.window_totals(ss.clean_edges(raw), ["time_key"], "load_ts", "30 days", "1000 days")
    assert set(rows(got)) <= set(rows(batch))
    once = ss.run_available(ss.first_arrivals(e, ["edge_id"], "load_ts", "2000 days").select("edge_id"), str(tmp_path / "f"), str(tmp_path / "fc"))
    assert rows(once) == rows(ss.clean_edges(raw).select("edge_id").distinct())
    t = dt.datetime(2024, 1, 1)
    clicks = spark.createDataFrame([("u", t + dt.timedelta(minutes=m)) for m in (0, 10, 25, 100, 105, 4000)], "user string, ts timestamp")
    clicks.write.parquet(str(tmp_path / "clicks"))
    stream = ss.sessions(ss.arrivals(spark, str(tmp_path / "clicks"), clicks.schema), ["user"], "ts", "30 minutes", "1 minute")
    got = ss.run_available(stream, str(tmp_path / "s"), str(tmp_path / "sc"))
    assert [r["n"] for r in got.orderBy("start").collect()] == [3, 2]
    assert [r["n"] for r in ss.sessions(clicks, ["user"], "ts", "30 minutes", "1 minute").orderBy("start").collect()] == [3, 2, 1]
