"""Behaviour over payment rails. ``flows`` is (focal, other, dir, time_key, rail, cents, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import value_ranks
from flowquarry.operators.edges import ratio
from flowquarry.operators.skew import top_k


def rail_mix(flows: DataFrame, rails: list[str]) -> DataFrame:
    """Per month, the share of each rail, one column a rail."""
    total = F.sum("cents")
    return flows.groupBy("time_key").agg(*[ratio(F.sum(F.when(F.col("rail") == r, F.col("cents")).otherwise(0)), total).alias(f"share_{r}") for r in rails])


def top_partners(flows: DataFrame, n: int = 5) -> DataFrame:
    """The n largest partners of each focal node; ties by name."""
    s = flows.groupBy("focal", "other").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
    return top_k(s, ["focal"], [F.desc("cents"), F.col("other")], n, "other", rank="k")


def rail_behaviour(flows: DataFrame) -> DataFrame:
    """Per focal node: HHI over rails, dominant rail (ties by name), its share, active months, percentile of that share among nodes of the same dominant rail (share strictly below)."""
    s = flows.groupBy("focal", "rail").agg(F.sum("cents").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("focal"))
    s = s.withColumn("p", p)
    d = s.groupBy("focal").agg(F.round(F.sum(F.col("p") * F.col("p")), 6).alias("rail_hhi"), F.min_by("rail", F.struct(-F.col("c"), F.col("rail"))).alias("dominant_rail"), F.round(F.max("p"), 6).alias("dominant_share"))
    months = flows.groupBy("focal").agg(F.count_distinct("time_key").alias("active_months"))
    below = value_ranks(d, ["dominant_rail"], "dominant_share").select("dominant_rail", "dominant_share", F.round(F.col("before") / F.col("total"), 6).alias("peer_pct"))
    return d.join(months, "focal").join(below, ["dominant_rail", "dominant_share"])


def rail_shifts(flows: DataFrame, least: int = 3) -> DataFrame:
    """Per focal node and rail: first and last month, debut (first seen after the node's first month), exit (last seen before its last), peak |z| of the rail's monthly amount (sample deviation; null below ``least`` months)."""
    m = flows.groupBy("focal", "rail", "time_key").agg(F.sum("cents").alias("c"))
    wf, wr = Window.partitionBy("focal"), Window.partitionBy("focal", "rail")
    x = F.col("c") / F.lit(100.0)
    m = m.select("focal", "rail", "time_key", x.alias("x"), F.min("time_key").over(wf).alias("a"), F.max("time_key").over(wf).alias("b"), F.avg(x).over(wr).alias("mu"), F.stddev_samp(x).over(wr).alias("sd"), F.count(F.lit(1)).over(wr).alias("k"))
    z = F.when((F.col("sd") > 1e-9) & (F.col("k") >= least), F.abs(F.col("x") - F.col("mu")) / F.when(F.col("sd") > 1e-9, F.col("sd")))
    return m.groupBy("focal", "rail").agg(F.min("time_key").alias("first_month"), F.max("time_key").alias("last_month"), (F.min("time_key") > F.min("a")).alias("is_debut"), (F.max("time_key") < F.max("b")).alias("is_exit"), F.round(F.max(z), 4).alias("peak_z"))


def rail_drift(flows: DataFrame, rails: list[str]) -> DataFrame:
    """Per focal node: cosine distance of its rail amounts in its first and last month, and of its whole mix to that of all nodes."""
    w = Window.partitionBy("focal")
    m = flows.select("focal", "rail", "cents", (F.col("time_key") == F.min("time_key").over(w)).alias("f"), (F.col("time_key") == F.max("time_key").over(w)).alias("l"))
    s = lambda r, c: F.sum(F.when((F.col("rail") == r) & c, F.col("cents")).otherwise(0)).cast("double")
    per = m.groupBy("focal").agg(*[s(r, F.col("f")).alias(f"f{i}") for i, r in enumerate(rails)], *[s(r, F.col("l")).alias(f"l{i}") for i, r in enumerate(rails)], *[s(r, F.lit(True)).alias(f"t{i}") for i, r in enumerate(rails)])
    whole = flows.agg(F.struct(*[F.sum(F.when(F.col("rail") == r, F.col("cents")).otherwise(0)).cast("double").alias(f"w{i}") for i, r in enumerate(rails)])).scalar()
    j = per.withColumn("__w", whole).select("*", "__w.*")

    def dist(a: str, b: str):
        dot = sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(len(rails))), F.lit(0.0))
        na, nb = (sum((F.col(f"{x}{i}") * F.col(f"{x}{i}") for i in range(len(rails))), F.lit(0.0)) for x in (a, b))
        return F.round(F.when((na > 0) & (nb > 0), 1 - dot / F.sqrt(na) / F.sqrt(nb)), 6)

    return j.select("focal", dist("f", "l").alias("first_last_distance"), dist("t", "w").alias("population_distance"))


def partner_overlap(flows: DataFrame) -> DataFrame:
    """Per focal node: Jaccard of the partners it pays and those that pay it."""
    p = flows.groupBy("focal", "other").agg(F.max(F.col("dir") == "out").alias("o"), F.max(F.col("dir") == "in").alias("i"))
    return p.groupBy("focal").agg(F.count(F.lit(1)).alias("n_partners"), ratio(F.count_if(F.col("o") & F.col("i")), F.count(F.lit(1))).alias("partner_jaccard"))
