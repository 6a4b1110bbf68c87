"""Studies over the node panel and its geography: detectors, locating a node by its neighbours, prefix curves, shrinkage, multipliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles, quantile
from flowquarry.functions.cleaning import located
from flowquarry.functions.geo import haversine_km
from flowquarry.operators.edges import incidence, no_self, ratio
from flowquarry.operators.geo_block import centre_of, unit_vector


def level_shift(series: DataFrame, key: str, t: str, x: str, least: int = 3) -> DataFrame:
    """(key, t, shift): the split of a key's series with the largest gap between the mean after and before, both of at least ``least`` points; ties to the earliest."""
    w = Window.partitionBy(key).orderBy(t)
    upto, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    s = series.select(key, t, F.avg(x).over(upto).alias("b"), F.count(x).over(upto).alias("nb"), F.avg(x).over(after).alias("a"), F.count(x).over(after).alias("na"))
    s = s.filter((F.col("nb") >= least) & (F.col("na") >= least)).withColumn("shift", F.round(F.col("a") - F.col("b"), 4))
    return s.groupBy(key).agg(F.min_by(t, F.struct(-F.abs(F.col("shift")), F.col(t))).alias(t), F.min_by("shift", F.struct(-F.abs(F.col("shift")), F.col(t))).alias("shift"))


def run_lengths(series: DataFrame, key: str, t: str, flag: Column) -> DataFrame:
    """(key, longest, n_runs, current) of runs of a true flag over consecutive t; current is the run that reaches the last t of all, else 0."""
    last = series.agg(F.max(t)).scalar()
    on = series.filter(flag).select(key, t, (F.col(t) - F.row_number().over(Window.partitionBy(key).orderBy(t))).alias("i"))
    runs = on.groupBy(key, "i").agg(F.count(F.lit(1)).alias("n"), F.max(t).alias("e"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.max(F.when(F.col("e") == last, F.col("n"))), F.lit(0)).alias("current"))


def shuffled(series: DataFrame, key: str, t: str, x: str, seed: int = 0) -> DataFrame:
    """Each key's values dealt anew to its own t, in the order of a hash: the placebo of a detector, the same every time."""
    w = Window.partitionBy(key)
    a = series.select(key, t, F.row_number().over(w.orderBy(t)).alias("k"))
    b = series.select(key, x, F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key, t)), t)).alias("k"))
    return a.join(b, [key, "k"]).select(key, t, x)


def neighbour_places(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(node, cp, lat, lon, cents): each node's located counterparties over the window."""
    p = points.filter(located("lat", "lon")).select(F.col("node").alias("cp"), "lat", "lon")
    s = incidence(no_self(edges)).groupBy("node", "cp").agg(F.sum("cents").alias("cents"))
    return s.join(p, "cp").select("node", "cp", "lat", "lon", "cents")


def locate(places: DataFrame, least: int = 3) -> DataFrame:
    """(node, n_places, lat, lon, radius_km, evidence): the centre of a node's located counterparties, the root mean squared distance from it, and how much that says."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    v = places.select("node", x.alias("x"), y.alias("y"), z.alias("z"))
    s = v.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))
    lat, lon = centre_of(F.col("x"), F.col("y"), F.col("z"))
    # For unit vectors the mean squared chord from the mean direction is 2 (1 - R).
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / F.col("n")
    km = F.lit(6371.0088) * F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - r)))
    e = F.when(F.col("n") < least, "too_few").when(km < 25, "pin").when(km < 100, "metro").when(km < 400, "region").otherwise("none")
    return s.select("node", F.col("n").alias("n_places"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), F.round(km, 1).alias("radius_km"), e.alias("evidence"))


def prefix_curve(places: DataFrame, points: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n_nodes, median_km, p90_km): distance from a located node's own point to the centre of its first k counterparties, largest amounts first, over the nodes that have max(ks)."""
    own = points.filter(located("lat", "lon")).select("node", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    w = Window.partitionBy("node").orderBy(F.desc("cents"), "cp")
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    n = places.join(own, "node").select("node", "la", "lo", F.row_number().over(w).alias("k"), x.alias("x"), y.alias("y"), z.alias("z"), "cents", "cp").filter(F.col("k") <= max(ks))
    run = Window.partitionBy("node").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n = n.select("node", "la", "lo", "k", *[F.sum(c).over(run).alias(c) for c in ("x", "y", "z")], F.max("k").over(Window.partitionBy("node")).alias("have"))
    lat, lon = centre_of(F.col("x"), F.col("y"), F.col("z"))
    e = n.filter((F.col("have") == max(ks)) & F.col("k").isin(ks)).select("k", haversine_km(F.col("la"), F.col("lo"), lat, lon).alias("km"))
    q = group_quantiles(e, ["k"], "km", {"median_km": 0.5, "p90_km": 0.9})
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n_nodes")).join(q, "k").select("k", "n_nodes", *[F.round(c, 1).alias(c) for c in ("median_km", "p90_km")])


def shrunk_width(located_: DataFrame, prior: DataFrame, by: str, n0: float = 5.0, floor_km: float = 5.0) -> DataFrame:
    """(node, width_km): sqrt((n s^2 + n0 prior^2) / (n + n0)), at least ``floor_km``; the prior is the median radius of the node's peers (``prior``: node and ``by``)."""
    j = located_.join(prior, "node")
    peers = group_quantiles(j.filter(F.col(by).isNotNull()), [by], "radius_km", {"p": 0.5})
    every = quantile(located_, "radius_km", 0.5)
    j = j.join(peers, by, "left").withColumn("p", F.coalesce("p", every))
    n = F.col("n_places")
    return j.select("node", F.round(F.greatest(F.lit(floor_km), F.sqrt((n * F.col("radius_km") ** 2 + n0 * F.col("p") ** 2) / (n + n0))), 2).alias("width_km"))


def calibration(errors: DataFrame, claimed: str, actual: str, factors: list[float]) -> DataFrame:
    """(factor, n, covered): share of cases whose actual distance lies within factor times the claimed radius."""
    f = F.explode(F.array(*[F.lit(x) for x in factors]))
    return errors.select(claimed, actual, f.alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col(actual) <= F.col("factor") * F.col(claimed)), F.count(F.lit(1))).alias("covered"))


def band_rule(scored: DataFrame, score: str, ok: Column, cuts: list[float], precision: float) -> DataFrame:
    """(cut, n_kept, coverage, precision, best): each cut keeps scores at most as large; best is the one with most coverage among those precise enough."""
    b = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    g = scored.select(F.col(score).alias("s"), ok.alias("ok"), b.alias("cut"))
    kept = F.col("s") <= F.col("cut")
    t = g.groupBy("cut").agg(F.count_if(kept).alias("n_kept"), ratio(F.count_if(kept), F.count(F.lit(1))).alias("coverage"), ratio(F.count_if(kept & F.col("ok")), F.count_if(kept)).alias("precision"))
    top = t.filter(F.col("precision") >= precision).agg(F.max("cut")).scalar()
    return t.withColumn("best", F.coalesce(F.col("cut") == top, F.lit(False)))


def trade_roles(spread_: DataFrame, far_km: float = 250.0) -> DataFrame:
    """2 x 2 of how far a node's payers and payees lie (in, out): local, importer (far payees), exporter (far payers), national."""
    i, o = F.col("in_km") >= far_km, F.col("out_km") >= far_km
    return spread_.withColumn("trade_role", F.when(F.col("in_km").isNull() | F.col("out_km").isNull(), None).when(i & o, "national").when(i, "exporter").when(o, "importer").otherwise("local"))


def multiplier(matrix: list[list[float]]) -> list[list[float]]:
    """(I - Q)^-1 of a small matrix of flows between groups, rows scaled to shares below one; on the driver, as groups are few."""
    q = np.array(matrix, float)
    return np.linalg.inv(np.eye(len(q)) - q).tolist()
