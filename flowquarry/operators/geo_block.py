"""Geography of a node's counterparties, and geographic studies. ``points`` is (node, lat, lon, zip3, state), located nodes having finite coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.cleaning import located
from flowquarry.functions.geo import haversine_km
from flowquarry.operators.edges import incidence, no_self, ratio

KEY = ["time_key", "node"]
LOCALITY = ((50.0, "LOCAL"), (250.0, "REGIONAL"), (1000.0, "MULTI_MARKET"))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def centre_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(lat, lon) of a vector sum."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def weighted_percentile(value: Column, weight: Column, q: float, *by: str) -> tuple[Column, Column]:
    """(running share of weight in the order of value, value where the share has reached q): to be aggregated by min."""
    w = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    share = F.sum(weight).over(w) / F.sum(weight).over(Window.partitionBy(*by))
    return share, F.when(share >= q, value)


def near(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Each edge from both ends with the own and the counterparty's place; self-edges out."""
    p = points.select("node", F.when(located("lat", "lon"), F.col("lat")).alias("lat"), F.when(located("lat", "lon"), F.col("lon")).alias("lon"), "zip3", "state")
    own = p.withColumnsRenamed({c: f"own_{c}" for c in ("lat", "lon", "zip3", "state")})
    return incidence(no_self(edges)).join(own, "node", "left").join(p.withColumnRenamed("node", "cp"), "cp", "left")


def spread(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Per node and month: centre of its located counterparties by amount, resultant length R, root mean squared distance about it (null below two located), distance from the own point, and the locality class."""
    n = near(edges, points).filter("lat is not null and cents > 0")
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    w = F.col("cents").cast("double")
    s = n.groupBy(*KEY).agg(F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * z).alias("z"), F.sum(w).alias("w"), F.count_distinct("cp").alias("n_cp"), F.first("own_lat").alias("own_lat"), F.first("own_lon").alias("own_lon"))
    lat, lon = centre_of(F.col("x"), F.col("y"), F.col("z"))
    s = s.select(*KEY, "n_cp", "own_lat", "own_lon", lat.alias("c_lat"), lon.alias("c_lon"), F.round(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / F.col("w"), 4).alias("geo_r"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    m = n.join(s.select(*KEY, "c_lat", "c_lon"), KEY).groupBy(*KEY).agg(F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("km"))
    out = s.join(m, KEY)
    km = F.when(F.col("n_cp") >= 2, F.round("km", 2))
    cls = F.when(km.isNull(), None)
    for most, name in LOCALITY:
        cls = cls.when(km < most, name)
    return out.select(*KEY, F.col("n_cp").alias("n_cp_located"), "geo_r", km.alias("spread_km"), F.round(haversine_km(F.col("own_lat"), F.col("own_lon"), F.col("c_lat"), F.col("c_lon")), 2).alias("registered_vs_flow_km"), cls.otherwise("NATIONAL").alias("locality"))


def side_spread(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(time_key, node, geo_spread_in_km, geo_spread_out_km): root mean squared distance of each side's located counterparties about that side's own centre; null below two located ones.

    The sum of squared distances needs the centre, so a side's rows meet it by a join on month, node and side, in the partitioning of the sums.
    """
    side = [*KEY, "dir"]
    n = near(edges, points).filter("lat is not null and cents > 0").select(*side, "cp", "cents", "lat", "lon")
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    w = F.col("cents").cast("double")
    s = n.groupBy(*side).agg(F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * z).alias("z"), F.count(F.lit(1)).alias("n_cp"))
    lat, lon = centre_of(F.col("x"), F.col("y"), F.col("z"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    m = n.join(s.select(*side, "n_cp", lat.alias("c_lat"), lon.alias("c_lon")), side).groupBy(*side, "n_cp").agg(F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("km"))
    km = F.when(F.col("n_cp") >= 2, F.round("km", 2))
    return m.groupBy(*KEY).agg(*[F.max(F.when(F.col("dir") == s, km)).alias(f"geo_spread_{s}_km") for s in ("in", "out")])


def coverage_home(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Per node, month and side: located share of amount, located counterparties, and the shares of located amount in the own zip3 and state (0 where the own one is known and nothing matches)."""
    n = near(edges, points)
    loc = F.col("lat").isNotNull()
    amt = lambda cond: F.sum(F.when(cond, F.col("cents")).otherwise(0))
    home = lambda c: ratio(amt(loc & F.coalesce(F.col(c) == F.col(f"own_{c}"), F.lit(False))), amt(loc))
    return n.groupBy(*KEY, "dir").agg(
        ratio(amt(loc), F.sum("cents")).alias("located_share"), F.count_distinct(F.when(loc, F.col("cp"))).alias("n_cp_located"),
        *[F.when(F.max(f"own_{c}").isNotNull(), home(c)).alias(f"home_{c}_share") for c in ("zip3", "state")],
    )


def market_breadth(edges: DataFrame, points: DataFrame, least: int = 5) -> DataFrame:
    """Per node and month over known zip3: how many hold 80 % of amount (counting while the sum before is below it) and the entropy in bits; null below ``least`` counterparties."""
    n = near(edges, points).filter("zip3 is not null and cents > 0")
    per = n.groupBy(*KEY, "zip3").agg(F.sum("cents").alias("a"), F.collect_set("cp").alias("cps"))
    # The set of a node's counterparties in one zip3 serves only to count them; sizes add up as a counterparty has one zip3.
    per = per.select(*KEY, "zip3", "a", F.size("cps").alias("k"))
    by = Window.partitionBy(*KEY)
    before = F.coalesce(F.sum("a").over(by.orderBy(F.desc("a"), "zip3").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = F.col("a") / F.sum("a").over(by)
    per = per.select(*KEY, "k", (before < F.sum("a").over(by) * 0.8).alias("in80"), (-p * F.log2(p)).alias("h"))
    enough = F.sum("k") >= least
    return per.groupBy(*KEY).agg(F.sum("k").alias("n_cp_zip"), F.when(enough, F.count_if("in80")).alias("n_zip3_80"), F.round(F.when(enough, F.sum("h")), 6).alias("zip3_entropy"))


def reach(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Per node and month: mean and the 50th and 90th percentile of the distance to its counterparties, by amount."""
    n = near(edges, points).filter("lat is not null and own_lat is not null and cents > 0")
    n = n.withColumn("km", F.round(haversine_km(F.col("own_lat"), F.col("own_lon"), F.col("lat"), F.col("lon")), 3))
    # Amounts are summed by distance first, so a window holds different distances, not a hub's edges.
    n = n.groupBy(*KEY, "km").agg(F.sum("cents").alias("cents"))
    _, p50 = weighted_percentile(F.col("km"), F.col("cents"), 0.5, *KEY)
    _, p90 = weighted_percentile(F.col("km"), F.col("cents"), 0.9, *KEY)
    n = n.select(*KEY, "cents", "km", p50.alias("a"), p90.alias("b"))
    return n.groupBy(*KEY).agg(F.round(F.sum(F.col("cents") * F.col("km")) / F.sum("cents"), 3).alias("reach_mean_km"), F.min("a").alias("reach_p50_km"), F.min("b").alias("reach_p90_km"))


def colocation(points: DataFrame, least: int = 5, digits: int = 4) -> DataFrame:
    """(lat, lon, n_nodes) of rounded places that at least ``least`` nodes share."""
    return points.filter(located("lat", "lon")).groupBy(F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon")).agg(F.count_distinct("node").alias("n_nodes")).filter(F.col("n_nodes") >= least)


def leave_one_out(edges: DataFrame, points: DataFrame, least: int = 2) -> DataFrame:
    """(node, cp, n_left, error_km): the centre of a located node's located neighbours without each one in turn, measured from that neighbour. Sums minus one term; never a pair of neighbours."""
    n = near(edges, points).filter("lat is not null").groupBy("node", "cp", "lat", "lon").agg(F.sum("cents").alias("cents"))
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    n = n.select("node", "cp", "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"))
    total = n.groupBy("node").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"s{c}") for c in ("x", "y", "z")])
    rest = n.join(total, "node").select("node", "cp", "lat", "lon", (F.col("k") - 1).alias("n_left"), *[(F.col(f"s{c}") - F.col(c)).alias(c) for c in ("x", "y", "z")])
    lat, lon = centre_of(F.col("x"), F.col("y"), F.col("z"))
    return rest.filter(F.col("n_left") >= least).select("node", "cp", "n_left", F.round(haversine_km(F.col("lat"), F.col("lon"), lat, lon), 2).alias("error_km"))


def net_flows(edges: DataFrame, points: DataFrame, area: str = "state") -> DataFrame:
    """Per month and area: amount within, out, in, and net; unknown areas are left out."""
    p = points.select("node", F.col(area).alias("area")).filter("area is not null")
    e = edges.join(p.select(F.col("node").alias("source"), F.col("area").alias("a")), "source").join(p.select(F.col("node").alias("dest"), F.col("area").alias("b")), "dest")
    own = F.col("a") == F.col("b")
    ends = F.when(own, F.array(F.struct(F.col("a").alias("area"), F.lit("within").alias("k")))).otherwise(F.array(F.struct(F.col("a").alias("area"), F.lit("out").alias("k")), F.struct(F.col("b").alias("area"), F.lit("in").alias("k"))))
    f = e.select("time_key", "cents", F.explode(ends).alias("x")).select("time_key", "cents", "x.*")
    s = lambda k: F.sum(F.when(F.col("k") == k, F.col("cents")).otherwise(0))
    return f.groupBy("time_key", "area").agg(s("within").alias("within_cents"), s("out").alias("out_cents"), s("in").alias("in_cents"), (s("in") - s("out")).alias("net_cents"))


def distance_rings(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(ring, n, cents) of edges between located nodes by distance."""
    p = points.filter(located("lat", "lon")).select("node", "lat", "lon")
    e = no_self(edges).join(p.select(F.col("node").alias("source"), F.col("lat").alias("a"), F.col("lon").alias("b")), "source").join(p.select(F.col("node").alias("dest"), F.col("lat").alias("c"), F.col("lon").alias("d")), "dest")
    km = haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    ring = F.when(km < 1, "0-1").when(km < 10, "1-10").when(km < 50, "10-50").when(km < 250, "50-250").when(km < 1000, "250-1000").otherwise("1000+")
    return e.groupBy(ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def shift_share(edges: DataFrame, points: DataFrame, sector: DataFrame, area: str = "state") -> DataFrame:
    """Per area: change of inflow from the first to the last month, split into national growth, sector mix and local part. Areas and sectors of payees."""
    g = edges.join(points.select(F.col("node").alias("dest"), F.col(area).alias("area")), "dest").join(sector.select(F.col("node").alias("dest"), "sector"), "dest").filter("area is not null and sector is not null")
    lo, hi = edges.agg(F.min("time_key")).scalar(), edges.agg(F.max("time_key")).scalar()
    first, last = (F.sum(F.when(F.col("time_key") == m, F.col("cents")).otherwise(0)) for m in (lo, hi))
    cell = g.groupBy("area", "sector").agg(first.alias("x0"), last.alias("x1"))
    nat = cell.groupBy("sector").agg(F.sum("x0").alias("s0"), F.sum("x1").alias("s1"))
    both = cell.join(nat, "sector").withColumn("r", F.coalesce(F.when(F.col("s0") > 0, F.col("s1") / F.col("s0") - 1), F.lit(0.0)))
    total = nat.agg((F.sum("s1") / F.sum("s0") - 1)).scalar()
    x0 = F.col("x0")
    out = both.groupBy("area").agg(F.sum("x0").alias("x0"), F.sum("x1").alias("x1"), F.sum(x0 * F.col("r")).alias("m"))
    return out.select("area", F.col("x0").alias("first_cents"), F.col("x1").alias("last_cents"), F.round(F.col("x0") * total, 2).alias("national"), F.round(F.col("m") - F.col("x0") * total, 2).alias("mix"), F.round(F.col("x1") - F.col("x0") - F.col("m"), 2).alias("local"))
