"""Queries on geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import geo_block as gb
from flowquarry.operators import parties as pt
from flowquarry.plans.base import EP, WP, edges, parties, rsql, sectors
from flowquarry.plans.registry import query
from flowquarry.session import table


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(least(CAST(1 AS DOUBLE), power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"


def points(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).select("node", "lat", "lon", "zip3", "state")


_NEAR = (
    EP
    + """, pl AS (SELECT node, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon, zip3, state FROM party),
nr AS (SELECT i.time_key, i.node, i.cp, i.dir, i.cents, a.lat AS own_lat, a.lon AS own_lon, a.zip3 AS own_zip3, a.state AS own_state, b.lat, b.lon, b.zip3, b.state FROM inc i LEFT JOIN pl a ON a.node = i.node LEFT JOIN pl b ON b.node = i.cp WHERE i.node <> i.cp) """
)


_SPREAD_SQL = (
    _NEAR
    + f""", v AS (SELECT *, CAST(cents AS DOUBLE) AS w, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM nr WHERE lat IS NOT NULL AND cents > 0),
s AS (SELECT time_key, node, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z, sum(w) AS w, count(DISTINCT cp) AS n_cp, max(own_lat) AS own_lat, max(own_lon) AS own_lon FROM v GROUP BY ALL),
c AS (SELECT *, degrees(atan2(z, sqrt(x * x + y * y))) AS c_lat, degrees(atan2(y, x)) AS c_lon FROM s),
m AS (SELECT v.time_key, v.node, sqrt(sum(v.w * {hav("v.lat", "v.lon", "c_lat", "c_lon")} * {hav("v.lat", "v.lon", "c_lat", "c_lon")}) / sum(v.w)) AS km FROM v JOIN c ON c.time_key = v.time_key AND c.node = v.node GROUP BY ALL),
o AS (SELECT c.*, CASE WHEN n_cp >= 2 THEN round(km, 2) END AS spread_km FROM c JOIN m USING (time_key, node))
SELECT time_key, node, n_cp AS n_cp_located, round(sqrt(x * x + y * y + z * z) / w, 4) AS geo_r, spread_km, round({hav("own_lat", "own_lon", "c_lat", "c_lon")}, 2) AS registered_vs_flow_km,
 CASE WHEN spread_km IS NULL THEN NULL WHEN spread_km < 50 THEN 'LOCAL' WHEN spread_km < 250 THEN 'REGIONAL' WHEN spread_km < 1000 THEN 'MULTI_MARKET' ELSE 'NATIONAL' END AS locality FROM o"""
)


#: The same as a view, spread.
SPREAD_ROWS = _SPREAD_SQL.replace("SELECT time_key, node, n_cp AS n_cp_located", ", spread AS (SELECT time_key, node, n_cp AS n_cp_located", 1).rstrip() + ") "


@query("g02_g09_geo_block", _SPREAD_SQL)
def g02(spark: SparkSession, d: str) -> DataFrame:
    return gb.spread(edges(spark, d), points(spark, d))


@query(
    "g03_side_spread",
    _NEAR
    + f""", v AS (SELECT *, CAST(cents AS DOUBLE) AS w, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM nr WHERE lat IS NOT NULL AND cents > 0),
c AS (SELECT time_key, node, dir, n_cp, degrees(atan2(z, sqrt(x * x + y * y))) AS c_lat, degrees(atan2(y, x)) AS c_lon FROM (SELECT time_key, node, dir, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z, count(DISTINCT cp) AS n_cp FROM v GROUP BY ALL)),
m AS (SELECT v.time_key, v.node, v.dir, CASE WHEN max(n_cp) >= 2 THEN round(sqrt(sum(w * power({hav("v.lat", "v.lon", "c_lat", "c_lon")}, 2)) / sum(w)), 2) END AS km FROM v JOIN c ON c.time_key = v.time_key AND c.node = v.node AND c.dir = v.dir GROUP BY ALL)
SELECT time_key, node, max(km) FILTER (dir = 'in') AS geo_spread_in_km, max(km) FILTER (dir = 'out') AS geo_spread_out_km FROM m GROUP BY time_key, node""",
)
def g03(spark: SparkSession, d: str) -> DataFrame:
    return gb.side_spread(edges(spark, d), points(spark, d))


@query(
    "g04_g05_coverage_home",
    _NEAR
    + f"""SELECT time_key, node, dir, {rsql("coalesce(sum(cents) FILTER (lat IS NOT NULL), 0)", "sum(cents)")} AS located_share, count(DISTINCT cp) FILTER (lat IS NOT NULL) AS n_cp_located,
 CASE WHEN max(own_zip3) IS NOT NULL THEN {rsql("coalesce(sum(cents) FILTER (lat IS NOT NULL AND zip3 = own_zip3), 0)", "sum(cents) FILTER (lat IS NOT NULL)")} END AS home_zip3_share,
 CASE WHEN max(own_state) IS NOT NULL THEN {rsql("coalesce(sum(cents) FILTER (lat IS NOT NULL AND state = own_state), 0)", "sum(cents) FILTER (lat IS NOT NULL)")} END AS home_state_share FROM nr GROUP BY time_key, node, dir""",
)
def g04(spark: SparkSession, d: str) -> DataFrame:
    return gb.coverage_home(edges(spark, d), points(spark, d))


@query(
    "g06_market_breadth",
    _NEAR
    + """, z AS (SELECT time_key, node, zip3, sum(cents) AS a, count(DISTINCT cp) AS k FROM nr WHERE zip3 IS NOT NULL AND cents > 0 GROUP BY ALL),
q AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY time_key, node ORDER BY a DESC, zip3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(a) OVER (PARTITION BY time_key, node) * CAST(0.8 AS DOUBLE) AS in80, a / CAST(sum(a) OVER (PARTITION BY time_key, node) AS DOUBLE) AS p FROM z)
SELECT time_key, node, CAST(sum(k) AS BIGINT) AS n_cp_zip, CASE WHEN sum(k) >= 5 THEN count(*) FILTER (in80) END AS n_zip3_80, round(CASE WHEN sum(k) >= 5 THEN sum(-p * log2(p)) END, 6) AS zip3_entropy FROM q GROUP BY time_key, node""",
)
def g06(spark: SparkSession, d: str) -> DataFrame:
    return gb.market_breadth(edges(spark, d), points(spark, d))


@query(
    "g07_reach",
    _NEAR
    + f""", k AS (SELECT time_key, node, cents, round({hav("own_lat", "own_lon", "lat", "lon")}, 3) AS km FROM nr WHERE lat IS NOT NULL AND own_lat IS NOT NULL AND cents > 0),
s AS (SELECT *, sum(cents) OVER (PARTITION BY time_key, node ORDER BY km RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(cents) OVER (PARTITION BY time_key, node) AS DOUBLE) AS sh FROM k)
SELECT time_key, node, round(sum(cents * km) / sum(cents), 3) AS reach_mean_km, min(km) FILTER (sh >= 0.5) AS reach_p50_km, min(km) FILTER (sh >= 0.9) AS reach_p90_km FROM s GROUP BY time_key, node""",
)
def g07(spark: SparkSession, d: str) -> DataFrame:
    return gb.reach(edges(spark, d), points(spark, d))


@query("k35_colocation", WP + "SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, count(DISTINCT node) AS n_nodes FROM party WHERE ok GROUP BY 1, 2 HAVING count(DISTINCT node) >= 5")
def k35(spark: SparkSession, d: str) -> DataFrame:
    return gb.colocation(points(spark, d))


@query(
    "k34_leave_one_out",
    _NEAR
    + f""", u AS (SELECT DISTINCT node, cp, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM nr WHERE lat IS NOT NULL),
r AS (SELECT node, cp, lat, lon, count(*) OVER w - 1 AS n_left, sum(x) OVER w - x AS x, sum(y) OVER w - y AS y, sum(z) OVER w - z AS z FROM u WINDOW w AS (PARTITION BY node))
SELECT node, cp, n_left, round({hav("lat", "lon", "degrees(atan2(z, sqrt(x * x + y * y)))", "degrees(atan2(y, x))")}, 2) AS error_km FROM r WHERE n_left >= 2""",
)
def k34(spark: SparkSession, d: str) -> DataFrame:
    return gb.leave_one_out(edges(spark, d), points(spark, d))


@query(
    "k45_net_flows",
    EP
    + """, f AS (SELECT time_key, a.state AS s, b.state AS t, cents FROM e JOIN party a ON a.node = e.source JOIN party b ON b.node = e.dest WHERE a.state IS NOT NULL AND b.state IS NOT NULL),
g AS (SELECT time_key, s AS area, 'within' AS k, cents FROM f WHERE s = t UNION ALL SELECT time_key, s, 'out', cents FROM f WHERE s <> t UNION ALL SELECT time_key, t, 'in', cents FROM f WHERE s <> t),
h AS (SELECT time_key, area, CAST(coalesce(sum(cents) FILTER (k = 'within'), 0) AS BIGINT) AS within_cents, CAST(coalesce(sum(cents) FILTER (k = 'out'), 0) AS BIGINT) AS out_cents, CAST(coalesce(sum(cents) FILTER (k = 'in'), 0) AS BIGINT) AS in_cents FROM g GROUP BY ALL)
SELECT *, in_cents - out_cents AS net_cents FROM h""",
)
def k45(spark: SparkSession, d: str) -> DataFrame:
    return gb.net_flows(edges(spark, d), points(spark, d))


@query(
    "k44_distance_rings",
    EP
    + f""", k AS (SELECT cents, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km FROM e JOIN party a ON a.node = e.source AND a.ok JOIN party b ON b.node = e.dest AND b.ok WHERE e.source <> e.dest)
SELECT CASE WHEN km < 1 THEN '0-1' WHEN km < 10 THEN '1-10' WHEN km < 50 THEN '10-50' WHEN km < 250 THEN '50-250' WHEN km < 1000 THEN '250-1000' ELSE '1000+' END AS ring, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM k GROUP BY 1""",
)
def k44(spark: SparkSession, d: str) -> DataFrame:
    return gb.distance_rings(edges(spark, d), points(spark, d))


@query(
    "k46_shift_share",
    EP
    + """, lo AS (SELECT min(time_key) AS a, max(time_key) AS b FROM e), cell AS (SELECT p.state AS area, p.naics2 AS sector, CAST(coalesce(sum(cents) FILTER (time_key = a), 0) AS BIGINT) AS x0, CAST(coalesce(sum(cents) FILTER (time_key = b), 0) AS BIGINT) AS x1 FROM e JOIN party p ON p.node = e.dest, lo WHERE p.state IS NOT NULL AND p.naics2 IS NOT NULL GROUP BY ALL),
nat AS (SELECT sector, CAST(sum(x0) AS DOUBLE) AS s0, CAST(sum(x1) AS DOUBLE) AS s1 FROM cell GROUP BY sector), g AS (SELECT sum(s1) / sum(s0) - 1 AS g FROM nat),
a AS (SELECT area, sum(x0) AS x0, sum(x1) AS x1, sum(x0 * coalesce(CASE WHEN s0 > 0 THEN s1 / s0 - 1 END, 0)) AS m FROM cell JOIN nat USING (sector) GROUP BY area)
SELECT area, CAST(x0 AS BIGINT) AS first_cents, CAST(x1 AS BIGINT) AS last_cents, round(x0 * g, 2) AS national, round(m - x0 * g, 2) AS mix, round(x1 - x0 - m, 2) AS local FROM a, g""",
)
def k46(spark: SparkSession, d: str) -> DataFrame:
    return gb.shift_share(edges(spark, d), points(spark, d), sectors(spark, d))


@query(
    "p08_coordinate_classes",
    """WITH c AS (SELECT CAST(lat AS VARCHAR) AS a, CAST(lon AS VARCHAR) AS b, lat AS y, lon AS x FROM customers)
SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'null' WHEN isnan(y) OR isnan(x) THEN 'non_numeric' WHEN y = 0 AND x = 0 THEN 'null_island' WHEN NOT (y BETWEEN -90 AND 90) OR NOT (x BETWEEN -180 AND 180) THEN 'out_of_range' WHEN x > 0 THEN 'positive_lon' WHEN y BETWEEN 24 AND 50 AND x BETWEEN -125 AND -66 THEN 'conus' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY 1""",
)
def p08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy(pt.coordinate_class("lat", "lon").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_located", "SELECT count(*) FILTER (coalesce(isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0), false)) AS n_located, count(*) AS n FROM customers")
def p07(spark: SparkSession, d: str) -> DataFrame:
    from flowquarry.functions.cleaning import located

    return table(spark, d, "customers").agg(F.count_if(located("lat", "lon")).alias("n_located"), F.count(F.lit(1)).alias("n"))
