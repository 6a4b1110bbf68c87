"""Node metrics of one hop and the hub ladder, on the payment graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import edges as eg
from flowquarry.operators import flow
from flowquarry.plans.base import E, EP, WP, edges, edges_once, parties, partition, rsql, sectors
from flowquarry.plans.registry import query

TIERS = {"P99": 0.99, "P99_9": 0.999}

_DEG = (
    E
    + """, deg AS (SELECT time_key, node, count(*) FILTER (dir = 'in') AS in_degree, count(*) FILTER (dir = 'out') AS out_degree,
 CAST(coalesce(sum(cents) FILTER (dir = 'in'), 0) AS BIGINT) AS in_cents, CAST(coalesce(sum(cents) FILTER (dir = 'out'), 0) AS BIGINT) AS out_cents,
 CAST(coalesce(sum(volume) FILTER (dir = 'in'), 0) AS BIGINT) AS in_volume, CAST(coalesce(sum(volume) FILTER (dir = 'out'), 0) AS BIGINT) AS out_volume,
 count(DISTINCT cp) AS n_neighbors, count(*) AS degree FROM inc GROUP BY time_key, node)
"""
)
_FLOW_COLS = f"""*, (in_cents + out_cents) / CAST(100 AS DOUBLE) AS strength, (in_cents - out_cents) / CAST(100 AS DOUBLE) AS net_flow,
 coalesce({rsql("in_cents - out_cents", "in_cents + out_cents")}, 0) AS flow_ratio, least(in_cents, out_cents) / CAST(100 AS DOUBLE) AS throughflow,
 round(ln(1 + (in_cents + out_cents) / CAST(100 AS DOUBLE)), 6) AS log_strength, {rsql("in_cents / CAST(100 AS DOUBLE)", "in_volume")} AS avg_in_ticket, {rsql("out_cents / CAST(100 AS DOUBLE)", "out_volume")} AS avg_out_ticket"""


@query("s21_node_universe", E + "SELECT source AS node FROM e UNION SELECT dest FROM e")
def s21(spark: SparkSession, d: str) -> DataFrame:
    return eg.node_universe(edges(spark, d))


@query("s12_both_directions", E + "SELECT dir, time_key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM inc GROUP BY ALL")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return eg.incidence(edges(spark, d)).groupBy("dir", "time_key").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("s03_clean_edges", E + "SELECT time_key, source, dest, cents, volume FROM e WHERE source <> dest AND cents > 0")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return eg.no_self(edges(spark, d)).filter("cents > 0")


@query("n01_degrees", _DEG + "SELECT * FROM deg")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return flow.degrees(edges(spark, d))


@query("n02_neighbors", E + "SELECT time_key, node, count(DISTINCT cp) AS n_neighbors FROM inc GROUP BY ALL")
def n02(spark: SparkSession, d: str) -> DataFrame:
    return flow.degrees(edges(spark, d)).select("time_key", "node", "n_neighbors")


@query("n03_n04_flows", _DEG + f"SELECT {_FLOW_COLS} FROM deg")
def n03(spark: SparkSession, d: str) -> DataFrame:
    return flow.flows(edges(spark, d))


_CONC = (
    E
    + """, rk AS (SELECT *, sum(cents) OVER (PARTITION BY time_key, node, dir) AS total, row_number() OVER (PARTITION BY time_key, node, dir ORDER BY cents DESC, cp) AS k FROM inc),
pp AS (SELECT *, CASE WHEN total > 0 THEN cents / CAST(total AS DOUBLE) END AS p FROM rk),
conc AS (SELECT time_key, node, """
    + ", ".join(
        f"round(sum(p * p) FILTER (dir = '{x}'), 6) AS hhi_{x}, round(max(p) FILTER (dir = '{x}'), 6) AS top1_{x}, round(sum(p) FILTER (dir = '{x}' AND k <= 3), 6) AS top3_{x}, round(-sum(CASE WHEN p > 0 THEN p * ln(p) WHEN p = 0 THEN 0 END) FILTER (dir = '{x}'), 6) AS entropy_{x}"
        for x in ("in", "out")
    )
    + " FROM pp GROUP BY time_key, node) "
)


@query("n05_n06_concentration", _CONC + "SELECT * FROM conc")
def n05(spark: SparkSession, d: str) -> DataFrame:
    return flow.concentration(edges(spark, d))


@query(
    "n07_flow_variants",
    _DEG
    + f"SELECT time_key, node, {rsql('in_cents', 'in_cents + out_cents')} AS in_share, {rsql('least(in_cents, out_cents)', 'greatest(in_cents, out_cents)')} AS pass_through_index, {rsql('in_cents - out_cents', 'in_cents + out_cents')} AS in_out_asymmetry, round(1 - {rsql('abs(in_cents - out_cents)', 'in_cents + out_cents', 12)}, 6) AS passthrough_score FROM deg",
)
def n07(spark: SparkSession, d: str) -> DataFrame:
    return flow.flow_variants(edges(spark, d))


_REC = (
    E
    + f""", dy AS (SELECT x.time_key, x.source AS node, least(x.cents, coalesce(y.cents, 0)) AS lo, greatest(x.cents, coalesce(y.cents, 0)) AS hi FROM e x LEFT JOIN e y ON y.time_key = x.time_key AND y.source = x.dest AND y.dest = x.source
 UNION ALL SELECT x.time_key, x.dest, least(x.cents, coalesce(y.cents, 0)), greatest(x.cents, coalesce(y.cents, 0)) FROM e x LEFT JOIN e y ON y.time_key = x.time_key AND y.source = x.dest AND y.dest = x.source WHERE y.source IS NULL),
rec AS (SELECT time_key, node, {rsql("sum(lo)", "sum(lo + hi)")} AS reciprocity_amount_share, {rsql("sum(lo)", "sum(hi)")} AS reciprocity_min_max, {rsql("count(*) FILTER (lo > 0)", "count(*)")} AS reciprocated_neighbors FROM dy GROUP BY time_key, node) """
)


@query("n21_n22_reciprocity", _REC + "SELECT * FROM rec")
def n21(spark: SparkSession, d: str) -> DataFrame:
    return flow.reciprocity(edges(spark, d))


@query("n03_conduits", _CONC.rstrip() + ", " + _REC.partition(", dy AS")[1][2:] + _REC.partition(", dy AS")[2].rstrip() + _DEG.partition(", deg AS")[1] + _DEG.partition(", deg AS")[2] + f", fl AS (SELECT {_FLOW_COLS} FROM deg) SELECT fl.time_key, fl.node, throughflow, flow_ratio, hhi_in, hhi_out, reciprocity_amount_share FROM fl JOIN conc USING (time_key, node) JOIN rec USING (time_key, node) WHERE fl.time_key = (SELECT max(time_key) FROM e) ORDER BY throughflow DESC, fl.node LIMIT 20")
def conduits(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nodes of the latest month through which most money flows (a top-k report)."""
    e = edges_once(spark, d)
    e = e.filter(F.col("time_key") == e.agg(F.max("time_key")).scalar())
    top = flow.flows(e).select("time_key", "node", "throughflow", "flow_ratio").orderBy(F.desc("throughflow"), "node").limit(20)
    return top.join(flow.concentration(e).select("time_key", "node", "hhi_in", "hhi_out"), ["time_key", "node"]).join(flow.reciprocity(e).select("time_key", "node", "reciprocity_amount_share"), ["time_key", "node"])


_GRP = ", grp AS (SELECT node, state AS grp FROM party WHERE state IS NOT NULL) "


@query(
    "n25_n26_intra",
    EP + _GRP + f"SELECT time_key, inc.node, {rsql('count(*) FILTER (a.grp = b.grp)', 'count(*)')} AS frac_intra_edges, {rsql('coalesce(sum(cents) FILTER (a.grp = b.grp), 0)', 'sum(cents)')} AS frac_intra_amount FROM inc LEFT JOIN grp a ON a.node = inc.node LEFT JOIN grp b ON b.node = inc.cp GROUP BY time_key, inc.node",
)
def n25(spark: SparkSession, d: str) -> DataFrame:
    return flow.intra_fractions(edges(spark, d), partition(spark, d))


def _part_sql(grp: str) -> str:
    return (
        EP
        + f""", grp AS (SELECT node, {grp} AS grp FROM party),
k AS (SELECT time_key, inc.node, coalesce(a.grp, 'NA') AS g, coalesce(b.grp, 'NA') AS h, count(*) AS k FROM inc LEFT JOIN grp a ON a.node = inc.node LEFT JOIN grp b ON b.node = inc.cp GROUP BY ALL),
nn AS (SELECT time_key, node, g, sum(k) AS k, sum(k * k) AS kk, coalesce(sum(k) FILTER (g = h), 0) AS ki FROM k GROUP BY ALL),
z AS (SELECT *, avg(ki) OVER w AS m, stddev_samp(ki) OVER w AS sd FROM nn WINDOW w AS (PARTITION BY time_key, g)),
zz AS (SELECT time_key, node, round(1 - kk / CAST(k * k AS DOUBLE), 6) AS c, round(CASE WHEN sd > 0 THEN (ki - m) / sd ELSE 0 END, 6) AS z FROM z)
SELECT time_key, node, c AS participation_coef, z AS within_module_z, CASE WHEN z >= 2.5 THEN CASE WHEN c <= 0.30 THEN 'R5' WHEN c <= 0.75 THEN 'R6' ELSE 'R7' END WHEN c <= 0.05 THEN 'R1' WHEN c <= 0.62 THEN 'R2' WHEN c <= 0.80 THEN 'R3' ELSE 'R4' END AS ga_role FROM zz"""
    )


@query("n23_participation", _part_sql("state"))
def n23(spark: SparkSession, d: str) -> DataFrame:
    return flow.participation(edges(spark, d), parties(spark, d).select("node", F.col("state").alias("grp")))


@query("n24_naics_participation", _part_sql("naics2"))
def n24(spark: SparkSession, d: str) -> DataFrame:
    return flow.participation(edges(spark, d), sectors(spark, d).withColumnRenamed("sector", "grp"))


@query(
    "n27_homophily",
    EP + "SELECT time_key, inc.node, " + ", ".join(rsql(f"coalesce(sum(cents) FILTER (dir = '{x}' AND a.naics2 = b.naics2), 0)", f"sum(cents) FILTER (dir = '{x}' AND b.naics2 IS NOT NULL)") + f" AS same_sector_{x}_share" for x in ("in", "out")) + " FROM inc LEFT JOIN party a ON a.node = inc.node LEFT JOIN party b ON b.node = inc.cp GROUP BY time_key, inc.node",
)
def n27(spark: SparkSession, d: str) -> DataFrame:
    return flow.homophily(edges(spark, d), sectors(spark, d))


@query(
    "n28_n33_sector_mix",
    EP
    + """, s AS (SELECT time_key, inc.node, dir, b.naics2 AS sector, sum(cents) AS a, count(*) AS n FROM inc JOIN party b ON b.node = inc.cp WHERE b.naics2 IS NOT NULL AND inc.node <> inc.cp GROUP BY ALL),
q AS (SELECT *, a / CAST(nullif(sum(a) OVER (PARTITION BY time_key, node, dir), 0) AS DOUBLE) AS p FROM s)
SELECT time_key, node, dir, CAST(sum(n) AS BIGINT) AS n_known_cp, CASE WHEN sum(n) >= 5 THEN count(*) END AS n_sectors, round(CASE WHEN sum(n) >= 5 THEN -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) END, 6) AS sector_entropy, round(CASE WHEN sum(n) >= 5 THEN max(p) END, 6) AS sector_top_share FROM q GROUP BY time_key, node, dir""",
)
def n28(spark: SparkSession, d: str) -> DataFrame:
    return flow.sector_mix(edges(spark, d), sectors(spark, d))


@query(
    "n29_n30_identity",
    EP + ", u AS (SELECT DISTINCT time_key, node FROM inc) SELECT time_key, u.node, coalesce(entity, 'not_in_customers') AS entity, coalesce(node_type, 'not_in_customers') AS node_type, naics2, naics4, naics6, coalesce(naics_coverage, 'not_in_customers') AS naics_coverage FROM u LEFT JOIN party USING (node)",
)
def n29(spark: SparkSession, d: str) -> DataFrame:
    nodes = eg.incidence(edges(spark, d)).select("time_key", "node").distinct()
    p = parties(spark, d).select("node", "entity", "node_type", "naics2", "naics4", "naics6", "naics_coverage")
    return nodes.join(p, "node", "left").withColumns({c: F.coalesce(c, F.lit("not_in_customers")) for c in ("entity", "node_type", "naics_coverage")})


_LADDER = (
    E
    + """, basis AS (SELECT node, count(*) AS degree, CAST(sum(cents) AS BIGINT) AS strength FROM inc GROUP BY node),
thr AS (SELECT 'P99' AS version, quantile_cont(degree, 0.99) AS degree_at, quantile_cont(strength, 0.99) AS strength_at FROM basis UNION ALL SELECT 'P99_9', quantile_cont(degree, 0.999), quantile_cont(strength, 0.999) FROM basis),
ladder AS (SELECT version, node FROM basis JOIN thr ON degree > degree_at OR strength > strength_at) """
)


@query("c21_ladder", _LADDER + "SELECT * FROM ladder")
def c21(spark: SparkSession, d: str) -> DataFrame:
    return eg.build_ladder(edges(spark, d), TIERS)[0]


@query("c21_thresholds", _LADDER + "SELECT version, round(degree_at, 6) AS degree_at, round(strength_at, 4) AS strength_at FROM thr")
def c21t(spark: SparkSession, d: str) -> DataFrame:
    return eg.build_ladder(edges(spark, d), TIERS)[1].select("version", F.round("degree_at", 6).alias("degree_at"), F.round("strength_at", 4).alias("strength_at"))


@query(
    "c22_ladder_distinct",
    E
    + """, basis AS (SELECT node, count(DISTINCT (dir, cp)) AS degree, CAST(sum(cents) AS BIGINT) AS strength FROM inc GROUP BY node), thr AS (SELECT quantile_cont(degree, 0.99) AS a, quantile_cont(strength, 0.99) AS b FROM basis)
SELECT 'P99' AS version, node FROM basis, thr WHERE degree > a OR strength > b""",
)
def c22(spark: SparkSession, d: str) -> DataFrame:
    return eg.build_ladder(edges(spark, d), {"P99": 0.99}, distinct=True)[0]


_VERS = _LADDER + ", ev AS (SELECT 'V0' AS version, * FROM e UNION ALL SELECT v.version, e.* FROM e, (SELECT DISTINCT version FROM thr) v WHERE NOT EXISTS (SELECT 1 FROM ladder l WHERE l.version = v.version AND (l.node = e.source OR l.node = e.dest))) "


@query("p01_versions", _VERS + "SELECT version, time_key, count(*) AS n_edges, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY ALL")
def p01(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    return eg.all_versions(e, eg.build_ladder(e, TIERS)[0], ["V0", *TIERS]).groupBy("version", "time_key").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cents").alias("cents"))


@query("p02_self_edges", E + "SELECT time_key, count(*) FILTER (source = dest) AS n_self, count(*) AS n_edges FROM e GROUP BY ALL")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("time_key").agg(F.count_if(F.col("source") == F.col("dest")).alias("n_self"), F.count(F.lit(1)).alias("n_edges"))


@query(
    "n31_hub_exposure",
    _LADDER + ", hub AS (SELECT DISTINCT node FROM ladder WHERE version = 'P99_9') SELECT time_key, inc.node, " + ", ".join(rsql(f"coalesce(sum(cents) FILTER (dir = '{x}' AND hub.node IS NOT NULL), 0)", f"sum(cents) FILTER (dir = '{x}')") + f" AS hub_{x}_share" for x in ("in", "out")) + " FROM inc LEFT JOIN hub ON hub.node = inc.cp GROUP BY time_key, inc.node",
)
def n31(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    return flow.hub_exposure(e, eg.build_ladder(e, TIERS)[0].filter("version = 'P99_9'").select("node"))


_COMP = EP.replace("inc AS (", "inc AS (", 1) + ", " + _LADDER.partition(", basis AS")[1][2:] + _LADDER.partition(", basis AS")[2].rstrip()
_CAT = ", cat AS (SELECT coalesce(p.node, h.node) AS node, CASE WHEN h.node IS NOT NULL THEN 'hub' ELSE p.node_type END AS category FROM party p FULL JOIN (SELECT node FROM ladder WHERE version = 'P99_9') h ON h.node = p.node), ii AS (SELECT inc.*, coalesce(cat.category, 'unknown') AS category FROM inc LEFT JOIN cat ON cat.node = inc.cp WHERE inc.node <> inc.cp) "


@query(
    "n32_composition",
    _COMP + _CAT + "SELECT time_key, node, " + ", ".join(f"{rsql(f'''count(*) FILTER (dir = '{x}' AND category = '{g}')''', f'''count(*) FILTER (dir = '{x}')''')} AS share_{x}_cp_{c}, {rsql(f'''coalesce(sum(cents) FILTER (dir = '{x}' AND category = '{g}'), 0)''', f'''sum(cents) FILTER (dir = '{x}')''')} AS share_{x}_amt_{c}" for x in ("in", "out") for g, c in flow.CATEGORIES.items()) + " FROM ii GROUP BY time_key, node",
)
def n32(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    hubs = eg.build_ladder(e, TIERS)[0].filter("version = 'P99_9'").select("node", F.lit(True).alias("hub"))
    cat = parties(spark, d).select("node", "node_type").join(hubs, "node", "full").select("node", F.when(F.col("hub"), "hub").otherwise(F.col("node_type")).alias("category"))
    return flow.composition(e, cat)


@query(
    "n34_business_flows",
    EP + f"""SELECT time_key, inc.node, CAST(coalesce(sum(cents) FILTER (dir = 'in' AND entity = 'business'), 0) AS BIGINT) AS b2b_in, CAST(coalesce(sum(cents) FILTER (dir = 'out' AND entity = 'business'), 0) AS BIGINT) AS b2b_out,
 {rsql("coalesce(sum(cents) FILTER (dir = 'out' AND entity = 'individual'), 0)", "sum(cents) FILTER (dir = 'out')")} AS payroll_intensity FROM inc LEFT JOIN party ON party.node = inc.cp WHERE inc.node <> inc.cp GROUP BY time_key, inc.node""",
)
def n34(spark: SparkSession, d: str) -> DataFrame:
    inc = eg.incidence(eg.no_self(edges(spark, d))).join(parties(spark, d).select(F.col("node").alias("cp"), "entity"), "cp", "left")
    s = lambda dr, ent: F.sum(F.when((F.col("dir") == dr) & (F.col("entity") == ent), F.col("cents")).otherwise(0))
    return inc.groupBy("time_key", "node").agg(s("in", "business").alias("b2b_in"), s("out", "business").alias("b2b_out"), eg.ratio(s("out", "individual"), F.sum(F.when(F.col("dir") == "out", F.col("cents")))).alias("payroll_intensity"))


def _older_sql(rules: dict, measure: dict) -> str:
    """Percentiles lower than the usual ones, so that small tables lose nodes too."""
    at = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{t}" for t, p in measure.items() for c in ("degree", "strength"))
    gone = " UNION ALL ".join(f"SELECT '{v}' AS version, node FROM basis, cuts WHERE {' OR '.join(f'{c} > {c}_{t}' for c, t in rule)}" for v, rule in rules.items())
    return (
        E + f""", basis AS (SELECT node, count(*) AS degree, CAST(sum(cents) AS BIGINT) AS strength FROM inc GROUP BY node), cuts AS (SELECT {at} FROM basis), gone AS ({gone}), vs AS (SELECT unnest(['V0', 'V1', 'V2', 'V3', 'V4']) AS version)
SELECT version, count(*) AS edges_kept, (SELECT count(*) FROM gone WHERE gone.version = vs.version) AS nodes_removed, CAST(sum(cents) AS BIGINT) AS cents_kept FROM vs, e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.version = vs.version AND g.node = e.source) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.version = vs.version AND g.node = e.dest) GROUP BY version"""
    )


@query("c22_retention_strict_first", _older_sql(eg.STRICT_FIRST, {"broad": 0.99, "strict": 0.999}))
def c22s(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    return eg.retention(e, eg.older_ladder(e, eg.STRICT_FIRST, 0.99, 0.999), list(eg.STRICT_FIRST))


@query("c22_retention_broad_first", _older_sql(eg.BROAD_FIRST, {"broad": 0.99, "strict": 0.999}))
def c22b(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    return eg.retention(e, eg.older_ladder(e, eg.BROAD_FIRST, 0.99, 0.999), list(eg.BROAD_FIRST))


@query("c23_hubs_by_degree", E + "SELECT node, count(DISTINCT cp) AS n_neighbors FROM inc WHERE node <> cp GROUP BY node HAVING count(DISTINCT cp) > 100")
def c23(spark: SparkSession, d: str) -> DataFrame:
    return eg.hub_nodes_by_degree(edges(spark, d), 100)


@query("c24_hubs_by_median", E + ", g AS (SELECT node, count(DISTINCT cp) AS degree FROM inc WHERE node <> cp GROUP BY node) SELECT * FROM g WHERE degree >= 15 * (SELECT quantile_cont(degree, 0.5) FROM g)")
def c24(spark: SparkSession, d: str) -> DataFrame:
    return eg.hub_nodes_by_median(edges(spark, d))


@query("k01_k02_parties", WP + "SELECT * EXCLUDE (digits, ok) FROM party")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d)
