"""Queries on the graph, its distributions, communities and supergraphs, and the iterative metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.ranks import with_average_rank
from flowquarry.operators import edges as eg
from flowquarry.operators import flow
from flowquarry.operators import graph as gr
from flowquarry.operators import iterative as it
from flowquarry.plans.base import E, EP, edges, edges_once, parties, partition, rsql, sectors
from flowquarry.plans.flow import _LADDER, TIERS
from flowquarry.plans.registry import query
from flowquarry.plans.temporal import T
from flowquarry.session import cut

D100 = "CAST(100 AS DOUBLE)"


@query(
    "c01_scale",
    E + f", n AS (SELECT time_key, count(DISTINCT node) AS n_nodes FROM inc GROUP BY 1) SELECT time_key, max(n_nodes) AS n_nodes, count(*) AS n_edges, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(volume) AS BIGINT) AS volume, {rsql(f'sum(cents) / {D100}', 'sum(volume)')} AS avg_ticket, round(count(*) / CAST(max(n_nodes) * (max(n_nodes) - 1) AS DOUBLE), 9) AS density FROM e JOIN n USING (time_key) GROUP BY time_key",
)
def c01(spark: SparkSession, d: str) -> DataFrame:
    return gr.scale(edges(spark, d))


@query(
    "c02_reciprocity",
    E + f"SELECT x.time_key, {rsql('count(y.source)', 'count(*)')} AS reciprocity_edges, {rsql('coalesce(sum(least(x.cents, y.cents)) FILTER (y.source IS NOT NULL), 0)', 'sum(x.cents)')} AS reciprocity_amount FROM e x LEFT JOIN e y ON y.time_key = x.time_key AND y.source = x.dest AND y.dest = x.source GROUP BY x.time_key",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    return gr.graph_reciprocity(edges(spark, d))


def _wc(w: str, x: str, y: str) -> str:
    s = {k: f"sum({v})" for k, v in {"w": w, "x": f"{w} * {x}", "y": f"{w} * {y}", "xx": f"{w} * {x} * {x}", "yy": f"{w} * {y} * {y}", "xy": f"{w} * {x} * {y}"}.items()}
    vx, vy = f"({s['w']} * {s['xx']} - {s['x']} * {s['x']})", f"({s['w']} * {s['yy']} - {s['y']} * {s['y']})"
    return f"round(CASE WHEN {vx} > {s['w']} * {s['xx']} * 1e-10 AND {vy} > {s['w']} * {s['yy']} * 1e-10 THEN ({s['w']} * {s['xy']} - {s['x']} * {s['y']}) / sqrt({vx}) / sqrt({vy}) END, 4)"


@query(
    "c03_c04_assortativity",
    E
    + f""", s AS (SELECT time_key, node, round(log10(coalesce(sum(cents) FILTER (dir = 'out'), 0) / {D100} + 1), 9) AS o, round(log10(coalesce(sum(cents) FILTER (dir = 'in'), 0) / {D100} + 1), 9) AS i FROM inc GROUP BY ALL),
j AS (SELECT e.time_key, cents / {D100} AS w, CAST(1 AS DOUBLE) AS one, a.o AS so, a.i AS si, b.o AS dd, b.i AS ti FROM e JOIN s a ON a.time_key = e.time_key AND a.node = e.source JOIN s b ON b.time_key = e.time_key AND b.node = e.dest)
SELECT time_key, {_wc("w", "so", "ti")} AS assort_out_in, {_wc("w", "so", "dd")} AS assort_out_out, {_wc("w", "si", "ti")} AS assort_in_in, {_wc("w", "si", "dd")} AS assort_in_out, {_wc("one", "so", "ti")} AS assort_unweighted FROM j GROUP BY time_key""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    return gr.assortativity(edges(spark, d))


@query(
    "c04_strength_degree_beta",
    E + f", s AS (SELECT time_key, node, ln(count(*)) AS x, ln(sum(cents) / {D100}) AS y FROM inc GROUP BY time_key, node HAVING sum(cents) > 0) SELECT time_key, round(regr_slope(y, x), 4) AS beta, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM s GROUP BY time_key",
)
def c04(spark: SparkSession, d: str) -> DataFrame:
    return gr.strength_degree_beta(edges(spark, d))


_STR = E + ", st AS (SELECT time_key, node, CAST(sum(cents) AS BIGINT) AS s, count(*) AS k FROM inc GROUP BY ALL) "
_GINI = "round((2 * sum(r * CAST({v} AS DOUBLE)) - (count(*) + 1) * CAST(sum({v}) AS DOUBLE)) / (count(*) * CAST(sum({v}) AS DOUBLE)), 6)"


@query("c06_gini", _STR + f"SELECT time_key, count(*) AS n_positive, {_GINI.format(v='s')} AS gini FROM (SELECT *, row_number() OVER (PARTITION BY time_key ORDER BY s) AS r FROM st WHERE s > 0) GROUP BY time_key")
def c06(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(edges(spark, d)).groupBy("time_key", "node").agg(F.sum("cents").alias("s"))
    return gr.gini(s, ["time_key"], "s")


@query(
    "c06_tail",
    _STR
    + f""", n AS (SELECT time_key, count(*) AS n, sum(s) AS tot, least(greatest(floor(count(*) * 0.05), 10), count(*)) AS k, greatest(ceil(count(*) * 0.001), 1) AS m FROM st WHERE s > 0 GROUP BY time_key),
r AS (SELECT st.time_key, s, row_number() OVER (PARTITION BY st.time_key ORDER BY s DESC) AS r, n.k, m, tot FROM st JOIN n USING (time_key) WHERE s > 0),
h AS (SELECT time_key, sum(ln(s)) FILTER (r <= k) / max(k) - ln(min(s) FILTER (r <= k)) AS mean, {rsql("sum(s) FILTER (r <= m)", "max(tot)")} AS top_share FROM r GROUP BY time_key)
SELECT time_key, round(CASE WHEN mean > 1e-12 THEN 1 / mean END, 4) AS hill_alpha, top_share FROM h""",
)
def c06t(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(edges(spark, d)).groupBy("time_key", "node").agg(F.sum("cents").alias("s"))
    return gr.tail_stats(s, ["time_key"], "s")


@query(
    "c07_c08_rich_club",
    _STR
    + f""", rr AS (SELECT *, row_number() OVER (PARTITION BY time_key ORDER BY s DESC, node) AS r, count(*) OVER (PARTITION BY time_key) AS n FROM st), rich AS (SELECT time_key, node FROM rr WHERE r <= greatest(floor(n * 0.01), 2)),
j AS (SELECT e.time_key, e.cents, a.node IS NOT NULL AS x, b.node IS NOT NULL AS y FROM e LEFT JOIN rich a ON a.time_key = e.time_key AND a.node = e.source LEFT JOIN rich b ON b.time_key = e.time_key AND b.node = e.dest),
club AS (SELECT time_key, count(*) FILTER (x AND y) AS n_in, coalesce(sum(cents) FILTER (x AND y), 0) AS ic, coalesce(sum(cents) FILTER (x OR y), 0) AS tc, sum(cents) AS ac FROM j GROUP BY time_key),
big AS (SELECT b.time_key, sum(b.cents) AS best FROM (SELECT time_key, cents, row_number() OVER (PARTITION BY time_key ORDER BY cents DESC) AS r FROM e) b JOIN club USING (time_key) WHERE r <= n_in GROUP BY b.time_key)
SELECT time_key, n_in, {rsql("ic", "best")} AS rich_club, {rsql("ic", "ac")} AS inside_share, {rsql("tc", "ac")} AS touched_share FROM club LEFT JOIN big USING (time_key)""",
)
def c07(spark: SparkSession, d: str) -> DataFrame:
    return gr.rich_club(edges(spark, d), 0.01)


@query(
    "c09_entropy",
    E
    + f""", s AS (SELECT time_key, node, sum(cents) / {D100} AS k FROM inc WHERE node <> cp GROUP BY ALL), a AS (SELECT time_key, sum(k) AS s1, sum(k * k) AS s2 FROM s GROUP BY time_key),
dy AS (SELECT time_key, least(source, dest) AS a, greatest(source, dest) AS b, sum(cents) / {D100} AS w FROM e WHERE source <> dest GROUP BY ALL), b AS (SELECT time_key, sum(w * w) AS w2 FROM dy GROUP BY time_key)
SELECT time_key, round(s2 / (s1 * s1), 6) AS strength_hhi, round(-ln((s2 + 2 * w2) / (s1 * s1)), 6) AS renyi2_entropy FROM a JOIN b USING (time_key)""",
)
def c09(spark: SparkSession, d: str) -> DataFrame:
    return gr.strength_hhi_entropy(edges(spark, d))


_DCOLS = ("degree", "dollars")


@query(
    "c14_distributions",
    _STR
    + f""", x AS (SELECT time_key, 'degree' AS metric, CAST(k AS DOUBLE) AS x FROM st UNION ALL SELECT time_key, 'dollars', s / {D100} FROM st),
g AS (SELECT time_key, metric, {_GINI.format(v="x")} AS gini FROM (SELECT *, row_number() OVER (PARTITION BY time_key, metric ORDER BY x) AS r FROM x WHERE x > 0) GROUP BY ALL)
SELECT time_key, metric, count(x) AS n, round(1 - count(x) / CAST(count(*) AS DOUBLE), 6) AS null_share, round(count(*) FILTER (x = 0) / CAST(count(x) AS DOUBLE), 6) AS zero_share, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, min(x) AS least, max(x) AS most, round(skewness(x), 4) AS skew,
 {", ".join(f"round(quantile_cont(x, {p / 100}), 4) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99))}, max(gini) AS gini FROM x LEFT JOIN g USING (time_key, metric) GROUP BY time_key, metric""",
)
def c14(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(edges(spark, d)).groupBy("time_key", "node").agg(F.count(F.lit(1)).alias("degree"), (F.sum("cents") / F.lit(100.0)).alias("dollars"))
    return gr.distribution(s, ["time_key"], list(_DCOLS))


_LAB = EP + ", grp AS (SELECT node, state AS grp FROM party WHERE state IS NOT NULL), le AS (SELECT e.*, a.grp AS gs, b.grp AS gd FROM e JOIN grp a ON a.node = e.source JOIN grp b ON b.node = e.dest) "


@query(
    "c01_modularity",
    _LAB + ", g AS (SELECT time_key, gs AS g, cents, gs = gd AS own FROM le UNION ALL SELECT time_key, gd, cents, gs = gd FROM le), p AS (SELECT time_key, g, CAST(sum(cents) AS DOUBLE) AS tot, CAST(coalesce(sum(cents) FILTER (own), 0) AS DOUBLE) AS inn FROM g GROUP BY ALL), q AS (SELECT time_key, inn / sum(tot) OVER (PARTITION BY time_key) - power(tot / sum(tot) OVER (PARTITION BY time_key), 2) AS q FROM p) SELECT time_key, count(*) AS n_communities, round(sum(q), 6) AS modularity FROM q GROUP BY time_key",
)
def c01m(spark: SparkSession, d: str) -> DataFrame:
    return gr.modularity(edges(spark, d), partition(spark, d))


_C15 = (
    _LAB
    + f""", fl AS (SELECT time_key, grp, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}, CAST(coalesce(sum(cents) FILTER (kind = '{k}'), 0) AS BIGINT) AS cents_{k}" for k in ("inside", "out", "in"))} FROM (
 SELECT time_key, gs AS grp, 'inside' AS kind, cents FROM le WHERE gs = gd UNION ALL SELECT time_key, gs, 'out', cents FROM le WHERE gs <> gd UNION ALL SELECT time_key, gd, 'in', cents FROM le WHERE gs <> gd) GROUP BY ALL),
mb AS (SELECT time_key, grp, count(*) AS n_members, count(*) FILTER (x) AS n_boundary FROM (SELECT time_key, grp, node, bool_or(x) AS x FROM (SELECT time_key, gs AS grp, source AS node, gs <> gd AS x FROM le UNION ALL SELECT time_key, gd, dest, gs <> gd FROM le) GROUP BY ALL) GROUP BY ALL),
mu AS (SELECT x.time_key, x.gs AS grp, sum(least(x.cents, y.cents)) AS matched FROM le x JOIN le y ON y.time_key = x.time_key AND y.source = x.dest AND y.dest = x.source WHERE x.gs = x.gd GROUP BY ALL),
z AS (SELECT *, 2 * cents_inside + cents_out + cents_in AS vol, sum(2 * cents_inside + cents_out + cents_in) OVER (PARTITION BY time_key) AS whole FROM fl JOIN mb USING (time_key, grp) LEFT JOIN mu USING (time_key, grp))
SELECT time_key, grp, n_members, n_inside, n_out, n_in, cents_inside, cents_out, cents_in, round(CASE WHEN n_members > 1 THEN n_inside / CAST(n_members * (n_members - 1) AS DOUBLE) END, 9) AS internal_density,
 {rsql("n_inside", "n_inside + n_out + n_in")} AS mixing_edges, {rsql("cents_inside", "cents_inside + cents_out + cents_in")} AS mixing_amount, round(CASE WHEN least(vol, whole - vol) > 0 THEN (cents_out + cents_in) / CAST(least(vol, whole - vol) AS DOUBLE) END, 6) AS conductance,
 {rsql("vol", "whole")} AS amount_share, {rsql("n_boundary", "n_members")} AS boundary_fraction, {rsql("coalesce(matched, 0)", "cents_inside")} AS matched_share FROM z"""
)


@query("c15_community_table", _C15)
def c15(spark: SparkSession, d: str) -> DataFrame:
    return gr.community_table(edges(spark, d), partition(spark, d))


@query("c16_sector_table", _C15.replace("node, state AS grp FROM party WHERE state IS NOT NULL", "node, naics2 AS grp FROM party WHERE naics2 IS NOT NULL"))
def c16(spark: SparkSession, d: str) -> DataFrame:
    """The community table by sector."""
    return gr.community_table(edges(spark, d), sectors(spark, d).select("node", F.col("sector").alias("grp")).filter("grp is not null"))


_SUP = _LAB + ", sup AS (SELECT time_key, gs AS source, gd AS dest, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_edges, count(DISTINCT (source, dest)) AS n_pairs, gs = gd AS is_self FROM le GROUP BY time_key, gs, gd) "


@query("c25_c27_supergraph", _SUP + "SELECT * FROM sup")
def c25(spark: SparkSession, d: str) -> DataFrame:
    return gr.supergraph(edges(spark, d), partition(spark, d))


@query(
    "c25_supergraph_nodes",
    _SUP + "SELECT time_key, node, CAST(coalesce(sum(cents) FILTER (node = cp AND dir = 'out'), 0) AS BIGINT) AS internal_cents, CAST(coalesce(sum(cents) FILTER (node <> cp AND dir = 'out'), 0) AS BIGINT) AS out_cents, CAST(coalesce(sum(cents) FILTER (node <> cp AND dir = 'in'), 0) AS BIGINT) AS in_cents, count(DISTINCT CASE WHEN node <> cp THEN cp END) AS n_partners FROM (SELECT time_key, source AS node, dest AS cp, 'out' AS dir, cents FROM sup UNION ALL SELECT time_key, dest, source, 'in', cents FROM sup) GROUP BY time_key, node",
)
def c25n(spark: SparkSession, d: str) -> DataFrame:
    return gr.supergraph_nodes(edges(spark, d), partition(spark, d))


@query("c26_sector_supergraph", EP + ", le AS (SELECT e.*, a.naics2 AS gs, b.naics2 AS gd FROM e JOIN party a ON a.node = e.source JOIN party b ON b.node = e.dest WHERE a.naics2 IS NOT NULL AND b.naics2 IS NOT NULL) SELECT time_key, gs AS source, gd AS dest, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_edges, count(DISTINCT (source, dest)) AS n_pairs, gs = gd AS is_self FROM le GROUP BY time_key, gs, gd")
def c26(spark: SparkSession, d: str) -> DataFrame:
    return gr.supergraph(edges(spark, d), sectors(spark, d).select("node", F.col("sector").alias("grp")).filter("grp is not null"))


_MATRIX = ("individual", "business", "unknown")


@query(
    "c27_flow_matrix",
    EP + ", le AS (SELECT a.entity AS source, b.entity AS dest, cents FROM e JOIN party a ON a.node = e.source JOIN party b ON b.node = e.dest) SELECT source, " + ", ".join(f"CAST(coalesce(sum(cents) FILTER (dest = '{g}'), 0) AS BIGINT) AS {g}" for g in _MATRIX) + " FROM le GROUP BY source",
)
def c27(spark: SparkSession, d: str) -> DataFrame:
    return gr.flow_matrix(edges(spark, d), parties(spark, d).select("node", F.col("entity").alias("grp")), list(_MATRIX))


@query(
    "c17_partition_agreement",
    EP
    + """, m AS (SELECT state AS a, naics2 AS b, count(*) AS n FROM party WHERE state IS NOT NULL AND naics2 IS NOT NULL GROUP BY ALL), sa AS (SELECT a, sum(n) AS n FROM m GROUP BY a), sb AS (SELECT b, sum(n) AS n FROM m GROUP BY b),
x AS (SELECT CAST((SELECT sum(n) FROM m) AS DOUBLE) AS t, (SELECT sum(n * ln(n)) FROM m) AS hab, (SELECT sum(n * ln(n)) FROM sa) AS ha, (SELECT sum(n * ln(n)) FROM sb) AS hb, (SELECT sum(n * (n - 1) / 2.0) FROM m) AS cab, (SELECT sum(n * (n - 1) / 2.0) FROM sa) AS ca, (SELECT sum(n * (n - 1) / 2.0) FROM sb) AS cb),
y AS (SELECT t, ln(t) - ha / t AS ea, ln(t) - hb / t AS eb, ln(t) - hab / t AS eab, cab, ca * cb / (t * (t - 1) / 2) AS ex, (ca + cb) / 2 AS mo FROM x)
SELECT CAST(t AS BIGINT) AS n, round(2 * (ea + eb - eab) / (ea + eb), 6) AS nmi, round((cab - ex) / (mo - ex), 6) AS ari FROM y""",
)
def c17(spark: SparkSession, d: str) -> DataFrame:
    p = parties(spark, d)
    a, b = p.select("node", F.col("state").alias("grp")).filter("grp is not null"), p.select("node", F.col("naics2").alias("grp")).filter("grp is not null")
    return gr.partition_agreement(a, b)


_LIFE = T + """, tp AS (SELECT t, dest AS node, arg_min(source, (-cents, source)) AS grp FROM et GROUP BY ALL), na AS (SELECT t + 1 AS t, grp AS x, count(*) AS nx FROM tp WHERE t < (SELECT max(t) FROM mm) GROUP BY ALL), nb AS (SELECT t, grp AS y, count(*) AS ny FROM tp WHERE t > (SELECT min(t) FROM mm) GROUP BY ALL),
ov AS (SELECT t, x, y, nx, ny, n / CAST(nx + ny - n AS DOUBLE) AS j FROM (SELECT b.t, a.grp AS x, b.grp AS y, count(*) AS n FROM tp a JOIN tp b ON b.node = a.node AND b.t = a.t + 1 GROUP BY ALL) JOIN na USING (t, x) JOIN nb USING (t, y)) """


def payer_groups(spark: SparkSession, d: str) -> DataFrame:
    """(t, node, grp): each month's payees grouped by their top payer."""
    from flowquarry.operators.temporal import with_t

    e = cut(with_t(edges(spark, d)), "edges")
    return cut(e.groupBy("t", F.col("dest").alias("node")).agg(F.min_by("source", F.struct(-F.col("cents"), F.col("source"))).alias("grp")), "groups")


@query(
    "c18_lifecycle",
    _LIFE
    + """, h AS (SELECT *, count(*) OVER (PARTITION BY t, x) AS s, count(*) OVER (PARTITION BY t, y) AS m FROM ov WHERE j >= 0.3)
SELECT t, x AS grp_before, y AS grp_after, CASE WHEN s > 1 THEN 'split' WHEN m > 1 THEN 'merge' WHEN ny / CAST(nx AS DOUBLE) > 1.2 THEN 'growth' WHEN ny / CAST(nx AS DOUBLE) < 0.8 THEN 'shrinkage' ELSE 'continuation' END AS event FROM h
UNION ALL SELECT t, NULL, y, 'birth' FROM nb WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.t = nb.t AND h.y = nb.y) UNION ALL SELECT t, x, NULL, 'death' FROM na WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.t = na.t AND h.x = na.x)""",
)
def c18(spark: SparkSession, d: str) -> DataFrame:
    return gr.lifecycle(payer_groups(spark, d))


@query(
    "c19_lifecycle_by_best",
    _LIFE
    + """, be AS (SELECT t, x, arg_min(y, (-j, y)) AS y, max(j) AS j, count(*) FILTER (j >= 0.15) AS k FROM ov GROUP BY t, x), f AS (SELECT t, x, y, j, CASE WHEN j >= 0.3 AND k > 1 THEN 'split' WHEN j >= 0.3 THEN 'continued' WHEN k > 0 THEN 'merged' ELSE 'died' END AS event FROM be)
SELECT t, x AS grp_before, CASE WHEN event <> 'died' THEN y END AS grp_after, round(j, 6) AS jaccard, event FROM f UNION ALL SELECT t, NULL, y, NULL, 'born' FROM nb WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = nb.t AND f.y = nb.y AND f.event <> 'died')""",
)
def c19(spark: SparkSession, d: str) -> DataFrame:
    return gr.lifecycle_by_best(payer_groups(spark, d))


@query(
    "c20_hub_summary",
    _LADDER + f""", hub AS (SELECT DISTINCT node FROM ladder WHERE version = 'P99'), al AS (SELECT time_key, sum(cents) AS a FROM e GROUP BY 1)
SELECT time_key, node, count(*) FILTER (dir = 'in') AS n_in, count(*) FILTER (dir = 'out') AS n_out, CAST(coalesce(sum(cents) FILTER (dir = 'in'), 0) AS BIGINT) AS in_cents, CAST(coalesce(sum(cents) FILTER (dir = 'out'), 0) AS BIGINT) AS out_cents, {rsql("sum(cents)", "2 * max(a)")} AS amount_share, CAST(count(DISTINCT cp) * (count(DISTINCT cp) - 1) // 2 AS BIGINT) AS co_pay_pairs FROM inc JOIN hub USING (node) JOIN al USING (time_key) GROUP BY time_key, node""",
)
def c20(spark: SparkSession, d: str) -> DataFrame:
    e = edges_once(spark, d)
    return gr.hub_summary(e, eg.build_ladder(e, TIERS)[0].filter("version = 'P99'").select("node"))


# ---- iterative

W = E + f", wl AS MATERIALIZED (SELECT source AS src, dest AS dst, sum(cents) / {D100} AS w FROM e GROUP BY ALL HAVING sum(cents) > 0), nd AS MATERIALIZED (SELECT src AS node FROM wl UNION SELECT dst FROM wl), ud AS MATERIALIZED (SELECT src, dst FROM wl WHERE src <> dst UNION SELECT dst, src FROM wl WHERE src <> dst) "
LOGW = W + ", lw AS MATERIALIZED (SELECT src, dst, round(ln(1 + w), 9) AS w FROM wl) "


def links(spark: SparkSession, d: str, log: bool = False) -> DataFrame:
    return cut(it.window_links(edges(spark, d), log), "window")


def _unroll(first: str, step: str, rounds: int, last: str) -> str:
    """SQL of a fixed number of rounds; {a} names the round before."""
    out = f", x0 AS MATERIALIZED ({first})"
    for i in range(rounds):
        out += f", x{i + 1} AS MATERIALIZED ({step.format(a=f'x{i}', i=i)})"
    return out + " " + last.format(a=f"x{rounds}")


_PR_STEP = "SELECT base.node, 0.15 * t + 0.85 * (coalesce(i.s, 0) + (1 - (SELECT sum(r * p) FROM {a} JOIN sh ON sh.src = {a}.node)) * t) AS r FROM base LEFT JOIN (SELECT dst, sum(r * p) AS s FROM {a} JOIN sh ON sh.src = {a}.node GROUP BY dst) i ON i.dst = base.node"
_PR = W + ", sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM wl), base AS MATERIALIZED ({base}) "
_PR_END = "SELECT node, round(r, 9) AS pagerank FROM {a}"


@query("n08_pagerank", _PR.format(base="SELECT node, 1.0 / (SELECT count(*) FROM nd) AS t FROM nd") + _unroll("SELECT node, CAST(t AS DOUBLE) AS r FROM base", _PR_STEP, 10, _PR_END))
def n08(spark: SparkSession, d: str) -> DataFrame:
    return it.pagerank(links(spark, d), 10)


_TOP_SEEDS = "SELECT node FROM (SELECT src AS node, w FROM wl UNION ALL SELECT dst, w FROM wl) GROUP BY node ORDER BY sum(w) DESC, node LIMIT 5"


@query("n09_personal_pagerank", _PR.format(base=f"SELECT nd.node, CASE WHEN s.node IS NULL THEN 0.0 ELSE 0.2 END AS t FROM nd LEFT JOIN ({_TOP_SEEDS}) s USING (node)") + _unroll("SELECT node, CAST(t AS DOUBLE) AS r FROM base", _PR_STEP, 6, _PR_END))
def n09(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return it.pagerank(e, 6, seeds=top_seeds(e))


def top_seeds(e: DataFrame, n: int = 5) -> DataFrame:
    s = e.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("w"))
    return s.orderBy(F.desc("w"), "node").limit(n).select("node")


def _hits_sql(rounds: int) -> str:
    out = LOGW + ", h0 AS MATERIALIZED (SELECT node, CAST(1 AS DOUBLE) AS h FROM nd)"
    for i in range(rounds):
        out += f", ar{i} AS MATERIALIZED (SELECT dst AS node, sum(w * h) AS a FROM lw JOIN h{i} ON h{i}.node = src GROUP BY dst), a{i} AS MATERIALIZED (SELECT node, a / (SELECT sqrt(sum(a * a)) FROM ar{i}) AS a FROM ar{i})"
        out += f", hr{i} AS MATERIALIZED (SELECT src AS node, sum(w * a) AS h FROM lw JOIN a{i} ON a{i}.node = dst GROUP BY src), h{i + 1} AS MATERIALIZED (SELECT node, h / (SELECT sqrt(sum(h * h)) FROM hr{i}) AS h FROM hr{i})"
    return out + f" SELECT nd.node, round(coalesce(h, 0), 6) AS hub, round(coalesce(a, 0), 6) AS authority FROM nd LEFT JOIN h{rounds} USING (node) LEFT JOIN a{rounds - 1} USING (node)"


@query("n10_hits", _hits_sql(6))
def n10(spark: SparkSession, d: str) -> DataFrame:
    return it.hits(links(spark, d, log=True), 6)


def _eigen_sql(rounds: int) -> str:
    step = "SELECT node, y / (SELECT sqrt(sum(y * y)) FROM r{i}) AS x FROM r{i}"
    out = W + ", x0 AS MATERIALIZED (SELECT DISTINCT src AS node, CAST(1 AS DOUBLE) AS x FROM ud)"
    for i in range(rounds):
        out += f", r{i} AS MATERIALIZED (SELECT node, x + coalesce(s, 0) AS y FROM x{i} LEFT JOIN (SELECT dst, sum(x) AS s FROM ud JOIN x{i} ON x{i}.node = src GROUP BY dst) ON dst = node), x{i + 1} AS MATERIALIZED ({step.format(i=i)})"
    return out + f" SELECT node, round(x, 6) AS eigenvector FROM x{rounds}"


@query("n11_eigenvector", _eigen_sql(6))
def n11(spark: SparkSession, d: str) -> DataFrame:
    return it.eigenvector(links(spark, d), 6)


@query("n11_katz", W + _unroll("SELECT node, CAST(1 AS DOUBLE) AS x FROM nd", "SELECT nd.node, 1 + 0.005 * coalesce(s, 0) AS x FROM nd LEFT JOIN (SELECT dst, sum(x) AS s FROM wl JOIN {a} ON {a}.node = src GROUP BY dst) ON dst = nd.node", 6, "SELECT node, round(x, 6) AS katz FROM {a}"))
def n11k(spark: SparkSession, d: str) -> DataFrame:
    return it.katz(links(spark, d), 0.005, 6)


# The queries above stop at the rounds their SQL unrolls; these go on to a tolerance, with the reference's bounds where it has any.


@query("n08_pagerank_converged")
def n08c(spark: SparkSession, d: str) -> DataFrame:
    return it.pagerank(links(spark, d), 200, tol=1e-10)


@query("n09_personal_pagerank_converged")
def n09c(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return it.pagerank(e, 200, seeds=top_seeds(e), tol=1e-10)


@query("n10_hits_converged")
def n10c(spark: SparkSession, d: str) -> DataFrame:
    return it.hits(links(spark, d, log=True), 200, tol=1e-9)


@query("n11_eigenvector_converged")
def n11c(spark: SparkSession, d: str) -> DataFrame:
    return it.eigenvector(links(spark, d), 100, tol=1e-8)


@query("n11_katz_converged")
def n11kc(spark: SparkSession, d: str) -> DataFrame:
    return it.katz(links(spark, d), None, 300, tol=1e-8)


@query("n12_core_numbers", W + _unroll("SELECT src AS node, count(*) AS core FROM ud GROUP BY src", "SELECT {a}.node, least(core, h) AS core FROM {a} JOIN (SELECT src, max(least(v, k)) AS h FROM (SELECT src, core AS v, row_number() OVER (PARTITION BY src ORDER BY core DESC) AS k FROM ud JOIN {a} ON {a}.node = dst) GROUP BY src) ON src = {a}.node", 60, "SELECT node, core FROM {a} UNION ALL SELECT node, 0 FROM nd WHERE node NOT IN (SELECT src FROM ud)"))
def n12(spark: SparkSession, d: str) -> DataFrame:
    return it.core_numbers(links(spark, d))


@query("n13_n20_betweenness")
def n13(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    b, t = cut(it.betweenness(e), "betweenness"), cut(it.triangles(e), "triangles")
    # Bridging sets betweenness against clustering.
    return b.join(t.select("node", "clustering"), "node", "left").select("node", "betweenness", F.round(F.col("betweenness") / (F.coalesce("clustering", F.lit(0.0)) + 1e-6), 2).alias("bridging"))


@query("n14_current_flow")
def n14(spark: SparkSession, d: str) -> DataFrame:
    """From 64 landmark pairs drawn by weighted degree."""
    return it.current_flow(links(spark, d))


def _levels_sql(rounds: int) -> str:
    """Trophic levels as unrolled rounds of conjugate gradients; once solved, further rounds change nothing."""
    q = LOGW.replace("WITH eraw", "WITH RECURSIVE eraw", 1) + """, rc(node, label) AS (SELECT node, node FROM nd UNION SELECT ud.dst, rc.label FROM rc JOIN ud ON ud.src = rc.node WHERE rc.label < ud.dst), cmp AS MATERIALIZED (SELECT node, min(label) AS component FROM rc GROUP BY node),
two AS MATERIALIZED (SELECT src AS i, dst AS j, w, -1 AS s FROM lw WHERE src <> dst UNION ALL SELECT dst, src, w, 1 FROM lw WHERE src <> dst), x0 AS MATERIALIZED (SELECT i AS node, sum(w) AS u, CAST(0 AS DOUBLE) AS h, sum(w * s) AS r, sum(w * s) / sum(w) AS p FROM two GROUP BY i)"""
    for k in range(1, rounds + 1):
        was = f"x{k - 1}"
        q += f""", y{k} AS MATERIALIZED (SELECT x.*, u * p - wq AS ap FROM {was} x JOIN (SELECT i, sum(w * p) AS wq FROM two JOIN {was} ON node = j GROUP BY i) ON i = node),
z{k} AS MATERIALIZED (SELECT node, u, h + a * p AS h, r - a * ap AS r, p, rz FROM y{k}, (SELECT sum(r * r / u) AS rz, CASE WHEN sum(p * ap) > 0 THEN sum(r * r / u) / sum(p * ap) ELSE 0 END AS a FROM y{k})), x{k} AS MATERIALIZED (SELECT node, u, h, r, r / u + b * p AS p FROM z{k}, (SELECT CASE WHEN max(rz) > 0 THEN sum(r * r / u) / max(rz) ELSE 0 END AS b FROM z{k}))"""
    return q + f", lev AS MATERIALIZED (SELECT cmp.node, component, round(coalesce(h, 0) - min(coalesce(h, 0)) OVER (PARTITION BY component), 4) AS level FROM cmp LEFT JOIN x{rounds} x ON x.node = cmp.node) "


_LEVELS = _levels_sql(40)
_STEPS = ", st AS (SELECT src, dst, w, power(b.level - a.level - 1, 2) AS q FROM lw JOIN lev a ON a.node = src JOIN lev b ON b.node = dst WHERE src <> dst) "
#: Tighter than the operator's default, so that the fourth digit of a level is sure.
SURE = 1e-10


@query("n15_trophic_levels", _LEVELS + "SELECT node, component, level FROM lev")
def n15(spark: SparkSession, d: str) -> DataFrame:
    return it.trophic_levels(links(spark, d, log=True), tol=SURE)


@query("c05_trophic_incoherence", _LEVELS + _STEPS + "SELECT round(sum(w * q) / sum(w), 4) AS f0, round(sqrt(sum(w * q) / sum(w)), 4) AS f0_root FROM st")
def c05(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d, log=True)
    return it.trophic_incoherence(e, cut(it.trophic_levels(e, tol=SURE), "levels"))


@query("n16_local_incoherence", _LEVELS + _STEPS + "SELECT node, round(sum(w * q) / sum(w), 4) AS incoherence FROM (SELECT src AS node, w, q FROM st UNION ALL SELECT dst, w, q FROM st) GROUP BY node")
def n16(spark: SparkSession, d: str) -> DataFrame:
    """Per node: weighted mean squared deviation of level steps from 1 over its edges."""
    e = links(spark, d, log=True)
    lv = cut(it.trophic_levels(e, tol=SURE), "levels")
    j = e.filter("src <> dst").join(lv.select(F.col("node").alias("src"), F.col("level").alias("a")), "src").join(lv.select(F.col("node").alias("dst"), F.col("level").alias("b")), "dst")
    ends = j.select(F.explode(F.array("src", "dst")).alias("node"), "w", F.pow(F.col("b") - F.col("a") - 1, 2).alias("q"))
    return ends.groupBy("node").agg(F.round(F.sum(F.col("w") * F.col("q")) / F.sum("w"), 4).alias("incoherence"))


@query(
    "n17_n18_triangles",
    W + ", dg AS (SELECT src AS node, count(*) AS k FROM ud GROUP BY src), tr AS (SELECT x.src AS node, count(*) AS t FROM ud x JOIN ud y ON y.src = x.src AND x.dst < y.dst JOIN ud z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src) SELECT node, k AS degree, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / CAST(k * (k - 1) AS DOUBLE) END, 6) AS clustering FROM dg LEFT JOIN tr USING (node)",
)
def n17(spark: SparkSession, d: str) -> DataFrame:
    return it.triangles(links(spark, d))


@query("n18_cyclic_triangles", W + ", q AS (SELECT src, dst FROM wl WHERE src <> dst) SELECT x.src AS node, count(*) AS cyclic FROM q x JOIN q y ON y.src = x.dst JOIN q z ON z.src = y.dst AND z.dst = x.src WHERE y.dst <> x.src GROUP BY x.src")
def n18(spark: SparkSession, d: str) -> DataFrame:
    return it.cyclic_triangles(links(spark, d))


@query(
    "n19_constraint",
    W + ", sy AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM wl WHERE src <> dst UNION ALL SELECT dst, src, w FROM wl WHERE src <> dst) GROUP BY ALL), p AS MATERIALIZED (SELECT src AS i, dst AS j, w / sum(w) OVER (PARTITION BY src) AS p FROM sy), v AS (SELECT x.i, y.j, sum(x.p * y.p) AS v FROM p x JOIN p y ON y.i = x.j JOIN p z ON z.i = x.i AND z.j = y.j GROUP BY ALL) SELECT p.i AS node, round(sum(power(p.p + coalesce(v.v, 0), 2)), 6) AS constraint FROM p LEFT JOIN v ON v.i = p.i AND v.j = p.j GROUP BY p.i",
)
def n19(spark: SparkSession, d: str) -> DataFrame:
    return it.constraint(links(spark, d))


@query(
    "n35_percentile_ranks",
    E + f", s AS (SELECT time_key, node, CAST(sum(cents) AS BIGINT) AS x FROM inc GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY time_key ORDER BY x) AS r, count(*) OVER (PARTITION BY time_key, x) AS c, count(*) OVER (PARTITION BY time_key) AS n FROM s) SELECT time_key, node, round((r + (c - 1) / CAST(2 AS DOUBLE)) / n, 6) AS strength_pct FROM r",
)
def n35(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(edges(spark, d)).groupBy("time_key", "node").agg(F.sum("cents").alias("x"))
    return with_average_rank(s, ["time_key"], "x", "r", "p").select("time_key", "node", F.round("p", 6).alias("strength_pct"))


@query("c10_components", W.replace("WITH eraw", "WITH RECURSIVE eraw", 1) + ", rc(node, label) AS (SELECT node, node FROM nd UNION SELECT ud.dst, rc.label FROM rc JOIN ud ON ud.src = rc.node WHERE rc.label < ud.dst) SELECT node, min(label) AS component FROM rc GROUP BY node")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return it.components(links(spark, d))


_REACH = W.replace("WITH eraw", "WITH RECURSIVE eraw", 1) + ", rch(a, b) AS (SELECT node, node FROM nd UNION SELECT rch.a, wl.dst FROM rch JOIN wl ON wl.src = rch.b), sc AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS scc FROM rch x JOIN rch y ON y.a = x.b AND y.b = x.a GROUP BY x.a) "


@query("c11_strong_components", _REACH + "SELECT * FROM sc")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return it.strong_components(links(spark, d))


@query(
    "n37_c12_bow_tie",
    _REACH + ", top AS (SELECT scc FROM sc GROUP BY scc ORDER BY count(*) DESC, scc LIMIT 1) SELECT sc.node, CASE WHEN sc.scc = top.scc THEN 'CORE' WHEN EXISTS (SELECT 1 FROM rch WHERE a = top.scc AND b = sc.node) THEN 'OUT' WHEN EXISTS (SELECT 1 FROM rch WHERE a = sc.node AND b = top.scc) THEN 'IN' ELSE 'OTHER' END AS bow_tie FROM sc, top",
)
def n37(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return it.bow_tie(e, cut(it.strong_components(e), "scc"))


@query("c11_flow_hierarchy", _REACH + "SELECT count(*) AS n_edges, round(count(*) FILTER (a.scc <> b.scc) / CAST(count(*) AS DOUBLE), 6) AS flow_hierarchy FROM wl JOIN sc a ON a.node = src JOIN sc b ON b.node = dst")
def c11h(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    s = cut(it.strong_components(e), "scc")
    j = e.join(s.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(s.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
    return j.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.count_if(F.col("a") != F.col("b")) / F.count(F.lit(1)), 6).alias("flow_hierarchy"))


def _lpa_sql(rounds: int) -> str:
    step = "SELECT node, arg_min(grp, (-w, grp)) AS grp FROM (SELECT node, grp, round(sum(w), 6) AS w FROM (SELECT bw.src AS node, {a}.grp, bw.w FROM bw JOIN {a} ON {a}.node = bw.dst UNION ALL SELECT {a}.node, grp, ow.w FROM {a} JOIN ow ON ow.node = {a}.node) GROUP BY ALL) GROUP BY node"
    return LOGW + ", bw AS MATERIALIZED (SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, w FROM lw WHERE src <> dst UNION ALL SELECT dst, src, w FROM lw WHERE src <> dst) GROUP BY ALL), ow AS MATERIALIZED (SELECT src AS node, max(w) AS w FROM bw GROUP BY src)" + _unroll("SELECT node, node AS grp FROM ow", step, rounds, "SELECT * FROM {a}")


@query("c13_label_propagation", _lpa_sql(4))
def c13(spark: SparkSession, d: str) -> DataFrame:
    return it.label_propagation(links(spark, d, log=True), 4)


@query(
    "k16_k_hop",
    W + f", sd AS MATERIALIZED ({_TOP_SEEDS}), h1 AS MATERIALIZED (SELECT DISTINCT b.dst AS node FROM ub b JOIN sd ON sd.node = b.src WHERE b.dst NOT IN (SELECT node FROM sd)), h2 AS (SELECT DISTINCT b.dst AS node FROM ub b JOIN h1 ON h1.node = b.src WHERE b.dst NOT IN (SELECT node FROM sd UNION SELECT node FROM h1)) SELECT node, 0 AS hop FROM sd UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2".replace("ub b", "(SELECT source AS src, dest AS dst FROM e UNION SELECT dest, source FROM e) b"),
)
def k16(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return it.k_hop(e, top_seeds(it.window_links(e)), 2)


@query("c13_louvain")
def c13l(spark: SparkSession, d: str) -> DataFrame:
    """Groups of all levels of modularity moves."""
    return it.louvain(links(spark, d, log=True))


@query("c13_modularity_moves")
def c13m(spark: SparkSession, d: str) -> DataFrame:
    """Groups by one level of modularity moves; which of equal optima is found depends on hashes, so the tests check invariants."""
    return it.modularity_moves(links(spark, d, log=True), 8)
