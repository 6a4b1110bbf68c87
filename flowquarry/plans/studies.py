"""Queries of the studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles, quantile
from flowquarry.operators import edges as eg
from flowquarry.operators import flow
from flowquarry.operators import geo_block as gb
from flowquarry.operators import iterative as it
from flowquarry.operators import panel as pn
from flowquarry.operators import studies as sd
from flowquarry.operators import temporal as tm
from flowquarry.plans.base import E, EP, edges, edges_once, parties, partition, rsql, sectors
from flowquarry.plans.geography import SPREAD_ROWS, hav, points
from flowquarry.plans.graph import SURE
from flowquarry.plans.panels import _MK, ST, strengths
from flowquarry.plans.registry import query
from flowquarry.plans.temporal import _SH, T
from flowquarry.session import cut

_PL = EP + ", lc AS (SELECT node AS cp, lat, lon FROM party WHERE ok), pp AS (SELECT node, cp, CAST(sum(cents) AS BIGINT) AS cents FROM inc WHERE node <> cp GROUP BY ALL), pl AS (SELECT node, cp, lat, lon, cents, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM pp JOIN lc USING (cp)) "
_LOC = _PL + """, ls AS (SELECT node, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM pl GROUP BY node), lk AS (SELECT *, 6371.0088 * sqrt(greatest(CAST(0 AS DOUBLE), 2 * (1 - sqrt(x * x + y * y + z * z) / n))) AS km FROM ls),
loc AS (SELECT node, n AS n_places, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon, round(km, 1) AS radius_km, CASE WHEN n < 3 THEN 'too_few' WHEN km < 25 THEN 'pin' WHEN km < 100 THEN 'metro' WHEN km < 400 THEN 'region' ELSE 'none' END AS evidence FROM lk) """


@query("k40_k41_locate", _LOC + "SELECT * FROM loc WHERE n_places >= 2")
def k40(spark: SparkSession, d: str) -> DataFrame:
    return sd.locate(sd.neighbour_places(edges(spark, d), points(spark, d))).filter("n_places >= 2")


@query(
    "k38_prefix_curve",
    _PL + f""", o AS (SELECT pl.*, p.lat AS la, p.lon AS lo, row_number() OVER (PARTITION BY pl.node ORDER BY cents DESC, cp) AS k FROM pl JOIN party p ON p.node = pl.node AND p.ok), r AS (SELECT node, la, lo, k, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(z) OVER w AS z, max(k) OVER (PARTITION BY node) AS have FROM o WHERE k <= 5 WINDOW w AS (PARTITION BY node ORDER BY k ROWS UNBOUNDED PRECEDING)),
ek AS (SELECT k, {hav("la", "lo", "degrees(atan2(z, sqrt(x * x + y * y)))", "degrees(atan2(y, x))")} AS km FROM r WHERE have = 5 AND k IN (1, 3, 5)) SELECT CAST(k AS INTEGER) AS k, count(*) AS n_nodes, round(quantile_cont(km, 0.5), 1) AS median_km, round(quantile_cont(km, 0.9), 1) AS p90_km FROM ek GROUP BY k""",
)
def k38(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sd.prefix_curve(sd.neighbour_places(edges(spark, d), p), p, [1, 3, 5])


@query(
    "k42_shrunk_width",
    _LOC + ", j AS (SELECT loc.*, naics2 FROM loc JOIN party USING (node) WHERE n_places >= 2), pe AS (SELECT naics2, quantile_cont(radius_km, 0.5) AS p FROM j WHERE naics2 IS NOT NULL GROUP BY 1), al AS (SELECT quantile_cont(radius_km, 0.5) AS a FROM loc WHERE n_places >= 2) SELECT node, round(greatest(5.0, sqrt((n_places * radius_km * radius_km + 5 * coalesce(p, a) * coalesce(p, a)) / (n_places + 5.0))), 2) AS width_km FROM j LEFT JOIN pe USING (naics2), al",
)
def k42(spark: SparkSession, d: str) -> DataFrame:
    loc = cut(sd.locate(sd.neighbour_places(edges(spark, d), points(spark, d))).filter("n_places >= 2"), "located")
    return sd.shrunk_width(loc, parties(spark, d).select("node", "naics2"), "naics2")


_ERR = _LOC + f", er AS (SELECT loc.node, radius_km, {hav('loc.lat', 'loc.lon', 'p.lat', 'p.lon')} AS km FROM loc JOIN party p ON p.node = loc.node AND p.ok WHERE n_places >= 3) "


def _errors(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    loc = sd.locate(sd.neighbour_places(edges(spark, d), p)).filter("n_places >= 3")
    own = p.filter("lat is not null and lon is not null").select("node", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    from flowquarry.functions.cleaning import located
    from flowquarry.functions.geo import haversine_km

    return loc.join(own.filter(located("la", "lo")), "node").select("node", "radius_km", haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")).alias("km"))


@query("k39_calibration", _ERR + f"SELECT factor, count(*) AS n, {rsql('count(*) FILTER (km <= factor * radius_km)', 'count(*)')} AS covered FROM er, (SELECT unnest([CAST(0.5 AS DOUBLE), 1, 1.5, 2]) AS factor) GROUP BY factor")
def k39(spark: SparkSession, d: str) -> DataFrame:
    return sd.calibration(_errors(spark, d), "radius_km", "km", [0.5, 1.0, 1.5, 2.0])


@query(
    "k37_band_rule",
    _ERR + f", g AS (SELECT b.cut, {'count(*) FILTER (radius_km <= b.cut)'} AS n_kept, {rsql('count(*) FILTER (radius_km <= b.cut)', 'count(*)')} AS coverage, {rsql('count(*) FILTER (radius_km <= b.cut AND km <= 250)', 'count(*) FILTER (radius_km <= b.cut)')} AS precision FROM er, (SELECT unnest([CAST(50 AS DOUBLE), 100, 250, 500, 1000, 3000]) AS cut) b GROUP BY b.cut) SELECT *, coalesce(cut = (SELECT max(cut) FROM g WHERE precision >= 0.5), false) AS best FROM g",
)
def k37(spark: SparkSession, d: str) -> DataFrame:
    return sd.band_rule(_errors(spark, d), "radius_km", F.col("km") <= 250, [50, 100, 250, 500, 1000, 3000], 0.5)


@query("k36_baseline_by_degree", _ERR + ", q AS (SELECT er.*, n_places FROM er JOIN loc USING (node)) SELECT CAST(floor(log2(n_places)) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(km, 0.5), 1) AS median_km FROM q GROUP BY 1")
def k36(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    n = sd.locate(sd.neighbour_places(edges(spark, d), points(spark, d))).select("node", "n_places")
    g = e.join(n, "node").select(F.floor(F.log2("n_places")).alias("bin"), "km")
    return g.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(group_quantiles(g, ["bin"], "km", {"m": 0.5}), "bin").select("bin", "n", F.round("m", 1).alias("median_km"))


@query(
    "k30_level_shift",
    ST + ", s AS (SELECT node, t, avg(x) OVER b AS b, count(*) OVER b AS nb, avg(x) OVER a AS a, count(*) OVER a AS na FROM sm WINDOW b AS (PARTITION BY node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), d AS (SELECT node, t, round(a - b, 4) AS shift FROM s WHERE nb >= 3 AND na >= 3) SELECT node, arg_min(t, (-abs(shift), t)) AS t, arg_min(shift, (-abs(shift), t)) AS shift FROM d GROUP BY node",
)
def k30(spark: SparkSession, d: str) -> DataFrame:
    return sd.level_shift(strengths(spark, d), "node", "t", "x")


@query(
    "w12_run_lengths",
    ST + ", o AS (SELECT node, t, t - row_number() OVER (PARTITION BY node ORDER BY t) AS i FROM sm WHERE x >= 100000), r AS (SELECT node, i, count(*) AS n, max(t) AS e FROM o GROUP BY ALL) SELECT node, max(n) AS longest, count(*) AS n_runs, coalesce(max(n) FILTER (e = (SELECT max(t) FROM mm)), 0) AS current FROM r GROUP BY node",
)
def w12(spark: SparkSession, d: str) -> DataFrame:
    return sd.run_lengths(strengths(spark, d), "node", "t", F.col("x") >= 100_000)


@query("w14_running_least", ST + "SELECT node, t, x, CAST(min(x) OVER w AS BIGINT) AS least, arg_min(t, (x, t)) OVER w AS least_t FROM sm WINDOW w AS (PARTITION BY node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """The least strength so far and the month it was first there, as one running minimum of a pair."""
    w = Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return strengths(spark, d).withColumn("m", F.min(F.struct("x", "t")).over(w)).select("node", "t", "x", F.col("m.x").alias("least"), F.col("m.t").alias("least_t"))


@query(
    "w15_halves",
    ST + ", h AS (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM sm) SELECT node, max(n) AS n, round(avg(x) FILTER (2 * i < n), 4) AS first_half, round(avg(x) FILTER (2 * i >= n), 4) AS second_half FROM h GROUP BY node",
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    """Means of the first and second half of a node's months, by their running count."""
    w = Window.partitionBy("node")
    h = strengths(spark, d).select("node", "x", (F.row_number().over(w.orderBy("t")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    late = 2 * F.col("i") >= F.col("n")
    return h.groupBy("node").agg(F.max("n").alias("n"), F.round(F.avg(F.when(~late, F.col("x"))), 4).alias("first_half"), F.round(F.avg(F.when(late, F.col("x"))), 4).alias("second_half"))


@query(
    "m20_placebo",
    ST + ", a AS (SELECT node, t, row_number() OVER (PARTITION BY node ORDER BY t) AS k FROM sm), b AS (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY md5('0|' || node || '|' || t), t) AS k FROM sm) SELECT a.node, a.t, b.x FROM a JOIN b ON b.node = a.node AND b.k = a.k",
)
def m20(spark: SparkSession, d: str) -> DataFrame:
    return sd.shuffled(strengths(spark, d), "node", "t", "x")


_SIDE = EP + """, pl AS (SELECT node, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM party WHERE ok),
ds AS (SELECT i.node, i.dir, i.cents AS w, """ + hav("a.lat", "a.lon", "b.lat", "b.lon") + """ AS km FROM inc i JOIN pl a ON a.node = i.node JOIN pl b ON b.node = i.cp WHERE i.node <> i.cp AND cents > 0),
sk AS (SELECT node, round(sum(w * km) FILTER (dir = 'in') / sum(w) FILTER (dir = 'in'), 1) AS in_km, round(sum(w * km) FILTER (dir = 'out') / sum(w) FILTER (dir = 'out'), 1) AS out_km FROM ds GROUP BY node) """


@query("k32_trade_roles", _SIDE + "SELECT *, CASE WHEN in_km IS NULL OR out_km IS NULL THEN NULL WHEN in_km >= 250 AND out_km >= 250 THEN 'national' WHEN in_km >= 250 THEN 'exporter' WHEN out_km >= 250 THEN 'importer' ELSE 'local' END AS trade_role FROM sk")
def k32(spark: SparkSession, d: str) -> DataFrame:
    from flowquarry.functions.geo import haversine_km

    n = gb.near(edges(spark, d), points(spark, d)).filter("lat is not null and own_lat is not null and cents > 0")
    km = haversine_km(F.col("own_lat"), F.col("own_lon"), F.col("lat"), F.col("lon"))
    side = lambda s: F.round(F.sum(F.when(F.col("dir") == s, F.col("cents") * km)) / F.sum(F.when(F.col("dir") == s, F.col("cents"))), 1)
    return sd.trade_roles(n.groupBy("node").agg(side("in").alias("in_km"), side("out").alias("out_km")))


@query(
    "k31_mislocated",
    _SIDE + ", r AS (SELECT node, ln(1 + in_km) AS y, ln(1 + out_km) AS x FROM sk WHERE in_km IS NOT NULL AND out_km IS NOT NULL), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r), rs AS (SELECT node, round(y - a - b * x, 6) AS residual FROM r, f) SELECT node, residual FROM rs WHERE residual > (SELECT quantile_cont(residual, 0.99) FROM rs)",
)
def k31(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose payers lie far beyond what their payees' distance suggests: the top hundredth of the residual."""
    s = cut(k32(spark, d).filter("in_km is not null and out_km is not null").select("node", F.log1p("in_km").alias("y"), F.log1p("out_km").alias("x")), "sides")
    f = s.agg(F.struct(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))).scalar()
    e = s.withColumn("f", f).select("node", F.round(F.col("y") - F.col("f.a") - F.col("f.b") * F.col("x"), 6).alias("residual"))
    return e.filter(F.col("residual") > quantile(e, "residual", 0.99))


_DYN = (
    _SH
    + f""", sx AS (SELECT t, time_key, node, CAST(sum(cents) AS BIGINT) / CAST(100 AS DOUBLE) AS s, count(*) FILTER (dir = 'in') AS in_degree FROM it GROUP BY ALL), tn AS (SELECT *, t - min(t) OVER w AS since, t - lag(t) OVER w AS gap, CASE WHEN lag(t) OVER w = t - 1 THEN ln((s + 1) / (lag(s) OVER w + 1)) END AS mom,
 CASE WHEN lag(t) OVER w = t - 1 THEN lag(in_degree) OVER w END AS prior FROM sx WINDOW w AS (PARTITION BY node ORDER BY t)),
mem AS (SELECT *, lag(t) OVER (PARTITION BY source, dest ORDER BY t) AS l FROM et), nw AS (SELECT t, dest AS node, CASE WHEN max(t) > 1 THEN {rsql("coalesce(sum(cents) FILTER (l IS NULL OR l < t - 6), 0)", "sum(cents)")} END AS new_share FROM mem GROUP BY t, dest),
lo AS (SELECT t, dest AS node, {rsql("coalesce(sum(before) FILTER (now IS NULL), 0)", "sum(before)")} AS lost_share, {rsql("count(*) FILTER (now IS NOT NULL AND before IS NOT NULL)", "count(*)")} AS pj FROM sh GROUP BY t, dest),
dm AS (SELECT tn.*, coalesce(new_share, 0) AS new_share, coalesce(lost_share, 0) AS lost_share, pj FROM tn LEFT JOIN nw USING (t, node) LEFT JOIN lo USING (t, node)), dq AS (SELECT t, quantile_cont(pj, 0.25) AS p25, quantile_cont(pj, 0.5) AS p50 FROM dm GROUP BY t) """
)


@query(
    "r05_dynamics_roles",
    _DYN
    + """SELECT time_key, node, CASE WHEN since <= 2 THEN 'newcomer' WHEN gap > 1 THEN 'intermittent' WHEN prior >= 3 AND (lost_share >= 0.4 OR (mom <= -0.3 AND pj <= p25)) THEN 'bleeding' WHEN in_degree >= 3 AND new_share >= 0.4 AND mom > 0.1 THEN 'expanding'
 WHEN pj >= p50 AND abs(mom) < 0.35 THEN 'steady' ELSE 'variable' END AS dynamics_role FROM dm JOIN dq USING (t)""",
)
def r05(spark: SparkSession, d: str) -> DataFrame:
    return dynamics(edges_once(spark, d))


def dynamics_metrics(e: DataFrame) -> DataFrame:
    """A row a month and node with what dynamics roles are told from."""
    x = tm.with_t(eg.incidence(e).groupBy("time_key", "node").agg((F.sum("cents") / F.lit(100.0)).alias("strength"), F.count_if(F.col("dir") == "in").alias("in_degree")))
    w = Window.partitionBy("node").orderBy("t")
    before = F.lag("t").over(w) == F.col("t") - 1
    mom = F.when(before, F.log((F.col("strength") + 1) / (F.lag("strength").over(w) + 1)))
    x = x.select("time_key", "t", "node", "strength", "in_degree", (F.col("t") - F.min("t").over(w)).alias("months_since_first_seen"), (F.col("t") - F.lag("t").over(w)).alias("activity_gap"), mom.alias("strength_mom"), F.when(before, F.lag("in_degree").over(w)).alias("prior_in_degree"))
    new = tm.cohorts(e).filter("dir = 'in'").select("time_key", "node", "new_amount_share")
    lost = tm.side_turnover(e).filter("dir = 'in'").select("t", "node", "lost_amount_share", F.col("jaccard").alias("payer_jaccard"))
    return x.join(new, ["time_key", "node"], "left").join(lost, ["t", "node"], "left")


def dynamics(e: DataFrame) -> DataFrame:
    """(time_key, node, dynamics_role) of an edge relation."""
    return pn.dynamics_roles(dynamics_metrics(e), ["t"]).select("time_key", "node", "dynamics_role")


def by_month(e: DataFrame) -> DataFrame:
    """Links (src, dst, w) whose ends carry their month, so that one run of an iterative algorithm treats every month as a graph of its own; w is log1p of dollars."""
    end = lambda c: F.concat_ws("|", "time_key", c)
    return it.window_links(e.select(end("source").alias("source"), end("dest").alias("dest"), "cents"), log=True)


def of_month(df: DataFrame) -> DataFrame:
    """Nodes of ``by_month`` as time_key and node again."""
    return df.withColumns({"time_key": F.substring_index("node", "|", 1), "node": F.expr("substring(node, instr(node, '|') + 1)")})


def month_levels(e: DataFrame) -> DataFrame:
    """(time_key, node, level) of each month of an edge relation, which is read three times: months of up to ``it.GROUP`` links are solved whole in a task each, larger ones together over blocks."""
    large = [r["time_key"] for r in e.groupBy("time_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > it.GROUP).collect()]
    in_large = F.col("time_key").isin(large)
    small = e.filter(~in_large).select("time_key", F.col("source").alias("src"), F.col("dest").alias("dst"), F.round(F.log1p(F.col("cents") / F.lit(100.0)), 9).alias("w")).filter("w > 0")
    levels = it.levels_of_groups(small, "time_key")
    if not large:
        return levels
    return levels.unionByName(of_month(it.trophic_levels(by_month(e.filter(in_large)), tol=SURE)).select("time_key", "node", "level"))


@query("r02_hierarchy_roles")
def r02(spark: SparkSession, d: str) -> DataFrame:
    """Terciles of the trophic level of each month."""
    e = cut(edges(spark, d).select("time_key", "source", "dest", "cents"), "edges")
    levels = cut(month_levels(e).withColumnRenamed("level", "trophic_level"), "levels")
    return pn.hierarchy_roles(levels, ["time_key"]).select("time_key", "node", "trophic_level", "hierarchy_role")


@query("r04_embeddedness_roles")
def r04(spark: SparkSession, d: str) -> DataFrame:
    """From each month's core numbers, and participation and share within the group of the partition by state."""
    e, p = edges_once(spark, d), partition(spark, d)
    cores = of_month(it.core_numbers(by_month(e)))
    m = flow.degrees(e).select("time_key", "node", "degree").join(cores, ["time_key", "node"], "left")
    m = m.join(flow.participation(e, p).select("time_key", "node", "participation_coef"), ["time_key", "node"], "left").join(flow.intra_fractions(e, p).select("time_key", "node", "frac_intra_amount"), ["time_key", "node"], "left")
    return pn.embeddedness_roles(m, ["time_key"]).select("time_key", "node", "core", "embeddedness_role")


@query(
    "m15_concentration_of_rhythm",
    T + ", p AS (SELECT source, dest, count(*) AS k, CAST(sum(cents) AS BIGINT) AS c FROM et GROUP BY ALL) SELECT CASE WHEN k = 1 THEN 'once' WHEN k < 6 THEN 'some' ELSE 'most' END AS presence, count(*) AS n_pairs, CAST(sum(c) AS BIGINT) AS cents, round(sum(c) / CAST((SELECT sum(c) FROM p) AS DOUBLE), 6) AS amount_share FROM p GROUP BY 1",
)
def m15(spark: SparkSession, d: str) -> DataFrame:
    p = edges(spark, d).groupBy("source", "dest").agg(F.count(F.lit(1)).alias("k"), F.sum("cents").alias("c"))
    g = p.groupBy(F.when(F.col("k") == 1, "once").when(F.col("k") < 6, "some").otherwise("most").alias("presence")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("c").alias("cents"))
    return g.withColumn("amount_share", F.round(F.col("cents") / p.agg(F.sum("c")).scalar(), 6))


@query("m15_recurring_by_sector", EP + f", p AS (SELECT source, dest, count(*) AS k, sum(cents) AS c FROM e GROUP BY ALL) SELECT coalesce(naics2, 'NA') AS sector, {rsql('coalesce(sum(c) FILTER (k >= 6), 0)', 'sum(c)')} AS recurring_share FROM p LEFT JOIN party ON node = dest GROUP BY 1")
def m15s(spark: SparkSession, d: str) -> DataFrame:
    p = edges(spark, d).groupBy("source", F.col("dest").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.sum("cents").alias("c")).join(sectors(spark, d), "node", "left")
    return p.groupBy(F.coalesce("sector", F.lit("NA")).alias("sector")).agg(eg.ratio(F.sum(F.when(F.col("k") >= 6, F.col("c")).otherwise(0)), F.sum("c")).alias("recurring_share"))


@query(
    "k54_own_bank_share",
    EP + f"SELECT time_key, inc.node, {rsql('coalesce(sum(cents) FILTER (p.node IS NOT NULL), 0)', 'sum(cents)')} AS on_us_ratio, CAST(coalesce(sum(cents) FILTER (p.node IS NULL), 0) AS BIGINT) AS off_us_cents FROM inc LEFT JOIN party p ON p.node = inc.cp WHERE dir = 'out' GROUP BY time_key, inc.node",
)
def k54(spark: SparkSession, d: str) -> DataFrame:
    """Share of outflow to known parties, and the flow to others, that could be captured."""
    inc = eg.incidence(edges(spark, d)).filter("dir = 'out'").join(parties(spark, d).select(F.col("node").alias("cp"), F.lit(True).alias("known")), "cp", "left")
    return inc.groupBy("time_key", "node").agg(eg.ratio(F.sum(F.when(F.col("known"), F.col("cents")).otherwise(0)), F.sum("cents")).alias("on_us_ratio"), F.sum(F.when(F.col("known").isNull(), F.col("cents")).otherwise(0)).alias("off_us_cents"))


_GROWTH = (
    SPREAD_ROWS
    + ", mm AS (SELECT time_key, dense_rank() OVER (ORDER BY time_key) AS t FROM (SELECT DISTINCT time_key FROM spread)), sm AS (SELECT node, t, spread_km AS x FROM spread JOIN mm USING (time_key) WHERE spread_km IS NOT NULL)"
    + _MK[len(ST) :].replace("n >= 4", "n >= 6")
    + ", r AS (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS tot FROM mk), cc AS (SELECT max(p) AS c FROM r WHERE p <= r * 0.1 / tot), ts AS (SELECT a.node, round(quantile_cont((b.x - a.x) / CAST(b.t - a.t AS DOUBLE), 0.5), 4) AS slope FROM sm a JOIN sm b ON b.node = a.node AND a.t < b.t GROUP BY a.node), gq AS (SELECT mk.*, coalesce(p <= c, false) AS passes, slope FROM mk JOIN ts USING (node), cc) "
)


def spread_trends(spark: SparkSession, d: str) -> DataFrame:
    """(node, n, s, z, p, passes, slope) of the months' spreads: trend test, discoveries held to 10 %, median slope."""
    from flowquarry.functions import stats

    s = cut(tm.with_t(gb.spread(edges(spark, d), points(spark, d))).filter("spread_km is not null").select("node", "t", F.col("spread_km").alias("x")), "spread")
    test = cut(stats.mann_kendall(s, "node", "t", "x", least=6), "tests")
    return stats.benjamini_hochberg(test, "p", 0.1).join(stats.theil_sen(s, "node", "t", "x"), "node")


@query("k29_expansion_queue", _GROWTH + "SELECT * FROM gq WHERE slope > 0 ORDER BY passes DESC, slope DESC, node LIMIT 30")
def k29(spark: SparkSession, d: str) -> DataFrame:
    """The 30 nodes whose spread grows most (a report), those that pass the test first."""
    return spread_trends(spark, d).filter("slope > 0").orderBy(F.desc("passes"), F.desc("slope"), "node").limit(30)


@query("k29_contraction_queue", _GROWTH + "SELECT * FROM gq WHERE slope < 0 ORDER BY passes DESC, slope, node LIMIT 30")
def k29c(spark: SparkSession, d: str) -> DataFrame:
    """The 30 nodes whose spread shrinks most (a report)."""
    return spread_trends(spark, d).filter("slope < 0").orderBy(F.desc("passes"), "slope", "node").limit(30)


_KINDS = ("business", "individual", "unknown")
_INV = (
    EP
    + ", kk AS (SELECT unnest(['business', 'individual', 'unknown']) AS k), ff AS (SELECT a.entity AS s, b.entity AS t, sum(cents) AS c FROM e JOIN party a ON a.node = e.source JOIN party b ON b.node = e.dest GROUP BY ALL), tt AS (SELECT s, sum(c) AS c FROM ff GROUP BY s), "
    + "q AS (SELECT "
    + ", ".join(f"{1 if i == j else 0} - coalesce((SELECT 0.5 * CAST(ff.c AS DOUBLE) / tt.c FROM ff JOIN tt USING (s) WHERE s = '{x}' AND t = '{y}' AND tt.c > 0), 0) AS a{i}{j}" for i, x in enumerate(_KINDS) for j, y in enumerate(_KINDS))
    + "), dd AS (SELECT *, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20) AS det FROM q) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS kind, "
        + ", ".join(f"round(({'' if (i + j) % 2 == 0 else '-'}(a{r[0]}{c[0]} * a{r[1]}{c[1]} - a{r[0]}{c[1]} * a{r[1]}{c[0]})) / det, 6) AS {y}" for j, y in enumerate(_KINDS) for r, c in [([k for k in range(3) if k != j], [k for k in range(3) if k != i])])
        + " FROM dd"
        for i, x in enumerate(_KINDS)
    )
)


@query("c28_multiplier", _INV)
def c28(spark: SparkSession, d: str) -> DataFrame:
    """Local multiplier between kinds of party: inverse of I - Q, Q being half of each kind's outflow shares. The matrix has a row a kind."""
    from flowquarry.operators import graph as gr

    kinds = ["business", "individual", "unknown"]
    m = {r["source"]: [float(r[k]) for k in kinds] for r in gr.flow_matrix(edges(spark, d), parties(spark, d).select("node", F.col("entity").alias("grp")), kinds).collect()}
    rows = [m.get(k, [0.0] * 3) for k in kinds]
    q = [[0.5 * x / sum(r) if sum(r) else 0.0 for x in r] for r in rows]
    inv = sd.multiplier(q)
    return spark.createDataFrame([(k, *[round(x, 6) for x in r]) for k, r in zip(kinds, inv, strict=True)], "kind string, business double, individual double, unknown double")
